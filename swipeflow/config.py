"""Business rules of the attendance model, gathered in one place.

Every number and pattern the gold computation uses lives here, so a
deployment can change an HR rule without touching a query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: these must equal the attendance rules being rebuilt ---
# work day starts at 05:00; earlier swipes belong to the previous day
DAY_CUTOFF_HOUR = 5
# productive standard: 8 hours inside
PRODUCTIVE_SECONDS = 28800
# overall standard: 9 hours span
OVERALL_SECONDS = 32400
# web sign-in days are capped at 9 hours
WEB_CAP_SECONDS = 32400
# first swipe type matching this LIKE pattern means a web sign-in day
WEB_PATTERN = "%Web%"
WEB_LABEL = "Web Sign-In"
OFFICE_LABEL = "Office Sign-In"
COMPLETE_LABEL = "Complete swipe"
INCOMPLETE_LABEL = "Incomplete swipe"
# only swipes with this status count
APPROVED_STATUS = "Approved"
# raw In/Out values accepted (case-sensitive, before trimming)
ACCEPTED_IO = ("In", "Out", "IN", "OUT")
# --- end of fixed values ---


@dataclass(frozen=True)
class AttendanceConfig:
    """Rules for turning swipes into work days.

    ``salt_seconds`` is not a business rule: it is the width of the time
    slices a single (employee, work day) is cut into for the ordered
    part of the computation, so that one very busy badge never lands in
    a single task.  A work day spans 86,400 s, so there are at most
    ``86400 / salt_seconds + 1`` slices per day, which also bounds the
    per-day summary window.
    """

    cutoff_hour: int = DAY_CUTOFF_HOUR
    productive_seconds: int = PRODUCTIVE_SECONDS
    overall_seconds: int = OVERALL_SECONDS
    web_cap_seconds: int = WEB_CAP_SECONDS
    web_pattern: str = WEB_PATTERN
    approved_status: str = APPROVED_STATUS
    accepted_io: tuple = field(default=ACCEPTED_IO)
    # trim/upper In_Out before the accepted-value test (trap: the
    # reference rule tests the raw value, so ' In ' is dropped)
    normalize_io_first: bool = False
    salt_seconds: int = 900


DEFAULT = AttendanceConfig()
