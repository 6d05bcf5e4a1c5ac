"""Column helpers (JVM-side expressions)."""
from .columns import (  # noqa: F401
    ceil_minutes, digits_only, hhmm, idiv, plus_seconds, time_text, whole_seconds, is_distinct, normalize_io, over,
    round_minutes, sanitize_name, sanitize_value, second_of_work_day, swipe_timestamp,
    under, web_capped, work_date,
)
