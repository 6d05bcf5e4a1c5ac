"""Personal data: keyed surrogates (op 9).

Detected entities are replaced by surrogates of the same type and format:
digits are permuted under a key (a Feistel network over all digits of a number,
so different numbers of one length get different ones), card numbers that pass
the Luhn check still pass it, IPv4 addresses stay addresses, letters of e-mail
addresses become letters of the same case, IBANs get new check digits, and titled names become names of the
same gender and script.  One original has one surrogate in the whole corpus,
however it is punctuated, so references to one person still agree.

Collisions are checked over the corpus: distinct originals are gathered (one row
each), and where two of one type share a surrogate, or one keeps its own, all
but the first get the next try of the key, until none collide.  Names and e-mail
addresses grow with the try, so there is room for any number of them; only a
format of fixed width whose values are nearly all in use is an error.  A first
try needs no table: documents compute it.  Only later tries are joined to the
documents that hold them.

Defined results: null and empty texts stay as they are; a document without
entities stays byte for byte; repeated rows get the same surrogates; an empty
table gives an empty result; other columns pass through, clashing helper names
get underscores.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, col, fresh, split_by_bitmap, stage, table, text_of

by_value(__name__)

KEY = b"replace this key"
TRIES = 20                       # rounds without fewer collisions before a fixed format counts as full

# --- fixed values -----------------------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# national digits of a phone number: North American 3-3-4, then by prefix and digit count
NANP = r"(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
SEP = r"[ ./()-]{0,2}"
ABROAD = (rf"(?:\+|00)(?:1(?:{SEP}\d){{10}}|3[34](?: ?\(0\))?(?:{SEP}\d){{9}}|44(?: ?\(0\))?(?:{SEP}\d){{9,10}}"
          rf"|(?!1|3[34]|44)[1-9]\d(?: ?\(0\))?(?:{SEP}\d){{6,13}})")
NATIONAL = (r"(?!\d\d[./-]\d\d[./-](?:19|20)\d\d(?!\d))0[1-9](?:[ ./-]?\d){7,9}"
            r"|[6-9]\d\d (?:\d{3} \d{3}|\d\d \d\d \d\d)(?! ?\d)")
COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
KINDS = {
    "email": r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": rf"(?<![\w+])(?:(?:\+\d{{1,3}}[ .-]?)?{NANP}|{ABROAD}|(?<![\d.,:/-])(?<!\d ){NATIONAL})(?!\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w|[.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
            r"::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)",
}
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа"],
          "n": ["Dr", "Prof", "Professor", "Doktor", "Доктор", "Профессор", "доктор", "профессор"]}
PARTICLES = "van von vom zu zur der den de del della di da dos du la le ter ten af av al el bin ibn".split()
GIVEN = {("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Paul"],
         ("f", "latin"): ["Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Hanna", "Julia", "Laura", "Maria", "Olivia", "Petra"],
         ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим", "Олег", "Павел"],
         ("n", "latin"): ["Alex", "Andrea", "Charlie", "Dominique", "Jordan", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yuki"],
         ("n", "cyrillic"): ["Валя", "Женя", "Саша", "Слава", "Шура", "Паша", "Тоша", "Лёша", "Веня", "Мика"],
         ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Мария", "Нина", "Ольга"]}
SYLLABLES = {"latin": "ba be bi bo da de di do ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te va ve".split(),
             "cyrillic": "ба бе во ва ге да де ди ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те".split()}
# ----------------------------------------------------------------------------
TITLE = {t: g for g, ts in TITLES.items() for t in ts}
# a name's word keeps the apostrophe of its first letter (O'Brien), not that of a possessive
WORD = r"(?:[ODL]['’](?=[^\W\d_]))?[^\W\d_]+"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) |[dl]['’])"
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
# longest titles first; two capitalised titles may stand together (Prof. Dr. ...)
TITLED = "|".join(map(re.escape, sorted(TITLE, key=len, reverse=True)))
NAMES = re.compile(rf"(?<!\w)(?P<title>{TITLED})(?P<dot>\.? )(?:(?:{TITLED})\.? )*"
                   rf"(?P<one>{PARTICLE}*{WORD}(?:-{WORD})*)(?: (?P<two>{PARTICLE}*{WORD}(?:-{WORD})*))?")
WORDS = re.compile(WORD)
HINT = re.compile(r"[\d@]")


def _stream(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, label: str, value: int, size: int, trial: int) -> int:
    """A keyed permutation of range(size): Feistel rounds on two halves, walked
    on until the value lies in the range again."""
    if size < 2:
        return 0
    half = -(-(size - 1).bit_length() // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            a, b = b, a ^ (_stream(key, label, size, trial, r, b) & mask)
        value = a << half | b
        if value < size:
            return value


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def canonical(kind: str, text: str) -> str:
    """What names the entity: the same for all ways to write it."""
    if kind == "phone":
        text = re.sub(r"^00", "+", text.replace("(0)", ""))
        return re.sub(r"[^\d+]", "", text)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    return text.lower() if kind == "email" else text


def checked_iban(country: str, body: str) -> str:
    """With the two check digits that make the number 1 modulo 97."""
    value = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(value) % 97:02d}{body}"


def genuine(kind: str, text: str) -> bool:
    """Whether a match of the format is one: formats that only a check tells apart."""
    if kind == "iban":
        name = canonical(kind, text)
        return 15 <= len(name) <= 34 and checked_iban(name[:2], name[4:]) == name
    if kind == "ipv6":
        try:
            return bool(re.search(r"\d", text)) and len(text) > 3 and bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    return True


def surrogate(key: bytes, kind: str, name: str, trial: int = 0) -> str:
    """The canonical surrogate of a canonical original."""
    if kind in ("phone", "ssn"):
        country = COUNTRY.match(name)
        keep = country.end() if country else 0       # the country code stays
        if kind == "phone" and re.match("0[1-9]", name):    # so does the trunk prefix, and what follows is no zero
            low = 10 ** (len(name) - 2)
            return "0" + str(low + permute(key, "trunk", int(name) - low, 9 * low, trial))
        rest = name[keep:]
        return name[:keep] + str(permute(key, kind, int(rest), 10 ** len(rest), trial)).zfill(len(rest))
    if kind == "card":
        if luhn(name):
            body = str(permute(key, "luhn", int(name[:-1]), 10 ** (len(name) - 1), trial)).zfill(len(name) - 1)
            return next(body + c for c in "0123456789" if luhn(body + c))
        value = name
        while True:                                  # numbers that fail the check stay among those that do
            value = str(permute(key, kind, int(value), 10 ** len(name), trial)).zfill(len(name))
            if not luhn(value):
                return value
    if kind == "ip":
        octets = [int(x) for x in name.split(".")]
        value = permute(key, kind, int.from_bytes(bytes(octets), "big"), 1 << 32, trial)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "iban":
        return checked_iban(name[:2], _letters(key, "iban" + name[:2], name[4:].lower(), trial).upper())
    if kind == "ipv6":
        value = permute(key, kind, int(ipaddress.IPv6Address(name)), 1 << 128, trial)
        return ipaddress.IPv6Address(value).exploded
    if kind == "email":
        local, _, domain = name.partition("@")
        host, _, top = domain.rpartition(".")
        more = _syllables(_stream(key, kind, name, trial), "latin", trial // 4).lower()    # short addresses get room
        return f"{_letters(key, 'local@' + domain, local, trial)}{more}@{_letters(key, 'host', host, trial)}.{top}"
    _, gender, script = kind.split(":")              # name:given or family: gender: script
    roll = _stream(key, kind, name, trial)
    if gender:
        pool = [n for n in GIVEN[gender, script] if n.casefold() != name]     # never the name itself, nor a longer form of it
        if trial < 2:
            return pool[roll % len(pool)]
        roll, stem = divmod(roll, len(pool))         # past the pool: a second part, longer with each try, keeps names apart
        return pool[stem] + "-" + _syllables(roll, script, trial)
    return _syllables(roll, script, 3 + trial // 4)


def _syllables(roll: int, script: str, n: int) -> str:
    out = ""
    for _ in range(n):
        roll, i = divmod(roll, len(SYLLABLES[script]))
        out += SYLLABLES[script][i]
    return out.capitalize()


def _letters(key: bytes, label: str, text: str, trial: int) -> str:
    """Letters and digits permuted as one number of mixed base; others stay."""
    bases = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
    size = value = 0
    for c, b in zip(text, bases):
        size = size * b + b - 1                      # ends as the largest number
        code = _stream(b"", c) if b > 1 and not c.isascii() else ord(c) - (97 if b == 26 else 48)
        value = value * b + (code % b if b > 1 else 0)
    odd = [c for c, b in zip(text, bases) if b > 1 and not c.isascii()]
    value = permute(key, label + "".join(odd), value, size + 1, trial)
    out = []
    for c, b in zip(reversed(text), reversed(bases)):
        value, code = divmod(value, b)
        out.append(c if b == 1 else chr(97 + code) if b == 26 else chr(48 + code))
    return "".join(reversed(out))


def shaped(kind: str, original: str, new: str) -> str:
    """A canonical surrogate in the format of the original."""
    if kind == "phone":
        digits = iter(new.lstrip("+"))
        return re.sub(r"^00|\(0\)|\d", lambda m: m[0] if len(m[0]) > 1 else next(digits), original)
    if kind in ("card", "ssn"):
        digits = iter(new)
        return re.sub(r"\d", lambda _: next(digits), original)
    if kind == "ip":
        return new
    if kind == "iban":
        letters = iter(new)
        return re.sub(r"\w", lambda _: next(letters), original)
    if kind == "ipv6":
        full = re.fullmatch("(?:[0-9A-Fa-f]{4}:){7}[0-9A-Fa-f]{4}", original)
        new = new if full else str(ipaddress.IPv6Address(new))
        return new.upper() if original != original.lower() else new
    if original.isupper():
        return new.upper()
    if kind == "email" and original != original.lower():
        local, at, domain = original.partition("@")
        grown = len(new) - len(original)
        original = local + " " * grown + at + domain
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new))
    return new


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def name_words(m: re.Match, part: str) -> list[tuple[int, int, str]]:
    """The words of one part of a name, without particles; none unless capitalised."""
    if m[part] is None:
        return []
    words = [(m.start(part) + w.start(), m.start(part) + w.end(), w[0]) for w in WORDS.finditer(m[part])]
    words = [w for w in words if w[2] not in PARTICLES and w[2] not in ("d", "l")]
    return [w for w in words if w[2][0].isupper()] if words and words[0][2][0].isupper() else []


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of each entity; name parts one by one, also
    where a name found after a title stands again without it."""
    found = []
    if HINT.search(text):
        found = [(m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])) for m in PATTERN.finditer(text)
                 if genuine(m.lastgroup, m[0])]
    kinds = {}
    for m in NAMES.finditer(text):
        one, two = (name_words(m, part) for part in ("one", "two"))
        for role, words in (("given" if one and two else "family", one), ("family", two if one else [])):
            for a, b, word in words:
                kind = f"{role}:{TITLE[m['title']] if role == 'given' else ''}:{_script(word)}"
                found.append((a, b, kind, word.casefold()))
                if word not in TITLE:
                    kinds.setdefault(word.casefold(), kind)
    found.sort()
    if not kinds:
        return found
    more, i, end = [], 0, 0
    for m in WORDS.finditer(text):
        kind = kinds.get(m[0].casefold()) if m[0][0].isupper() else None
        if kind is None:
            continue
        while i < len(found) and found[i][0] < m.end():
            end = max(end, found[i][1])
            i += 1
        if end <= m.start():
            more.append((m.start(), m.end(), kind, m[0].casefold()))
    return sorted(found + more)


def replaced(key: bytes, text: str, tries: dict) -> tuple[str, int]:
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, name in found:
        if a < at:
            continue
        new = surrogate(key, kind, name, tries.get((kind, name), 0))
        out += [text[at:a], shaped(kind, text[a:b], new)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {(k, kind, name) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for _, _, kind, name in entities(t)}
        k, kind, name = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(kind, pa.string()), pa.array(name, pa.string())],
                                         names=["k", "kind", "name"])


def _assign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x) for x in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "name", "trial", "new"])
    return run


def _replace(key: bytes, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tries = b.column(b.num_columns - 1).to_pylist()
            done = [(t, 0) if not t else replaced(key, t, {(x["kind"], x["name"]): x["trial"] for x in o or ()})
                    for t, o in zip(b.column(at).to_pylist(), tries)]
            cols = list(b.columns[:-1])
            cols[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in done], pa.int64())], names=names)
    return run


def later_tries(found: DataFrame, key: bytes) -> DataFrame | None:
    """Originals whose first surrogate collides -> (kind, name, trial); None if
    there are none.  Each round settles all but the first of a shared surrogate."""
    schema = "kind string, name string, trial int, new string"
    now = found.select("kind", "name").distinct().withColumn("trial", F.lit(0)).mapInArrow(_assign(key), schema)
    now = stage(now, "surrogates")
    least, idle = None, 0
    while True:
        first = now.groupBy("kind", "new").agg(F.min(F.struct("trial", "name")).alias("one"), F.count("*").alias("c"))
        clash = (now.join(first.where("c > 1"), ["kind", "new"])
                 .where((F.col("one.name") != F.col("name"))).select("kind", "name", "trial"))
        own = now.where(F.lower("new") == F.lower("name")).select("kind", "name", "trial")
        again = stage(clash.union(own).distinct(), "surrogate-clashes")
        left = again.count()
        if not left:
            late = now.where("trial > 0").select("kind", "name", "trial")
            return None if late.isEmpty() else late
        least, idle = (left, 0) if least is None or left < least else (least, idle + 1)
        if idle == TRIES:
            raise RuntimeError("surrogates still collide: a format of fixed width has no room left")
        keep = now.join(again.select("kind", "name"), ["kind", "name"], "left_anti")
        new = again.withColumn("trial", F.col("trial") + 1).mapInArrow(_assign(key), schema)
        now = stage(keep.unionByName(new), "surrogates")


def pseudonymised(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> tuple[DataFrame, str]:
    """``docs`` with surrogates in the text, and the name of one more column:
    entities replaced."""
    (k, late_col, count) = fresh(docs, "text_key", "late_tries", "n_entities")
    keyed = docs.withColumn(k, F.xxhash64(text_of(col(docs, text_col))))
    found = stage(keyed.select(F.col(k).alias("k"), text_of(col(keyed, text_col)).alias("t"))
                  .mapInArrow(_detect, "k long, kind string, name string"), "entities")
    late = later_tries(found, key)
    kind = "array<struct<kind:string,name:string,trial:int>>"
    if late is None:
        ready = keyed.withColumn(late_col, F.lit(None).cast(kind))
    else:
        of = stage(found.distinct().join(late, ["kind", "name"]).groupBy("k").agg(
            F.collect_list(F.struct("kind", "name", "trial")).alias(late_col)), "late-tries")
        named, rest = split_by_bitmap(keyed, k, of.select("k"))
        ready = named.join(of.withColumnRenamed("k", k), k, "left").select(*[col(keyed, c) for c in keyed.columns], late_col) \
            .unionByName(rest.withColumn(late_col, F.lit(None).cast(kind)))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = ready.drop(k).toDF(*names, "late")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    out = plain.mapInArrow(_replace(key, docs.columns.index(text_col), [*names, "n"]), f"{schema}, n long")
    return out.toDF(*docs.columns, count), count


def op9_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = pseudonymised(table(spark, sf_dir, "documents"))
    return out
