"""The scalar functions and comparisons of the query surface, each a plain Spark expression.

Text compares by upper-cased characters, one for one: fold() gives the key. Null propagates unless stated. A fault
that depends on data raises an error that starts with FAULT and its code when the row is met.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULT = "fault:"
#: Characters that keep their form in comparisons though Unicode has a single capital for them.
UNFOLDED = "ıſ"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def fold(x) -> Column:
    """The key by which text is compared, grouped, joined and ordered."""
    c = col(x)
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    one = F.transform(chars, lambda ch: F.when((F.char_length(F.upper(ch)) == 1) & ~ch.isin(list(UNFOLDED)), F.upper(ch)).otherwise(ch))
    return F.when(F.octet_length(c) == F.char_length(c), F.upper(c)).otherwise(F.array_join(one, ""))


def equal(a, b) -> Column:
    return fold(text(a)) == fold(text(b))


def compare(a, op: str, b) -> Column:
    """a op b for text by fold keys; op is =, <>, <, <=, > or >=."""
    x, y = fold(text(a)), fold(text(b))
    table = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
    if op not in table:
        raise ValueError(f"ComparisonUnsupported: {op}")
    return table[op]


def within(x, values: Iterable) -> Column:
    """x IN (values): unknown if x is null, or if nothing matches and a value is null."""
    return fold(text(x)).isin([fold(F.lit(v)) if v is not None else F.lit(None).cast("string") for v in values])


def like_regex(pattern: str) -> str:
    """The regular expression of a pattern with %, _, [set] and [^set]; an unclosed bracket stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif end > i + 1:
            body = pattern[i + 1 : end]
            out.append(("[^" if body[0] == "^" else "[") + re.sub(r"([\\\[\]&~^])", r"\\\1", body[1:] if body[0] == "^" else body) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return "(?isud)^" + "".join(out) + "$"


def like(x, pattern) -> Column:
    """x LIKE pattern, which is a text or an expression; unknown if either is null."""
    if not isinstance(pattern, Column):
        return col(x).rlike(like_regex(pattern))
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[[^\]]+\]|.)"), F.lit(1))
    body = lambda p: F.regexp_replace(F.regexp_replace(F.substring(p, 2, 1 << 30), r"\]$", ""), r"([\\\[\]&~^])", r"\\$1")
    no = lambda p: F.substring(p, 2, 1) == "^"
    chosen = lambda p: F.when(no(p), F.concat(F.lit("[^"), F.regexp_replace(body(p), r"^\\\^", ""), F.lit("]"))).otherwise(F.concat(F.lit("["), body(p), F.lit("]")))
    one = lambda p: F.when(p == "%", ".*").when(p == "_", ".").when(F.char_length(p) > 1, chosen(p)).otherwise(F.regexp_replace(p, r"([^\w\s])", r"\\$1"))
    return F.rlike(col(x), F.concat(F.lit("(?isud)^"), F.array_join(F.transform(pieces, one), ""), F.lit("$")))


def concat(*parts) -> Column:
    """All parts as text one after the other; null counts as ''."""
    if len(parts) < 2:
        raise ValueError("FunctionArityInvalid: CONCAT")
    return F.concat(*[F.coalesce(text(p).cast("string"), F.lit("")) for p in parts])


def lower(x) -> Column:
    return F.lower(col(x))


def upper(x) -> Column:
    return F.upper(col(x))


def trim(x, side: str = "both") -> Column:
    """Without U+0020 at the ends; other white space stays."""
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](col(x))


def length(x) -> Column:
    """UTF-16 units without spaces at the end."""
    c = F.rtrim(col(x))
    units = F.when(F.octet_length(c) == F.char_length(c), F.char_length(c)).otherwise(F.octet_length(F.encode(c, "UTF-16BE")) / 2)
    return units.cast("long")


def is_blank(x) -> Column:
    """1 for null, '' and nothing but Unicode white space, else 0."""
    c = col(x)
    return F.when(c.isNull() | c.rlike(r"^[\p{Z}\s\x85]*$"), 1).otherwise(0).cast("long")


def replace(x, old, new) -> Column:
    """Every occurrence of old in any case; '' as old changes nothing. old and new are texts or expressions; null gives null."""
    c, a, b = col(x), text(old), text(new)
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(a, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.regexp_replace(b, r"([\\$])", r"\\$1")
    return F.when(a == "", F.when(b.isNotNull(), c)).otherwise(F.regexp_replace(c, quoted, plain))


def _guard(bad: Column, code: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(FAULT + code)).cast("string")).otherwise(value)


#: Characters that UTF-16 writes as two units, in which lengths and places count.
_PAIRS = r"[\x{10000}-\x{10FFFF}]"


def _units(c: Column) -> Column:
    """The UTF-16 units of a text as cells: a character, or one followed by 1 or 2 for either half of a pair."""
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.flatten(F.transform(chars, lambda ch: F.when(ch.rlike(_PAIRS), F.array(F.concat(ch, F.lit("1")), F.concat(ch, F.lit("2")))).otherwise(F.array(ch))))


def _cut(c: Column, start: Column, count: Column) -> Column:
    """count units from start, both within bounds; half a pair that is left becomes U+FFFD."""
    cells = F.slice(_units(c), F.greatest(start, F.lit(1)), F.greatest(count, F.lit(0)))
    half = F.lit("\ufffd")
    one = lambda x, i: F.when(F.char_length(x) == 1, x).when(F.right(x, F.lit(1)) == "1", F.when(i == F.size(cells) - 1, half).otherwise(F.left(x, F.lit(1)))).otherwise(F.when(i == 0, half).otherwise(F.lit("")))
    return F.array_join(F.transform(cells, one), "")


def substring(x, start, count) -> Column:
    """count UTF-16 units from the 1-based start; places before the first use up the count; a negative count faults."""
    c, s, n = col(x), text(start).cast("int"), text(count).cast("int")
    left = F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.lit(1) - s))
    plain = F.substring(c, F.greatest(s, F.lit(1)), left)
    return _guard(n < 0, "SubstringLengthInvalid", F.when(c.rlike(_PAIRS), _cut(c, s, left)).otherwise(plain))


def left(x, n) -> Column:
    """The first n UTF-16 units."""
    c, k = col(x), text(n).cast("int")
    return _guard(k < 0, "LeftLengthInvalid", F.when(c.rlike(_PAIRS), _cut(c, F.lit(1), k)).otherwise(F.left(c, k)))


def right(x, n) -> Column:
    """The last n UTF-16 units."""
    c, k = col(x), text(n).cast("int")
    size = F.size(_units(c))
    return _guard(k < 0, "RightLengthInvalid", F.when(c.rlike(_PAIRS), _cut(c, size - F.least(k, size) + 1, k)).otherwise(F.right(c, k)))


def coalesce(*xs) -> Column:
    if len(xs) < 2:
        raise ValueError("FunctionArityInvalid: COALESCE")
    return F.coalesce(*map(text, xs))


def nullif(a, b) -> Column:
    x = text(a)
    return F.when(equal(x, b), F.lit(None)).otherwise(x)


def iif(test: Column, a, b) -> Column:
    """a where the test holds, b where it doesn't or is unknown."""
    return F.when(test, text(a)).otherwise(text(b))


def case(branches: list[tuple[Column, object]], otherwise=None) -> Column:
    out = F
    for test, value in branches:
        out = out.when(test, text(value))
    return out.otherwise(text(otherwise))


def to_int(x) -> Column:
    """TRY_CONVERT(int, x): a 32-bit integer, with white space around it and a sign allowed; else null."""
    return col(x).cast("string").try_cast("int").cast("long")
