"""String functions with MySQL meaning, as compositions of built-in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substring(s: Column, pos: int | Column, length: int | Column | None = None) -> Column:
    """1-based, negative from the end; position 0 and lengths below 1 give the empty string."""
    p, n = _c(pos), F.char_length(s)
    start = F.when(p < 0, n + p + 1).otherwise(p)
    out = F.substr(s, start) if length is None else F.substr(s, start, F.greatest(_c(length), F.lit(0)))
    return F.when(s.isNull() | p.isNull(), None).when((start < 1) | (start > n), F.lit("")).otherwise(out)


def left(s: Column, n: int | Column) -> Column:
    return F.left(s, F.greatest(_c(n), F.lit(0)))


def right(s: Column, n: int | Column) -> Column:
    return F.right(s, F.greatest(_c(n), F.lit(0)))


def pad(s: Column, n: int | Column, filler: str, on_left: bool) -> Column:
    """LPAD / RPAD: cut when shorter, empty for an empty filler that would be needed, NULL for a negative length."""
    n = _c(n)
    room = F.when(n < 0, None).when((F.lit(filler) == "") & (F.char_length(s) < n), F.lit(""))
    done = F.lpad(s, n, F.lit(filler)) if on_left else F.rpad(s, n, F.lit(filler))
    return F.when(n < 0, None).when((F.lit(filler) == "") & (F.char_length(s) < n), room).otherwise(done)


def trim_string(s: Column, what: str, side: str = "both") -> Column:
    """Remove a whole string from the ends again and again (TRIM(BOTH x FROM s)); SQL's trim takes a set."""
    if not what:
        return s
    quoted = r"\Q" + what.replace(r"\E", r"\E\\E\Q") + r"\E"
    if side in ("both", "leading"):
        s = F.regexp_replace(s, f"^(?:{quoted})+", "")
    if side in ("both", "trailing"):
        s = F.regexp_replace(s, f"(?:{quoted})+$", "")
    return s


def first_byte(s: Column) -> Column:
    """ASCII: the first byte, 0 for the empty string."""
    b = F.encode(s, "UTF-8")
    return F.when(s == "", F.lit(0)).otherwise(F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int"))


def ord_(s: Column) -> Column:
    """ORD: the bytes of the first character as one big-endian number."""
    return F.when(s == "", F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.encode(F.substring(s, 1, 1), "UTF-8")), 16, 10).cast("long"))


def char(*codes: Column | int) -> Column:
    """CHAR: numbers as bytes (more than one where needed), NULLs left out."""
    return F.unhex(F.concat_ws("", *(F.hex(_c(c).cast("long")) if not isinstance(c, int) else F.lit(f"{c:02X}" if c > 15 else f"0{c:X}") for c in codes)))


def insert(s: Column, pos: int, length: int, new: str) -> Column:
    """INSERT(s, pos, len, new): s itself when pos is out of range."""
    n = F.char_length(s)
    rest = F.lit("") if length < 0 else F.substr(s, F.lit(pos + length))
    keep = F.substr(s, F.lit(1), F.lit(max(pos - 1, 0)))
    return F.when((F.lit(pos) < 1) | (F.lit(pos) > n), s).otherwise(F.concat(keep, F.lit(new), rest))


def locate_ci(needle: str, s: Column, start: int = 1) -> Column:
    """LOCATE / POSITION, case-insensitive; 0 when absent or the start is below 1."""
    if start < 1:
        return F.when(s.isNotNull(), F.lit(0))
    return F.locate(needle.lower(), F.lower(s), start)


def instr_ci(s: Column, needle: str) -> Column:
    return F.when(s.isNull(), None).when(F.lit(needle) == "", F.lit(1)).otherwise(F.instr(F.lower(s), needle.lower()))


def substring_index(s: Column, delimiter: str, count: int) -> Column:
    return F.when(s.isNotNull(), F.lit("")) if not delimiter else F.substring_index(s, delimiter, count)


def strcmp_ci(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of the lower-cased strings without their trailing spaces."""
    x, y = F.rtrim(F.lower(a)), F.rtrim(F.lower(b))
    return F.when(x < y, F.lit(-1)).when(x == y, F.lit(0)).when(x > y, F.lit(1))


def field_ci(x: Column, *options: str) -> Column:
    """FIELD: the 1-based place of x among the options, case-insensitive; 0 if absent or NULL."""
    return F.coalesce(F.array_position(F.array(*(F.lit(o.lower()) for o in options)), F.lower(x)), F.lit(0)).cast("int")


def elt(n: Column, *options: str) -> Column:
    return F.when((n > 0) & (n <= len(options)), F.try_element_at(F.array(*map(F.lit, options)), n.cast("int")))


def make_set(bits: Column, *options: str) -> Column:
    """The options whose bit is set, joined by commas."""
    return F.when(bits.isNotNull(), F.concat_ws(",", *(F.when(F.shiftright(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, F.lit(o)) for i, o in enumerate(options))))


def export_set(bits: Column, on: str, off: str, separator: str = ",", number: int = 64) -> Column:
    """The lowest bits, least first, as on/off strings."""
    flags = [F.when(F.shiftright(bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, F.lit(on)).otherwise(F.lit(off)) for i in range(number)]
    return F.when(bits.isNotNull(), F.concat_ws(separator, *flags))


def octal(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 8)


def quote(s: Column) -> Column:
    """A literal of SQL; the text NULL for NULL."""
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\x1a", "\\Z")), s)
    return F.coalesce(F.concat(F.lit("'"), out, F.lit("'")), F.lit("NULL"))


def soundex(s: Column) -> Column:
    """SOUNDEX of any length, as MySQL has it: vowels and H, W, Y don't part equal codes."""
    letters = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    codes = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    kept = F.regexp_replace(F.replace(codes, F.lit("0"), F.lit("")), r"(\d)\1+", "$1")
    first = F.translate(F.substring(letters, 1, 1), "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    rest = F.when(kept.startswith(first), F.substr(kept, F.lit(2))).otherwise(kept)
    code = F.concat(F.substring(letters, 1, 1), rest)
    return F.when(s.isNull(), None).when(letters == "", F.lit("")).otherwise(F.rpad(code, F.greatest(F.lit(4), F.length(code)), F.lit("0")))


def format_number(x: Column, decimals: int) -> Column:
    return F.format_number(x, decimals)


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(n, F.lit(0)))


def to_base64(s: Column) -> Column:
    """Without line breaks."""
    return F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit(""))


def like(s: Column, pattern: str, escape: str = "\\") -> Column:
    """LIKE under the default collation: case-insensitive."""
    return s.ilike(pattern) if escape == "\\" else F.ilike(s, F.lit(pattern), F.lit(escape))


def regexp(s: Column, pattern: str) -> Column:
    """The REGEXP operator: case-insensitive."""
    return s.rlike(f"(?i){pattern}")


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(("(?i)" if "i" in flags else "") + pattern).cast("int")


def regexp_instr(s: Column, pattern: str) -> Column:
    """The 1-based place of the first match, 0 if there is none."""
    before = F.split(s, pattern, 2)
    return F.when(s.isNull(), None).when(s.rlike(pattern), F.char_length(before[0]) + 1).otherwise(F.lit(0))


# Character sets that hold a part of Unicode, and what lies outside of them.
OUTSIDE = {"ascii": r"[^\x00-\x7F]", "latin1": r"[^\x00-\xFF]", "utf8mb3": r"[\x{10000}-\x{10FFFF}]", "utf8": r"[\x{10000}-\x{10FFFF}]"}


def convert_using(s: Column, charset: str) -> Column:
    """CONVERT(s USING charset): characters that the character set lacks become ?; binary gives the bytes."""
    if charset == "binary":
        return s.cast("binary")
    if charset in OUTSIDE:
        return F.regexp_replace(s, OUTSIDE[charset], "?")
    if charset != "utf8mb4":
        raise ValueError(f"no character set {charset}")
    return s


def charset(x: Column) -> Column:
    """CHARSET(x): utf8mb4 of texts, else binary."""
    return F.when(F.typeof(x).startswith("string"), F.lit("utf8mb4")).otherwise(F.lit("binary"))


def collation(x: Column) -> Column:
    """COLLATION(x), by the nearest name of the dialect."""
    kind = F.typeof(x)
    return F.when(kind.contains("LCASE"), F.lit("utf8mb4_general_ci")).when(kind.startswith("string"), F.lit("utf8mb4_bin")).otherwise(F.lit("binary"))


def group_concat(x: Column, order: list[Column], separator: str = ",", longest: int = 1024) -> Column:
    """GROUP_CONCAT, cut at the length that group_concat_max_len names; NULLs are skipped."""
    held = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), x.cast("string").alias("x")))))
    return F.when(F.size(held) > 0, F.left(F.array_join(F.transform(held, lambda s: s.x), separator), F.lit(longest)))
