"""Date and time functions with MySQL meaning. A TIME is a Long of microseconds, as it may pass 24 hours and be negative."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 10**6, 60 * 10**6, 3600 * 10**6, 86400 * 10**6
#: Limit of TIME: 838:59:59.
TIME_LIMIT = (838 * 3600 + 59 * 60 + 59) * SECOND
EPOCH_DAYS = 719528  # TO_DAYS('1970-01-01')


def to_days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + EPOCH_DAYS


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - EPOCH_DAYS).cast("int"))


def time_of(ts: Column) -> Column:
    """TIME(ts) in microseconds."""
    return F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * MINUTE + F.floor(F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def to_seconds(ts: Column) -> Column:
    return to_days(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def microsecond(ts: Column) -> Column:
    return (time_of(ts) % SECOND).cast("int")


def parse_time(s: Column) -> Column:
    """A TIME literal: [-][D ]HH:MM[:SS[.ffffff]]."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(s, r"^\s*(-?)(?:(\d+) )?(\d+):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?\s*$", i), F.lit("")), F.lit("0"))
    micro = F.rpad(part(6), 6, "0").cast("long")
    value = part(2).cast("long") * DAY + part(3).cast("long") * HOUR + part(4).cast("long") * MINUTE + part(5).cast("long") * SECOND + micro
    ok = s.rlike(r"^\s*-?(\d+ )?\d+:[0-5]?\d(:[0-5]?\d(\.\d{1,6})?)?\s*$")
    return F.when(ok, F.greatest(F.least(F.when(F.ltrim(s).startswith("-"), -value).otherwise(value), F.lit(TIME_LIMIT)), F.lit(-TIME_LIMIT)))


def show_time(t: Column) -> Column:
    """Microseconds as [-]HH:MM:SS[.ffffff], clamped to the limit of TIME."""
    x = F.least(F.abs(t), F.lit(TIME_LIMIT))
    whole = F.floor(x / SECOND).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    micro = x % SECOND
    text = F.when(micro == 0, text).otherwise(F.concat(text, F.lit("."), F.lpad(micro.cast("string"), 6, "0")))
    return F.when(t.isNull(), None).when(t < 0, F.concat(F.lit("-"), text)).otherwise(text)


def sec_to_time(n: Column) -> Column:
    return show_time((n * SECOND).cast("long"))


def time_to_sec(t: Column) -> Column:
    """Whole seconds of a TIME in microseconds, toward zero."""
    return (F.sign(t) * F.floor(F.abs(t) / SECOND)).cast("long")


def make_time(h: Column, m: Column, s: Column) -> Column:
    ok = m.between(0, 59) & (s >= 0) & (s < 60)
    size = F.abs(h).cast("long") * HOUR + m * MINUTE + F.round(s * SECOND).cast("long")
    return F.when(ok, F.least(size, F.lit(TIME_LIMIT)) * F.when(h < 0, F.lit(-1)).otherwise(F.lit(1)))


def add_time(ts: Column, t: Column) -> Column:
    return ts + F.make_dt_interval(secs=t.cast("decimal(20,6)") / SECOND)


def sub_time(ts: Column, t: Column) -> Column:
    return add_time(ts, -t)


def time_diff(a: Column, b: Column) -> Column:
    """Of two datetimes, in microseconds."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def make_date(y: Column, day_of_year: Column) -> Column:
    """MAKEDATE: NULL below day 1; two-digit years are 1970 to 2069."""
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.when(day_of_year >= 1, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day_of_year - 1).cast("int")))


def period_add(p: Column, months: Column) -> Column:
    m = F.floor(p / 100) * 12 + p % 100 - 1 + months
    return (F.floor(m / 12) * 100 + m % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    months = lambda p: F.floor(p / 100) * 12 + p % 100
    return (months(a) - months(b)).cast("long")


def week_and_year(d: Column, mode: int) -> tuple[Column, Column]:
    """Week (1 to 53) and the year that it belongs to. Bit 0: weeks start on Monday; bit 2 differs from bit 0: week 1
    is the first one that starts in the year, else the first with four days or more in it."""
    monday = bool(mode & 1)
    by_start = bool(mode & 4) if monday else not mode & 4

    def first_week(year: Column) -> Column:
        jan1 = F.make_date(year, F.lit(1), F.lit(1))
        gone = F.weekday(jan1) if monday else F.dayofweek(jan1) - 1  # days since the week's start
        start = F.date_sub(jan1, gone)
        late = gone > 0 if by_start else gone > 3
        return F.when(late, F.date_add(start, 7)).otherwise(start)

    y = F.year(d)
    this, after = first_week(y), first_week(y + 1)
    year = F.when(d >= after, y + 1).when(d < this, y - 1).otherwise(y)
    start = F.when(d >= after, after).when(d < this, first_week(y - 1)).otherwise(this)
    return F.floor(F.datediff(d, start) / 7).cast("int") + 1, year


def week(d: Column, mode: int = 0) -> Column:
    """WEEK(d, mode). Modes without bit 1 count days before week 1 as week 0, and late days by their own year."""
    number, year = week_and_year(d, mode)
    if mode & 2:
        return number
    monday = bool(mode & 1)
    by_start = bool(mode & 4) if monday else not mode & 4
    y = F.year(d)
    jan1 = F.make_date(y, F.lit(1), F.lit(1))
    gone = F.weekday(jan1) if monday else F.dayofweek(jan1) - 1
    start = F.when(gone > 0 if by_start else gone > 3, F.date_add(F.date_sub(jan1, gone), 7)).otherwise(F.date_sub(jan1, gone))
    return F.when(d < start, F.lit(0)).otherwise(F.floor(F.datediff(d, start) / 7).cast("int") + 1)


def year_week(d: Column, mode: int = 0) -> Column:
    number, year = week_and_year(d, mode | 2)
    return year * 100 + number


# Specifiers of DATE_FORMAT that have a Java pattern.
PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a"}


def ordinal_day(ts: Column) -> Column:
    d = F.dayofmonth(ts)
    suffix = F.when(d.between(11, 13), F.lit("th")).when(d % 10 == 1, F.lit("st")).when(d % 10 == 2, F.lit("nd")).when(d % 10 == 3, F.lit("rd")).otherwise(F.lit("th"))
    return F.concat(d.cast("string"), suffix)


def date_format(ts: Column, pattern: str) -> Column:
    """DATE_FORMAT: its specifiers become Java patterns or composed columns when the plan is made."""
    parts: list[Column] = []
    for spec, text in re.findall(r"%(.)|([^%]+)", pattern):
        if text:
            parts.append(F.lit(text))
        elif spec in PATTERNS:
            parts.append(F.date_format(ts, PATTERNS[spec]))
        elif spec == "D":
            parts.append(ordinal_day(ts))
        elif spec == "w":
            parts.append((F.dayofweek(ts) - 1).cast("string"))
        elif spec in "UuVv":
            mode = {"U": 0, "u": 1, "V": 2, "v": 3}[spec]
            parts.append(F.lpad(week(ts.cast("date"), mode).cast("string"), 2, "0"))
        elif spec in "Xx":
            parts.append(week_and_year(ts.cast("date"), 2 if spec == "X" else 3)[1].cast("string"))
        else:
            parts.append(F.lit(spec))
    return F.concat(*parts)


def time_format(t: Column, pattern: str) -> Column:
    """TIME_FORMAT of microseconds; %H and %k pass 23."""
    x = F.abs(t)
    h, m, s, f = F.floor(x / HOUR), F.floor(x % HOUR / MINUTE), F.floor(x % MINUTE / SECOND), x % SECOND
    twelve = (h + 11) % 12 + 1
    known = {"H": F.format_string("%02d", h), "k": h.cast("string"), "h": F.format_string("%02d", twelve), "I": F.format_string("%02d", twelve), "l": twelve.cast("string"), "i": F.format_string("%02d", m), "s": F.format_string("%02d", s), "S": F.format_string("%02d", s), "f": F.format_string("%06d", f), "p": F.when(h % 24 < 12, F.lit("AM")).otherwise(F.lit("PM"))}
    known["T"] = F.format_string("%02d:%02d:%02d", h, m, s)
    parts = [F.lit(text) if text else known.get(spec, F.lit(spec)) for spec, text in re.findall(r"%(.)|([^%]+)", pattern)]
    return F.concat(*parts)


def str_to_date(s: Column, pattern: str) -> Column:
    """STR_TO_DATE as a timestamp; NULL where it doesn't fit."""
    java = "".join("'" + text.replace("'", "''") + "'" if any(map(str.isalpha, text)) else text or PATTERNS.get(spec, spec) for spec, text in re.findall(r"%(.)|([^%]+)", pattern))
    return F.try_to_timestamp(s, F.lit(java)).cast("timestamp_ntz")


# GET_FORMAT.
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}


def get_format(kind: str, region: str) -> str | None:
    return FORMATS.get((kind.upper().replace("TIMESTAMP", "DATETIME"), region.upper()))


# Units of compound intervals, largest first.
COMPOUND = {
    "YEAR_MONTH": ("YEAR", "MONTH"), "DAY_HOUR": ("DAY", "HOUR"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"), "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "MINUTE_SECOND": ("MINUTE", "SECOND"), "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"),
}
_MICROS = {"MICROSECOND": 1, "SECOND": SECOND, "MINUTE": MINUTE, "HOUR": HOUR, "DAY": DAY, "WEEK": 7 * DAY}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def date_add(ts: Column, amount: int | str, unit: str) -> Column:
    """ts + INTERVAL amount unit, for all simple and compound units; a day past the month's end becomes its last."""
    unit = unit.upper()
    if unit in COMPOUND:
        numbers = re.findall(r"\d+", str(amount))
        sign, names = -1 if str(amount).strip().startswith("-") else 1, COMPOUND[unit][-len(numbers) :]
        if unit == "YEAR_MONTH":
            return date_add(ts, sign * sum(int(n) * _MONTHS[name] for n, name in zip(numbers, names, strict=True)), "MONTH")
        return reduce(lambda c, p: date_add(c, sign * int(p[0]), p[1]), zip(numbers, names, strict=True), ts)
    if unit in _MONTHS:
        return ts + F.make_ym_interval(F.lit(0), F.lit(int(amount) * _MONTHS[unit]))
    return add_time(ts, F.lit(int(amount) * _MICROS[unit]))


def date_add_column(ts: Column, amount: Column, unit: str) -> Column:
    """ts + INTERVAL amount unit for a simple unit and an amount in a column."""
    unit = unit.upper()
    if unit in _MONTHS:
        return ts + F.make_ym_interval(F.lit(0), (amount * _MONTHS[unit]).cast("int"))
    return add_time(ts, amount.cast("long") * _MICROS[unit])


def date_sub(ts: Column, amount: int | str, unit: str) -> Column:
    text = str(amount).strip()
    return date_add(ts, text[1:] if text.startswith("-") else f"-{text}", unit)


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT: compound units give their parts as one number."""
    unit = unit.upper()
    parts = {"YEAR": F.year(ts), "QUARTER": F.quarter(ts), "MONTH": F.month(ts), "WEEK": week(ts.cast("date"), 0), "DAY": F.dayofmonth(ts), "HOUR": F.hour(ts), "MINUTE": F.minute(ts), "SECOND": F.second(ts), "MICROSECOND": microsecond(ts)}
    if unit not in COMPOUND:
        return parts[unit].cast("long")
    out = None
    for name in COMPOUND[unit]:
        out = parts[name].cast("long") if out is None else out * (10**6 if name == "MICROSECOND" else 100) + parts[name]
    return out


def timestamp_diff(unit: str, a: Column, b: Column) -> Column:
    """TIMESTAMPDIFF(unit, a, b): complete units from a to b."""
    unit = unit.upper()
    if unit in _MONTHS:
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        rest = lambda t: (F.dayofmonth(t) - 1) * DAY + time_of(t)
        whole = months - F.when((months > 0) & (rest(b) < rest(a)), 1).when((months < 0) & (rest(b) > rest(a)), -1).otherwise(0)
        q = whole / _MONTHS[unit]
    else:
        q = time_diff(b, a) / _MICROS[unit]
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def to_precision(ts: Column, digits: int) -> Column:
    """NOW(fsp) and TIMESTAMP(fsp): as many digits of the second as asked for, 0 to 6, the rest cut."""
    if not 0 <= digits <= 6:
        raise ValueError("0 to 6 digits of the second")
    step = 10 ** (6 - digits)
    return ts - F.make_dt_interval(secs=(microsecond(ts) % step / F.lit(10**6)).cast("decimal(18,6)"))


def utc_time() -> Column:
    """UTC_TIME in microseconds of the day, seconds whole."""
    return F.pmod(F.unix_seconds(F.current_timestamp()), F.lit(86400)) * SECOND


def from_unixtime(n: Column, pattern: str | None = None) -> Column:
    """FROM_UNIXTIME in UTC, as text where a format is given; NULL below 0 and past the year 3001."""
    days, within = F.floor(n / 86400), F.pmod(n, F.lit(86400)).cast("decimal(18,6)")
    ts = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"), secs=within)
    inside = F.when(n.between(0, 32536771199), ts)
    return inside if pattern is None else date_format(inside, pattern)
