"""Conditional, comparison, hashing and network functions with MySQL meaning."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def if_(condition: Column, a, b) -> Column:
    return F.when(condition, a).otherwise(b)


def least(*xs: Column) -> Column:
    """NULL if any argument is (the built-in skips NULLs)."""
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).otherwise(F.least(*xs))


def greatest(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, (x.isNull() for x in xs)), None).otherwise(F.greatest(*xs))


def interval(n: Column, *bounds: float) -> Column:
    """INTERVAL(n, a, b, ...): how many of the rising bounds are at most n; -1 for NULL."""
    return F.when(n.isNull(), F.lit(-1)).otherwise(reduce(lambda a, b: a + b, ((n >= x).cast("int") for x in bounds)))


def is_ipv4(s: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return s.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def inet_aton(s: Column) -> Column:
    """A dotted address of one to four parts as a number; the last part fills the remaining bytes."""
    parts = F.split(s, r"\.")
    n = F.size(parts)
    value = F.lit(0).cast("long")
    for k in range(4):
        part = F.try_element_at(parts, F.lit(k + 1)).try_cast("long")
        place = F.when(F.lit(k + 1) == n, F.lit(1)).otherwise(F.lit(256 ** (3 - k)))
        value = value + F.when(F.lit(k) < n, part * place).otherwise(F.lit(0))
    fits = F.forall(F.transform(parts, lambda p: p.try_cast("int")), lambda p: p <= 255)
    return F.when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){0,3}$") & fits, value)


def inet_ntoa(n: Column) -> Column:
    x = n.cast("long")
    return F.when(x.between(0, 2**32 - 1), F.concat_ws(".", *(F.shiftright(x, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0))))


@F.pandas_udf(T.BooleanType())
def is_ipv6(s: pd.Series) -> pd.Series:
    import ipaddress

    def ok(x):
        if x is None:
            return None
        try:
            ipaddress.IPv6Address(x)
            return "%" not in x
        except ValueError:
            return False

    return s.map(ok)


@F.pandas_udf(T.BinaryType())
def inet6_aton(s: pd.Series) -> pd.Series:
    import ipaddress

    def pack(x):
        try:
            return ipaddress.ip_address(x).packed
        except ValueError:
            return None

    return s.map(pack)


@F.pandas_udf(T.StringType())
def inet6_ntoa(b: pd.Series) -> pd.Series:
    import ipaddress

    def show(x):
        if x is None or len(x) not in (4, 16):
            return None
        a = ipaddress.ip_address(bytes(x))
        mapped = getattr(a, "ipv4_mapped", None)
        return f"::ffff:{mapped}" if mapped else str(a)

    return b.map(show)


def is_ipv4_mapped(b: Column) -> Column:
    return F.coalesce((F.octet_length(b) == 16) & F.hex(b).startswith("0" * 20 + "FFFF"), F.lit(False))


def is_ipv4_compat(b: Column) -> Column:
    h = F.hex(b)
    return F.coalesce((F.octet_length(b) == 16) & h.startswith("0" * 24) & ~h.startswith("0" * 31), F.lit(False))


def is_uuid(s: Column) -> Column:
    h = "[0-9a-fA-F]"
    return s.rlike(rf"^(?:{h}{{32}}|{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}|\{{{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}\}})$")


def uuid_to_bin(s: Column, swap: bool = False) -> Column:
    h = F.regexp_replace(s, "[-{}]", "")
    if swap:
        h = F.concat(F.substring(h, 13, 4), F.substring(h, 9, 4), F.substring(h, 1, 8), F.substring(h, 17, 16))
    return F.when(is_uuid(s), F.unhex(h))


def bin_to_uuid(b: Column, swap: bool = False) -> Column:
    h = F.lower(F.hex(b))
    if swap:
        h = F.concat(F.substring(h, 9, 8), F.substring(h, 5, 4), F.substring(h, 1, 4), F.substring(h, 17, 16))
    return F.when(F.octet_length(b) == 16, F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def fold_key(key: bytes, size: int = 16) -> bytes:
    """A key of AES from a password: XOR of its blocks."""
    out = bytearray(size)
    for i, b in enumerate(key):
        out[i % size] ^= b
    return bytes(out)


def aes_encrypt(s: Column, key: str) -> Column:
    return F.aes_encrypt(s.cast("binary"), F.lit(fold_key(key.encode())), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(b: Column, key: str) -> Column:
    """NULL where it can't be decrypted."""
    return F.try_aes_decrypt(b, F.lit(fold_key(key.encode())), F.lit("ECB"), F.lit("PKCS"))


@F.pandas_udf(T.BinaryType())
def compress(s: pd.Series) -> pd.Series:
    import zlib

    def pack(x):
        if x is None:
            return None
        raw = x.encode() if isinstance(x, str) else bytes(x)
        return len(raw).to_bytes(4, "little") + zlib.compress(raw) if raw else b""

    return s.map(pack)


@F.pandas_udf(T.BinaryType())
def uncompress(b: pd.Series) -> pd.Series:
    import zlib

    def unpack(x):
        if x is None:
            return None
        try:
            return zlib.decompress(bytes(x)[4:]) if len(x) else b""
        except zlib.error:
            return None

    return b.map(unpack)


def uncompressed_length(b: Column) -> Column:
    """The length header, four bytes, least first."""
    byte = lambda k: F.conv(F.hex(F.substring(b, k, 1)), 16, 10).cast("long") * 256 ** (k - 1)
    return F.when(b.isNull(), None).when(F.octet_length(b) < 4, F.lit(0)).otherwise(byte(1) + byte(2) + byte(3) + byte(4))


def format_bytes(n: Column) -> Column:
    out = None
    for power, unit in ((6, "EiB"), (5, "PiB"), (4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")):
        text = F.concat(F.format_string("%.2f", n / F.lit(1024.0**power)), F.lit(f" {unit}"))
        out = F.when(F.abs(n) >= 1024**power, text) if out is None else out.when(F.abs(n) >= 1024**power, text)
    return out.when(n.isNotNull(), F.concat(F.format_string("%4d", n.cast("long")), F.lit(" bytes")))


def format_pico_time(n: Column) -> Column:
    x, out = n.cast("double"), None
    for size, unit in ((86400e12, "d"), (3600e12, "h"), (60e12, "min"), (1e12, "s"), (1e9, "ms"), (1e6, "us"), (1e3, "ns")):
        text = F.concat(F.format_string("%.2f", x / F.lit(size)), F.lit(f" {unit}"))
        out = F.when(F.abs(x) >= size, text) if out is None else out.when(F.abs(x) >= size, text)
    return out.when(x.isNotNull(), F.concat(F.format_string("%3d", x.cast("long")), F.lit(" ps")))


def list_add(items: Column, item: str) -> Column:
    """Add to a comma-separated list unless it is there."""
    return F.when(items.isNull() | (items == ""), F.lit(item)).when(F.array_contains(F.split(items, ","), item), items).otherwise(F.concat(items, F.lit(f",{item}")))


def list_drop(items: Column, item: str) -> Column:
    return F.array_join(F.array_remove(F.split(items, ","), item), ",")


def quote_identifier(s: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(s, F.lit("`"), F.lit("``")), F.lit("`"))


def extract_value(xml: Column, path: str) -> Column:
    """EXTRACTVALUE: the text at an XPath."""
    return F.xpath_string(xml, F.lit(path))


def random_bytes(n: Column) -> Column:
    """n random bytes, 1 to 1024; NULL for other lengths."""
    more = F.concat(*(F.unhex(F.sha2(F.uuid(), 512)) for _ in range(16)))
    return F.when(n.between(1, 1024), F.substring(more, F.lit(1), n))


def uuid_short() -> Column:
    """UUID_SHORT: numbers that rise within a partition and differ in the whole statement, above the hour's own range."""
    return F.shiftleft(F.floor(F.unix_seconds(F.current_timestamp()) / 3600), 43).bitwiseAND(F.lit(2**62 - 1)) + F.monotonically_increasing_id()
