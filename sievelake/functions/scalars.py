"""Scalar functions as Column builders: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits (fixed values): the offset basis in two halves, and the low part of the prime 2^40 + 435.
FNV_HIGH, FNV_LOW = 0xCBF29CE4, 0x84222325
FNV_PRIME_LOW = 435
LOW32 = 0xFFFFFFFF
TWO_64 = 18446744073709551616

UNITS = ["KiB", "MiB", "GiB", "TiB"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_size(size, raw: bool = False) -> Column:
    """Bytes as `1.5 KiB`, up to TiB; below 1024 and negative ones as `n B`; raw: the number.  Ties round to even."""
    b = _col(size).cast("long")
    if raw:
        return b.cast("string")
    out = F.concat(b.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS, 1):
        scaled = F.bround(b / F.lit(float(1024**k)), 1)
        out = F.when(b >= 1024**k, F.concat(F.format_string("%.1f", scaled), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_count(n) -> Column:
    """Thousands separated by commas."""
    return F.format_number(_col(n), 0)


def _tenths(x: Column) -> Column:
    """One decimal of a number from 1.  The whole part goes first: then the binary value decides, not its shortest text."""
    return F.format_string("%.1f", F.floor(x).cast("double") + F.bround(x - F.floor(x).cast("double"), 1))


def format_eta(elapsed, current, total) -> Column:
    """Time left at the rate so far: `~10s`, `~3.0m`, `~2.0h`; empty where it can't be told."""
    cur, end = _col(current).cast("double"), _col(total).cast("double")
    rate = F.try_divide(cur, _col(elapsed).cast("double"))
    left = F.coalesce(F.try_divide(end - cur, rate), F.lit(0.0))
    text = (
        F.when(left < 60, F.format_string("~%.0fs", F.bround(left, 0)))
        .when(left < 3600, F.concat(F.lit("~"), _tenths(left / 60), F.lit("m")))
        .otherwise(F.concat(F.lit("~"), _tenths(left / 3600), F.lit("h")))
    )
    return F.when((cur <= 0) | (end <= 0) | (cur > end), F.lit("")).otherwise(text)


def fnv1a64_halves(text) -> Column:
    """FNV-1a of the UTF-8 bytes as struct(high, low), 32 bits each in a BIGINT: no step overflows.
    The digits are a lambda's variable: as an expression they would be worked out again for each byte."""

    def step(state: Column, octet: Column) -> Column:
        low = state["low"].bitwiseXOR(octet)
        product = low * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(LOW32)).alias("high"), product.bitwiseAND(F.lit(LOW32)).alias("low"))

    def halves(digits: Column) -> Column:
        n = F.shiftright(F.length(digits), 1)
        places = F.slice(F.sequence(F.lit(0), n), F.lit(2), n)
        octets = F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
        start = F.struct(F.lit(FNV_HIGH).cast("long").alias("high"), F.lit(FNV_LOW).cast("long").alias("low"))
        return F.aggregate(octets, start, step)

    return F.transform(F.array(F.hex(F.encode(_col(text), "UTF-8"))), halves)[0]


def fnv1a64(text) -> Column:
    """FNV-1a as DECIMAL(20,0): Spark has no unsigned 64-bit type."""
    h = fnv1a64_halves(text)
    return (h["high"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["low"].cast("decimal(20,0)")).cast("decimal(20,0)")


def hex16(number) -> Column:
    """An unsigned 64-bit number (DECIMAL) as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.conv(_col(number).cast("string"), 10, 16), 16, "0"))


def fnv1a64_hex(text) -> Column:
    h = fnv1a64_halves(text)
    return F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))


def wrapped_sum(number) -> Column:
    """Sum of unsigned 64-bit numbers modulo 2^64: the same in any order."""
    return (F.sum(_col(number).cast("decimal(20,0)")) % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")


#: Classes of characters in the order they are written: sign and pattern.
CLASSES = [
    ("a", "[a-z]"),
    ("A", "[A-Z]"),
    ("0", "[0-9]"),
    ("SP", " "),
    (".", r"\."),
    ("-", "-"),
    ("_", "_"),
    ("?", r"[\x00-\x1F!-,:-@\[\]^`{-\x7F]"),
    ("~", r"[^\x00-\x7F]"),
]


def char_classes(text) -> Column:
    """Which kinds of characters occur; slashes of both kinds don't count."""
    c = _col(text)
    return F.concat(*[F.when(c.rlike(pattern), F.lit(sign)).otherwise(F.lit("")) for sign, pattern in CLASSES])


def path_depth(path) -> Column:
    c = _col(path)
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def extension(path) -> Column:
    """From the last dot of the last segment, with the dot."""
    return F.regexp_extract(_col(path), r"(\.[^./]*)$", 1)


def path_pattern(path) -> Column:
    """A path's shape without its names: depth, bytes, extension, character classes, bytes of each segment."""
    c = _col(path)
    segments = F.concat_ws(".", F.transform(F.split(c, "/"), lambda s: F.octet_length(s).cast("string")))
    return F.concat(
        F.lit("d="), path_depth(c).cast("string"), F.lit(",l="), F.octet_length(c).cast("string"), F.lit(",ext="), extension(c),
        F.lit(",c="), char_classes(c), F.lit(",segs="), segments,
    )


def sanitize_error(message) -> Column:
    """Absolute paths at the start or after a space or colon become <path>."""
    return F.regexp_replace(_col(message), "(^|[ :])/[^ :\n\t]+", "$1<path>")


def report_key(message, src, dst) -> Column:
    """16 hexadecimal digits that name a kind of error: its sanitized text and the shapes of both paths."""
    return shape_key(sanitize_error(message), path_pattern(src), path_pattern(dst))


def shape_key(message, src, dst) -> Column:
    """The same of a sanitized text and two shapes."""
    zero = F.chr(F.lit(0))
    return fnv1a64_hex(F.concat(_col(message), zero, _col(src), zero, _col(dst)))


def rate(count, seconds) -> Column:
    """Whole things a second; null where no time has passed."""
    return F.try_divide(_col(count).cast("double"), _col(seconds).cast("double")).cast("long")


def base_name(path) -> Column:
    return F.regexp_extract(_col(path), "([^/]*)$", 1)


def dir_name(path) -> Column:
    return F.regexp_replace(_col(path), "/[^/]*$", "")


def same_extents(a, b) -> Column:
    """Equal number of extents, pairwise equal in physical place and length; null counts as none."""

    def shape(c) -> Column:
        return F.coalesce(F.transform(_col(c), lambda e: F.struct(e["physical"].alias("p"), e["length"].alias("l"))), F.array().cast("array<struct<p:bigint,l:bigint>>"))

    return shape(a) == shape(b)


def utc_stamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
