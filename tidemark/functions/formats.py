"""Scalar formats: times, sizes, ids, backoff, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = 1_000_000_000
#: Seconds of the years 0000 to 9999; times beyond are shown as the epoch.
LEAST_SECOND, LAST_SECOND = -62_167_219_200, 253_402_300_799


def _stamp(sec: Column) -> Column:
    return F.timestamp_seconds(F.when(sec.between(LEAST_SECOND, LAST_SECOND), sec).otherwise(F.lit(0)))


def compact_time(sec: Column) -> Column:
    """YYYYMMDD-HHMMSS, in UTC if the session is."""
    return F.date_format(_stamp(sec), "yyyyMMdd-HHmmss")


def rfc3339(sec: Column) -> Column:
    return F.date_format(_stamp(sec), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """Seconds since the epoch, or null if invalid or before it."""
    ok = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    sec = F.unix_seconds(F.try_to_timestamp(F.when(ok, F.upper(text))))
    return F.when(sec >= 0, sec)


def split_nanos(ns: Column) -> Column:
    """(sec, nsec) with 0 <= nsec, also before the epoch."""
    sec = F.floor(ns / F.lit(NANOS).cast("decimal(20,0)")).cast("bigint")
    return F.struct(sec.alias("sec"), F.pmod(ns, F.lit(NANOS)).cast("int").alias("nsec"))


def join_nanos(sec: Column, nsec: Column) -> Column:
    return sec * F.lit(NANOS) + nsec


def bytes_text(n: Column) -> Column:
    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    # ties go to the even digit, which a format string alone doesn't do
    return (
        F.when(n < kb, F.format_string("%d B", n))
        .when(n < mb, F.format_string("%.1f KB", F.bround(n / kb, 1)))
        .when(n < gb, F.format_string("%.1f MB", F.bround(n / mb, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / gb, 2)))
    )


def short_hex(x: Column) -> Column:
    """Six digits, an ellipsis and four of a long id; 'none' of an empty one."""
    return F.when(F.coalesce(x, F.lit("")) == "", "none").when(F.length(x) > 12, F.concat(F.substring(x, 1, 6), F.lit("…"), F.substring(x, -4, 4))).otherwise(x)


def progress(done: Column, total: Column) -> Column:
    """Share between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / F.greatest(total, F.lit(1))))


def percent(done: Column, total: Column) -> Column:
    return F.floor(progress(done, total) * 100).cast("int")


def complete(done: Column, total: Column) -> Column:
    return (total > 0) & (done >= total)


def restart_backoff_ms(attempt: Column) -> Column:
    return F.lit(100) * F.pow(F.lit(2), F.least(attempt, F.lit(5))).cast("bigint")


def dial_backoff_ms(poll_ms: Column, attempt: Column) -> Column:
    return F.least(F.lit(5000), F.greatest(F.lit(50), poll_ms) * F.pow(F.lit(2), F.least(attempt, F.lit(4))).cast("bigint"))


def redacted(text: Column) -> Column:
    """The first four characters and the length."""
    return F.concat(F.substring(text, 1, 4), F.lit("… ("), F.length(text).cast("string"), F.lit(" chars)"))


def path_error(path: Column) -> Column:
    """Why a folder's path isn't accepted, or null."""
    return F.when(~F.startswith(path, F.lit("/")), "relative").when(F.contains(path, F.lit("//")), "empty_component").when(F.array_contains(F.split(path, "/"), ".."), "traversal")


def packed(id: Column) -> Column:
    """An id in half its size if it is in lower-case hexadecimal; the first byte says so."""
    raw = F.unhex(id)
    return F.when(F.lower(F.hex(raw)) == id, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), id.cast("binary")))


def unpacked(id: Column) -> Column:
    rest = F.substring(id, F.lit(2), F.length(id))
    return F.when(F.substring(id, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def packed_list(chunks: Column) -> Column:
    """A list of chunks with packed ids."""
    return F.transform(chunks, lambda c: F.struct(packed(c["id"]).alias("id"), c["len"].alias("len")))


def unpacked_list(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(unpacked(c["id"]).alias("id"), c["len"].alias("len")))
