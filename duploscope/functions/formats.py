"""Sizes, times and labels as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duploscope.functions.paths import _col, _lookup

# Size buckets, units, and the labels and categories of results.
KIB, MIB, GIB, TIB = 1024, 1024**2, 1024**3, 1024**4
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
TIER_LABELS = {"VerySimilar": "Very similar", "Similar": "Similar", "LooselySimilar": "Loosely similar"}
OUTCOME_CATEGORIES = {
    "Recycled": ("CleanupOutcomeMoved", "Success"),
    "SkippedMissing": ("CleanupOutcomeMissing", "Skipped"),
    "SkippedIdentityMismatch": ("CleanupOutcomeChanged", "Skipped"),
    "SkippedChanged": ("CleanupOutcomeChanged", "Skipped"),
    "SkippedKeeperUnavailable": ("CleanupOutcomeKeeper", "Skipped"),
    "SkippedVerificationFailed": ("CleanupOutcomeVerification", "Skipped"),
    "SkippedPolicy": ("CleanupOutcomePolicy", "Skipped"),
    "FailedRecycleBin": ("CleanupOutcomeRecycleBinFailed", "Failed"),
    "Cancelled": ("CleanupOutcomeCancelled", "Cancelled"),
}
OUTCOME_OTHERWISE = ("CleanupOutcomePlatformFailed", "Failed")


def size_bucket(size: Column | str) -> Column:
    """Size class; 1 GiB itself still belongs to the class below it."""
    size = _col(size)
    return (
        F.when(size < MIB, "LessThan1Mb")
        .when(size < 10 * MIB, "OneTo10Mb")
        .when(size < 100 * MIB, "TenTo100Mb")
        .when(size <= GIB, "OneHundredMbTo1Gb")
        .when(size > GIB, "MoreThan1Gb")
    )


def format_bytes(size: Column | str) -> Column:
    """Readable size: whole bytes, or one decimal of the largest fitting unit."""
    size = F.greatest(_col(size), F.lit(0))

    def scaled(unit: int) -> Column:
        value = F.round(size.cast("double") / float(1024**unit), 1)
        return F.concat(F.format_number(value, 1), F.lit(" " + SIZE_UNITS[unit]))

    return (
        F.when(size < KIB, F.concat(F.format_number(size, 0), F.lit(" " + SIZE_UNITS[0])))
        .when(size < MIB, scaled(1))
        .when(size < GIB, scaled(2))
        .when(size < TIB, scaled(3))
        .otherwise(scaled(4))
    )


def iso_utc(moment: Column | str) -> Column:
    """Round-trip UTC text with seven decimals; Spark times are exact to six."""
    utc = F.to_utc_timestamp(_col(moment), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def tier_label(tier: Column | str) -> Column:
    return _lookup({name: F.lit(label) for name, label in TIER_LABELS.items()}, _col(tier))


def outcome_category(status: Column | str) -> Column:
    """Message key and tone of an outcome status, as a struct."""
    pair = lambda values: F.struct(F.lit(values[0]).alias("message_key"), F.lit(values[1]).alias("tone"))
    known = {name: pair(values) for name, values in OUTCOME_CATEGORIES.items()}
    return F.coalesce(_lookup(known, _col(status)), pair(OUTCOME_OTHERWISE))


def content_digest(content: Column | str) -> Column:
    """SHA-256 in hexadecimal; null where the content is."""
    return F.sha2(_col(content), 256)


def content_equal(left: Column | str, right: Column | str) -> Column:
    """Byte equality; null, not false, where either side could not be read."""
    return _col(left) == _col(right)
