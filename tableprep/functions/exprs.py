"""Scalar column expressions used by history, reports and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."


def relative_time(ts: Column, now: Column) -> Column:
    """"Just now", minutes, hours, "Yesterday", days, else the date."""
    gap = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    days = F.floor(gap / 86400)
    left = gap - days * 86400
    minutes, hours = F.floor(left / 60), F.floor(left / 3600)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    return (F.when((days == 0) & (left < 60), "Just now")
            .when((days == 0) & (left < 3600), ago(minutes, "minute"))
            .when(days == 0, ago(hours, "hour"))
            .when(days == 1, "Yesterday")
            .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
            .otherwise(F.date_format(ts, "MMM dd, yyyy")))


def human_bytes(size: Column) -> Column:
    """Bytes as text with a unit, rounded to two digits."""
    size = size.cast("double")
    out = None
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "Bytes")):
        value = F.round(size / 1024.0 ** power, 2)
        whole = value.cast("long").cast("string")
        text = F.concat(F.when(value == F.floor(value), whole).otherwise(value.cast("string")), F.lit(f" {unit}"))
        out = F.when(size >= 1024.0 ** power, text) if out is None else out.when(size >= 1024.0 ** power, text)
    return out.otherwise(F.lit("0 Bytes"))


def truncate_text(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(ELLIPSIS))).otherwise(text)


def safe_name(text: Column) -> Column:
    """Everything but letters, digits, space, hyphen and underscore becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N} _-]", "_")


def file_stem(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def file_ext(name: Column) -> Column:
    """Lower-case extension with the dot, or an empty text."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def split_list(text: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty items."""
    # a bare F.trim would be given the item's index as the characters to trim
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def to_json_row(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def text_search(query: str, *fields: Column) -> Column:
    """Case-insensitive: any of the fields contains the query; a null field is empty."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(f, F.lit(""))).contains(needle)
    return hit
