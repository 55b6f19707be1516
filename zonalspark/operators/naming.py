"""Names and descriptions of result columns, filters and periods."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_name(resource: Column, short_name: Column, kwargs: dict | None) -> Column:
    """{resource}.{name}; with arguments the name ends in the first 8 digits of the MD5 of their sorted JSON, which is
    the same for every row and so worked out once."""
    end = "_" + hashlib.md5(json.dumps(kwargs, sort_keys=True).encode()).hexdigest()[:8] if kwargs else ""
    return F.concat(resource, F.lit("."), short_name, F.lit(end))


def without_none(name: Column, outcome: Column) -> Column:
    """A trailing _none becomes _{outcome} where there is one."""
    return F.when(F.endswith(name, F.lit("_none")) & outcome.isNotNull(), F.concat(F.substring(name, F.lit(1), F.char_length(name) - 4), outcome)).otherwise(name)


def filter_text(filters: dict) -> str:
    """'key: a–b; key: x, y' of a filter catalogue: ranges, selections (an empty one has nothing after the colon), other
    dictionaries as JSON, and plain values as they are."""

    def said(f) -> str:
        kind = f.get("type") if isinstance(f, dict) else None
        if kind == "range":
            return f"{f.get('start')}–{f.get('end')}"
        if kind == "categorical" and isinstance(f.get("selected"), list):
            return ", ".join(map(str, f["selected"]))
        return json.dumps(f) if isinstance(f, dict) else str(f)

    return "; ".join(f"{key}: {said(f)}" for key, f in filters.items())


def field_track(name: Column, label: Column) -> Column:
    """A column's name as a track: without what is before the first point, the time label at its end and a leading word
    for its kind, and with spaces for _."""
    own = F.regexp_replace(F.regexp_replace(name, F.lit(r"^[^.]*\."), F.lit("")), F.concat(F.lit("[_.]?"), label, F.lit("$")), F.lit(""))
    return F.regexp_replace(F.replace(own, F.lit("_"), F.lit(" ")), r"(?i)^(categorical|binary|numeric|ordinal)\s+", "")


def period(at: Column, kind: Column) -> Column:
    """A time by its type: year, year and month, or date; null for none."""
    return F.when(kind == "year", F.date_format(at, "yyyy")).when(kind == "year month", F.date_format(at, "yyyy-MM")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def unique_names(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Of equal names inside keys the second and later get _1, _2 .. in order of appearance."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1
    return rows.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("_"), n.cast("string"))).otherwise(F.col(name)))


def newest_labels(rows: DataFrame, keys: list[str], label: str, most: int = 25) -> DataFrame:
    """labels: the latest labels, newest first, with ', ...' if there are more."""
    every = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(label).cast("string")), False).alias("_l"))
    return every.select(*keys, F.concat(F.array_join(F.slice("_l", 1, most), ", "), F.when(F.size("_l") > most, ", ...").otherwise("")).alias("labels"))
