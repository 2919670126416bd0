"""Column-level helpers. Every helper returns a built-in Spark expression, so
all of them stay inside whole-stage codegen (no Python UDFs)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (provided tables load as NTZ)."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def json_object(text: ColumnOrName) -> Column:
    """Parse JSON text once into a VARIANT; malformed text gives NULL."""
    return F.try_parse_json(_col(text))


def json_value_in(parsed: Column, key: str) -> Column:
    """Scalar at ``$.key`` of an already parsed VARIANT, as text.

    Objects and arrays give NULL (they are not scalars), JSON null gives
    NULL, booleans and numbers give their JSON text (``true``, ``12``)."""
    path = f"$.{key}"
    node = F.try_variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(node)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(None).cast("string")).otherwise(
        F.try_variant_get(parsed, path, "string")
    )


def json_value(text: ColumnOrName, key: str) -> Column:
    """Scalar JSON value of a text column (parses per call: prefer
    ``json_value_in`` on a column parsed once when several keys are read)."""
    return json_value_in(json_object(text), key)


def parse_day(text: ColumnOrName) -> Column:
    """``Y-M-D`` text to a TIMESTAMP_NTZ at midnight; unparsable → NULL.
    Lenient on digit counts (``2024-1-5`` parses), strict on calendar
    validity (``1998-02-30`` does not)."""
    return F.try_to_timestamp(_col(text), F.lit("y-M-d")).cast("timestamp_ntz")


def month_key(ts: ColumnOrName) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def elapsed_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole 24-hour periods from ``start`` to ``end`` (truncated toward zero)."""
    return F.timestamp_diff("DAY", _col(start), _col(end))


def day_diff(end_date: ColumnOrName, start_date: ColumnOrName) -> Column:
    """Calendar-day difference between two dates."""
    return F.datediff(_col(end_date), _col(start_date))


def count_if(cond: Column) -> Column:
    """Rows where ``cond`` is TRUE (NULL is not counted)."""
    return F.count_if(cond)


def safe_divide(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division returning NULL on a zero denominator."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def listagg_distinct(value: ColumnOrName, sep: str = ", ") -> Column:
    """Sorted distinct values joined by ``sep``; NULL when there are none.

    ``collect_set`` aggregates partially before the shuffle, so each group
    carries only its distinct values (analyst / plan / project names)."""
    values = F.array_sort(F.collect_set(_col(value)))
    return F.when(F.size(values) > 0, F.array_join(values, sep))
