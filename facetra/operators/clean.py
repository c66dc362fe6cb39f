"""Cleaning: text, flags, numbers, required values, ranges, duplicates.

Every step is a projection or a filter, except de-duplication. The audit report
counts flags over one pass of the raw rows and one grouped pass of the kept
rows; it never runs one action per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    best_row,
    clean_text,
    long_rows,
    settle,
    stripped,
    to_flag,
    to_number,
)
from ..functions.scale import constants
from ..spec import TRACKS, FeatureSpec, require_columns

# Names an exported row index gets.
INDEX_COLUMNS = ("Unnamed: 0", "_c0")

REPORT_SCHEMA = "section string, column string, value long"


def validate_cleaning_columns(df: DataFrame, spec: FeatureSpec = TRACKS) -> None:
    require_columns(df, spec.expected, "DataFrame to clean")


def drop_index_column(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` without an exported row index, and how many columns went."""
    found = [c for c in INDEX_COLUMNS if c in df.columns]
    return df.drop(*found), len(found)


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def standardize_text(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Strip white space of text columns; blank text becomes NULL."""
    return df.withColumns({c: clean_text(F.col(c)) for c in _present(df, spec.text)})


def blank_counts(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    cols = _present(df, spec.text)
    one = df.agg(*[F.count_if(stripped(F.col(c)) == "").alias(c) for c in cols])
    return long_rows(one, [(c, F.col(c)) for c in cols], ("column", "value"))


def normalize_flag(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    if not spec.flag or spec.flag not in df.columns:
        return df
    return df.withColumn(spec.flag, to_flag(F.col(spec.flag), dict(df.dtypes)[spec.flag]))


def flag_coercions(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    c = F.col(spec.flag)
    return df.agg((F.count(c) - F.count(to_flag(c, dict(df.dtypes)[spec.flag]))).alias("value"))


def coerce_numeric(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    types = dict(df.dtypes)
    cols = _present(df, spec.numeric)
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in cols})


def numeric_coercions(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    types = dict(df.dtypes)
    cols = _present(df, spec.numeric)
    lost = {c: F.count(c) - F.count(to_number(F.col(c), types[c])) for c in cols}
    one = df.agg(*[v.alias(c) for c, v in lost.items()])
    return long_rows(one, [(c, F.col(c)) for c in cols], ("column", "value"))


def typed_rows(df: DataFrame, spec: FeatureSpec = TRACKS, marks: bool = False) -> DataFrame:
    """Text, flag and numbers in one projection.

    ``marks`` adds what each value was before: ``_blank_``, ``_set_`` and
    ``_flag`` columns for the report.
    """
    types = dict(df.dtypes)
    texts, nums = _present(df, spec.text), _present(df, spec.numeric)
    flag = [spec.flag] if spec.flag and spec.flag in df.columns else []
    parsed = [*texts, *flag, *[c for c in nums if types[c] == "string"]]
    bare = df.withColumns({c: stripped(F.col(c)) for c in parsed})
    values = {c: F.col(c) for c in df.columns}
    values |= {c: F.nullif(F.col(c), F.lit("")) for c in texts}
    values |= {c: to_flag(F.col(c), types[c], stripped_already=True) for c in flag}
    values |= {c: to_number(F.col(c), types[c], stripped_already=True) for c in nums}
    if marks:
        values |= {f"_blank_{c}": F.col(c) == "" for c in texts}
        values |= {f"_set_{c}": F.col(c).isNotNull() for c in [*flag, *nums]}
    return settle(bare, values)


def drop_missing(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Drop rows that lack a required text."""
    return df.na.drop(subset=list(spec.required_text))


def missing_counts(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    cols = list(spec.required_text)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return long_rows(one, [(c, F.col(c)) for c in cols], ("column", "value"))


def invalid_flags(df: DataFrame, spec: FeatureSpec = TRACKS) -> dict[str, Column]:
    """Per checked column: true where its value is set and out of range."""
    out = {c: ~F.col(c).between(0.0, 1.0) for c in spec.bounded}
    out.update({c: F.col(c) <= 0 for c in spec.positive})
    lo, hi = spec.target_range
    out[spec.target] = ~F.col(spec.target).between(lo, hi)
    return {c: v for c, v in out.items() if c in df.columns}


def remove_invalid(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Out-of-range values become NULL; rows that lack a required number go.

    The target is not required: a row with a bad target stays, without it.
    """
    bad = invalid_flags(df, spec)
    fixed = df.withColumns({c: F.when(~b, F.col(c)) for c, b in bad.items()})
    return fixed.na.drop(subset=_present(df, spec.required_numeric))


def invalid_counts(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    bad = invalid_flags(df, spec)
    one = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    return long_rows(one, [(c, F.col(c)) for c in bad], ("column", "value"))


def deduplicate(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """One row per key: most values set, then highest target, then first.

    "First" is the ingest order when the table has one, else the smallest
    remaining columns, which is a total order up to exact copies. Exact copies
    tie in it, so they need no separate pass.
    """
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns])
    order = [-filled, -F.coalesce(F.col(spec.target).cast("double"), F.lit(-1.0))]
    if spec.order_by:
        order.append(F.col(spec.order_by))
    rest = sorted(c for c in df.columns if c not in (*spec.key, spec.target, spec.order_by))
    for c in rest:
        order += [F.col(c).isNull(), F.col(c)]
    return best_row(df, spec.key, order)


def duplicate_counts(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """One row: rows, distinct rows, distinct keys.

    Chained groupings, each smaller than the one before; copies and hot keys
    meet on the map side.
    """
    data = df.drop(spec.order_by) if spec.order_by else df
    rows = data.groupBy(*data.columns).agg(F.count("*").alias("_n"))
    keys = rows.groupBy(*spec.key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    return keys.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_d"), F.lit(0)).alias("distinct_rows"),
        F.count("*").alias("distinct_keys"),
    )


def clean_rows(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """All row-wise steps, without de-duplication. Also works on a stream."""
    df, _ = drop_index_column(df)
    return remove_invalid(drop_missing(typed_rows(df, spec), spec), spec)


def clean_data(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """The cleaned table (lazy). :func:`clean_report` gives the audit."""
    validate_cleaning_columns(df, spec)
    return deduplicate(clean_rows(df, spec), spec)


def clean_report(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """What each cleaning step changed or removed, as long rows."""
    validate_cleaning_columns(df, spec)
    raw, dropped = drop_index_column(df)
    texts, nums = _present(raw, spec.text), _present(raw, spec.numeric)
    marked = typed_rows(raw, spec, marks=True)
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spec.required_text])
    bad = invalid_flags(marked, spec)
    valid = named
    for c in spec.required_numeric:
        ok = F.col(c).isNotNull()
        valid = valid & (ok & ~bad[c] if c in bad else ok)
    counters = {f"blank_{c}": F.count_if(F.col(f"_blank_{c}")) for c in texts}
    lost = [*nums, *([spec.flag] if spec.flag in raw.columns else [])]
    counters |= {f"lost_{c}": F.count_if(F.col(f"_set_{c}") & F.col(c).isNull()) for c in lost}
    counters |= {f"missing_{c}": F.count_if(F.col(c).isNull()) for c in spec.required_text}
    counters |= {f"invalid_{c}": F.count_if(named & b) for c, b in bad.items()}
    got = constants(
        marked, rows=F.count("*"), named=F.count_if(named), valid=F.count_if(valid), **counters
    )
    kept = duplicate_counts(clean_rows(raw, spec), spec).first()

    rows = [
        ("input_rows", None, got["rows"]),
        ("output_rows", None, kept["distinct_keys"]),
        ("rows_removed_total", None, got["rows"] - kept["distinct_keys"]),
        ("index_columns_removed", None, dropped),
        *[("blank_text_values", c, got[f"blank_{c}"]) for c in texts],
        ("flag_values_coerced_to_missing", None, got.get(f"lost_{spec.flag}", 0)),
        *[("numeric_values_coerced_to_missing", c, got[f"lost_{c}"]) for c in nums],
        *[("missing_values_before_drop", c, got[f"missing_{c}"]) for c in spec.required_text],
        ("rows_removed_for_missing_values", None, got["rows"] - got["named"]),
        *[("invalid_values_detected", c, got[f"invalid_{c}"]) for c in bad],
        ("rows_removed_for_invalid_values", None, got["named"] - got["valid"]),
        ("rows_removed_for_duplicates", None, kept["rows"] - kept["distinct_keys"]),
        ("duplicate_rows_removed", None, kept["rows"] - kept["distinct_rows"]),
        ("duplicate_keys_removed", None, kept["distinct_rows"] - kept["distinct_keys"]),
    ]
    return df.sparkSession.createDataFrame(
        [(s, c or "total", int(v)) for s, c, v in rows], REPORT_SCHEMA
    )
