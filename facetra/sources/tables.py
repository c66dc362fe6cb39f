"""Reading and writing tables: CSV and JSON in, CSV, Parquet and JSON out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import numbers, to_flag
from ..operators.clean import drop_index_column
from ..spec import TRACKS, FeatureSpec
from .records import split_csv

# Texts a CSV uses for a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def typed_columns(df: DataFrame, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Numbers and flag of the spec in their types; other columns as they are."""
    out = numbers(df, [c for c in spec.numeric if c in df.columns])
    if spec.flag and spec.flag in out.columns:
        out = out.withColumn(spec.flag, to_flag(F.col(spec.flag), dict(out.dtypes)[spec.flag]))
    return out


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: FeatureSpec = TRACKS,
    typed: bool = True,
    multiline: bool | str = False,
    na_tokens: Sequence[str] = NA_TOKENS,
    order: str | None = None,
) -> DataFrame:
    """CSV with a header; missing-value texts become NULL, an index column goes.

    No schema inference: columns are read as text and typed by role in the
    projection. ``typed=False`` keeps the text, for cleaning to audit.
    ``multiline="split"`` allows line breaks within values and still reads a file in many tasks, in two
    passes (``records.py``); with ``multiline=True`` a file is one task.
    ``order`` names a column to add, which sorts rows as they stand in their files
    (file, block, place in the block); as ``order_by`` of a spec it makes "first" mean first read.
    """
    if multiline == "split":
        raw = split_csv(spark, path)
        place = F.col("_place")
    else:
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)
        place = _place()
    raw, _ = drop_index_column(raw)
    names = [c for c in raw.columns if c != "_place" or multiline != "split"]
    tokens = list(na_tokens)
    kept = raw.select(
        *[F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in names],
        *([place.alias(order)] if order else []),
    )
    return typed_columns(kept, spec) if typed else kept


def _place() -> Column:
    """Where a row was read: sortable text of file, block start and place in the task."""
    at = [F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0")]
    return F.concat_ws("#", *at, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))


def load_json(
    spark: SparkSession,
    path: str | Sequence[str],
    spec: FeatureSpec = TRACKS,
    lines: bool = False,
    schema=None,
    typed: bool = True,
) -> DataFrame:
    """JSON records: one array per file, or one record per line (splittable)."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    raw, _ = drop_index_column(reader.json(path))
    return typed_columns(raw, spec) if typed else raw


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def write_tables(
    tables: Mapping[str, DataFrame | None], directory: str, fmt: str = "csv"
) -> dict[str, str]:
    """Write each table that is not empty under ``directory``; returns the paths."""
    written = {}
    for name, df in tables.items():
        if df is None or not df.columns:
            continue
        held = df.persist()  # computed once for the test and the file
        try:
            if held.isEmpty():
                continue
            path = f"{directory.rstrip('/')}/{name}"
            writer = held.write.mode("overwrite")
            if fmt == "csv":
                writer = writer.option("header", True)
            writer.format(fmt).save(path)
            written[name] = path
        finally:
            held.unpersist()
    return written


def export_sample(df: DataFrame, key: Sequence[str], path: str, n: int = 10) -> str:
    """The first ``n`` rows by key as JSON records."""
    df.orderBy(*key).limit(n).write.mode("overwrite").json(path)
    return path


def save_liked(liked: DataFrame, path: str, spec: FeatureSpec = TRACKS) -> str:
    """Sorted keys, one JSON record per line."""
    liked.select(*spec.key).distinct().orderBy(*spec.key).write.mode("overwrite").json(path)
    return path


def load_liked(spark: SparkSession, path: str, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Keys from JSON lines, or from one JSON array of ids (single-column key).

    Raises FileNotFoundError without the file and ValueError when its content
    is neither.
    """
    try:
        head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"liked file not found: {path}") from e
        raise
    if not head:
        raise ValueError(f"liked file '{path}' is empty")
    first = head[0][0].strip()
    key = spec.key[0]
    if first.startswith("["):
        whole = spark.read.text(path, wholetext=True)
        parsed = whole.select(F.from_json("value", "array<string>").alias("ids"))
        if parsed.filter("ids is null").limit(1).collect():
            raise ValueError(f"could not parse liked file '{path}'")
        return parsed.select(F.explode("ids").alias(key)).distinct()
    fields = ", ".join(f"`{k}` string" for k in spec.key)
    rows = spark.read.schema(f"{fields}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    wrong = rows.filter(F.col("_bad").isNotNull() | F.col(key).isNull()).limit(1).collect()
    if not first.startswith("{") or wrong:
        raise ValueError(f"liked file '{path}' must contain a JSON list of ids")
    return rows.select(*spec.key).distinct()
