"""Checked queries: sources, cleaning, validation and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import cut_lineage
from ..operators import clean, profile, validate
from ..sources import tables as io
from . import runs
from .bindings import (
    DIRTY,
    DIRTY_SQL,
    EVENTS,
    ITEMS,
    ITEMS_SQL,
    PARTS,
    PARTS_SQL,
    TYPED_SQL,
    scratch,
)
from .registry import outer, query, sql_round

PART_DOUBLES = "p_size p_retailprice avg_quantity avg_discount avg_tax total_quantity n_lines demand"
PART_KEEP = "p_partkey p_name p_brand p_type is_large"


# sources and sinks ---------------------------------------------------------


SPLIT_BYTES = 256 * 1024  # so that a file of this size counts as large


@query("src1_csv_roundtrip", outer(PARTS_SQL, PART_KEEP, PART_DOUBLES, "SELECT * FROM catalogue"))
def _csv(t):
    path = scratch(t.spark)
    rows = t.catalogue.withColumn("Unnamed: 0", F.lit(1))
    rows.write.option("header", True).csv(path)
    back = io.load_csv(t.spark, path, PARTS, multiline=False)
    return back.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query(
    "src1_csv_split_multiline",
    "SELECT doc_id, CASE WHEN text <> '' THEN text END AS text, lang, n_chars FROM documents",
)
def _csv_split(t):
    """Whole texts with line breaks and quotes, through files of which each is read in many splits."""
    path = scratch(t.spark)
    rows = t.documents.select("doc_id", "text", "lang", "n_chars")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    kept = {c: t.spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in kept:
            t.spark.conf.set(c, str(SPLIT_BYTES))
        back = cut_lineage(io.load_csv(t.spark, path, PARTS, typed=False, multiline="split", na_tokens=[""]))
    finally:
        for c, v in kept.items():
            t.spark.conf.set(c, v)
    number = lambda c: F.col(c).cast("long").alias(c)
    return back.select(number("doc_id"), "text", "lang", number("n_chars"))


@query("src2_json_roundtrip", outer(PARTS_SQL, PART_KEEP, PART_DOUBLES, "SELECT * FROM catalogue"))
def _json(t):
    path = scratch(t.spark)
    t.catalogue.write.json(path)
    return io.load_json(t.spark, path, PARTS, lines=True, schema=t.catalogue.schema)


@query("src3_drop_index_column", "SELECT doc_id, lang, n_chars FROM documents")
def _index(t):
    rows = t.documents.select("doc_id", "lang", "n_chars").withColumn("Unnamed: 0", F.lit(0))
    return clean.drop_index_column(rows)[0]


@query("src4_normalized_names", outer("", "c_custkey c_mktsegment", "c_acctbal", "SELECT * FROM customer"))
def _names(t):
    messy = t.customer.select(
        F.col("c_custkey").alias(" C_CustKey"),
        F.col("c_mktsegment").alias("C_MKTSEGMENT "),
        F.col("c_acctbal").alias("c_acctbal"),
    )
    return io.normalize_names(messy)


@query("src5_category_alias", "SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type")
def _alias(t):
    renamed = t.part.withColumnRenamed("p_type", "type")
    return renamed.groupBy(PARTS.resolve_category(renamed)).agg(F.count("*").alias("n"))


@query(
    "snk1_summary_tables",
    outer(
        PARTS_SQL,
        "p_type",
        "demand_low p_size_mean avg_quantity_std",
        """SELECT p_type, CAST(count(*) FILTER (WHERE demand <= 50 AND demand > 25) AS DOUBLE) AS demand_low,
        avg(p_size) AS p_size_mean, stddev_samp(avg_quantity) AS avg_quantity_std FROM catalogue GROUP BY p_type""",
    ),
)
def _summary_tables(t):
    out = runs.export_summary(t.catalogue, scratch(t.spark), PARTS)
    read = lambda n: t.spark.read.option("header", True).csv(out[n])
    means = read("summary_category_means")
    tiers = read("summary_target_by_category")
    return means.join(tiers, "p_type").select(
        "p_type",
        F.col("Medium").cast("double").alias("demand_low"),
        F.col("p_size_mean").cast("double").alias("p_size_mean"),
        F.col("avg_quantity_std").cast("double").alias("avg_quantity_std"),
    )


@query(
    "snk11_json_sample",
    outer("", "event_id event_type", "value", "SELECT * FROM events ORDER BY event_id LIMIT 10"),
)
def _sample(t):
    path = io.export_sample(t.events.select("event_id", "event_type", "value"), ["event_id"], scratch(t.spark))
    return io.load_json(
        t.spark, path, EVENTS, lines=True, typed=False, schema="event_id long, event_type string, value double"
    )


# cleaning --------------------------------------------------------------------


@query(
    "cln2_standardized_text",
    f"WITH {TYPED_SQL} SELECT kind, owner, note, count(*) AS n FROM typed GROUP BY ALL",
)
def _text(t):
    rows = clean.standardize_text(t.dirty, DIRTY)
    return rows.groupBy("kind", "owner", "note").agg(F.count("*").alias("n"))


def _long(ctes: str, columns: str, expr: str, source: str) -> str:
    each = [
        f"SELECT '{c}' AS \"column\", CAST({expr.format(c=c)} AS BIGINT) AS value FROM {source}"
        for c in columns.split()
    ]
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(each)


@query(
    "cln2_blank_counts", _long(DIRTY_SQL, "rec_id kind owner note", "count_if(trim({c}) = '')", "dirty")
)
def _blank(t):
    return clean.blank_counts(t.dirty, DIRTY)


@query("cln3_flag_values", f"WITH {TYPED_SQL} SELECT flag, count(*) AS n FROM typed GROUP BY flag")
def _flag(t):
    return clean.normalize_flag(t.dirty, DIRTY).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    "cln3_flag_coercions",
    f"WITH {DIRTY_SQL} SELECT CAST(count_if(flag = ' maybe ') AS BIGINT) AS value FROM dirty",
)
def _flag_coerced(t):
    return clean.flag_coercions(t.dirty, DIRTY)


@query(
    "cln4_numeric_values",
    outer(
        TYPED_SQL,
        "rec_id",
        "amount score share",
        "SELECT rec_id, sum(amount) AS amount, max(score) AS score, min(share) AS share FROM typed GROUP BY rec_id",
    ),
)
def _numeric(t):
    rows = clean.coerce_numeric(t.dirty, DIRTY)
    return rows.groupBy("rec_id").agg(
        F.sum("amount").alias("amount"), F.max("score").alias("score"), F.min("share").alias("share")
    )


@query(
    "cln4_numeric_coercions",
    _long(
        DIRTY_SQL,
        "score amount share",
        "count_if({c} IS NOT NULL AND TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL)",
        "dirty",
    ),
)
def _numeric_coerced(t):
    return clean.numeric_coercions(t.dirty, DIRTY)


@query("cln5_missing_counts", _long(TYPED_SQL, "rec_id kind owner", "count_if({c} IS NULL)", "typed"))
def _missing(t):
    return clean.missing_counts(clean.standardize_text(t.dirty, DIRTY), DIRTY)


@query("cln5_complete_rows", f"WITH {TYPED_SQL} SELECT kind, count(*) AS n FROM named GROUP BY kind")
def _complete(t):
    rows = clean.drop_missing(clean.standardize_text(t.dirty, DIRTY), DIRTY)
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def _named(t):
    rows = clean.standardize_text(t.dirty, DIRTY)
    return clean.drop_missing(clean.coerce_numeric(rows, DIRTY), DIRTY)


@query(
    "cln6_invalid_counts",
    f"""WITH {TYPED_SQL}
SELECT 'share' AS "column", CAST(count_if(NOT share BETWEEN 0 AND 1) AS BIGINT) AS value FROM named
UNION ALL SELECT 'amount', CAST(count_if(amount <= 0) AS BIGINT) FROM named
UNION ALL SELECT 'score', CAST(count_if(NOT score BETWEEN 0 AND 100) AS BIGINT) FROM named""",
)
def _invalid(t):
    return clean.invalid_counts(_named(t), DIRTY)


@query(
    "cln6_valid_rows",
    outer(
        TYPED_SQL,
        "rec_id n scored",
        "amount",
        "SELECT rec_id, count(*) AS n, count(score) AS scored, sum(amount) AS amount FROM kept GROUP BY rec_id",
    ),
)
def _valid(t):
    rows = clean.remove_invalid(_named(t), DIRTY)
    return rows.groupBy("rec_id").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("amount").alias("amount")
    )


ITEM_ORDER = "l_extendedprice DESC, l_discount, l_quantity, l_tax, line_group"


@query(
    "cln7_dedup_best_row",
    outer(
        ITEMS_SQL,
        "l_orderkey l_linenumber line_group",
        "l_quantity l_extendedprice l_discount l_tax",
        f"""SELECT * FROM items QUALIFY row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY {ITEM_ORDER}) = 1""",
    ),
)
def _dedup(t):
    return clean.deduplicate(t.items, ITEMS)


DISTINCT_SQL = """SELECT CAST((SELECT count(*) FROM kept) AS BIGINT) AS "rows",
  CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM kept)) AS BIGINT) AS distinct_rows,
  CAST((SELECT count(*) FROM (SELECT DISTINCT rec_id FROM kept)) AS BIGINT) AS distinct_keys"""


@query("cln7_duplicate_counts", f"WITH {TYPED_SQL} {DISTINCT_SQL}")
def _duplicate_counts(t):
    return clean.duplicate_counts(clean.clean_rows(t.dirty, DIRTY), DIRTY)


FILLED = " + ".join(
    f"CAST({c} IS NOT NULL AS INTEGER)" for c in "rec_id kind owner note flag amount score share".split()
)


@query(
    "cln8_clean_table",
    outer(
        TYPED_SQL,
        "rec_id kind owner note flag",
        "amount score share",
        f"""SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY {FILLED} DESC,
        coalesce(score, -1) DESC, amount NULLS LAST, flag NULLS LAST, kind NULLS LAST, note NULLS LAST,
        owner NULLS LAST, share NULLS LAST) = 1""",
    ),
)
def _clean(t):
    return clean.clean_data(t.dirty, DIRTY)


def _report_sql() -> str:
    n = {
        k: f"(SELECT count(*) FROM {v})"
        for k, v in {
            "in": "dirty",
            "named": "named",
            "kept": "kept",
            "rows": "(SELECT DISTINCT * FROM kept)",
            "keys": "(SELECT DISTINCT rec_id FROM kept)",
        }.items()
    }
    flat = {
        "input_rows": n["in"],
        "output_rows": n["keys"],
        "rows_removed_total": f"{n['in']} - {n['keys']}",
        "index_columns_removed": "0",
        "flag_values_coerced_to_missing": "(SELECT count_if(flag = ' maybe ') FROM dirty)",
        "rows_removed_for_missing_values": f"{n['in']} - {n['named']}",
        "rows_removed_for_invalid_values": f"{n['named']} - {n['kept']}",
        "rows_removed_for_duplicates": f"{n['kept']} - {n['keys']}",
        "duplicate_rows_removed": f"{n['kept']} - {n['rows']}",
        "duplicate_keys_removed": f"{n['rows']} - {n['keys']}",
    }
    parts = [("total", s, e) for s, e in flat.items()]
    for c in ("rec_id", "kind", "owner", "note"):
        parts.append((c, "blank_text_values", f"(SELECT count_if(trim({c}) = '') FROM dirty)"))
    for c in ("score", "amount", "share"):
        lost = f"count_if({c} IS NOT NULL AND TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL)"
        parts.append((c, "numeric_values_coerced_to_missing", f"(SELECT {lost} FROM dirty)"))
    for c in ("rec_id", "kind", "owner"):
        parts.append((c, "missing_values_before_drop", f"(SELECT count_if({c} IS NULL) FROM typed)"))
    for c, bad in (
        ("share", "NOT share BETWEEN 0 AND 1"),
        ("amount", "amount <= 0"),
        ("score", "NOT score BETWEEN 0 AND 100"),
    ):
        parts.append((c, "invalid_values_detected", f"(SELECT count_if({bad}) FROM named)"))
    rows = [
        f"SELECT '{s}' AS section, '{c}' AS \"column\", CAST({e} AS BIGINT) AS value" for c, s, e in parts
    ]
    return f"WITH {TYPED_SQL}\n" + "\nUNION ALL ".join(rows)


@query("cln8_clean_report", _report_sql())
def _clean_report(t):
    return clean.clean_report(t.dirty, DIRTY)


@query(
    "cln9_clean_csv",
    outer(
        TYPED_SQL,
        "rec_id kind n",
        "amount",
        """SELECT rec_id, kind, count(*) AS n, sum(amount) AS amount FROM (
        SELECT rec_id, kind, amount FROM kept QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY """
        + FILLED
        + """ DESC, coalesce(score, -1) DESC, amount NULLS LAST, flag NULLS LAST, kind NULLS LAST,
        note NULLS LAST, owner NULLS LAST, share NULLS LAST) = 1) GROUP BY rec_id, kind""",
    ),
)
def _clean_csv(t):
    path = scratch(t.spark)
    t.dirty.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    cleaned, _ = runs.run_cleaning(t.spark, path, DIRTY)
    return cleaned.groupBy("rec_id", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


# validation ------------------------------------------------------------------


def _typed_rows(t):
    return clean.typed_rows(t.dirty, DIRTY)


@query(
    "val1_extra_columns",
    "SELECT 'is_large' AS extra UNION ALL SELECT 'p_partkey'",
)
def _extra(t):
    spec = PARTS.with_roles(flag=None)
    extra = validate.validate_schema(t.catalogue, spec)
    return t.spark.createDataFrame([(c,) for c in extra], "extra string")


VIOLATIONS = f"""WITH {TYPED_SQL}
SELECT 'share' AS "column", CAST(count_if(NOT share BETWEEN 0 AND 1) AS BIGINT) AS value FROM typed
UNION ALL SELECT 'amount', CAST(count_if(amount <= 0) AS BIGINT) FROM typed"""


@query("val3_range_violations", VIOLATIONS)
def _violations(t):
    return validate.range_violations(_typed_rows(t), DIRTY)


@query(
    "val4_duplicates",
    f"""WITH {TYPED_SQL} SELECT (SELECT count(*) FROM typed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed))
    AS duplicate_rows, (SELECT count(*) FROM typed) - (SELECT count(*) FROM (SELECT DISTINCT rec_id FROM typed))
    AS duplicate_keys""",
)
def _dups(t):
    return validate.duplicates(_typed_rows(t), DIRTY)


@query(
    "val5_inconsistent_keys",
    f"""WITH {ITEMS_SQL} SELECT count(*) AS inconsistent_keys FROM (
    SELECT l_orderkey, l_linenumber FROM items GROUP BY ALL HAVING count(DISTINCT l_quantity) > 1
    OR count(DISTINCT l_discount) > 1 OR count(DISTINCT l_tax) > 1 OR count(DISTINCT l_extendedprice) > 1)""",
)
def _inconsistent(t):
    return validate.count_inconsistent(t.items, ITEMS)


@query(
    "val6_pair_correlation",
    outer(
        "",
        "feature_a feature_b is_weak",
        "r threshold",
        """SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b,
        corr(l_quantity, l_extendedprice) AS r, CAST(0.5 AS DOUBLE) AS threshold,
        corr(l_quantity, l_extendedprice) < 0.5 AS is_weak FROM lineitem""",
    ),
)
def _pair(t):
    return validate.pair_correlation(t.items, ITEMS)


TYPED_COLUMNS = "rec_id kind owner note flag amount score share"


@query("val7_missing_summary", _long(TYPED_SQL, TYPED_COLUMNS, "count_if({c} IS NULL)", "typed"))
def _missing_summary(t):
    return validate.missing_summary(_typed_rows(t))


def _validation_sql() -> str:
    keys = "(SELECT count(DISTINCT rec_id) FROM typed)"
    rows = "(SELECT count(*) FROM typed)"
    differ = """(SELECT count(*) FROM (SELECT rec_id FROM typed WHERE rec_id IS NOT NULL GROUP BY rec_id
      HAVING count(DISTINCT amount) > 1 OR count(DISTINCT share) > 1))"""
    parts = [
        ("num_rows", "total", rows),
        ("num_columns", "total", "8"),
        ("duplicate_rows", "total", f"{rows} - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed))"),
        ("duplicate_keys", "total", f"{rows} - (SELECT count(*) FROM (SELECT DISTINCT rec_id FROM typed))"),
        ("unique_keys", "total", keys),
        ("inconsistent_keys", "total", differ),
        ("range_violations", "share", "(SELECT count_if(NOT share BETWEEN 0 AND 1) FROM typed)"),
        ("range_violations", "amount", "(SELECT count_if(amount <= 0) FROM typed)"),
    ]
    parts += [
        ("missing_values", c, f"(SELECT count_if({c} IS NULL) FROM typed)") for c in TYPED_COLUMNS.split()
    ]
    each = [
        f"SELECT '{s}' AS section, '{c}' AS \"column\", CAST({e} AS BIGINT) AS value" for s, c, e in parts
    ]
    return f"WITH {TYPED_SQL}\n" + "\nUNION ALL ".join(each)


@query("val8_validation_report", _validation_sql())
def _validation(t):
    return validate.validation_report(_typed_rows(t), DIRTY)


# profiling -------------------------------------------------------------------


@query(
    "sum1_shape",
    """SELECT 'rows' AS section, 'total' AS "column", (SELECT count(*) FROM orders) AS value
UNION ALL SELECT 'columns', 'total', CAST(6 AS BIGINT)
UNION ALL SELECT 'dtype', unnest(['bigint', 'double', 'string', 'timestamp_ntz']), unnest([2, 1, 2, 1]::BIGINT[])
UNION ALL SELECT 'position', unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate',
  'o_orderpriority']), unnest([0, 1, 2, 3, 4, 5]::BIGINT[])""",
)
def _shape(t):
    return profile.describe_shape(t.orders)


def _moments(table: str, columns: str) -> str:
    each = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
        CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
        quantile_cont({c}, 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max, skewness({c}) AS skewness,
        kurtosis({c}) AS kurtosis FROM {table}"""
        for c in columns.split()
    ]
    return "\nUNION ALL ".join(each)


STATS = "mean std min q1 median q3 max skewness kurtosis"
ITEM_COLUMNS = "l_extendedprice l_quantity l_discount l_tax"


@query("sum2_describe_numeric", outer(ITEMS_SQL, '"column" count', STATS, _moments("items", ITEM_COLUMNS)))
def _describe(t):
    return profile.describe_numeric(t.items, spec=ITEMS)


@query("sum2_describe_numeric_events", outer("", '"column" count', STATS, _moments("events", "user_id value")))
def _describe_events(t):
    return profile.describe_numeric(t.events, spec=EVENTS)


def _top_values(table: str, columns: str, n: int) -> str:
    each = [
        f"""SELECT '{c}' AS "column", count(*) OVER () AS num_unique,
        row_number() OVER (ORDER BY n DESC, v) AS rank, v AS value, n AS count
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})
        QUALIFY rank <= {n}"""
        for c in columns.split()
    ]
    return "\nUNION ALL ".join(each)


@query(
    "sum3_describe_categorical", f"WITH {PARTS_SQL}\n" + _top_values("catalogue", "p_type p_brand is_large", 10)
)
def _categorical(t):
    return profile.describe_categorical(t.catalogue, spec=PARTS)


@query(
    "sum4_describe_missing",
    f"WITH {TYPED_SQL}\n"
    + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count_if({c} IS NULL) AS BIGINT) AS count,
        {sql_round("round_even(count_if(" + c + " IS NULL) * 100::DOUBLE / count(*), 2)")} AS percentage FROM typed"""
        for c in TYPED_COLUMNS.split()
    ),
)
def _describe_missing(t):
    return profile.describe_missing(_typed_rows(t))


def _fences(table: str, columns: str) -> str:
    each = [
        f"""SELECT '{c}' AS "column", CAST(count_if({c} < lo OR {c} > hi) AS BIGINT) AS count,
        round_even(count_if({c} < lo OR {c} > hi) * 100::DOUBLE / count({c}), 2) AS percentage,
        round_even(any_value(lo), 4) AS lower_bound, round_even(any_value(hi), 4) AS upper_bound
        FROM {table}, (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM (
          SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}))"""
        for c in columns.split()
    ]
    return "\nUNION ALL ".join(each)


BOUNDS = "percentage lower_bound upper_bound"


@query("sum5_iqr_outliers", outer(ITEMS_SQL, '"column" count', BOUNDS, _fences("items", ITEM_COLUMNS)))
def _outliers(t):
    return profile.detect_outliers(t.items, spec=ITEMS)


@query(
    "sum5_iqr_outliers_events",
    outer(
        "sevenths AS (SELECT user_id, value / 7 AS value FROM events)",
        '"column" count',
        BOUNDS,
        _fences("sevenths", "user_id value"),
    ),
)
def _outliers_events(t):
    return profile.detect_outliers(t.events.withColumn("value", F.col("value") / 7), spec=EVENTS)


def correlation_cells(table: str, columns: list[str]) -> str:
    each = []
    for a in columns:
        for b in columns:
            r = "CAST(1 AS DOUBLE)" if a == b else f"corr({a}, {b})"
            each.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r} AS r FROM {table}")
    each = [s + " GROUP BY ()" if "corr" not in s else s for s in each]
    return "\nUNION ALL ".join(each)


@query(
    "sum6_correlation_matrix",
    outer(ITEMS_SQL, "feature_a feature_b", "r", correlation_cells("items", ITEM_COLUMNS.split())),
)
def _matrix(t):
    return profile.correlation_matrix(t.items, ITEM_COLUMNS.split(), ITEMS)


@query(
    "sum7_target_correlations",
    outer(
        ITEMS_SQL,
        "feature",
        "correlation",
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, round_even(corr({c}, l_extendedprice), 4) AS correlation FROM items"
            for c in ("l_quantity", "l_discount", "l_tax")
        ),
    ),
)
def _target(t):
    return profile.target_correlations(t.items, spec=ITEMS)


@query(
    "sum8_category_summary",
    outer(
        ITEMS_SQL,
        "line_group l_quantity_count l_discount_count l_tax_count",
        "l_quantity_mean l_quantity_std l_discount_mean l_discount_std l_tax_mean l_tax_std",
        "SELECT line_group, "
        + ", ".join(
            f"count({c}) AS {c}_count, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std"
            for c in ("l_quantity", "l_discount", "l_tax")
        )
        + " FROM items GROUP BY line_group",
    ),
)
def _category(t):
    return profile.category_summary(t.items, spec=ITEMS)


@query(
    "sum9_tier_pivot",
    """SELECT event_type, CAST(count_if(value BETWEEN 0 AND 25) AS BIGINT) AS "Low",
CAST(count_if(value > 25 AND value <= 50) AS BIGINT) AS "Medium",
CAST(count_if(value > 50 AND value <= 75) AS BIGINT) AS "High",
CAST(count_if(value > 75 AND value <= 100) AS BIGINT) AS "Very High" FROM events GROUP BY event_type""",
)
def _pivot(t):
    spec = EVENTS.with_roles(target="value", features=("user_id",))
    return profile.tier_pivot(t.events, spec=spec)


@query("sum11_nonzero_entries", f"WITH nz AS ({VIOLATIONS}) SELECT * FROM nz WHERE value > 0")
def _nonzero(t):
    return validate.nonzero(validate.range_violations(_typed_rows(t), DIRTY))


@query("sum10_all_tables")
def _all(t):
    """Row count of every profile table of the catalogue, which is joined once for all of them."""
    tables = profile.summarize(cut_lineage(t.catalogue), PARTS)
    parts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(k)) for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

