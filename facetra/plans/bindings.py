"""Role bindings of the test tables, in Spark and as SQL for the checks."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import shared_folder
from ..spec import FeatureSpec

ITEMS = FeatureSpec(
    key=("l_orderkey", "l_linenumber"),
    category="line_group",
    target="l_extendedprice",
    features=("l_quantity", "l_discount", "l_tax"),
    numeric=("l_extendedprice", "l_quantity", "l_discount", "l_tax"),
    bounded=("l_discount", "l_tax"),
    positive=("l_quantity", "l_extendedprice"),
    consistent=("l_quantity", "l_discount", "l_tax", "l_extendedprice"),
    weak_pair=("l_quantity", "l_extendedprice"),
)
EVENTS = FeatureSpec(
    key=("event_id",),
    category="event_type",
    target="user_id",
    features=("value",),
    numeric=("user_id", "value"),
)
PARTS = FeatureSpec(
    key=("p_partkey",),
    name="p_name",
    owner="p_brand",
    category="p_type",
    target="demand",
    flag="is_large",
    size="total_quantity",
    features=("p_size", "p_retailprice", "avg_quantity", "avg_discount", "avg_tax"),
    codes=("n_lines",),
    text=("p_name", "p_brand", "p_type"),
    required_text=("p_name", "p_brand", "p_type"),
    numeric=(
        "demand",
        "total_quantity",
        "p_size",
        "p_retailprice",
        "avg_quantity",
        "avg_discount",
        "avg_tax",
        "n_lines",
    ),
    required_numeric=("p_size", "p_retailprice"),
    bounded=("avg_discount", "avg_tax"),
    positive=("p_size", "p_retailprice"),
    weak_pair=("avg_quantity", "demand"),
    category_aliases=("type",),
)
DIRTY = FeatureSpec(
    key=("rec_id",),
    name="note",
    owner="owner",
    category="kind",
    target="score",
    flag="flag",
    features=("amount", "share"),
    text=("rec_id", "kind", "owner", "note"),
    required_text=("rec_id", "kind", "owner"),
    numeric=("score", "amount", "share"),
    required_numeric=("amount", "share"),
    bounded=("share",),
    positive=("amount",),
    consistent=("amount", "share"),
    weak_pair=("amount", "share"),
)
DIMS = 64
VECTORS = FeatureSpec(
    key=("vec_id",),
    category="label",
    target="e0",
    features=tuple(f"e{i}" for i in range(DIMS)),
    numeric=tuple(f"e{i}" for i in range(DIMS)),
)

ITEMS_SQL = """items AS (
  SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS line_group,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""

PARTS_SQL = """catalogue AS (
  SELECT p_partkey, p_name, p_brand, p_type, p_size >= 25 AS is_large, CAST(p_size AS DOUBLE) AS p_size,
         p_retailprice, avg_quantity, avg_discount, avg_tax, total_quantity, n_lines, demand
  FROM part JOIN (
    SELECT l_partkey, round(avg(l_quantity) + CAST(1e-9 AS DOUBLE), 6) AS avg_quantity, round(avg(l_discount) + CAST(1e-9 AS DOUBLE), 6) AS avg_discount,
           round(avg(l_tax) + CAST(1e-9 AS DOUBLE), 6) AS avg_tax, sum(l_quantity) AS total_quantity,
           CAST(count(*) AS DOUBLE) AS n_lines, round(avg(l_extendedprice) / 1000 + CAST(1e-9 AS DOUBLE), 2) AS demand
    FROM lineitem GROUP BY l_partkey) s ON p_partkey = l_partkey)"""

DIRTY_SQL = """base AS (
  SELECT event_id, event_type, user_id, value FROM events
  UNION ALL SELECT event_id, event_type, user_id, value FROM events WHERE event_id % 17 = 0),
dirty AS (
  SELECT CASE WHEN event_id % 101 <> 0 THEN 'E' || CAST(event_id - event_id % 3 AS VARCHAR) END AS rec_id,
         CASE WHEN event_id % 7 = 0 THEN '   ' WHEN event_id % 5 = 0 THEN '  ' || event_type || ' '
              ELSE event_type END AS kind,
         CASE WHEN event_id % 53 <> 0 THEN 'user ' || CAST(user_id AS VARCHAR) END AS owner,
         CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' n' || CAST(event_id % 10 AS VARCHAR) END AS note,
         CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN ' maybe ' END AS flag,
         CASE WHEN event_id % 11 = 0 THEN 'n/a'
              WHEN event_id % 13 = 0 THEN '-' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)
              WHEN event_id % 19 <> 0 THEN ' ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS amount,
         CASE WHEN event_id % 29 = 0 THEN 'broken' ELSE CAST(event_id % 130 AS VARCHAR) END AS score,
         value / 400 AS share FROM base)"""

TYPED_SQL = (
    DIRTY_SQL
    + """,
typed AS (
  SELECT nullif(trim(rec_id), '') AS rec_id, nullif(trim(kind), '') AS kind, nullif(trim(owner), '') AS owner,
         nullif(trim(note), '') AS note,
         CASE WHEN lower(trim(flag)) IN ('true', 't', '1', 'yes') THEN true
              WHEN lower(trim(flag)) IN ('false', 'f', '0', 'no') THEN false END AS flag,
         TRY_CAST(trim(amount) AS DOUBLE) AS amount, TRY_CAST(trim(score) AS DOUBLE) AS score, share
  FROM dirty),
named AS (SELECT * FROM typed WHERE rec_id IS NOT NULL AND kind IS NOT NULL AND owner IS NOT NULL),
ranged AS (
  SELECT rec_id, kind, owner, note, flag, CASE WHEN amount > 0 THEN amount END AS amount,
         CASE WHEN score BETWEEN 0 AND 100 THEN score END AS score,
         CASE WHEN share BETWEEN 0 AND 1 THEN share END AS share FROM named),
kept AS (SELECT * FROM ranged WHERE amount IS NOT NULL AND share IS NOT NULL)"""
)

VECTORS_SQL = (
    "vectors AS (SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(DIMS))
    + " FROM embeddings)"
)


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/facetra-{uuid.uuid4().hex}"


class Tables:
    """The test tables under one folder and the views bound to roles."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        return self.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            F.concat("l_returnflag", "l_linestatus").alias("line_group"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        lines = self.lineitem.groupBy("l_partkey").agg(
            F.round(F.avg("l_quantity") + F.lit(1e-9), 6).alias("avg_quantity"),
            F.round(F.avg("l_discount") + F.lit(1e-9), 6).alias("avg_discount"),
            F.round(F.avg("l_tax") + F.lit(1e-9), 6).alias("avg_tax"),
            F.sum("l_quantity").alias("total_quantity"),
            F.count("*").cast("double").alias("n_lines"),
            F.round(F.avg("l_extendedprice") / 1000 + F.lit(1e-9), 2).alias("demand"),
        )
        return self.part.join(lines, F.col("p_partkey") == F.col("l_partkey")).select(
            "p_partkey",
            "p_name",
            "p_brand",
            "p_type",
            (F.col("p_size") >= 25).alias("is_large"),
            F.col("p_size").cast("double").alias("p_size"),
            "p_retailprice",
            "avg_quantity",
            "avg_discount",
            "avg_tax",
            "total_quantity",
            "n_lines",
            "demand",
        )

    @cached_property
    def dirty(self) -> DataFrame:
        rows = self.events.select("event_id", "event_type", "user_id", "value")
        rows = rows.unionByName(rows.filter("event_id % 17 = 0"))
        e = F.col("event_id")
        cents = F.round(F.col("value") * 100).cast("long").cast("string")

        def at(n, v=0):
            return e % n == v

        flag = F.when(at(5), "TRUE").when(at(5, 1), "no").when(at(5, 2), "1").when(at(5, 3), " maybe ")
        return rows.select(
            F.when(~at(101), F.concat(F.lit("E"), (e - e % 3).cast("string"))).alias("rec_id"),
            F.when(at(7), "   ")
            .when(at(5), F.concat(F.lit("  "), "event_type", F.lit(" ")))
            .otherwise(F.col("event_type"))
            .alias("kind"),
            F.when(~at(53), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("owner"),
            F.when(at(4), "  ").otherwise(F.concat(F.lit(" n"), (e % 10).cast("string"))).alias("note"),
            flag.alias("flag"),
            F.when(at(11), "n/a")
            .when(at(13), F.concat(F.lit("-"), cents))
            .when(~at(19), F.concat(F.lit(" "), cents))
            .alias("amount"),
            F.when(at(29), "broken").otherwise((e % 130).cast("string")).alias("score"),
            (F.col("value") / 400).alias("share"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        dims = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)]
        return self.embeddings.select("vec_id", "label", *dims)

    @cached_property
    def liked(self) -> DataFrame:
        """Parts bought by the customer with the most lines (lowest key on ties)."""
        bought = self.lineitem.join(
            self.orders, F.col("l_orderkey") == F.col("o_orderkey")
        ).select("o_custkey", "l_partkey")
        lines = bought.groupBy("o_custkey").agg(F.count("*").alias("n"))
        top = lines.orderBy(F.desc("n"), "o_custkey").limit(1).first()["o_custkey"]
        return (
            bought.filter(F.col("o_custkey") == top).select(F.col("l_partkey").alias("p_partkey")).distinct()
        )


LIKED_SQL = """buyer AS (
  SELECT o_custkey AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1),
liked AS (
  SELECT DISTINCT l_partkey AS p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_custkey = (SELECT top FROM buyer))"""
