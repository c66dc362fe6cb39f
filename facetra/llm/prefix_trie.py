"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns get their place in a conversation from one range sort and the row counts of its
partitions, so that a conversation with a third of all turns is many tasks. A node is a
distinct sequence of first turns; its key is two 64-bit sums (exclusive or) of hashes of
(place, MD5 of the turn), so two sequences share a key by accident with a probability of
about (nodes squared) / 2^129.

Subtree totals come from rounds of joins. A round rakes all leaves into their parents and
compresses chains: of nodes with a single child, those whose depth has its lowest one bit at
the place of the round are cut out, so a chain halves every round. The child of such a node
then hands on what the node held. At the end, rounds are undone last to first, and each
node cut out takes its total from that child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, written

GROUP = 20  # conversations that share a base
HEADS = 4  # a rebuilt conversation takes fewer turns than this from its base
CHUNK = 4_096  # turns, or ids, handled in one step
HOT, HOT_KEYS = 20_000, 50_000
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_in_place(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``part``, ``place``, ``digest``, ``words`` in the order of turns, written."""
    rows = df.select(
        column(conv).cast("long").alias("conv"),
        column(turn).alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
    ).filter("conv is not null")
    # Equal rows are told apart by where they were read, so that they can lie in several partitions.
    rows = rows.withColumn("read", F.monotonically_increasing_id())
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text", "read"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    place = F.monotonically_increasing_id()
    rows = written(rows.select("conv", place.alias("place"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    return rows.withColumn("part", F.shiftright("place", 33))


def _capped(value: Column) -> Column:
    return F.least(value, F.lit(HEADS - 1)).cast("long")


def rebuilt(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations, and the conversations.

    Conversation c is the first h turns of conversation c - c mod 20 and then its own after its
    first h; h is the CRC-32 of its decimal digits, modulo 4. Turns: ``conv``, ``depth`` from
    1, ``digest``, ``words``, ``length`` (turns of the whole). Conversations: ``conv``, ``length``.
    """
    rows = turns_in_place(df, conv, turn, role, text)
    parts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "parts")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = F.col("conv") - F.pmod("conv", F.lit(GROUP))
    convs = parts.groupBy("conv").agg(F.sum("n").alias("own")).withColumns({"h": h, "base": base})
    bases = convs.select(F.col("conv").alias("base"), _capped(F.col("own")).alias("heads"))
    convs = convs.join(bases, "base", "left").withColumn("borrowed", F.least("h", F.coalesce("heads", F.lit(0))))
    convs = convs.withColumn("length", F.col("borrowed") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = written(convs.select("conv", "base", "h", "borrowed", "length"), "conversations")
    parts = parts.join(convs, "conv")
    placed = rows.join(parts, ["conv", "part"]).withColumn("at", F.col("place") - F.col("first") + F.col("before") + 1)
    own = placed.filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("borrowed")).alias("depth"), "digest", "words", "length")
    heads = placed.filter((F.col("conv") == F.col("base")) & (F.col("at") < HEADS)).select("base", F.col("at").alias("depth"), "digest", "words")
    lent = convs.join(heads, "base").filter("depth <= h").select("conv", "depth", "digest", "words", "length")
    return written(own.unionByName(lent), "rebuilt"), convs.select("conv", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every first-d-turns sequence of every conversation: ``conv``, ``depth``, key ``x``, ``y``, parent's key, ``words``, ``last``."""
    turns = turns.withColumns(
        {
            "hx": F.xxhash64("depth", "digest"),
            "hy": F.xxhash64("digest", "depth", F.lit(1)),
            "chunk": F.floor((F.col("depth") - 1) / CHUNK),
        }
    )
    so_far = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = turns.filter(F.col("length") > CHUNK).groupBy("conv", "chunk").agg(F.bit_xor("hx").alias("sx"), F.bit_xor("hy").alias("sy"))
    carried = long_ones.select("conv", "chunk", F.bit_xor("sx").over(earlier).alias("cx"), F.bit_xor("sy").over(earlier).alias("cy"))
    rows = turns.withColumns({"x": F.bit_xor("hx").over(so_far), "y": F.bit_xor("hy").over(so_far)}).join(carried, ["conv", "chunk"], "left")
    rows = rows.withColumns({"x": F.col("x").bitwiseXOR(F.coalesce("cx", F.lit(0))), "y": F.col("y").bitwiseXOR(F.coalesce("cy", F.lit(0)))})
    rows = rows.select(
        "conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "words", (F.col("depth") == F.col("length")).alias("last")
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    return written(rows.unionByName(roots), "prefixes")


def looked_up(rows: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """``rows`` (key ``px``, ``py``, own key ``x``, ``y``) with the columns of ``values`` (key ``x``, ``y``, ``uses``).

    A key used by more than ``HOT`` rows, or 1/50,000 of all ``n``, is split among salts. At most
    50,000 keys can be, so their list is broadcast; a row picks its salt by its own key.
    """
    most = max(HOT, n // HOT_KEYS)
    salts = F.greatest(F.lit(1), F.ceil(F.col("uses") / most))
    hot = values.filter(F.col("uses") > most).select(F.col("x").alias("px"), F.col("y").alias("py"), salts.alias("salts"))
    salted = rows.join(F.broadcast(hot), ["px", "py"], "left").withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.coalesce("salts", F.lit(1)))).drop("salts")
    every = values.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("uses")
    return salted.join(every.withColumnsRenamed({"x": "px", "y": "py"}), ["px", "py", "salt"], "left").drop("salt")


def contracted(nodes: DataFrame, deepest: int) -> DataFrame:
    """``x``, ``y``, ``leaves``, ``saved``: totals over the subtree of every node.

    ``nodes``: ``x``, ``y``, parent's ``px``, ``py`` (null at the root), ``depth``, ``leaves``,
    ``saved``. A row of the tree in hand holds what was raked into it, and in ``up_leaves``,
    ``up_saved`` what nodes cut out between it and its parent held.
    """
    zero = F.lit(0).cast("long")
    tree = nodes.withColumns({"up_leaves": zero, "up_saved": zero})
    bits = max(1, int(deepest).bit_length())
    raked: list[DataFrame] = []
    cut: list[DataFrame] = []
    round_ = 0
    while True:
        kids = tree.filter("px is not null").groupBy("px", "py").agg(F.count(F.lit(1)).alias("kids"), F.min(F.struct("x", "y")).alias("kid"))
        tree = tree.join(kids.withColumnsRenamed({"px": "x", "py": "y"}), ["x", "y"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        bit = 1 << (round_ % bits)
        turn = F.col("depth").bitwiseAND(F.lit(2 * bit - 1)) == bit
        tree = written(tree.withColumn("chosen", (F.col("kids") == 1) & F.col("px").isNotNull() & turn), "tree")
        leaves, inner = tree.filter("kids = 0"), tree.filter("kids > 0")
        raked.append(leaves.select("x", "y", "leaves", "saved"))
        if inner.limit(1).count() == 0:
            break
        given = leaves.groupBy("px", "py").agg(F.sum(F.col("leaves") + F.col("up_leaves")).alias("more_leaves"), F.sum(F.col("saved") + F.col("up_saved")).alias("more_saved"))
        inner = inner.join(given.withColumnsRenamed({"px": "x", "py": "y"}), ["x", "y"], "left")
        inner = inner.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
        # The child of a chosen node stays: it is inner, and not chosen itself.
        above = inner.filter("chosen").select(
            F.col("kid.x").alias("x"), F.col("kid.y").alias("y"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("px").alias("qx"), F.col("py").alias("qy"),
            *[F.col(c).alias(f"v_{c}") for c in ("leaves", "saved", "up_leaves", "up_saved")],
        )
        below = inner.filter("not chosen").select("x", "y", "up_leaves", "up_saved")
        out = written(above.join(below, ["x", "y"]), "cut")
        if out.limit(1).count():
            cut.append(out)
            gone = out.select(F.col("vx").alias("x"), F.col("vy").alias("y"))
            inner = inner.join(gone, ["x", "y"], "left_anti")
            inner = inner.join(out.drop("up_leaves", "up_saved"), ["x", "y"], "left")
            moved = F.col("vx").isNotNull()
            changes = {f"up_{c}": F.col(f"up_{c}") + F.when(moved, F.col(f"v_{c}") + F.col(f"v_up_{c}")).otherwise(0) for c in ("leaves", "saved")}
            inner = inner.withColumns({"px": F.when(moved, F.col("qx")).otherwise(F.col("px")), "py": F.when(moved, F.col("qy")).otherwise(F.col("py")), **changes})
        tree = inner.select("x", "y", "px", "py", "depth", "leaves", "saved", "up_leaves", "up_saved")
        round_ += 1
    known = raked[0]
    for more in raked[1:]:
        known = known.unionByName(more)
    for out in reversed(cut):
        back = out.join(known, ["x", "y"])
        again = back.select(F.col("vx").alias("x"), F.col("vy").alias("y"), *[(F.col(f"v_{c}") + F.col(f"up_{c}") + F.col(c)).alias(c) for c in ("leaves", "saved")])
        known = known.unionByName(written(again, "undone"))
    return known


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Runs of equal ``x``, ``y`` in each batch: the key, and the values of ``names``."""
    for batch in batches:
        x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
        if not len(x):
            continue
        cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        values = [batch.column(c).to_pylist() for c in names]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
            yield (int(x[a]), int(y[a])), *[v[a:b] for v in values]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, ids in _groups(batches, "conv"):
        at = range(0, len(ids), CHUNK)
        lines = [",".join(map(str, ids[i : i + CHUNK])) for i in at]
        columns = [[key[0]] * len(lines), [key[1]] * len(lines), [ids[i] for i in at]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(lines)], names=["x", "y", "first", "line"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, state):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["x", "y", "sha"])

    key = state = None
    for now, lines in _groups(batches, "line"):
        if now != key:
            if state:
                yield row(key, state)
            key, state = now, hashlib.sha256(lines[0].encode())
            lines = lines[1:]
        for line in lines:
            state.update(b"," + line.encode())
    if state:
        yield row(key, state)


def end_digests(ends: DataFrame) -> DataFrame:
    """``x``, ``y``, ``sha``: SHA-256 of the ids ``conv`` of each key, ascending, with commas between.

    Ids are sorted and joined in range partitions, by ``CHUNK`` a line; the task of a key then reads its
    lines in order and holds one line and the state of the digest.
    """
    lines = ends.select("x", "y", "conv").repartitionByRange("x", "y", "conv").sortWithinPartitions("x", "y", "conv")
    lines = lines.mapInArrow(_lines, "x long, y long, first long, line string")
    lines = lines.repartition("x", "y").sortWithinPartitions("x", "y", "first")
    return lines.mapInArrow(_hashed, "x long, y long, sha string")


def trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's; null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, (members - 1) times
    words of the last text), all long, and ``ends_sha256`` (of the ids of members that end here).
    Turns go by ``turn`` (null first), ties by role and text; repeated rows are turns of their own; null
    roles and texts are empty; rows without a conversation take no part; ids below 0 count modulo 20
    as Python does; other columns are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    turns, convs = rebuilt(df, conv, turn, role, text)
    paths = prefixes(turns, convs)
    nodes = paths.groupBy("x", "y").agg(
        F.min("depth").alias("depth"), F.min("px").alias("px"), F.min("py").alias("py"),
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
    )
    nodes = written(nodes, "nodes")
    n, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    if n == 0:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    children = nodes.filter("px is not null").groupBy("px", "py").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"px": "x", "py": "y"})
    nodes = nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes, "nodes")
    leaves = (F.col("n_children") == 0).cast("long").alias("leaves")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    totals = contracted(nodes.select("x", "y", "px", "py", "depth", leaves, saved), deepest)
    parents = nodes.filter("n_children > 0").select("x", "y", F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("uses"))
    out = looked_up(nodes, parents, n).join(totals, ["x", "y"]).join(end_digests(paths.filter("last")), ["x", "y"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )
