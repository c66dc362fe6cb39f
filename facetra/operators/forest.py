"""Forests: in parts of MLlib's own, or grown tree by tree in tasks that hold all rows as bins."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import constants, cut_lineage, shared_folder
from ..functions.trees import Growth, Tree, binned, cut_points, described, grow_tree, leaves, unpacked

# Rows of bins, labels and weights that every task of a fit may hold; larger fits go to MLlib.
MAX_TASK_BYTES = 128 << 20
# Trees that the driver may hold; larger forests stay a table in the shared folder.
MAX_HELD_BYTES = 16 << 20
NODE_BYTES = 16
CUT_ROWS = 10_000  # rows that candidate cuts are found on, as in MLlib
BLOCK_ROWS, TASK_BLOCKS = 8_192, 8  # rows scored at once, and such blocks a task
TABLE = "tree int, feature binary, cut binary, child binary, value binary, importance binary"


class Forest(Model, MLWritable, MLReadable):
    """A forest in parts, each an MLlib model of its own.

    A tree counts alike in whatever part it is: predictions are means over the parts weighted by
    their trees, as are class probabilities and importances.
    """

    def __init__(self, parts: Sequence[Model] = (), prediction: str = "prediction"):
        super().__init__()
        self.parts, self.prediction = list(parts), prediction

    @property
    def trees(self) -> list:
        return [t for p in self.parts for t in p.trees]

    @property
    def classifies(self) -> bool:
        return isinstance(self.parts[0], RandomForestClassificationModel)

    def hasParam(self, paramName: str) -> bool:
        return self.parts[0].hasParam(paramName)

    @property
    def _weights(self) -> list[float]:
        counts = [p.getNumTrees for p in self.parts]
        return [n / sum(counts) for n in counts]

    @property
    def featureImportances(self) -> DenseVector:
        total = sum(w * p.featureImportances.toArray() for w, p in zip(self._weights, self.parts))
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [f"{self.prediction}_of_part_{i}" for i in range(len(self.parts))]
        out = df
        for name, part in zip(names, self.parts):
            part = part.copy().setPredictionCol("" if self.classifies else name)
            if self.classifies:
                part = part.setRawPredictionCol("").setProbabilityCol(name)
            out = part.transform(out)
        if not self.classifies:
            mean = sum((F.col(f"`{n}`") * F.lit(w) for n, w in zip(names[1:], self._weights[1:])), F.col(f"`{names[0]}`") * F.lit(self._weights[0]))
            return out.withColumn(self.prediction, mean).drop(*names)
        classes = self.parts[0].numClasses
        held = [vector_to_array(F.col(f"`{n}`")) for n in names]
        share = [sum((h[c] * F.lit(w) for h, w in zip(held[1:], self._weights[1:])), held[0][c] * F.lit(self._weights[0])) for c in range(classes)]
        return self._judged(out.withColumn("probability", array_to_vector(F.array(*share))).drop(*names))

    def _judged(self, df: DataFrame) -> DataFrame:
        """The class of the largest share, the first one among equal shares."""
        shares = vector_to_array("probability")
        return df.withColumn(self.prediction, (F.array_position(shares, F.array_max(shares)) - 1).cast("double"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    """Parts under the path, then what reads them."""

    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        for i, part in enumerate(self.forest.parts):
            part.write().overwrite().save(f"{path}/part-{i}")
        extra = {"parts": len(self.forest.parts), "prediction": self.forest.prediction, "classifies": self.forest.classifies}
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession, extraMetadata={"forest": extra})


class _ForestReader(MLReader):
    def load(self, path: str) -> Forest:
        found = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        held = found["forest"]
        kind = RandomForestClassificationModel if held["classifies"] else RandomForestRegressionModel
        forest = Forest([kind.load(f"{path}/part-{i}") for i in range(held["parts"])], held["prediction"])
        forest._resetUid(found["uid"])
        return forest


class GrownForest(Forest):
    """A forest whose trees are arrays: a few megabytes on the driver, or a table with one row a tree.

    ``source`` is that table, or the rows of it that the driver holds. Trees of a table are read by the
    tasks that score, each for its blocks of rows, and never pass through the driver.
    """

    def __init__(self, source: list[tuple] | DataFrame, ids: Sequence[int], cuts: Sequence[np.ndarray], bins: int, classes: int, prediction: str, kept: dict):
        Model.__init__(self)
        self.source, self.ids, self.cuts, self.bins, self.classes = source, list(ids), list(cuts), bins, classes
        self.prediction, self.kept = prediction, kept

    @property
    def held(self) -> bool:
        return isinstance(self.source, list)

    @property
    def classifies(self) -> bool:
        return self.classes > 0

    @property
    def numClasses(self) -> int:
        return self.classes

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    @property
    def getNumTrees(self) -> int:
        return len(self.ids)

    def getCacheNodeIds(self) -> bool:
        return self.kept["nodes"]

    def hasParam(self, paramName: str) -> bool:
        return paramName == "predictionCol" or (self.classifies and paramName == "probabilityCol")

    def _only(self, ids: Sequence[int]) -> GrownForest:
        source = [r for r in self.source if r[0] in ids] if self.held else self.source.filter(F.col("tree").isin(list(ids)))
        return GrownForest(source, ids, self.cuts, self.bins, self.classes, self.prediction, self.kept)

    @property
    def parts(self) -> list[GrownForest]:
        n = self.kept["part"]
        return [self._only(self.ids[i : i + n]) for i in range(0, len(self.ids), n)]

    @property
    def trees(self) -> list[GrownForest]:
        return [self._only([i]) for i in self.ids]

    def _rows(self, *columns: str) -> list[tuple]:
        if self.held:
            at = ["tree", *Tree._fields]
            return [tuple(r[at.index(c)] for c in columns) for r in self.source]
        return [tuple(r) for r in self.source.select(*columns).orderBy("tree").collect()]

    @property
    def toDebugString(self) -> str:
        said = [f"GrownForest: uid={self.uid}, trees={len(self.ids)}, features={self.numFeatures}"]
        for number, *parts in self._rows("tree", *Tree._fields):
            said += [f"  Tree {number}:", described(unpacked(parts, self.bins, self.classes), self.cuts)]
        return "\n".join(said)

    @cached_property
    def featureImportances(self) -> DenseVector:
        total = sum(np.frombuffer(v, "float64") for _, v in self._rows("tree", "importance"))
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self._by_closure(df) if self.held else self._by_table(df)
        sums = F.col("_sums")
        if not self.classifies:
            return out.withColumn(self.prediction, sums[0] / F.lit(float(len(self.ids)))).drop("_sums")
        whole = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
        shares = F.transform(sums, lambda v: F.when(whole > 0, v / whole).otherwise(v))
        return self._judged(out.withColumn("probability", array_to_vector(shares)).drop("_sums"))

    def _by_closure(self, df: DataFrame) -> DataFrame:
        """Trees of the driver travel with the function."""
        source, cuts, bins, classes = self.source, self.cuts, self.bins, self.classes

        @F.pandas_udf("array<double>")
        def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = [unpacked(parts, bins, classes) for _, *parts in source]
            for batch in batches:
                table = binned(np.array(batch.tolist(), "float64").reshape(len(batch), -1), cuts, bins) if len(batch) else None
                total = added(trees, table) if len(batch) else []
                yield pd.Series(list(total), dtype="object")

        return df.withColumn("_sums", sums(vector_to_array("features")))

    def _by_table(self, df: DataFrame) -> DataFrame:
        """Blocks of numbered rows meet the trees of the table; one sum a row comes back."""
        cuts, bins, classes = self.cuts, self.bins, self.classes
        held = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        n = held.count()
        tasks = max(1, math.ceil(n / (BLOCK_ROWS * TASK_BLOCKS)))
        packed = held.select("_row", vector_to_array("features").alias("x")).coalesce(tasks)
        blocks = packed.mapInArrow(lambda batches: _blocks(batches, cuts, bins), "ids binary, bins binary")

        def scored(pairs):
            totals: dict[bytes, tuple] = {}
            for block, row in pairs:
                ids = bytes(block.ids)
                tree = unpacked([bytes(v) for v in row[1:]], bins, classes)
                if ids not in totals:
                    table = np.frombuffer(bytes(block.bins), binned(np.empty((0, 0)), [], bins).dtype).reshape(len(ids) // 8, -1)
                    totals[ids] = (table, np.zeros((len(table), max(classes, 1))))
                table, total = totals[ids]
                total += tree.value[leaves(tree, table)]
            return [(ids, total) for ids, (_, total) in totals.items()]

        pairs = blocks.rdd.cartesian(self.source.select("tree", *Tree._fields).rdd).mapPartitions(scored)
        totals = pairs.reduceByKey(lambda a, b: a + b, max(tasks, 1)).map(lambda r: (bytearray(r[0]), bytearray(r[1].tobytes())))
        table = df.sparkSession.createDataFrame(totals, "ids binary, sums binary", verifySchema=False)
        scores = table.mapInArrow(lambda batches: _spread(batches, classes), "_row long, _sums array<double>")
        return held.join(scores, "_row").drop("_row")

    def write(self) -> MLWriter:
        return _GrownWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _GrownReader()


def added(trees: Sequence[Tree], table: np.ndarray) -> np.ndarray:
    """Sums over trees of what they predict for rows of bins."""
    total = np.zeros((len(table), trees[0].value.shape[1]))
    for tree in trees:
        total += tree.value[leaves(tree, table)]
    return total


def _features(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)


def _blocks(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray], bins: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(at, BLOCK_ROWS)
            table = binned(_features(batch.column(1), batch.num_rows), cuts, bins)
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([table.tobytes()], pa.binary())], names=["ids", "bins"])


def _spread(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, sums in zip(*[batch.column(i).to_pylist() for i in range(2)]):
            flat = np.frombuffer(sums, "float64")
            ends = np.arange(0, len(flat) + 1, max(classes, 1), dtype="int32")
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "int64")), rows], names=["_row", "_sums"])


class _GrownWriter(MLWriter):
    """The table of trees under the path, and what it takes to read them."""

    def __init__(self, forest: GrownForest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        f, spark = self.forest, self.sparkSession
        table = spark.createDataFrame(f.source, TABLE) if f.held else f.source
        table.write.mode("overwrite").parquet(f"{path}/trees")
        extra = {"ids": f.ids, "cuts": [c.tolist() for c in f.cuts], "bins": f.bins, "classes": f.classes, "prediction": f.prediction, "kept": f.kept, "held": f.held}
        DefaultParamsWriter.saveMetadata(f, path, spark, extraMetadata={"grown": extra})


class _GrownReader(MLReader):
    def load(self, path: str) -> GrownForest:
        spark = SparkSession.active()
        found = DefaultParamsReader.loadMetadata(path, spark)
        held = found["grown"]
        source = spark.read.schema(TABLE).parquet(f"{path}/trees")
        if held["held"]:
            source = [(t, *map(bytes, parts)) for t, *parts in source.orderBy("tree").collect()]
        cuts = [np.array(c, "float64") for c in held["cuts"]]
        forest = GrownForest(source, held["ids"], cuts, held["bins"], held["classes"], held["prediction"], held["kept"])
        forest._resetUid(found["uid"])
        return forest


def _subset(strategy: str, width: int, trees: int, classifies: bool) -> int:
    """Features tried a node, by MLlib's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classifies else "onethird"
    named = {"all": width, "onethird": width / 3, "sqrt": math.sqrt(width), "log2": max(1.0, math.log2(width))}
    if strategy in named:
        return math.ceil(named[strategy])
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


def _column(values: pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy().astype("float64")


def grow(held: DataFrame, forest, part: int) -> GrownForest | None:
    """``forest`` (an MLlib estimator) over kept rows, one tree a task; None where tasks can't hold the rows.

    Rows are numbers of bins, a byte a feature: 1,000,000 rows of 20 features with their labels are 28 MB. They
    are gathered once and every task that grows trees reads them; seeds follow from the number of the tree.
    """
    spark, label = held.sparkSession, F.col(f"`{forest.getLabelCol()}`").cast("double")
    classifies = isinstance(forest, RandomForestClassifier)
    weighted = forest.isSet("weightCol") and bool(forest.getWeightCol())
    if forest.getImpurity() not in ("gini", "variance"):
        return None
    weight = F.col(f"`{forest.getWeightCol()}`").cast("double") if weighted else F.lit(1.0)
    odd = label.isNull() | F.isnan(label) | weight.isNull() | F.isnan(weight) | (weight < 0)
    if classifies:
        odd = odd | (label < 0) | (label != F.floor(label))
    width = F.max(F.size(vector_to_array("features")))
    got = constants(held, n=F.count("*"), odd=F.count_if(odd), top=F.max(label), width=width, weight=F.sum(weight))
    n, width = got["n"], got["width"]
    if got["odd"]:
        raise ValueError(f"{got['odd']} rows have no label or weight that a forest can be grown on")
    if not n:
        raise ValueError("a forest needs at least one row")
    classes = int(got["top"]) + 1 if classifies else 0
    if classes == 1:
        raise ValueError("a classifier needs rows of at least two classes")
    if n * (width + 8 + 8 * weighted) > MAX_TASK_BYTES:
        return None
    bins = min(forest.getMaxBins(), n)
    numbers = held.select(vector_to_array("features").alias("x"), label.alias("y"), weight.alias("w"))
    share = max(forest.getMaxBins() ** 2, CUT_ROWS) / n
    sample = (numbers if share >= 1 else numbers.sample(False, share, forest.getSeed())).select("x", "w").toArrow()
    if not sample.num_rows:
        sample = numbers.limit(CUT_ROWS).select("x", "w").toArrow()
    x = _features(sample["x"].combine_chunks(), sample.num_rows)
    if not np.isfinite(x).all():
        raise ValueError("features must not be NaN or infinite")
    cuts = [cut_points(x[:, i], _column(sample["w"]), bins) for i in range(width)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _features(batch.column(0), batch.num_rows)
                if not np.isfinite(x).all():
                    raise ValueError("features must not be NaN or infinite")
                parts = [binned(x, cuts, bins), *[batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["x", "y", "w"])

    blocks = numbers.mapInArrow(packed, "x binary, y binary, w binary").toArrow()
    kinds = {"x": binned(x[:0], cuts, bins).dtype, "y": np.dtype("float64"), "w": np.dtype("float64")}
    x, y, w = (np.concatenate([np.frombuffer(b.as_buffer(), kinds[c]) for b in blocks[c]]) for c in ("x", "y", "w"))
    x, y, w = x.reshape(n, width), y.astype("int64") if classifies else y, w if weighted else None
    del blocks
    trees, seed = forest.getNumTrees(), forest.getSeed()
    how = Growth(
        forest.getMaxDepth(),
        forest.getMinInstancesPerNode(),
        forest.getMinWeightFractionPerNode() * got["weight"],
        forest.getMinInfoGain(),
        _subset(forest.getFeatureSubsetStrategy(), width, trees, classifies),
        forest.getBootstrap(),
        forest.getSubsamplingRate(),
        classes,
    )
    rows = spark.sparkContext.broadcast((x, y, w))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w = rows.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                tree = grow_tree(x, y, w, bins, how, np.random.default_rng([seed % 2**63, i]))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([p], pa.binary()) for p in tree.packed]], names=["tree", *Tree._fields])

    table = spark.range(0, trees, 1, trees).mapInArrow(grown, TABLE)
    nodes = min(2 * n, 2 ** (how.depth + 1))
    try:
        if trees * nodes * NODE_BYTES <= MAX_HELD_BYTES:
            source = [(t, *map(bytes, parts)) for t, *parts in sorted(map(tuple, table.collect()))]
        else:
            path = f"{shared_folder(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
            table.write.parquet(path)
            source = spark.read.schema(TABLE).parquet(path)
    finally:
        rows.unpersist()
    kept = {"nodes": forest.getCacheNodeIds(), "part": part}
    return GrownForest(source, range(trees), cuts, bins, classes, forest.getPredictionCol(), kept)


