"""K-means clusters of rows by their scaled features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import key_hash, numbers
from ..functions.scale import FEW_TASKS, compact, constants, side_by_side
from ..spec import TRACKS, FeatureSpec, require_columns

# Search settings.
SAMPLE_ROWS = 2000
RESTARTS = 10
START_THREADS = 5  # starts run side by side
PASS_ROWS = 10_000  # rows of a task of a pass
STRIP_ROWS = 2_048  # rows whose distances to all centres of one number are held at once
MAX_TASK_BYTES = 128 << 20  # rows that every task may hold; larger fits make one pass a move
MAX_ITER = 300
TOLERANCE = 1e-4
NO_CLUSTER = -1


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_columns(df, features)
    return numbers(df, features).na.drop(subset=list(features))


def scaling(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a constant one divides by 1."""
    rows = complete_rows(df, features)
    got = constants(
        rows,
        n=F.count("*"),
        **{f"m_{c}": F.avg(c) for c in features},
        **{f"s_{c}": F.stddev_pop(c) for c in features},
    )
    if not got["n"]:
        raise ValueError("No rows with values for all chosen features.")
    return {c: (got[f"m_{c}"], got[f"s_{c}"] or 1.0) for c in features}


def scale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scaled copies ``<feature>_scaled`` of the complete rows."""
    rows = complete_rows(df, list(scales))
    return rows.withColumns(
        {f"{c}_scaled": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()}
    )


def vectors(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    names = [f"{c}_scaled" for c in scales]
    return VectorAssembler(inputCols=names, outputCol="features").transform(scale(df, scales))


class Clusters(Model, MLWritable, MLReadable):
    """Centres of one k-means fit and its cost; ``prediction`` is the number of the nearest one."""

    def __init__(self, centres: Sequence[Sequence[float]] = (), cost: float = 0.0):
        super().__init__()
        self.centres, self.cost = np.array(centres, dtype="float64"), cost

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        squares = [
            F.aggregate(F.zip_with(x, F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
            for c in self.centres
        ]
        nearest = F.transform(F.array(F.array(*squares)), lambda d: F.array_position(d, F.array_min(d)))[0]
        return df.withColumn("prediction", (nearest - 1).cast("int"))

    def write(self) -> MLWriter:
        return _ClustersWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ClustersReader()


class _ClustersWriter(MLWriter):
    def __init__(self, model: Clusters):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        held = {"centres": self.model.centres.tolist(), "cost": self.model.cost}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"clusters": held})


class _ClustersReader(MLReader):
    def load(self, path: str) -> Clusters:
        found = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = Clusters(**found["clusters"])
        model._resetUid(found["uid"])
        return model


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch as one block of doubles."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("float64")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "block"])


def _moved(points, found: dict[int, np.ndarray], partial: Callable) -> dict[int, tuple]:
    """Per set of centres: what ``partial`` adds up over the blocks, from one pass."""

    def both(a, b):
        return tuple(x + y for x, y in zip(a, b))

    pairs = points.mapPartitions(lambda blocks: partial(blocks, found))
    tasks = points.getNumPartitions()
    if tasks > FEW_TASKS:  # the sums of a few tasks meet on the driver
        pairs = pairs.reduceByKey(both, min(tasks, len(found)))
    totals: dict = {}
    for at, one in pairs.collect():
        totals[at] = both(totals[at], one) if at in totals else one
    return totals


def _settled(blocks: Iterable[np.ndarray], found: dict[int, np.ndarray]) -> list[tuple]:
    """Sums and sizes of the clusters of every set, and its cost, set by set."""
    totals: dict = {}
    for x in blocks:
        for at, centres in found.items():
            nearest = ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)
            member = (nearest[:, None] == np.arange(len(centres))[None, :]).astype("float64")
            gaps = x - centres[nearest]
            one = (member.T @ x, member.sum(axis=0), float((gaps * gaps).sum()))
            totals[at] = one if at not in totals else tuple(a + b for a, b in zip(totals[at], one))
    return list(totals.items())


def _stepped(blocks: Iterable[np.ndarray], found: dict[int, np.ndarray]) -> list[tuple]:
    """Sums and sizes of the clusters of every set: sets of one size go through the same products.

    Rows lie across, so that the least of a few distances is found by comparing whole rows of them.
    """
    alike: dict[int, list[int]] = {}
    for at, centres in found.items():
        alike.setdefault(len(centres), []).append(at)
    sums = {k: 0.0 for k in alike}
    stacked = {}
    for k, sets in alike.items():
        c = np.stack([found[at] for at in sets], axis=1).reshape(k * len(sets), -1)  # first centres of all sets, then second ones
        lines = np.column_stack([-2 * c, (c * c).sum(axis=1)]).reshape(k, len(sets), -1)
        stacked[k] = np.ascontiguousarray((lines[1:] - lines[0]).reshape((k - 1) * len(sets), -1))  # how much farther than the first
    held: dict[tuple, tuple] = {}  # memory of the products, taken once
    for block in blocks:
        for lo in range(0, len(block), STRIP_ROWS):
            strip = block[lo : lo + STRIP_ROWS]
            n = len(strip)
            x = np.column_stack([strip, np.ones(n)])
            across = np.ascontiguousarray(x.T)
            for k, sets in alike.items():
                shape = (len(sets), n)
                if (k, n) not in held:
                    kinds = [((k, *shape), "float64"), (shape, bool), (shape, "uint16"), (shape, "uint16"), ((k, *shape), bool)]
                    held[k, n] = tuple(np.empty(*kind) for kind in kinds)
                gaps, nearer, step, nearest, member = held[k, n]
                np.matmul(stacked[k], across, out=gaps.reshape(k * len(sets), n)[len(sets) :])
                least = gaps[0]
                least[:] = nearest[:] = 0
                for j in range(1, k):
                    np.less(gaps[j], least, out=nearer)
                    np.multiply(nearer, np.uint16(j), out=step)
                    np.maximum(nearest, step, out=nearest)
                    np.minimum(least, gaps[j], out=least)
                np.equal(nearest[None], np.arange(k, dtype="uint16")[:, None, None], out=member)
                np.copyto(gaps, member)
                sums[k] = sums[k] + gaps.reshape(k * len(sets), n) @ x
    out = []
    for k, sets in alike.items():
        if isinstance(sums[k], np.ndarray):
            whole = sums[k].reshape(k, len(sets), -1)
            out += [(at, (whole[:, i, :-1].copy(), whole[:, i, -1].copy())) for i, at in enumerate(sets)]
    return out


def _means(sums: np.ndarray, sizes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A cluster without rows keeps its centre."""
    return np.where((sizes > 0)[:, None], sums / np.where(sizes > 0, sizes, 1.0)[:, None], centres)


def _still(new: np.ndarray, old: np.ndarray) -> bool:
    return bool((((new - old) ** 2).sum(axis=1) <= TOLERANCE**2).all())


def _walked(x: np.ndarray, first: np.ndarray, max_iter: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All moves of one set of centres over rows that the task holds: the sets before the last two moves, and the last.

    A row is only compared again where the moves since its last comparison may have changed its nearest centre
    (Hamerly's bounds: at most so far to its own centre, at least so far to any other).
    """
    (n, width), k = x.shape, len(first)
    centres, before = first, []
    label, own, other = np.zeros(n, "int64"), np.full(n, np.inf), np.zeros(n)
    norms = np.einsum("ij,ij->i", x, x)
    slack = 1e-6 * (1.0 + float(np.sqrt(norms.max()))) if n else 0.0  # of the rounding of distances
    sums, sizes = np.zeros((k, width)), np.zeros(k)
    for move in range(max_iter):
        between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
        np.fill_diagonal(between, np.inf)
        doubt = np.flatnonzero(own > np.maximum(other, (between.min(axis=1) / 2)[label]) - slack) if move else np.arange(n)
        squares = (centres * centres).sum(axis=1)[:, None]
        for lo in range(0, len(doubt), STRIP_ROWS):
            rows = doubt[lo : lo + STRIP_ROWS]
            p = x[rows]
            gaps = squares - 2 * (centres @ p.T)
            least, second, nearest = gaps[0].copy(), np.full(len(rows), np.inf), np.zeros(len(rows), "int64")
            for j in range(1, k):
                np.copyto(nearest, j, where=gaps[j] < least)
                np.minimum(second, np.maximum(gaps[j], least), out=second)
                np.minimum(least, gaps[j], out=least)
            own[rows] = np.sqrt(np.maximum(least + norms[rows], 0.0))
            other[rows] = np.sqrt(np.maximum(second + norms[rows], 0.0))
            was = label[rows]
            went = np.ones(len(rows), bool) if not move else nearest != was
            if went.any():
                label[rows] = nearest
                for to, sign in ((nearest[went], 1.0), (was[went], -1.0))[: 1 + bool(move)]:
                    sizes += sign * np.bincount(to, minlength=k)
                    for c in range(width):
                        sums[:, c] += sign * np.bincount(to, weights=p[went, c], minlength=k)
        new = _means(sums, sizes, centres)
        before = [*before[-1:], centres]
        still, moved = _still(new, centres), np.sqrt(((new - centres) ** 2).sum(axis=1))
        centres = new
        if still:
            break
        own += moved[label]
        other -= moved.max()
    return before, centres


def fit_each(data: DataFrame, ks: Sequence[int], seed: int = 42, restarts: int = RESTARTS, max_iter: int = MAX_ITER) -> dict[int, Clusters]:
    """The best of several starts by training cost, for every number of clusters. ``data`` should be cached.

    MLlib places the first centres of every start (k-means||). A set of centres then moves until no centre
    moves by more than ``TOLERANCE``. Where tasks can hold all rows, each set makes its moves in a task of its own.
    Beyond that all sets share their passes: one job moves every set that still moves, so the number of jobs
    is that of the longest fit instead of the sum over fits. The last two moves of all sets are made once
    more together, set by set over the blocks of rows, which gives the centres and costs.
    """
    starts = [(k, seed + at) for k in ks for at in range(restarts)]
    plain = data.select("features")  # not kept itself, so that MLlib keeps its own form for the passes of a start

    def started(start: tuple[int, int]) -> np.ndarray:
        k, own = start
        return np.array(KMeans(k=k, maxIter=0, seed=own).fit(plain).clusterCenters())

    centres = dict(enumerate(side_by_side(started, starts, START_THREADS)))
    before: dict[int, list[np.ndarray]] = {i: [] for i in centres}  # the last two moves
    costs = dict.fromkeys(centres, 0.0)
    blocks = data.select(vector_to_array("features").alias("x")).mapInArrow(_packed, "n long, block binary").persist()
    context = data.sparkSession.sparkContext
    try:
        points = blocks.rdd.map(lambda r: np.frombuffer(r.block).reshape(r.n, -1))
        n = blocks.agg(F.sum("n")).first()[0] or 0
        width = len(next(iter(centres.values()))[0])
        if 0 < n * width * 8 <= MAX_TASK_BYTES and max_iter:
            whole = np.concatenate([np.frombuffer(b.as_buffer()) for b in blocks.select("block").toArrow()["block"]]).reshape(n, width)
            rows = context.broadcast(whole)
            del whole
            sets = sorted(centres.items(), key=lambda s: -len(s[1]))  # the longest first
            try:
                for at, walk in context.parallelize(sets, len(sets)).map(lambda s: (s[0], _walked(rows.value, s[1], max_iter))).collect():
                    before[at], centres[at] = walk
            finally:
                rows.unpersist()
        else:
            moving = set(centres)
            for _ in range(max_iter):
                for at, (sums, sizes) in _moved(points, {i: centres[i] for i in sorted(moving)}, _stepped).items():
                    new = _means(sums, sizes, centres[at])
                    if _still(new, centres[at]):
                        moving.discard(at)
                    before[at] = [*before[at][-1:], centres[at]]
                    centres[at] = new
                if not moving:
                    break
        for move in (-2, -1):
            again = {i: v[0] for i, v in before.items() if len(v) >= -move}
            for at, (sums, sizes, cost) in (_moved(points, again, _settled) if again else {}).items():
                centres[at], costs[at] = _means(sums, sizes, again[at]), cost
                before[at] = [centres[at]] if move == -2 else []
    finally:
        blocks.unpersist()
    best = {k: min((i for i, s in enumerate(starts) if s[0] == k), key=costs.get) for k in ks}
    return {k: Clusters(centres[i], costs[i]) for k, i in best.items()}


def fit_kmeans(data: DataFrame, k: int, seed: int = 42, restarts: int = RESTARTS, max_iter: int = MAX_ITER) -> Clusters:
    """The best of several starts by training cost. ``data`` should be cached."""
    return fit_each(data, [k], seed, restarts, max_iter)[k]


def exact_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), the same under any partitioning."""
    return df.orderBy(key_hash(seed, key), *key).limit(n)


def silhouette(df: DataFrame, features: Sequence[str], label: str = "cluster", most: int = SAMPLE_ROWS) -> DataFrame:
    """Mean silhouette with Euclidean distance over ``df``, and the number of its rows.

    ``df`` is a sample of at most ``most`` rows, which every task holds as a whole; a larger
    one is refused. :func:`squared_silhouette` takes tables of any size.

    Distances of a row to all sample rows are one small matrix product inside
    the task that holds the row; pairs of rows never become rows.
    """
    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("int").alias("_l"))
    table = rows.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"the sample has more than the {most} rows that are allowed")
    points = np.column_stack([table[f].to_numpy() for f in features])
    centre = points.mean(axis=0) if len(points) else 0.0  # small numbers keep the product form exact
    points = points - centre
    labels = table["_l"].to_numpy()
    groups, sizes = np.unique(labels, return_counts=True)
    if len(groups) < 2:
        return df.sparkSession.createDataFrame([(None, table.num_rows)], "silhouette double, rows_used long")
    member = (labels[:, None] == groups[None, :]).astype("float64")

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            mine = np.searchsorted(groups, batch.column("_l").to_numpy(zero_copy_only=False))
            x = x - centre
            squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
            gaps = np.sqrt(np.maximum(squares, 0.0))
            sums = gaps @ member
            at = np.arange(len(x))
            own = sizes[mine]
            a = sums[at, mine] / np.maximum(own - 1, 1)
            others = sums / sizes
            others[at, mine] = np.inf
            b = others.min(axis=1)
            top = np.maximum(a, b)
            s = np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    local = df.sparkSession.createDataFrame(table).repartition(8)
    return local.mapInArrow(widths, "s double").agg(F.avg("s").alias("silhouette"), F.count("s").alias("rows_used"))


def squared_silhouette(assigned: DataFrame) -> float:
    """Silhouette of all rows with squared distance, which needs no pairs."""
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(assigned)


def find_optimal_k(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    k_range: Iterable[int] = range(2, 11),
    seed: int = 42,
    restarts: int = RESTARTS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per number of clusters: training cost, silhouette of a sample, silhouette of all rows.

    The sample has ``sample_rows`` rows (``rows_used`` says how many it was) and Euclidean distances;
    ``squared_silhouette`` uses squared distances and every row.
    """
    scales = scaling(df, features)
    data = compact(vectors(df.select(*key, *features), scales), PASS_ROWS, FEW_TASKS)
    sample = exact_sample(data, key, sample_rows, seed).persist()
    try:
        fitted = fit_each(data, list(k_range), seed, restarts)

        def judged(k: int) -> tuple:
            placed = fitted[k].transform(sample).withColumnRenamed("prediction", "cluster")
            width = silhouette(placed, [f"{c}_scaled" for c in scales], most=sample_rows).first()
            whole = squared_silhouette(fitted[k].transform(data).withColumnRenamed("prediction", "cluster"))
            return int(k), float(fitted[k].cost), width["silhouette"], width["rows_used"], whole

        rows = side_by_side(judged, list(fitted), START_THREADS)
        return df.sparkSession.createDataFrame(
            rows, "k int, inertia double, silhouette double, rows_used long, squared_silhouette double"
        )
    finally:
        data.unpersist()
        sample.unpersist()


def assign_clusters(
    df: DataFrame,
    n_clusters: int = 5,
    features: Sequence[str] | None = None,
    seed: int = 42,
    restarts: int = RESTARTS,
    spec: FeatureSpec = TRACKS,
) -> tuple[DataFrame, Clusters, dict[str, tuple[float, float]]]:
    """All rows with their cluster; rows without all features get -1."""
    features = list(features or spec.features)
    scales = scaling(df, features)
    data = compact(vectors(df.select(*features), scales).select("features"), PASS_ROWS, FEW_TASKS)
    try:
        model = fit_kmeans(data, n_clusters, seed, restarts)
    finally:
        data.unpersist()
    return place(df, model, scales), model, scales


def place(df: DataFrame, model: Transformer, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Label every row; incomplete rows skip the model and get -1."""
    from pyspark.ml.functions import array_to_vector

    typed = numbers(df.select("*", *[F.col(c).alias(f"_x_{c}") for c in scales]), [f"_x_{c}" for c in scales])
    parts = [
        F.coalesce((F.col(f"_x_{c}") - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in scales.items()
    ]
    whole = F.lit(True)
    for c in scales:
        whole = whole & F.col(f"_x_{c}").isNotNull()
    ready = typed.withColumn("features", array_to_vector(F.array(*parts))).withColumn("_ok", whole)
    labelled = model.transform(ready)
    cluster = F.when(F.col("_ok"), F.col("prediction")).otherwise(F.lit(NO_CLUSTER))
    return labelled.select(*df.columns, cluster.alias("cluster"))


def centroids(model: Clusters, scales: dict[str, tuple[float, float]], spark) -> DataFrame:
    """Cluster centres in the original units."""
    rows = []
    for i, centre in enumerate(model.clusterCenters()):
        rows.append((i, *[float(v * s + m) for v, (m, s) in zip(centre, scales.values())]))
    columns = ", ".join(f"`{c}` double" for c in scales)
    return spark.createDataFrame(rows, f"cluster int, {columns}")


def cluster_summary(df: DataFrame, features: Sequence[str] | None = None, spec: FeatureSpec = TRACKS) -> DataFrame:
    """Size, mean target, mean features and most common category per cluster."""
    cols = [c for c in (features or spec.features) if c in df.columns]
    used = df.filter(F.col("cluster") >= 0)
    aggs = [F.count("*").alias("size")]
    if spec.target in df.columns:
        aggs.append(F.avg(F.col(spec.target).cast("double")).alias("mean_target"))
    aggs += [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in cols]
    table = used.groupBy("cluster").agg(*aggs)
    if spec.category not in df.columns:
        return table.orderBy("cluster")
    # one counter per cluster and category, then the largest; ties to the smaller name
    counts = used.filter(F.col(spec.category).isNotNull()).groupBy("cluster", spec.category).count()
    top = counts.groupBy("cluster").agg(
        F.min(F.struct((-F.col("count")).alias("n"), F.col(spec.category).alias("c")))["c"].alias("top_category")
    )
    return table.join(top, "cluster", "left").orderBy("cluster")
