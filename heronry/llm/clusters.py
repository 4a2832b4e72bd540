"""K-means over integer vectors with Elkan's bounds (Elkan, 2003), exact to the last tie.

Each vector keeps its cluster, an upper bound of the distance to its centroid
and a lower bound for every centroid. When centroids move, the bounds move by
as much, and a distance is only computed where the bounds and half the
distance between two centroids leave it open. Bounds are rounded outwards
(lower ones to 16 bits), and a centroid is passed over only if it is strictly
farther, so one that ties is always looked at. All distances that decide, and
those returned, are sums of squares of integers, computed without rounding.

The vectors with their bounds are rows of BLOCK vectors. An assignment reads
them, writes the next generation to the shared folder and drops the one before,
so two generations, about 1.7 times the table, stand there at most, and a lost
executor costs only its own tasks. Each block carries the sums of its vectors
by cluster; Spark adds them up, and k centroids come to the driver. Vectors
are never shuffled, so a vector that repeats does no harm.

Defined cases: rows are kept if the vector has exactly `size` components, none
null, NaN or infinite, and the others don't appear; fewer kept rows than k make
as many clusters; a null id is hashed as "null" and kept; repeated rows are
vectors of their own, and start centroids that share an id follow their
components; a component beyond 2^27 after scaling is taken as 2^27, as its
squared distance has no place in a long, and an inertia beyond a long is the
largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import drop_path
from heronry.session import fresh_path

K = 40
ROUNDS = 5
SIZE = 64
SCALE = 256
SEED = 2
#: Vectors in a row of the state.
BLOCK = 8192
#: Largest component, and up to which floats hold every square sum.
MOST, PLAIN = 1 << 27, 1 << 22

STATE = "ids array<long>, wide boolean, vectors binary, cluster binary, upper binary, lower binary, distance binary, sums array<long>, counts array<long>"
LARGEST = (1 << 63) - 1


def kept(vector: Column, size: int) -> Column:
    """The vector has `size` components, all finite numbers."""
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as integers."""
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (both of float64 if small, else of int64)."""
    gap = x - y
    return (gap * gap).sum(axis=-1).astype(np.int64)


def root_above(d2: np.ndarray) -> np.ndarray:
    """No less than the square root."""
    return np.sqrt(d2.astype(np.float64)) * (1 + 2.0**-50)


def root_below(d2: np.ndarray) -> np.ndarray:
    """No more than the square root."""
    return np.sqrt(d2.astype(np.float64)) * (1 - 2.0**-50)


def stored_above(x: np.ndarray) -> np.ndarray:
    """32 bits, rounded up."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def stored_below(x: np.ndarray) -> np.ndarray:
    """16 bits, rounded down."""
    x = np.clip(x, 0, 65504)
    y = x.astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(0)), y)


class Centroids:
    """k centroids, half their distances (rounded down) and how far each has moved (rounded up)."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now
        between = np.stack([squares(now, c) for c in now])
        self.half = root_below(between) / 2
        apart = self.half + np.where(np.eye(len(now), dtype=bool), np.inf, 0)
        self.nearest = apart.min(axis=1)
        self.moved = np.zeros(len(now)) if before is None else root_above(squares(now, before))


def assign_first(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distance at once: (cluster, squared distance, lower bounds)."""
    if x.dtype == np.float64:
        d2 = ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)
    else:
        d2 = np.stack([squares(x, y) for y in c], axis=1)
    cluster = d2.argmin(axis=1)  # the first of equal ones
    return cluster, d2[np.arange(len(x)), cluster], root_below(d2)


def assign_next(x: np.ndarray, c: np.ndarray, of: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper bounds, lower bounds, distances computed) after the centroids have moved."""
    cluster = cluster.copy()
    upper = (upper + of.moved[cluster]) * (1 + 2.0**-50)
    lower = np.maximum((lower - of.moved) * (1 - 2.0**-50), 0)
    open_ = np.nonzero(upper >= of.nearest[cluster])[0]
    xs, own, low = x[open_], cluster[open_], lower[open_]
    d2 = squares(xs, c[own])
    up, computed = root_above(d2), len(open_)
    low[np.arange(len(own)), own] = root_below(d2)
    for k in range(len(c)):
        at = np.nonzero((own != k) & (up >= low[:, k]) & (up >= of.half[own, k]))[0]
        if not len(at):
            continue
        new = squares(xs[at], c[k])
        computed += len(at)
        low[at, k] = root_below(new)
        nearer = (new < d2[at]) | ((new == d2[at]) & (k < own[at]))
        at, new = at[nearer], new[nearer]
        own[at], d2[at], up[at] = k, new, root_above(new)
    cluster[open_], upper[open_], lower[open_] = own, up, low
    return cluster, upper, lower, computed


def exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if those hold every sum of squares, else as integers."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= PLAIN
    kind = np.float64 if small else np.int64
    return x.astype(kind), c.astype(kind)


def block_row(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, distance: np.ndarray | None, k: int) -> pa.RecordBatch:
    wide = bool(len(x)) and int(np.abs(x).max()) > 32767
    sums = np.stack([x[cluster == c].sum(axis=0) for c in range(k)])
    binary = lambda a: pa.array([a.tobytes()], pa.binary())
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    columns = [
        listed(ids), pa.array([wide]), binary(x.astype("<i4" if wide else "<i2")), binary(cluster.astype("<u2")), binary(stored_above(upper).astype("<f4")), binary(stored_below(lower).astype("<f2")),
        binary(distance.astype("<i8")) if distance is not None else pa.array([None], pa.binary()), listed(pa.array(sums.reshape(-1))), listed(pa.array(np.bincount(cluster, minlength=k))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in STATE.split(", ")])


def first_blocks(rows: DataFrame, start: np.ndarray, size: int, scale: int, block: int, last: bool) -> DataFrame:
    """The state after the assignment of (id, vector) to the start centroids."""

    def run(batches):
        held, n = [], 0

        def blocks(end: bool):
            nonlocal held, n
            table = pa.Table.from_batches(held) if held else None
            while n >= block or (end and n):
                part, table, n = table.slice(0, block), table.slice(block), n - min(n, block)
                vectors = part.column(1).combine_chunks()
                x, c = exact(quantised(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale), start)
                cluster, d2, lower = assign_first(x, c)
                yield block_row(part.column(0).combine_chunks(), x.astype(np.int64), cluster, root_above(d2), lower, d2 if last else None, len(c))
            held = table.to_batches() if table is not None and n else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= block:
                yield from blocks(False)
        yield from blocks(True)

    return rows.mapInArrow(run, STATE)


def next_blocks(state: DataFrame, now: np.ndarray, before: np.ndarray, size: int, last: bool) -> DataFrame:
    """The state after the centroids have moved; the last one has exact distances."""
    of = Centroids(now, before)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {f: batch.column(f)[k] for f in ("ids", "wide", "vectors", "cluster", "upper", "lower")}
                view = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)  # noqa: B023, E731
                x, c = exact(view("vectors", "<i4" if row["wide"].as_py() else "<i2").reshape(-1, size).astype(np.int64), now)
                cluster, upper, lower, _ = assign_next(x, c, of, view("cluster", "<u2").astype(np.int64), view("upper", "<f4").astype(np.float64), view("lower", "<f2").reshape(len(x), -1).astype(np.float64))
                yield block_row(row["ids"].values, x.astype(np.int64), cluster, upper, lower, squares(x, c[cluster]) if last else None, len(c))

    return state.select("ids", "wide", "vectors", "cluster", "upper", "lower").mapInArrow(run, STATE)


def moved(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Every cluster's floored mean; an empty one stays."""
    k, size = before.shape
    total = lambda name: {r[0]: r[1] for r in state.select(F.posexplode(name).alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()}  # noqa: E731  k * size rows
    sums, counts = total("sums"), total("counts")
    return np.array([[sums[c * size + i] // counts[c] if counts.get(c) else int(before[c, i]) for i in range(size)] for c in range(k)], np.int64)


def unpacked(state: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cluster = np.frombuffer(batch.column(1)[k].as_buffer(), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(cluster), pa.array(np.frombuffer(batch.column(2)[k].as_buffer(), "<i8"))], names=["vec_id", "cluster", "distance"])

    return state.select("ids", "cluster", "distance").mapInArrow(run, "vec_id long, cluster int, distance long")


def start_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors (vec_id, vector) whose ids hash lowest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.select(F.sha2(key.cast("binary"), 256).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return quantised(np.array([r["vector"] for r in first], np.float64), scale)


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each kept vector, final centroids). Runs at once, and leaves its result in the shared folder."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(kept(F.col("vector"), size))
    now = start_centroids(rows, k, seed, scale)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), now
    before, path = now, ""
    for done in range(rounds + 1):
        last, old = done == rounds, path
        state = first_blocks(rows, now, size, scale, block, last) if not done else next_blocks(spark.read.schema(STATE).parquet(path), now, before, size, last)
        path = fresh_path(spark, "clusters")
        state.write.parquet(path)
        if old:
            drop_path(spark, old)
        if not last:
            before, now = now, moved(spark.read.schema(STATE).parquet(path), now)
    return unpacked(spark.read.schema(STATE).parquet(path)), now


def report(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = cluster(vectors, **options)
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    told = [(int(min(sums.get(c, 0), LARGEST)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())] or [(0, "")]
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster") + 1)
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        pick([n for n, _ in told], "long").alias("cluster_inertia"),
        F.lit(int(min(sum(sums.values()), LARGEST))).cast("long").alias("inertia"),
        pick([h for _, h in told], "string").alias("centroid_sha256"),
    )
