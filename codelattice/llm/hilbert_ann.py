"""Nearest neighbours by inner product with shifted Hilbert curves.

Vectors get one more coordinate that makes all lengths equal, so that inner products order them like
distances. For each of several curves they are projected on a few random directions, shifted and laid on
a Hilbert curve. Rows and queries are range-partitioned by (curve, key); their ranks come from positions in
the sorted partitions plus the partitions' offsets. A query's candidates are the rows within ``window`` ranks
on any curve, rescored exactly in blocks.

The window is measured: a bounded sample of queries (``audit``) is scanned against all rows, and the window
is the smallest that holds the share ``recall`` of their true neighbours on at least one curve. On vectors
without structure, as in isotropic noise, that window is a large part of the table; on clustered ones it is
short. Every row is indexed. Equal vectors are folded, with as many of their smallest ids as can be needed.

Vectors null, zero or holding null or non-finite components take no part. Vectors of different lengths have no inner
product; each length that occurs is a table of its own. Rows that repeat a vec_id count once per distinct vector, and
ask with the first of them in the order of components. Ties go to the smaller vec_id. A table without queries
or vectors gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import materialise, ship
from codelattice.llm.vectors import as_rows, folded, matrix, usable

TOP, EVERY, CURVES, DIMS, BITS, AUDIT, RECALL, MOST_BLOCK = 20, 20, 4, 8, 7, 96, 0.97, 65_536


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates of ``bits`` bits (Skilling 2004)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    x = [c ^ t for c in x]
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | ((c >> b) & 1)
    return key


def _curves(dim: int, curves: int, dims: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    g = np.random.default_rng(11)
    base = np.linalg.qr(g.standard_normal((dim + 1, dim + 1)))[0]
    frames = [base[:, [(c * dims + i) % (dim + 1) for i in range(min(dims, dim + 1))]] for c in range(curves)]
    return frames, [g.random(f.shape[1]) for f in frames]


def keys(v: np.ndarray, longest: float, spread: float, curves: int, dims: int, bits: int, query: bool) -> np.ndarray:
    """Keys (rows x curves). Coordinates beyond ``spread`` are laid at the edge of the grid."""
    v = v / longest
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))
    frames, shifts = _curves(v.shape[1], curves, dims)
    out = []
    for frame, shift in zip(frames, shifts, strict=True):
        y = (np.column_stack([v, last]) @ frame / spread + 1 + shift) / 3
        out.append(hilbert(np.clip((y * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits))
    return np.column_stack(out)


def _place(longest: float, spread: float, curves: int, dims: int, bits: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                k = keys(matrix(batch.column("data")), longest, spread, curves, dims, bits, query)
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c), pa.int64()), pa.array(k[:, c]), pa.array(np.full(len(k), int(query)), pa.int64()), batch.column("vec_id")], ["curve", "key", "kind", "vec_id"])

    return run


def best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest scores, ties to smaller ids."""
    if len(score) > top:
        at = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:top]


def answers(q: np.ndarray, own: list[int], v: np.ndarray, ids: list[list[int]], top: int, ok: np.ndarray | None = None) -> Iterator[tuple[list[int], list[float]]]:
    """The best ids and scores for each query; ids: those of each row's vector, smallest first."""
    small = np.array([i[0] for i in ids], np.int64)
    many = any(len(i) > 1 for i in ids)
    for a in range(0, len(q), 256):
        score = q[a : a + 256] @ v.T
        if ok is not None:
            score[~ok[a : a + 256]] = -np.inf
        for s, me in zip(score, own[a : a + 256], strict=True):
            at = best(s, small, top + 1)
            at = at[s[at] > -np.inf]
            if many:
                pairs = sorted((-s[p], i) for p in at for i in ids[p] if i != me)[:top]
            else:
                pairs = [(-s[p], small[p]) for p in at if small[p] != me][:top]
            yield [int(i) for _, i in pairs], [float(-x) for x, _ in pairs]


def _scan(q: np.ndarray, own: list[int], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = answers(q, own, matrix(batch.column("data")), batch.column("ids").to_pylist(), top)
            rows = [(me, i, s) for me, (ids, scores) in zip(own, found, strict=True) for i, s in zip(ids, scores, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _rescore(top: int, window: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(queries):
            v, q = matrix(rows.column("data").combine_chunks()), matrix(queries.column("data").combine_chunks())
            ranks, at, own = rows.column("rank").to_numpy(), queries.column("rank").to_numpy(), queries.column("vec_id").to_pylist()
            ids = rows.column("ids").to_pylist()
            for a in range(0, len(q), 256):
                ok = np.abs(ranks[None, :] - at[a : a + 256, None]) <= window
                found = answers(q[a : a + 256], own[a : a + 256], v, ids, top, ok)
                out += [(me, i, s) for me, (i, s) in zip(own[a : a + 256], found, strict=True) if i]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "ids": pa.array(cols[1], pa.list_(pa.int64())), "scores": pa.array(cols[2], pa.list_(pa.float64()))})

    return run


def nearest(table: DataFrame, *, top: int = TOP, every: int = EVERY, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, audit: int = AUDIT, recall: float = RECALL, most_block: int = MOST_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its ``top`` nearest others found."""
    ship(table.sparkSession)
    if dims * bits > 62:
        raise ValueError("keys must fit in 62 bits")
    own, out = usable(table), None
    for size in sorted(r["d"] for r in own.select(F.size("embedding").alias("d")).distinct().collect()):
        found = _nearest(own.where(F.size("embedding") == size), size, top, every, curves, dims, bits, audit, recall, most_block)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(own: DataFrame, size: int, top: int, every: int, curves: int, dims: int, bits: int, audit: int, recall: float, most_block: int) -> DataFrame | None:
    spark = own.sparkSession
    rows = materialise(as_rows(folded(own, smallest=top + 1)), "rows")
    queries = materialise(as_rows(own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))), "queries")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    longest = own.agg(F.sqrt(F.max(square))).first()[0]
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(audit).collect()
    if not sample:
        return None
    # Projections on random directions rarely leave three times the share of one direction.
    spread = min(1.0, 3.0 / float(np.sqrt(size + 1)))
    place = (longest, spread, curves, dims, bits)
    placed = rows.mapInArrow(_place(*place, False), "curve long, key long, kind long, vec_id long").unionByName(queries.mapInArrow(_place(*place, True), "curve long, key long, kind long, vec_id long"))
    width = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.repartitionByRange(width, "curve", "key", "vec_id", "kind").sortWithinPartitions("curve", "key", "vec_id", "kind")
    # The number within the sorted partition, in the low bits; the partition in the high ones.
    placed = materialise(placed.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("curve", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = placed.join(parts, ["curve", "part"]).select("curve", "kind", "vec_id", (F.col("at") - F.col("low") + F.col("before")).alias("rank"))
    ranked = materialise(ranked, "ranked")
    window = _window(rows, ranked, sample, top, recall)
    block = int(min(most_block, max(256, window // 2)))
    data = ranked.where("kind = 0").join(rows, "vec_id").withColumn("block", F.floor(F.col("rank") / block))
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block))
    asked = ranked.where("kind = 1").join(queries, "vec_id").withColumn("block", F.explode(reach))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own, for the cogroup
    found = data.groupBy("curve", "block").cogroup(asked.groupBy("curve", "block")).applyInArrow(_rescore(top, window), "query_id long, ids array<long>, scores array<double>")
    found = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _window(rows: DataFrame, ranked: DataFrame, sample: list, top: int, recall: float) -> int:
    """The ranks that hold ``recall`` of the sample's true neighbours on at least one curve."""
    q, own = matrix([bytes(r["data"]) for r in sample]), [r["vec_id"] for r in sample]
    true = rows.mapInArrow(_scan(q, own, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("query_id", "vec_id")
    member = rows.select("vec_id", F.explode("ids").alias("m")).withColumnRenamed("vec_id", "rep")
    true = true.join(member, F.col("vec_id") == F.col("m")).select("query_id", "rep")
    x = ranked.where("kind = 0").select(F.col("vec_id").alias("rep"), "curve", F.col("rank").alias("rr"))
    y = ranked.where("kind = 1").select(F.col("vec_id").alias("query_id"), "curve", F.col("rank").alias("qr"))
    apart = true.join(x, "rep").join(y, ["query_id", "curve"]).groupBy("query_id", "rep").agg(F.min(F.abs(F.col("rr") - F.col("qr"))).alias("apart"))
    found = np.sort(np.array([r[0] for r in apart.select("apart").collect()], np.int64))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 16 if len(found) else 1024
