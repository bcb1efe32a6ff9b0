"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are folded first. Distinct vectors are dealt into shards by a hash; each shard's graph is
built in one task, once. Blocks of vectors then visit every shard's graph with a beam search that runs a whole
block in lock step, at every size of a shard; a shard's blocks are split over tasks, each with a copy of the graph. Two
audits widen the beam: known links (nodes turned by the threshold's angle) must be found in every graph, and a sample of
every block must get the links of an exact scan. Where a beam as wide as the shard still misses some, as in a graph of
several parts, the block is scanned. Cosines of found links are checked in double precision, and a vector for which the
search finds ``DENSE`` links or more in a shard is counted exactly there, so the size of a group of near copies never
depends on the beam.

Links are returned as pairs only where a vector has few in a shard; of a dense group each task returns
counts and a spanning forest, so a group's pairs are never laid out. Components are joined in Spark.

Shards hold about ``shard_rows`` vectors, at least ``shards`` of them, so the memory of a task is bounded.
Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths with each other. Rows that repeat a vec_id are one node: equal ones count once, links of different
ones join in one component, and n_links is the largest of their counts; each row is returned. Rows
without a vec_id are returned with a null component. Links at the threshold count, so ties need no order. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import connected_components, few, materialise, release, ship, written_so_far
from codelattice.llm.vectors import as_rows, folded, matrix, usable

COSINE, SHARDS, SHARD_ROWS, BLOCK_ROWS, TASK_BLOCKS = 0.9, 6, 16_384, 2048, 16
DEGREE, BUILD_BEAM, BEAM, AUDIT, AUDIT_RECALL, SAMPLE, DENSE = 16, 64, 64, 512, 0.998, 64, 12
STEP = 512


class Graph:
    """A navigable small-world graph on unit vectors (float32); layers[l] maps nodes to neighbours, -1 for none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    # -------------------------------------------------------------- search
    def beam(self, q: np.ndarray, layer: int, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query, nearest first: nodes (-1: none) and cosines."""
        near, n = self.layers[layer], len(self.x)
        rows = np.arange(len(q))
        ids = np.full((len(q), width), -1, np.int32)
        sims = np.full((len(q), width), -np.inf, np.float32)
        fresh = np.zeros((len(q), width), bool)
        seen = np.zeros((len(q), n + 1), bool)  # the last column takes the entries -1
        e = entry.shape[1]
        ids[:, :e], fresh[:, :e] = entry, entry >= 0
        sims[:, :e] = np.where(entry >= 0, np.einsum("bed,bd->be", self.x[entry], q), -np.inf)
        seen[rows[:, None], entry] = True
        expand = min(expand, width)
        live = rows
        while len(live):
            score = np.where(fresh[live], sims[live], -np.inf)
            pick = np.argpartition(-score, expand - 1, axis=1)[:, :expand] if width > expand else np.tile(np.arange(width), (len(live), 1))
            ok = np.take_along_axis(score, pick, 1) > -np.inf
            go = ok.any(axis=1)
            live, pick, ok = live[go], pick[go], ok[go]
            if not len(live):
                break
            cur = np.where(ok, ids[live[:, None], pick], -1)
            fresh[live[:, None], pick] &= ~ok
            nb = np.where(cur[:, :, None] >= 0, near[cur], -1).reshape(len(live), -1)
            nb.sort(axis=1)
            new = (nb >= 0) & ~seen[live[:, None], nb]
            new[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            seen[live[:, None], nb] = True
            most = int(new.sum(axis=1).max(initial=0))
            if not most:
                continue
            order = np.argsort(~new, axis=1, kind="stable")[:, :most]
            nb, new = np.take_along_axis(nb, order, 1), np.take_along_axis(new, order, 1)
            s = np.where(new, np.einsum("bmd,bd->bm", self.x[nb], q[live]), -np.inf).astype(np.float32)
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(new, nb, -1)], axis=1)
            all_f = np.concatenate([fresh[live], new], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sims[live], ids[live], fresh[live] = (np.take_along_axis(a, top, 1) for a in (all_s, all_i, all_f))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Descend from the top layer, then a beam on the lowest."""
        entry = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(q, layer, entry, 4)[0][:, :1]
        return self.beam(q, 0, entry, width)

    # -------------------------------------------------------------- building
    @staticmethod
    def choose(x: np.ndarray, of: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """From candidates (nearest first) those that are nearer to the node than to any chosen before; what
        room is left goes to the nearest others."""
        b, c = cand.shape
        v = x[cand]
        between = np.einsum("bcd,bed->bce", v, v)
        closest = np.full((b, c), -np.inf, np.float32)
        state = np.zeros((b, c), np.int8)
        count = np.zeros(b, np.int64)
        for j in range(c):
            good = (cand[:, j] >= 0) & (sims[:, j] >= closest[:, j]) & (count < degree)
            state[good, j] = 2
            count += good
            closest = np.where(good[:, None], np.maximum(closest, between[:, :, j]), closest)
        state[(state == 0) & (cand >= 0)] = 1
        order = np.argsort(-state, axis=1, kind="stable")[:, :degree]
        out = np.where(np.take_along_axis(state, order, 1) > 0, np.take_along_axis(cand, order, 1), -1)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 7) -> Graph:
        """Nodes enter in a seeded random order, in batches that at most double the graph."""
        n, g = len(x), np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - g.random(n)) / np.log(DEGREE)).astype(int), 8)
        order = g.permutation(n)
        order = order[np.argsort(-level[order], kind="stable")]  # upper layers first, so that they exist below
        graph = cls(x, [np.full((n, 2 * DEGREE if l == 0 else DEGREE), -1, np.int32) for l in range(int(level.max(initial=0)) + 1)], int(order[0]))
        done = 0
        while done < n:
            batch = order[done : done + max(1, min(done, STEP)) if done else 1]
            graph._insert(batch, level[batch], done)
            done += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, level: np.ndarray, done: int) -> None:
        x = self.x
        for layer in range(len(self.layers) - 1, -1, -1):
            own = batch[level >= layer]
            if not len(own):
                continue
            q, near = x[own], self.layers[layer]
            degree = near.shape[1]
            parts = []
            if done:
                entry = np.full((len(own), 1), self.entry, np.int32)
                for above in range(len(self.layers) - 1, layer, -1):
                    entry = self.beam(q, above, entry, 1)[0]
                parts.append(self.beam(q, layer, entry, BUILD_BEAM))
            if len(own) > 1:
                s = q @ q.T
                np.fill_diagonal(s, -np.inf)
                k = min(degree, len(own) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                parts.append((own[top].astype(np.int32), np.take_along_axis(s, top, 1)))
            if not parts:
                continue
            ids, sims = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts], 1)
            o = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
            chosen = self.choose(x, own, ids, sims, DEGREE)
            near[own[:, None], np.arange(DEGREE)[None, :]] = chosen
            self._link_back(layer, own, chosen)

    def _link_back(self, layer: int, own: np.ndarray, chosen: np.ndarray) -> None:
        x, near = self.x, self.layers[layer]
        degree = near.shape[1]
        src, dst = np.repeat(own, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sim = np.einsum("nd,nd->n", x[src], x[dst])
        o = np.lexsort((-sim, dst))
        src, dst = src[o], dst[o]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        src, dst, place = src[place < degree], dst[place < degree], place[place < degree]
        extra = np.full((len(node), int(min(count.max(), degree))), -1, np.int32)
        extra[np.searchsorted(node, dst), place] = src
        for i in range(0, len(node), STEP):
            at = node[i : i + STEP]
            cand = np.concatenate([near[at], extra[i : i + STEP]], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, np.einsum("bcd,bd->bc", x[cand], x[at]), -np.inf).astype(np.float32)
            o = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, o, 1), np.take_along_axis(sims, o, 1)
            full = (cand >= 0).sum(axis=1) > degree
            near[at[~full]] = cand[~full, :degree] if cand.shape[1] >= degree else np.pad(cand[~full], ((0, 0), (0, degree - cand.shape[1])), constant_values=-1)
            if full.any():
                near[at[full]] = self.choose(x, at[full], cand[full], sims[full], degree)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def audited_width(graph: Graph, exact: np.ndarray, cosine: float, seed: int = 3) -> int:
    """The narrowest beam, doubling from BEAM, that finds the audited share of known links: nodes of the
    shard are turned away by exactly the angle of ``cosine`` and sought. At most as wide as the shard."""
    n, g, width = len(exact), np.random.default_rng(seed), min(BEAM, len(exact))
    nodes = g.choice(n, min(AUDIT, n), replace=False)
    v = exact[nodes]
    away = g.standard_normal(v.shape)
    away -= (away * v).sum(axis=1, keepdims=True) * v
    long = np.sqrt((away * away).sum(axis=1, keepdims=True))
    probe = (cosine * v + np.sqrt(1 - cosine * cosine) * away / np.where(long > 0, long, 1)).astype(np.float32)
    while width < n and (graph.search(probe, width)[0] == nodes[:, None]).any(axis=1).mean() < AUDIT_RECALL:
        width = min(2 * width, n)
    return width


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float, width: int) -> list[np.ndarray]:
    """For each query (unit vectors, doubles) the nodes with cosine >= ``cosine``, found by beams that widen
    until a sample of the queries has all the links that an exact scan gives it. own: the query's node in
    this shard or -1."""
    n, single = len(exact), q.astype(np.float32)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    sample = np.unique(np.linspace(0, len(q) - 1, min(SAMPLE, len(q))).astype(int))
    truth = [set(np.flatnonzero(line >= cosine).tolist()) for line in q[sample] @ exact.T]
    while True:
        parts = [graph.search(single[i : i + STEP], width) for i in range(0, len(q), STEP)]
        ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
        near = sims >= cosine - 1e-3
        dense = near.sum(axis=1) >= DENSE
        if all(dense[r] or t <= set(ids[r][near[r]].tolist()) for r, t in zip(sample, truth, strict=True)):
            break
        if width >= n:
            dense[:] = True
            break
        width = min(2 * width, n)
    for i in np.flatnonzero(near.any(axis=1) & ~dense):
        c = ids[i][near[i]].astype(np.int64)
        c = c[c != own[i]]
        out[i] = c[exact[c] @ q[i] >= cosine]
    rows = np.flatnonzero(dense)
    for i in range(0, len(rows), 256):
        for r, line in zip(rows[i : i + 256], q[rows[i : i + 256]] @ exact.T, strict=True):
            c = np.flatnonzero(line >= cosine)
            out[r] = c[c != own[r]]
    return out


# ------------------------------------------------------------------ Spark
def _builder(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    v = matrix(table.column("data").combine_chunks())
    exact = unit(v)
    g = Graph.build(exact.astype(np.float32))
    head = np.array([len(g.layers), g.entry, *(a.shape[1] for a in g.layers)], "<i8")
    blob = head.tobytes() + b"".join(a.astype("<i4").tobytes() for a in g.layers)
    ids, w = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "copies"))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([-1], pa.int64()), "ids": pa.array([ids], pa.binary()), "copies": pa.array([w], pa.binary()), "data": pa.array([exact.tobytes()], pa.binary()), "graph": pa.array([blob], pa.binary())})


def _blocker(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    exact = unit(matrix(table.column("data").combine_chunks()))
    ids = table.column("node").to_numpy().astype("<i8").tobytes()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids], pa.binary()), "data": pa.array([exact.tobytes()], pa.binary())})


def _visit(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, graph = None, None
        for batch in batches:
            for row in range(len(batch)):
                r = {n: batch.column(n)[row] for n in batch.schema.names}
                shard, ids = r["shard"].as_py(), np.frombuffer(r["ids"].as_buffer(), "<i8")
                x = np.frombuffer(r["data"].as_buffer(), "<f8").reshape(len(ids), -1)
                if r["block"].as_py() < 0:
                    blob = r["graph"].as_buffer()
                    layers = int(np.frombuffer(blob, "<i8", 1)[0])
                    head = np.frombuffer(blob, "<i8", 2 + layers)
                    at, tables = 8 * (2 + layers), []
                    for d in head[2:]:
                        tables.append(np.frombuffer(blob, "<i4", len(ids) * int(d), at).reshape(len(ids), int(d)))
                        at += 4 * len(ids) * int(d)
                    here, graph = shard, Graph(x.astype(np.float32), tables, int(head[1]))
                    width = audited_width(graph, x, cosine)
                    nodes, exact, copies = ids, x, np.frombuffer(r["copies"].as_buffer(), "<i8")
                    continue
                if shard != here:
                    raise RuntimeError("a block came before its shard's graph")
                at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
                own = np.where(nodes[at] == ids, at, -1)
                found = links_of(graph, exact, x, own, cosine, width)
                yield _report(shard, ids, nodes, copies, found)

    return run


LINKS = "a long, b long, shard long, n long"


def _report(shard: int, ids: np.ndarray, nodes: np.ndarray, copies: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs (a, b, shard, copies of b) of queries with few links; for others one row with b null and the sum,
    and links of a spanning forest with n null."""
    rows: list[tuple] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, f in zip(ids.tolist(), found, strict=True):
        if len(f) < DENSE:
            rows += [(a, b, shard, w) for b, w in zip(nodes[f].tolist(), copies[f].tolist(), strict=True)]
        else:
            rows.append((a, None, shard, int(copies[f].sum())))
            for b in nodes[f].tolist():
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    rows.append((a, b, None, None))
    cols = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "shard", "n"])


def near_duplicates(table: DataFrame, *, cosine: float = COSINE, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    ship(table.sparkSession)
    since, own = written_so_far(), usable(table)
    again = materialise(own.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "again")
    own = own.join(few(again), "vec_id", "left_anti").unionByName(own.join(few(again), "vec_id", "left_semi").distinct())
    # node: a number of the distinct vector's own, fixed by writing it.
    distinct = folded(own).withColumn("dim", F.size("embedding").cast("long")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialise(as_rows(distinct), "distinct")
    n = distinct.count()
    shards, blocks = max(shards, -(-n // shard_rows)), max(1, -(-n // block_rows))
    tasks = -(-blocks // TASK_BLOCKS)  # of a shard
    deal = F.pmod(F.xxhash64("data"), F.lit(shards)).cast("long")
    distinct = distinct.withColumn("shard", F.col("dim") * shards + deal)
    index = distinct.groupBy("shard").applyInArrow(_builder, "shard long, block long, ids binary, copies binary, data binary, graph binary")
    index = materialise(index, "graphs").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    queries = distinct.withColumn("block", F.pmod(F.xxhash64("data", F.lit(1)), F.lit(blocks)).cast("long"))
    queries = materialise(queries.groupBy("dim", "block").applyInArrow(_blocker, "dim long, block long, ids binary, data binary"), "blocks")
    present = distinct.select("dim", "shard").distinct().withColumnRenamed("dim", "d")
    queries = queries.join(F.broadcast(present), F.col("dim") == F.col("d")).withColumn("task", F.col("block") % tasks)  # a row a shard
    nothing = F.lit(None).cast("binary")
    visits = index.unionByName(queries.select("shard", "block", "ids", nothing.alias("copies"), "data", nothing.alias("graph"), "task"))
    visits = visits.repartitionByRange(shards * tasks, "shard", "task").sortWithinPartitions("shard", "task", "block").drop("task")
    found = materialise(visits.mapInArrow(_visit(cosine), LINKS), "links")
    out, kept = _result(table, own, distinct.drop("data"), found, again)
    release(since, again, kept)
    return out


def _result(table: DataFrame, own: DataFrame, distinct: DataFrame, found: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, and the written table that they are read from."""
    pairs = found.where("b is not null and n is not null")
    home = distinct.select(F.col("node").alias("v"), F.col("shard").alias("home"), "copies")
    # A link counts if either end found it; an end that was scanned exactly in a shard has its sum already.
    back = pairs.select("a", "b").join(home, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("home").alias("shard"), F.col("copies").alias("n"))
    sums = found.where("b is null")
    back = back.join(sums.select("a", "shard"), ["a", "shard"], "left_anti").select("a", "b", "shard", "n")
    counts = pairs.unionByName(back).distinct().unionByName(sums).groupBy("a").agg(F.sum("n").alias("others"))
    # Copies of a vector take their class's result; single vectors, the rule, need no second look.
    rep = folded(own).where("copies > 1").select("embedding", F.col("vec_id").alias("r"))
    copies = own.join(rep, "embedding").select(F.col("vec_id").alias("m"), "r").where("m <> r")
    end = lambda c: distinct.select(F.col("node").alias(c), F.col("vec_id").alias(f"{c}_id"))
    links = found.where("b is not null").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    # An id with several vectors joins the components of all of them.
    links = links.unionByName(copies.join(again, F.col("m") == F.col("vec_id"), "left_semi").select(F.col("r").alias("a"), F.col("m").alias("b")))
    component = connected_components(links).select(F.col("node").alias("id"), "component")
    per = distinct.select("node", F.col("vec_id").alias("rep"), "copies").join(counts, F.col("node") == F.col("a"), "left").join(component, F.col("rep") == F.col("id"), "left")
    per = per.select("rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "copies")
    every = per.select(F.col("rep").alias("m"), "n_links", "component_id").unionByName(copies.join(per.where("copies > 1"), F.col("r") == F.col("rep")).select("m", "n_links", "component_id"))
    every = materialise(every.groupBy("m").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "every")
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(every, F.col("vec_id") == F.col("m"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")), every
