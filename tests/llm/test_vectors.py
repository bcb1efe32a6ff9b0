"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from codelattice.llm import hilbert_ann, hnsw_neardup, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, copies int"


def near_exact(rows):
    v = {i: np.array(e, float) for i, e in rows if e is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    links = {i: {j for j in v if j != i and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.9} for i in v}
    comp = {i: i for i, _ in rows}
    for _ in rows:
        for i, js in links.items():
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(links.get(i, ())), comp[i]) for i, _ in rows}


def sample():
    g = np.random.default_rng(4)
    rows = [g.standard_normal(16) for _ in range(150)]
    base = g.standard_normal(16)
    rows += [base + 0.15 * g.standard_normal(16) for _ in range(60)]
    rows += [base * 2, base * 2, rows[3] * 5, rows[3], rows[3]]
    return [(i * 5, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_near_duplicate_vectors_against_brute_force(spark):
    rows = sample()
    table = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id) for r in hnsw_neardup.near_duplicates(table, shards=3).collect()}
    assert out == near_exact(rows)


def test_beams_find_links_in_large_shards():
    g = np.random.default_rng(5)
    x = hnsw_neardup.unit(g.standard_normal((3000, 32)))
    x[1500:] = hnsw_neardup.unit(x[:1500] + 0.04 * g.standard_normal((1500, 32)))
    x[100:160] = hnsw_neardup.unit(x[99] + 0.03 * g.standard_normal((60, 32)))
    graph = hnsw_neardup.Graph.build(x.astype(np.float32))
    width = hnsw_neardup.audited_width(graph, x, 0.9)
    assert width < len(x) // 2
    found = hnsw_neardup.links_of(graph, x, x[:2000], np.arange(2000), 0.9, width)
    exact = (x[:2000] @ x.T) >= 0.9
    missed = sum(set(np.flatnonzero(e).tolist()) - {i} != set(f.tolist()) for i, (e, f) in enumerate(zip(exact, found, strict=True)))
    assert missed <= 2


def test_small_shards_are_searched_through_the_graph(monkeypatch):
    """Of 80 vectors too every one is sought by beams, and what they find is exact."""
    g = np.random.default_rng(6)
    x = hnsw_neardup.unit(g.standard_normal((80, 16)))
    x[40:70] = hnsw_neardup.unit(x[:30] + 0.05 * g.standard_normal((30, 16)))
    graph = hnsw_neardup.Graph.build(x.astype(np.float32))
    sought, search = [], hnsw_neardup.Graph.search
    monkeypatch.setattr(hnsw_neardup.Graph, "search", lambda self, q, width: (sought.append(len(q)), search(self, q, width))[1])
    found = hnsw_neardup.links_of(graph, x, x, np.arange(80), 0.9, hnsw_neardup.BEAM)
    assert sum(sought) >= 80
    assert [set(f.tolist()) for f in found] == [set(np.flatnonzero(line >= 0.9).tolist()) - {i} for i, line in enumerate(x @ x.T)]


def test_near_duplicate_vectors_of_a_larger_table(spark):
    """Against brute force on sf0.1, where shards are many times a beam."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, v = np.array([r.vec_id for r in rows]), hnsw_neardup.unit(np.array([r.embedding for r in rows], float))
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    comp, before = ids.copy(), None
    while before is None or (comp != before).any():
        before = comp.copy()
        for i in np.flatnonzero(near.any(axis=1)):
            comp[i] = min(comp[i], comp[near[i]].min())
    out = {r.vec_id: (r.n_links, r.component_id) for r in hnsw_neardup.near_duplicates(table).collect()}
    assert out == dict(zip(ids.tolist(), zip(near.sum(axis=1).tolist(), comp.tolist(), strict=True), strict=True))


def test_a_repeated_id_with_other_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.001]), (2, [0.0, 2.0]), (3, [-1.0, 0.0])]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw_neardup.near_duplicates(spark.createDataFrame([(*r, 0, 1, 2) for r in rows], SCHEMA)).collect())
    assert out == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 3)]


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [2.0, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0, 0.0, 0.0]), (160, []), (None, [1.0, 0.0]), (20, [2.0, 0.0]), (180, [0.0, 1.0])]
    return spark.createDataFrame([(i, e, None, 1, 2) for i, e in rows], SCHEMA)


def test_odd_vectors(spark):
    out = [(r.vec_id, r.n_links, r.component_id) for r in hnsw_neardup.near_duplicates(odd(spark)).collect()]
    assert len(out) == 12 and all(n == 0 and c == i for i, n, c in out if i not in (0, 20))
    assert {(n, c) for i, n, c in out if i in (0, 20)} == {(1, 0)}
    found = [(r.query_id, r.vec_id, r.score) for r in hilbert_ann.nearest(odd(spark)).collect()]
    assert {q for q, _, _ in found} == {0, 20, 180} and all(q != v for q, v, _ in found)
    none = spark.createDataFrame([], SCHEMA)
    assert hnsw_neardup.near_duplicates(none).count() == 0 and hilbert_ann.nearest(none).count() == 0


def exact_lists(rows, top=20):
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    out = {}
    for n, i in enumerate(ids):
        if i % 20 == 0:
            s = v @ v[n]
            s[n] = -np.inf
            order = np.lexsort((ids, -s))[:top]
            out[int(i)] = [(int(ids[o]), s[o]) for o in order if s[o] > -np.inf]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and q not in [r.vec_id for r in rows]
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rows, rows[1:], strict=False))
    assert {q: len(r) for q, r in got.items()} == {q: len(w) for q, w in want.items()}
    return np.mean([len({r.vec_id for r in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_nearest_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(queries.op4_hilbert_ann(spark, sf).collect(), exact_lists(rows)) >= 0.9


def test_nearest_with_copies_and_lengths(spark):
    rows = sample()
    table = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], SCHEMA)
    found = hilbert_ann.nearest(table).collect()
    assert recall(found, exact_lists(rows)) >= 0.9
    few = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows[:9]], SCHEMA)
    assert hilbert_ann.nearest(few).where(F.col("query_id") == 0).count() == 8


def test_hilbert_curve_steps_to_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_ann.hilbert(side, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = side[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
