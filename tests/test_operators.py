"""Operators on graphs and vectors: hand-made cases and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice import api
from codelattice.operators import extraction, graph, loading, models, retrieval
from codelattice.plans import catalogue
from codelattice.sources import tables
from codelattice.streaming import incremental


def edges(spark, rows):
    return spark.createDataFrame([(*r, "calls") if len(r) == 3 else r for r in rows], "src string, dst string, weight double, rel string").select("src", "dst", "rel", "weight")


def test_calls_spread(spark):
    out = {(r.src, r.dst): r.weight for r in graph.expand_calls(edges(spark, [("a", "b", 0.8), ("b", "c", 0.5), ("c", "d", 1.0)]), 3).collect()}
    assert out == pytest.approx({("a", "c"): 0.2, ("a", "d"): 0.05, ("b", "d"): 0.25})
    assert graph.expand_calls(edges(spark, [("a", "b", 1.0), ("b", "a", 1.0)]), 3).count() == 0


def test_calls_against_a_queue(spark):
    g = np.random.default_rng(1)
    rows = {(f"n{a:02d}", f"n{b:02d}"): round(float(w), 2) for a, b, w in zip(g.integers(0, 25, 60), g.integers(0, 25, 60), g.uniform(0.3, 1, 60), strict=True) if a != b}
    near = {}
    for (a, b), w in sorted(rows.items()):
        near.setdefault(a, []).append((b, w))
    want = {}
    for s in near:
        seen, queue = {s}, [(s, 1.0, 0)]
        while queue:
            node, cum, depth = queue.pop(0)
            for b, w in near.get(node, []) if depth < 3 else []:
                if b not in seen:
                    seen.add(b)
                    queue.append((b, cum * w * 0.5**depth, depth + 1))
                    if (s, b) not in rows:
                        want[s, b] = cum * w * 0.5**depth
    got = {(r.src, r.dst): r.weight for r in graph.expand_calls(edges(spark, [(*k, w) for k, w in rows.items()]), 3).collect()}
    assert got == pytest.approx(want)


def test_window(spark):
    n = spark.createDataFrame([(0, "f", 1), (1, "f", 6), (2, "f", 7), (3, "g", 1), (4, "f", 6)], "idx long, file string, lineno int")
    pairs = {(r.src_idx, r.dst_idx) for r in graph.context_window(n).collect()}
    assert pairs == {(0, 1), (1, 0), (0, 4), (4, 0), (1, 4), (4, 1), (1, 2), (2, 1), (4, 2), (2, 4)}


def test_ppmi_is_symmetric_positive_and_scale_free(spark, sf):
    n = loading.index_nodes(tables.nodes(spark, sf))
    a = graph.adjacency(loading.index_edges(tables.edges(spark, sf), n))
    one = {(r.i, r.j): r.v for r in graph.ppmi(a).collect()}
    two = {(r.i, r.j): r.v for r in graph.ppmi(a.withColumn("v", F.col("v") * 7)).collect()}
    assert min(one.values()) > 0 and all(one[j, i] == pytest.approx(v) for (i, j), v in one.items())
    assert one == pytest.approx(two, abs=1e-6)


def test_svd_against_numpy(spark):
    g = np.random.default_rng(2)
    m = g.standard_normal((30, 5)) @ g.standard_normal((5, 20)) * (g.random((30, 1)) > 0.1)
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(20) if m[i, j]], "i long, j long, v double")
    rows, sigma = models.svd(cells, 4)
    assert sigma == pytest.approx(np.linalg.svd(m)[1][:4], rel=1e-6) and sigma == sorted(sigma, reverse=True)
    e = np.zeros((30, 4))
    for r in rows.collect():
        e[r.i] = r.vec
    assert e.T @ e == pytest.approx(np.diag(np.square(sigma)), abs=1e-6 * sigma[0] ** 2)


def test_walks_follow_edges_and_repeat(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 0, 0.5)], "src_idx long, dst_idx long, weight double")
    first, again = (sorted(tuple(map(str, r)) for r in models.walks(x, 3, 12).collect()) for x in (e, e.repartition(3)))
    assert first == again and len(first) == 12
    known = {(0, 1), (1, 2), (2, 3), (3, 0)}
    for r in models.walks(e, 3, 12).collect():
        assert len(r.walk) == 12 and r.walk[0] == r.start
        assert all((a, b) in known or (b, a) in known for a, b in zip(r.walk, r.walk[1:], strict=False))


def test_held_walks_are_those_by_joins(spark, monkeypatch):
    g = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in zip(g.integers(0, 40, 90), g.integers(0, 40, 90), strict=True) if a != b} | {(7, x) for x in range(100, 190)}
    e = spark.createDataFrame([(a, b + (b > 150) * 2**40, float(g.choice([0.0, 0.3, 0.5, 1.7]))) for a, b in sorted(pairs)], "src_idx long, dst_idx long, weight double")
    for neighbours, seed in ((None, 42), (50, 2**33)):
        held = models.walks(e, 3, 19, neighbours, seed)
        plan = held._jdf.queryExecution().toString()
        assert "Join" not in plan and "Exchange" not in plan
        with monkeypatch.context() as m:
            m.setattr(models, "HELD_BYTES", 0)
            joined = models.walks(e, 3, 19, neighbours, seed)
        assert held.schema.simpleString() == joined.schema.simpleString()
        rows = sorted(held.collect())
        assert rows == sorted(joined.collect()) and all(len(r.walk) == 19 for r in rows)
    assert models.walks(e.where("false")).count() == 0


def test_walks_reach_every_neighbour(spark, tmp_path, monkeypatch):
    """A part with 120 neighbours: walks go to all of them, held by tasks or by joins; nodes that have the same ways share them."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS p_partkey, 'x' AS p_name, 'Brand#1' AS p_brand, 'T' AS p_type, 1 AS p_size FROM range(1, 150) r(i)) TO '{tmp_path}/part.parquet'")
    # Orders of two lines: part 1, then one of the parts 2 to 121 that is no multiple of 50.
    con.execute(f"COPY (SELECT i::BIGINT AS l_orderkey, CASE n WHEN 1 THEN 1 ELSE i END::BIGINT AS l_partkey, n::INTEGER AS l_linenumber, 0.0 AS l_discount, 'R' AS l_returnflag, 50.0 AS l_quantity FROM range(2, 122) r(i), range(1, 3) s(n)) TO '{tmp_path}/lineitem.parquet'")
    n = {r.ord: r.idx for r in catalogue._nodes(spark, str(tmp_path)).collect()}
    held = catalogue.QUERIES["random_walks"](spark, str(tmp_path)).collect()
    assert {x for r in held for x in r.walk} == {n[k] for k in range(1, 122)}
    assert {x for r in held for x in r.walk[1:] if r.start == n[1]} >= {n[1]} and len({r.walk[2] for r in held}) > 60
    # Skip-grams are trained on the same walks.
    with monkeypatch.context() as m:
        m.setattr(models, "skipgram", lambda walked: walked)
        assert sorted(catalogue.QUERIES["skipgram"](spark, str(tmp_path)).collect()) == sorted(held)
    e = spark.createDataFrame([(0, i, 1.0) for i in range(1, 301)], "src_idx long, dst_idx long, weight double")
    monkeypatch.setattr(models, "HELD_BYTES", 12 * (301 + 301))
    shared = models.walks(e, 2, 9)
    assert "Join" not in shared._jdf.queryExecution().toString()
    rows = sorted(shared.collect())
    assert max(x for r in rows for x in r.walk[2:] if r.start) > 280
    monkeypatch.setattr(models, "HELD_BYTES", 0)
    assert rows == sorted(models.walks(e, 2, 9).collect())


def test_a_step_of_skipgrams_is_that_of_its_pairs(monkeypatch):
    """Held against a loop over the pairs; drawn words are worked out once a word, however often it stands on the walks."""
    g = np.random.default_rng(8)
    walks, drawn = g.integers(0, 6, (4, 37)).astype(np.int32), np.array([1, 1, 5, 9, 11, 9], np.int32)
    vin, vout = g.standard_normal((2, 12, 8)).astype(np.float32)
    near = np.random.default_rng(3).integers(1, 4, walks.shape)
    by, n = np.zeros((2, 12, 8)), np.zeros((2, 12))
    wrong = lambda x: 1 / (1 + np.exp(x))
    for walk, size in zip(walks, near, strict=True):
        for i, j in ((i, j) for i in range(37) for j in range(37) if 0 < abs(i - j) <= size[i]):
            a, b = walk[i], walk[j]
            step = wrong(vin[a] @ vout[b])
            by[0, a] += step * vout[b]
            by[1, b] += step * vin[a]
            n[0, a] += 4
            n[1, b] += 1
            for d in drawn:
                step = -wrong(-vin[a] @ vout[d]) * 3 / len(drawn)
                by[0, a] += step * vout[d]
                by[1, d] += step * vin[a]
                n[1, d] += 3 / len(drawn)
    want = np.stack([vin, vout]) + by * np.minimum(0.025, models.MOST_STEP / np.maximum(n, 1))[..., None]
    rows, kept = [], models._unlikely
    monkeypatch.setattr(models, "_unlikely", lambda x: rows.append(x.shape) or kept(x))
    models._train(walks, vin, vout, drawn, 3, 3, 0.025, np.random.default_rng(3))
    assert np.stack([vin, vout]) == pytest.approx(want, abs=1e-5)
    assert [x for x in rows if len(x) == 2] == [(6, 6)]


def test_skipgrams_of_several_tasks(spark, monkeypatch):
    g = np.random.default_rng(6)
    pairs = {(int(a) + k, int(b) + k) for k in (0, 2**33) for a, b in g.integers(0, 30, (120, 2)) if a != b}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src_idx long, dst_idx long, weight double")
    w = models.walks(e, 10, 40).repartitionByRange(3, "start").select(F.expr("slice(walk, 1, 40 - walk_no)").alias("walk"))
    tasks = []
    kept = type(w).coalesce
    monkeypatch.setattr(type(w), "coalesce", lambda self, n: tasks.append(n) or kept(self, n))
    monkeypatch.setattr(models, "TRAINER_WORDS", 1000)
    out = {r.idx: np.array(r.vec) for r in models.skipgram(w, 8, 5, 4).collect()}
    assert tasks == [3] * 4 and sorted(out) == sorted({x for p in pairs for x in p})
    v = np.array([out[i] / np.linalg.norm(out[i]) for i in sorted(out)])
    half = sum(i < 2**33 for i in out)
    near, far = v[:half] @ v[:half].T, v[:half] @ v[half:].T
    assert near.mean() > far.mean() + 0.5
    assert models.skipgram(w.where("false")).count() == 0


def test_views(spark):
    e = spark.createDataFrame([(i, (i + 1) % 9, 1.0) for i in range(9)], "src_idx long, dst_idx long, weight double")
    v = models.skipgram(models.walks(e, 2, 8), dim=4, epochs=1)
    p = models.fuse([v, v.where("idx < 5")], 6)
    rows = p.collect()
    assert len(rows) == 9 and all(np.linalg.norm(r.vec) == pytest.approx(1) for r in rows)
    s = models.smooth_step(p, e).collect()
    assert len(s) == 9 and all(np.linalg.norm(r.vec) == pytest.approx(1) for r in s)


def test_calibration(spark):
    scored = spark.createDataFrame([("a", "b", True, 0.9), ("a", "b", False, 0.1)], "src string, dst string, positive boolean, score double")
    assert models.best_tau(models.tau_grid(scored)) == pytest.approx(0.1)
    assert models.best_tau(models.tau_grid(scored.where("false"))) == 1.0


def test_split_is_a_share(spark, sf):
    e = tables.edges(spark, sf)
    n = e.count()
    assert models.split(e, 0.8).where("train").count() == int(n * 0.8)


def test_ordinal_without_a_single_window(spark, monkeypatch):
    monkeypatch.setattr(loading, "BUCKET", 10)
    rows = spark.range(0, 5000, 7).withColumnRenamed("id", "ord")
    out = [r.idx for r in loading.ordinal(rows, "ord", "idx").orderBy("ord").collect()]
    assert out == list(range(len(out)))


def test_pruning(spark):
    n = spark.createDataFrame([("a", "function", "parse"), ("b", "var", "ab"), ("c", "var", "lonely"), ("d", "function", "lonely"), ("e", "function", "json")], "id string, kind string, name string")
    e = edges(spark, [("a", "b", 1.0), ("a", "e", 1.0), ("a", "gone", 1.0), ("a", "d", 0.2), ("a", "d", 0.3)])
    r = loading.node_reasons(n, e)
    assert {x.id for x in loading.prune_nodes(r).collect()} == {"a", "d"}
    assert sorted((x.dst, x.weight) for x in loading.prune_edges(e, r).collect()) == [("d", 0.3), ("gone", 1.0)]


def test_cascade(spark, sf):
    from codelattice.plans import catalogue

    out = catalogue.QUERIES["multi_stage"](spark, sf).collect()
    assert out and all(r.query != r.id and r["rank"] <= 10 for r in out)


def test_hashed_search_finds_neighbours(spark):
    g = np.random.default_rng(3)
    v = g.standard_normal((200, 8))
    v[100:] = v[:100] + 0.05 * g.standard_normal((100, 8))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    q = p.where("id < 20").withColumnRenamed("id", "query")
    exact = {(r.query, r.id) for r in retrieval.knn(p, q, 2).collect()}
    found = {(r.query, r.id) for r in retrieval.knn_hashed(p, q, 2).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_search_beyond_a_broadcast(spark, monkeypatch, sf):
    from codelattice.plans import catalogue

    few = sorted(map(tuple, catalogue.QUERIES["knn_exact"](spark, sf).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, catalogue.QUERIES["knn_exact"](spark, sf).collect())) == few


SOURCE = '''
import os.path
from json import loads as read
class A(B):
    size: int = 1
    def run(self, n: List[int]) -> str:
        total = helper(n)
        self.go(total)
        return total
def helper(x):
    return x
'''


def test_extraction(spark):
    files = spark.createDataFrame([("p/a.py", SOURCE), ("p/bad.py", "def ("), ("p/none.py", None)], "path string, content string")
    nodes, e, types = extraction.extract(files)
    got = {(r.kind, r.name): r for r in nodes.collect()}
    assert {("class", "A"), ("function", "run"), ("function", "helper"), ("var", "size"), ("var", "total"), ("file", "a.py"), ("file", "none.py")} == set(got)
    assert got["class", "A"].bases == ["B"] and got["function", "run"].args == 2 and got["class", "A"].lineno == 4
    short = lambda s: s.split("@")[0].rsplit("_", 1)[0]
    rels = {(short(r.src), short(r.dst), r.rel, r.weight) for r in e.collect()}
    assert ("class_a", "class_b", "inherits", 1.0) in rels and ("function_run", "function_helper", "calls", 1.0) in rels
    assert ("function_run", "function_self_go", "calls", 1.0) in rels and ("file_a_py", "import_read", "imports", 1.0) in rels
    assert ("function_run", "var_n", "cooccurs", 0.5) in rels and ("function_helper", "var_x", "cooccurs", 0.3) in rels
    assert {(short(r.symbol), r.type_token) for r in types.collect()} == {("var_size", "int"), ("function_run", "List[int]"), ("function_run", "str")}


def test_ignore_patterns(spark):
    rows = spark.createDataFrame([("build/x.py",), ("src/build/x.py",), ("src/keep.log",), ("src/a.log",), ("top.txt",), ("src/top.txt",)], "p string")
    got = [r.g for r in rows.select(extraction.ignored(F.col("p"), ["# c", "build/", "*.log", "!keep.log", "/top.txt"]).alias("g")).collect()]
    assert got == [True, True, False, True, True, False]


def test_jsonl_model_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"src":"a","dst":"b"}\n\n{bad\n{"src":"a","dst":"c","rel":"calls","weight":0.5}\n')
    rows = tables.read_jsonl(spark, str(tmp_path / "in"), tables.EDGE).cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    good = tables.with_defaults(rows.where("_corrupt_record is null"))
    assert {(r.dst, r.rel, r.weight) for r in good.collect()} == {("b", "unknown", 1.0), ("c", "calls", 0.5)}
    assert tables.write_model(str(tmp_path / "model"), {"edges": good}) == {"edges": 2}
    (tmp_path / "in/a.json").write_text('{"src":"a","dst":"b","rel":"calls","weight":1.0}\n')
    args = (str(tmp_path / "in"), tables.EDGE, str(tmp_path / "out"), str(tmp_path / "cp"), ["src", "dst"])
    incremental.follow(spark, *args).awaitTermination()
    (tmp_path / "in/b.json").write_text('{"src":"a","dst":"b","rel":"calls","weight":2.0}\n')
    incremental.follow(spark, *args).awaitTermination()
    assert [r.weight for r in incremental.latest(spark, str(tmp_path / "out"), ["src", "dst"]).collect()] == [2.0]


def test_the_last_edge_of_a_pair_sets_its_weight(spark):
    nodes = spark.createDataFrame([(0, 1, 11), (1, 20, 25), (2, 30, 130)], "idx long, lineno int, end_lineno int")
    edges = spark.createDataFrame([(0, 1, "calls", 0.4), (1, 0, "calls", 0.8), (0, 1, "uses", 1.0), (0, 2, "calls", 0.5)], "src_idx long, dst_idx long, rel string, weight double")
    got = {(r.src_idx, r.dst_idx, r.rel): round(r.weight, 9) for r in graph.scope_boost(edges, nodes).collect()}
    assert got == {(0, 1, "calls"): 1.1, (1, 0, "calls"): 1.1, (0, 1, "uses"): 1.1, (0, 2, "calls"): 0.5}


def test_weights_of_the_hierarchy_follow_the_boost(spark):
    """Calls and line windows are boosted, subtokens and the hierarchy are not, and the hierarchy adds to what is there by then."""
    nodes = spark.createDataFrame([("a", 0, "function", "one", "p/f.py", 1, 5), ("b", 1, "function", "two", "p/f.py", 3, 7)], "id string, idx long, kind string, name string, file string, lineno int, end_lineno int")
    edges = spark.createDataFrame([("a", "b", "calls", 0.5)], "src string, dst string, rel string, weight double")
    rows = {(r.src_idx, r.dst_idx, r.rel): r.weight for r in api.enrich(nodes, edges)[0].where("src_idx < 2 and dst_idx < 2").collect()}
    assert rows[0, 1, "calls"] == rows[0, 1, "context_window"] == 1.2  # the window's 1 is the last weight of the pair
    assert rows[0, 1, "same_file"] == rows[1, 0, "same_file"] == 4.2 and rows[0, 1, "same_package"] == 2.2


def test_walks_go_back_and_away_as_asked(spark):
    """On a path of five nodes: with a tiny p every walk turns back, with a tiny q it goes on."""
    line = spark.createDataFrame([(i, i + 1, "calls", 1.0) for i in range(4)], "src_idx long, dst_idx long, rel string, weight double")
    for r in models.walks(line, 3, 6, p=1e-9).collect():
        assert r.walk[0] == r.walk[2] == r.walk[4] and r.walk[1] == r.walk[3]
    for r in models.walks(line, 3, 4, q=1e-9).where("start = 0").collect():
        assert list(r.walk) == [0, 1, 2, 3]


def test_kept_cells_and_hashes_find_the_nearest(spark, sf, tmp_path):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vec")
    asked = p.where("id % 25 = 0").selectExpr("id AS query", "vec")
    want = {(r.query, r.id) for r in retrieval.knn(p, asked, 10).collect()}
    retrieval.write_index(retrieval.build_index(p), f"{tmp_path}/cells")
    found = retrieval.search_index(retrieval.read_index(spark, f"{tmp_path}/cells"), asked, 10, 15)
    assert len(want & {(r.query, r.id) for r in found.collect()}) >= 0.9 * len(want)
    hashed = {(r.query, r.id) for r in retrieval.knn_hashed(p, asked, 10).collect()}
    assert len(hashed) == len(want) and len(want & hashed) >= 0.9 * len(want)


def test_names_that_are_left_out_and_ends(spark):
    code = "class Data(x.Base, Other):\n    pass\n\ndef run(a):\n    result = (a,\n        a)\n    size: int = 1\n"
    files = spark.createDataFrame([("m.py", code)], "path string, content string")
    nodes, edges, types = extraction.extract(files)
    got = {r.name: (r.lineno, r.end_lineno, r.bases) for r in nodes.collect()}
    assert got["m.py"][:2] == (1, 7) and got["Data"] == (1, 2, ["x.Base", "Other"]) and got["result"][:2] == (5, 6)
    fewer, _, _ = extraction.extract(files, rules=extraction.Rules(frozenset({"data", "result"}), annotated=False, ends=False))
    assert {r.name for r in fewer.collect()} == {"m.py", "run"} and fewer.where("end_lineno is not null").count() == 0


def test_ignore_files_are_found_above(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("x")
    assert extraction.find_rules(str(tmp_path / "a/b")) == str(tmp_path / ".gitignore")


def test_hashed_search_shuffles_no_pairs(spark, sf, monkeypatch):
    """Blocks of queries give what one block gives, and what meets in a shuffle grows with k a query and task, not with pairs."""
    p = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vec")
    asked = p.where("id % 25 = 0").selectExpr("id AS query", "vec")
    plans = []
    monkeypatch.setattr(retrieval, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    one = sorted(map(tuple, retrieval.knn_hashed(p, asked, 10).collect()))
    assert len(one) == 200 and "MapInArrow" in plans[0] and "Join" not in plans[0]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 7)
    monkeypatch.setattr(retrieval, "SCORE_ROWS", 100)
    assert sorted(map(tuple, retrieval.knn_hashed(p, asked, 10).collect())) == one


def test_hashed_search_with_narrow_buckets(spark):
    """Only points that share a bucket in some table are compared; queries that get too few are answered in full."""
    g = np.random.default_rng(5)
    v = g.standard_normal((300, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    q = p.where("id < 15").withColumnRenamed("id", "query")
    codes = retrieval._projected(6, 0.05, 2, 42)(v)
    score = np.round(v @ v.T, 9)
    got = {}
    for r in retrieval.knn_hashed(p, q, 3, 0.05, 2).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id))
    for n in range(15):
        near = [i for i in range(300) if (codes[i] == codes[n]).any()]
        near = near if len(near) >= 3 else range(300)
        assert [i for _, i in sorted(got[n])] == sorted(near, key=lambda i: (-score[n, i], i))[:3]


def test_lexical_search_scores_kinds_of_symbols(spark):
    """As pair by pair: few names, many symbols and queries; symbols and queries that come twice; ties at the edge of k."""
    g = np.random.default_rng(7)
    words = ["red", "ring", "bolt", "redring", "blue"]
    names = [(f"s{int(g.integers(0, 50)):02}", str(g.choice(words))) for _ in range(70)]
    index = sorted({(t, i) for i, n in names for t in (n, *g.choice(words, 2))})
    asked = [(f"q{n % 9}", [str(w) for w in g.choice(words, 1 + n % 3)]) for n in range(12)]
    want = {}
    for q, tokens in asked:
        for t in tokens:
            for token, i in index:
                for own, name in names:
                    if token == t and own == i:
                        points, most = want.get((q, i), (0.0, 0))
                        gain = 10 if name == t else 5 if name.startswith(t) else 3 if t in name else 1
                        want[q, i] = points + gain, max(most, len(tokens))
    ranked = {}
    for (q, i), (points, most) in want.items():
        ranked.setdefault(q, []).append((-round(points / most, 9), i))
    rows = retrieval.lexical(spark.createDataFrame(index, "token string, id string"), spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(asked, "query string, tokens array<string>"), 6)
    got = sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in rows.collect())
    assert got == sorted((q, n, i, -s) for q, every in ranked.items() for n, (s, i) in enumerate(sorted(every)[:6], 1))
    plan = retrieval.lexical(spark.createDataFrame(index, "token string, id string"), spark.createDataFrame(names, "id string, name string"), spark.createDataFrame(asked, "query string, tokens array<string>"), 6)
    assert "list" in plan._jdf.queryExecution().analyzed().toString()  # no join of queries with symbols


def test_pairs_of_a_namespace_are_dealt_out(spark, sf):
    """A small table gives many pairs: they come from several tasks, and scores from pairs of files."""
    from codelattice.plans import catalogue

    out = catalogue.QUERIES["namespace_score"](spark, sf)
    filled = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(filled) > 4 and max(filled) < sum(filled) / 2


def test_cascade_asks_only_what_has_a_vector(spark, sf, monkeypatch):
    """A query without a vector gives no rows in the end, and its lexical stage isn't run."""
    from codelattice.plans import catalogue

    seen, plain = [], retrieval.lexical
    monkeypatch.setattr(retrieval, "lexical", lambda i, n, q, k: seen.append(q) or plain(i, n, q, k))
    points = catalogue._points
    want = sorted(map(tuple, catalogue.QUERIES["multi_stage"](spark, sf).where("query <> 'part_000100'").collect()))
    monkeypatch.setattr(catalogue, "_points", lambda s, d: points(s, d).where("idx <> 100"))
    got = catalogue.QUERIES["multi_stage"](spark, sf)
    assert {r.query for r in got.collect()} == {r.query for r in seen[-1].collect()} == {"part_000000"} and want
