"""Scalar functions against hand-made tables."""

import pytest
from pyspark.sql import functions as F

from codelattice.functions import names, scores, text, vectors


def values(spark, items, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, s string")
    return [r.out for r in rows.select("i", f(F.col("s")).alias("out")).orderBy("i").collect()]


def test_camel(spark):
    cases = {"XMLParser": ["XML", "Parser"], "getXMLParser2Fast": ["get", "XML", "Parser2", "Fast"], "HTTP2Server": ["HTT", "P2", "Server"], "": [], "a_b": ["a", "b"]}
    assert values(spark, cases, text.camel) == list(cases.values())


def test_parts(spark):
    assert values(spark, ["a__b_", "x"], text.snake) == [["a", "b"], ["x"]]
    assert values(spark, ["a--b"], text.kebab) == [["a", "b"]]
    assert values(spark, ["ab12Cd"], text.numeric) == [["ab", "12", "Cd"]]
    assert set(values(spark, ["User_user"], text.subtokens)[0]) == {"User", "user", "User_user"}
    assert sorted(values(spark, ["User_user"], text.normalised)[0]) == ["user", "user", "user_us"]


def test_stem(spark):
    cases = {"user": "user", "string": "str", "number": "numb", "ing": "ing", "Running": "runn", "ABC": "ABC", "Name": "name"}
    assert values(spark, cases, text.stem) == list(cases.values())


def test_hierarchy(spark):
    cases = {"a\\b\\c.py": ("c.py", "a/b", "a"), "/root/x.py": ("x.py", "/root", "root"), "": ("", "", ""), "./p/q.py": ("q.py", "./p", "p"), "x.py": ("x.py", "", "x.py")}
    got = values(spark, cases, lambda c: F.array(*text.hierarchy(c)))
    assert [tuple(x) for x in got] == list(cases.values())


def test_sanitised(spark):
    assert values(spark, ["a b--c", "__", "X" * 80], text.sanitised) == ["a_b_c", "unnamed", "x" * 50]


def test_types(spark):
    assert values(spark, ["List[Dict[str, int]]", "int", "list[int]"], text.type_constructors) == [["List", "Dict"], [], []]
    assert values(spark, ["List[Dict[str, int]]", "int"], text.type_primitives) == [["str", "int"], ["int"]]
    assert values(spark, ["Dict[str, Int]", "int"], text.inner_types) == [["str", "int"], []]


def test_generic_names(spark):
    rows = spark.createDataFrame([("ab", "var"), ("ab", "function"), ("Data", "class"), ("x", "import"), ("parse", "function")], "name string, kind string")
    assert [r.g for r in rows.select(names.is_generic(F.col("name"), F.col("kind")).alias("g")).collect()] == [True, False, True, True, False]
    assert {"import", "len", "json"} <= names.excluded()


def test_namespace(spark):
    cases = [("a/b/x.py", "c/x.py", 1.0), ("a/b/x.py", "a/b/y.py", 0.7), ("a/b/x.py", "a/c/y.py", 0.4), ("x/a/p.py", "y/a/q.py", 0.0), ("p.py", "q.py", 0.0)]
    for p, q, want in cases:
        row = spark.createDataFrame([(p, q)], "p string, q string").select(scores.namespace(*text.hierarchy(F.col("p")), *text.hierarchy(F.col("q"))).alias("s")).first()
        assert row.s == pytest.approx(want)


def test_keyword_ladder(spark):
    rows = spark.createDataFrame([("handler", "class", ""), ("handler_x", "class", ""), ("my_handler", "class", ""), ("x", "handler", ""), ("x", "handlers", ""), ("x", "var", "list handler"), ("x", "var", "")], "n string, k string, t string")
    one = [r.s for r in rows.select(scores.keyword_score(F.col("n"), F.col("k"), F.col("t"), ["handler"]).alias("s")).collect()]
    assert one == [1.0, 0.8, 0.6, 0.4, 0.2, 0.3, 0.0]
    two = [r.s for r in spark.createDataFrame([("b_a", "v", ""), ("a", "v", "b"), ("x", "a b", ""), ("x", "v", "a b"), ("a", "v", "")], "n string, k string, t string").select(scores.keyword_score(F.col("n"), F.col("k"), F.col("t"), ["a", "b"]).alias("s")).collect()]
    assert two == pytest.approx([0.7, 0.6, 0.3, 0.35, 0.175])


def test_vectors_and_scopes(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "x array<double>, z array<double>").select(vectors.norm(F.col("x")).alias("n"), vectors.unit(F.col("x")).alias("u"), vectors.unit(F.col("z")).alias("z")).first()
    assert row.n == 5 and row.u == [0.6, 0.8] and row.z == [0.0, 0.0]
    lengths = spark.createDataFrame([(10, 3), (10, 2), (None, 2)], "a int, b int").select(scores.scope_similarity(F.col("a"), F.col("b"), 0.3).alias("s")).collect()
    assert [r.s for r in lengths] == [0.3, 0.0, 0.0]
