"""From a folder of sources to answers, through the commands."""

import json
import subprocess

import pytest

from codelattice import api, cli
from codelattice.sources import git

CODE = {
    "pkg/reader.py": "class ConfigReader:\n    def read_config(self, path: str) -> dict:\n        return parse_config(path)\n\ndef parse_config(path: str) -> dict:\n    return load_file(path)\n",
    "pkg/loader.py": "def load_file(path: str) -> str:\n    text: str = open_file(path)\n    return text\n\ndef open_file(path: str) -> str:\n    return path\n",
    "pkg/writer.py": "def write_config(path: str, values: dict) -> int:\n    body = format_config(values)\n    return save_file(path, body)\n\ndef format_config(values: dict) -> str:\n    return values\n",
    "skip/other.py": "def ignored_function():\n    return 1\n",
}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("code")
    for name, code in CODE.items():
        (top / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (top / "src" / name).write_text(code)
    (top / "src/.gitignore").write_text("skip/\n")
    run = lambda *a: cli.parser().parse_args([str(x) for x in a])
    a = run("extract", top / "src", "--out", top / "tables")
    a.run(spark, a)
    a = run("train", top / "tables", "--model", top / "model", "--fast", "--dim", 8, "--walks", 2, "--length", 5)
    s = api.replace(cli._settings(a), walks=2, length=5, graph_dim=4, context_dim=4, typed_dim=2, smoothing=1, epochs=1)
    api.train(*cli._read(spark, a.folder), a.model, s)
    return top, run


def test_extract_and_train(spark, made):
    top, _ = made
    nodes, edges, types = cli._read(spark, f"{top}/tables")
    assert {r.file for r in nodes.select("file").distinct().collect()} == {k for k in CODE if k.startswith("pkg")}
    model = api.Model(spark, f"{top}/model")
    assert 0.1 <= model.tau <= 10 and model.settings.graph_dim == 4
    assert model.tables["embeddings"].where("size(vec) = 8").count() == model.tables["embeddings"].count() > nodes.count()


def test_search_and_similar(spark, made, capsys):
    top, run = made
    model = api.Model(spark, f"{top}/model")
    best = model.search("parse_config").orderBy("rank").first()
    assert best["name"] == "parse_config" and best["score"] == 1.0
    rows = model.similar([best["id"]], 5).orderBy("rank").collect()
    assert 0 < len(rows) <= 5 and best["id"] not in {r["id"] for r in rows}
    left = model.similar([best["id"]], 5, [rows[0]["name"]]).collect()
    assert rows[0]["name"] not in {r["name"] for r in left}
    assert model.similar(["nothing"]).count() == 0
    a = run("query", top / "model", "--keywords", "config read", "--format", "toon")
    a.run(spark, a)
    assert capsys.readouterr().out.startswith("query:\n  keywords: config read\nresults[")


def test_formats():
    rows = [{"id": "a", "score": 0.5, "file": "x, y"}, {"id": "7", "score": None, "file": ""}]
    assert api.as_toon(rows, {"symbol": "a:b"}) == 'query:\n  symbol: "a:b"\nresults[2]{id,score,file}:\n  a,0.5,"x, y"\n  "7",null,""'
    assert api.as_toon([], {}) == "query:\nresults[0]:"
    assert json.loads(api.as_json(rows, {"symbol": "a"}))["results"] == rows


def test_git(tmp_path):
    sh = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    assert git.head(str(tmp_path)) is None
    sh("init")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    sh("add", "."), sh("commit", "-m", "one")
    first = git.head(str(tmp_path))
    (tmp_path / "b.py").write_text("y = 2\n")
    assert git.tracked(str(tmp_path)) == ["a.py", "b.py"] and git.changed(str(tmp_path), first) == ["b.py"] and git.commit_time(str(tmp_path)) > 0


def test_optimize_and_validate(spark, made, capsys):
    top, run = made
    a = run("optimize", top / "tables", "--out", top / "lean", "--min-weight", 0.6)
    a.run(spark, a)
    nodes, edges, types = cli._read(spark, f"{top}/lean")
    assert 0 < nodes.count() <= cli._read(spark, f"{top}/tables")[0].count()
    assert edges.where("weight < 0.6").count() == 0 and edges.count() > 0
    assert types.join(nodes, types.symbol == nodes.id, "left_anti").count() == 0
    for name in ("validate", "stats"):
        a = run(name, top / "lean")
        code = a.run(spark, a)
        assert code in (0, 1, None)
    assert "defines_in_file" in capsys.readouterr().out


def test_retrain(spark, made):
    top, run = made
    src = top / "src"
    sh = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    sh("init"), sh("add", "."), sh("commit", "-m", "one")
    a = run("retrain", src, "--model", top / "model", "--out", top / "newer")
    a.run(spark, a)  # the model knows no commit: all tracked files
    newer = api.Model(spark, f"{top}/newer")
    assert newer.commit == git.head(str(src))
    assert newer.tables["nodes"].count() == api.Model(spark, f"{top}/model").tables["nodes"].count()


def test_dimensions_and_presets():
    assert api.default_dimensions(40) == {"graph_dim": 32, "context_dim": 32, "typed_dim": 32, "final_dim": 38}
    assert api.default_dimensions(150, 10)["graph_dim"] == 57 and api.default_dimensions(500, 30)["typed_dim"] == 16
    assert api.default_dimensions(10**6, 5000) == {"graph_dim": 119, "context_dim": 119, "typed_dim": 64, "final_dim": 181}
    old = api.Settings().legacy()
    assert (old.svd_steps, old.window, old.epochs, old.taus, old.tau_span, old.neighbours, old.capped, old.bonus) == (10, 10, 5, 50, 2.0, None, False, False)
    assert "scopes" not in old.steps and api.Settings(automatic=True).fitted(150, 10).graph_dim == 57


def test_keywords():
    assert api.keywords('Parse "my Config", file') == ["parse", "my", "config", "file"]
    assert api.keywords("don't Stop", True) == ["don't", "Stop"]


def test_models_are_found(tmp_path):
    for name in ("b", "a/deep", ".hidden"):
        for table in ("embeddings", "nodes", "settings"):
            (tmp_path / name / table).mkdir(parents=True)
    (tmp_path / "none/embeddings").mkdir(parents=True)
    assert api.discover(str(tmp_path)) == [str(tmp_path / "a/deep"), str(tmp_path / "b")]
    assert api.discover(str(tmp_path / "b")) == [str(tmp_path / "b")]


def test_other_searches_and_code(spark, made, capsys):
    top, run = made
    model = api.Model(spark, f"{top}/model")
    best = model.search("parse_config").first()["id"]
    near, exact = ([r["id"] for r in x.orderBy("rank").collect()] for x in (model.nearest([best], 5, 100), model.plain([best], 4)))
    assert near[0] == best and len(exact) == 4 and best not in exact
    assert model.search("PARSE_config", case_sensitive=True).count() == 0
    found = model.gather(["parse config", "load file", "open file", "never asked"]).collect()
    assert found and len({(r["file"], r["lineno"]) for r in found}) == len(found)
    a = run("query", top, "--keywords", "parse_config", "--full", "--code", top / "src")
    assert a.run(spark, a) == 0
    first = json.loads(capsys.readouterr().out)["results"][0]
    assert first["code"] == "def parse_config(path: str) -> dict:\n    return load_file(path)"


def test_the_older_variant_trains(spark, made):
    top, _ = made
    nodes, edges, types = cli._read(spark, f"{top}/tables")
    s = api.replace(api.Settings().legacy(), walks=1, length=4, graph_dim=4, context_dim=4, typed_dim=2, final_dim=6, epochs=1, svd_steps=1, smoothing=1, taus=5)
    model = api.train(nodes, edges, types, f"{top}/older", s)
    assert model.settings == s and model.tables["embeddings"].where("id like 'subtoken:%'").count() == 0
