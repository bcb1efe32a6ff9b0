"""Commands: extract, optimize, train, retrain, query, validate, stats.

    python -m codelattice.cli extract src --out tables
    python -m codelattice.cli train tables --model model
    python -m codelattice.cli query model --keywords "parse config"
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice import api
from codelattice.functions.names import excluded
from codelattice.operators import extraction, loading
from codelattice.session import session
from codelattice.sources import git

#: Folders that are left out of an extraction.
SKIPPED = (".venv", "venv", "__pycache__", ".git", "node_modules", ".pytest_cache")


def sources(spark: SparkSession, folder: str, extensions: str = "py", skipped: tuple[str, ...] = SKIPPED, wanted: tuple[str, ...] = (), ignore: bool = True) -> DataFrame:
    """path (relative), content of the files of a folder: not ignored, not in skipped, and in wanted if given."""
    root = os.path.abspath(folder)
    found = extraction.read_sources(spark, folder, f"*.{{{extensions}}}")
    found = found.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root) + "/?", ""))
    rules = extraction.find_rules(root) if ignore else None
    patterns: list[str] = []
    if rules:
        with open(rules) as f:
            patterns = f.read().splitlines()
    return extraction.wanted_paths(found, extensions.split(","), skipped, wanted, patterns)


def _extracted(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = sources(spark, a.folder, a.extensions, tuple(a.exclude), tuple(a.include), not a.no_gitignore)
    return extraction.extract(found, rules=extraction.Rules(excluded(a.exclude_keywords)))


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return api.from_jsonl(spark, *[f"{folder}/{x}" for x in ("nodes", "edges", "types")])


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    api.to_jsonl(*_extracted(spark, a), a.out)


def optimize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes to another folder, since a table can't be read and replaced at once."""
    nodes, edges, types = _read(spark, a.folder)
    reasons = loading.node_reasons(nodes, edges, excluded(a.exclude_keywords))
    gone = F.col("is_excluded")
    if not a.keep_generic:
        gone = gone | F.col("is_generic")
    if not a.keep_isolated:
        gone = gone | (F.col("is_isolated") & ~F.col("kind").isin(*loading.KEPT_KINDS))
    reasons = reasons.withColumn("removed", gone)
    api.to_jsonl(loading.prune_nodes(reasons), loading.prune_edges(edges, reasons, a.min_weight), loading.prune_types(types, reasons), a.out)
    loading.prune_summary(reasons).orderBy("kind").show()


def _settings(a: argparse.Namespace) -> api.Settings:
    s = api.Settings(seed=a.seed, ratio=a.ratio, walks=a.walks, length=a.length)
    s = s.legacy() if a.profile == "legacy" else s
    s = replace(s, final_dim=a.dim) if a.dim else replace(s, automatic=True)
    return s.quick() if a.fast else s


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    api.train(*_read(spark, a.folder), a.model, _settings(a), *((git.head(a.code), git.commit_time(a.code)) if a.code else ()))


def retrain(spark: SparkSession, a: argparse.Namespace) -> None:
    """Trains on what belongs to files that changed since the model's commit, into another folder."""
    old = api.Model(spark, a.model)
    files = git.tracked(a.folder) if a.force or not old.commit else git.changed(a.folder, old.commit)
    if not files:
        print("nothing has changed")
        return
    wanted = spark.createDataFrame([(f,) for f in files], "file string")
    api.train(*loading.changed_only(*_extracted(spark, a), wanted), a.out, old.settings, git.head(a.folder), git.commit_time(a.folder))


def query(spark: SparkSession, a: argparse.Namespace) -> int:
    """Asks the model in a folder, or every model found below it."""
    models = [a.model] if a.no_recursive else api.discover(a.model)
    asked = {"symbol": a.symbol} if a.symbol else {"keywords": a.keywords}
    rows: list[dict] = []
    for path in models:
        model = api.Model(spark, path)
        found = model.similar([a.symbol], a.top_k, a.exclude) if a.symbol else model.search(a.keywords, a.top_k, a.exclude, a.case_sensitive)
        rows += [r.asDict() | ({"model": path} if len(models) > 1 else {}) for r in found.orderBy("rank").collect()]  # at most top_k each
    if a.full:
        for row in rows:
            row["code"] = api.code_of(row["file"], row["lineno"], row["end_lineno"], a.code)
    print((api.as_toon if a.format == "toon" else api.as_json)(rows, asked))
    return 0 if models else 1


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    """Shows missing fields, numbers that are none and missing references; 1 if there are any."""
    wrong = api.field_report(spark, *[f"{a.folder}/{x}" for x in ("nodes", "edges", "types")])
    report = loading.reference_report(*_read(spark, a.folder)).orderBy("place")
    wrong.show(truncate=False)
    report.show(truncate=False)
    return int(not report.isEmpty() or not wrong.where("n > 0").isEmpty())


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes, edges, types = _read(spark, a.folder)
    for table in (loading.distribution(nodes, "kind", 20), loading.distribution(edges, "rel", 20), loading.distribution(types, "type_token", 20), loading.weight_stats(edges)):
        table.show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codelattice")
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for x in positional:
            c.add_argument(x)
        return c

    for f in (extract, retrain):
        c = command(f, "folder")
        c.add_argument("--out", required=True)
        c.add_argument("--extensions", default="py", help="comma-separated")
        c.add_argument("--exclude", nargs="*", default=list(SKIPPED))
        c.add_argument("--include", nargs="*", default=[])
        c.add_argument("--no-gitignore", action="store_true")
        c.add_argument("--exclude-keywords", nargs="*", default=[])
    c.add_argument("--model", required=True)
    c.add_argument("--force", action="store_true")
    c = command(optimize, "folder")
    c.add_argument("--out", required=True)
    c.add_argument("--min-weight", type=float, default=0.3)
    c.add_argument("--keep-isolated", action="store_true")
    c.add_argument("--keep-generic", action="store_true")
    c.add_argument("--exclude-keywords", nargs="*", default=[])
    c = command(train, "folder")
    c.add_argument("--model", required=True)
    c.add_argument("--code", help="the folder of the sources, to remember its commit")
    c.add_argument("--fast", action="store_true")
    c.add_argument("--profile", choices=("current", "legacy"), default="current")
    for name, kind, default in (("dim", int, None), ("walks", int, 10), ("length", int, 80), ("ratio", float, 0.8), ("seed", int, 42)):
        c.add_argument(f"--{name}", type=kind, default=default)
    c = command(query, "model")
    what = c.add_mutually_exclusive_group(required=True)
    what.add_argument("--symbol")
    what.add_argument("--keywords")
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--exclude", nargs="*", default=[])
    c.add_argument("--format", choices=("json", "toon"), default="json")
    c.add_argument("--case-sensitive", action="store_true")
    c.add_argument("--no-recursive", action="store_true")
    c.add_argument("--full", action="store_true", help="with the code of each result")
    c.add_argument("--code", default=".", help="the folder of the sources")
    command(validate, "folder")
    command(stats, "folder")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
