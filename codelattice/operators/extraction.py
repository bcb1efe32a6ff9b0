"""Symbols, edges and type tokens of Python sources, one file a row."""

from __future__ import annotations

import ast
import fnmatch
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, part string, a string, b string, c string, weight double, first int, last int, n int, bases array<string>"


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """path, content of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def find_rules(folder: str) -> str | None:
    """The ignore file of a folder or of the nearest one above it."""
    at = os.path.realpath(folder)
    while True:
        if os.path.exists(found := os.path.join(at, ".gitignore")):
            return found
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)


def wanted_paths(files: DataFrame, extensions: Sequence[str] = ("py",), skipped: Sequence[str] = (), wanted: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Rows (path, ...) with one of the extensions that hold no skipped part, are not ignored and, if any is asked for, hold
    a wanted part."""
    path = F.col("path")
    out = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*[x.lower() for x in extensions]) & path.contains("."))
    for x in skipped:
        out = out.where(~path.contains(x))
    if patterns:
        out = out.where(~ignored(path, list(patterns)))
    if wanted:
        out = out.where(reduce(or_, [path.contains(x) for x in wanted]))
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns cover a relative path: the last that matches wins, ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!").rstrip("/")
        glob = lambda g: fnmatch.translate(g).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "")
        if p.startswith("/"):
            rx = f"^{glob(p[1:])}(/|$)"
        elif "**" in p:
            rx = "(^|/)" + ".*".join(glob(x) for x in p.split("**"))
        else:
            rx = f"(^|/){glob(p)}(/|$)"
        out = F.when(path.rlike(rx), F.lit(not back)).otherwise(out)
    return out


def _clean(name: str) -> str:
    return (re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_")[:50] or "unnamed").lower()


@dataclass(frozen=True)
class Rules:
    """Names (lower case) that are no symbols; whether annotated assignments count; whether symbols have end lines."""

    without: frozenset[str] = frozenset()
    annotated: bool = True
    ends: bool = True


class _File(ast.NodeVisitor):
    """Rows of one file. Functions are nearer than classes, classes nearer than the file."""

    def __init__(self, path: str, tree: ast.Module, rules: Rules):
        self.path, self.rules, self.ids, self.nodes, self.edges, self.types = path, rules, {}, {}, {}, {}
        self.classes: list[str | None] = []
        self.functions: list[str | None] = []
        last = max((getattr(n, "end_lineno", None) or 0 for n in ast.walk(tree)), default=0)
        self.name = path.rsplit("/", 1)[-1]
        self.symbol("file", self.name, 1, last if last > 1 else None)

    @property
    def root(self) -> str:
        return self.ref("file", self.name)

    def ref(self, kind: str, name: str) -> str:
        return self.ids.setdefault((kind, name), f"{kind}_{_clean(name)}_{len(self.ids) + 1:04d}")

    def symbol(self, kind: str, name: str, first: int, last: int | None, **more) -> str | None:
        """The symbol's id; None for names that are left out, whose edges and types go with them."""
        if name.lower() in self.rules.without:
            return None
        key = self.ref(kind, name)
        self.nodes.setdefault(key, {"kind": kind, "name": name, "first": first, "last": last if self.rules.ends else None, **more})
        return key

    def edge(self, src: str | None, dst: str | None, rel: str, weight: float = 1.0) -> None:
        if src and dst:
            self.edges[src, dst, rel] = max(weight, self.edges.get((src, dst, rel), 0.0))

    def typed(self, symbol: str | None, annotation: ast.expr | None) -> None:
        if symbol and annotation is not None:
            t = (symbol, ast.unparse(annotation))
            self.types[t] = self.types.get(t, 0) + 1

    def scope(self) -> str | None:
        return (self.functions and self.functions[-1]) or (self.classes and self.classes[-1]) or None

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        me = self.symbol("class", node.name, node.lineno, node.end_lineno, bases=[ast.unparse(b) for b in node.bases])
        self.edge(self.root, me, "defines_in_file")
        for b in node.bases:
            if isinstance(b, ast.Name):
                self.edge(me, self.ref("class", b.id), "inherits")
        self.classes.append(me)
        self.generic_visit(node)
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        me = self.symbol("function", node.name, node.lineno, node.end_lineno, n=len(node.args.args))
        self.edge((self.classes and self.classes[-1]) or self.root, me, "defines_in_file")
        self.typed(me, node.returns)
        for a in node.args.args:
            self.typed(me, a.annotation)
        self.functions.append(me)
        self.generic_visit(node)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import | ast.ImportFrom) -> None:
        for a in node.names:
            name = a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name)
            self.edge(self.root, self.ref("import", name), "imports")

    visit_ImportFrom = visit_Import

    def visit_Call(self, node: ast.Call) -> None:
        if caller := self.scope():
            f = node.func
            if isinstance(f, ast.Name):
                self.edge(caller, self.ref("function", f.id), "calls")
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                self.edge(caller, self.ref("function", f"{f.value.id}.{f.attr}"), "calls")
            for a in node.args:
                if isinstance(a, ast.Name):
                    self.edge(caller, self.ref("var", a.id), "cooccurs", 0.5)
        self.generic_visit(node)

    def variable(self, node: ast.Assign | ast.AnnAssign, target: ast.expr, annotation: ast.expr | None) -> None:
        if isinstance(target, ast.Name):
            me = self.symbol("var", target.id, node.lineno, node.end_lineno)
            self.edge(self.scope() or self.root, me, "defines_in_file")
            self.typed(me, annotation)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.variable(node, t, None)
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if self.rules.annotated:
            self.variable(node, node.target, node.annotation)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and (scope := self.scope()):
            self.edge(scope, self.ref("var", node.id), "cooccurs", 0.3)

    def rows(self) -> Iterator[tuple]:
        for key, x in self.nodes.items():
            yield self.path, "node", key, x["kind"], x["name"], None, x["first"], x["last"], x.get("n"), x.get("bases")
        for (src, dst, rel), w in self.edges.items():
            yield self.path, "edge", src, dst, rel, w, None, None, None, None
        for (symbol, token), n in self.types.items():
            yield self.path, "type", symbol, token, None, None, None, None, n, None


def _parse(rules: Rules):
    kinds = [pa.string()] * 5 + [pa.float64()] + [pa.int32()] * 3 + [pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    tree = ast.parse(content or "")
                    file = _File(path, tree, rules)
                    file.visit(tree)
                except (SyntaxError, ValueError, RecursionError):  # a file that can't be parsed has no symbols
                    continue
                rows += file.rows()
            cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def extract(sources: DataFrame, qualified: bool = True, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and types of (path, content). Ids are numbered per file; qualified ids carry a digest of
    the path, so that they can't collide, else the first path keeps an id."""
    rows = sources.mapInArrow(_parse(rules), SCHEMA)
    of = (lambda c: F.concat(F.col(c), F.lit("@"), F.substring(F.md5(F.col("path").cast("binary")), 1, 12))) if qualified else F.col
    nodes = rows.where("part = 'node'").select(of("a").alias("id"), F.col("b").alias("kind"), F.col("c").alias("name"), F.col("path").alias("file"), F.col("first").alias("lineno"), F.col("last").alias("end_lineno"), F.col("n").alias("args"), "bases")
    nodes = nodes.groupBy("id").agg(F.min_by(F.struct("kind", "name", "file", "lineno", "end_lineno", "args", "bases"), F.struct("file", "lineno")).alias("x")).select("id", "x.*")
    edges = rows.where("part = 'edge'").select(of("a").alias("src"), of("b").alias("dst"), F.col("c").alias("rel"), "weight").groupBy("src", "dst", "rel").agg(F.max("weight").alias("weight"))
    types = rows.where("part = 'type'").select(of("a").alias("symbol"), F.col("b").alias("type_token"), F.col("n").alias("count")).groupBy("symbol", "type_token").agg(F.sum("count").alias("count"))
    return nodes, edges, types


def snippets(files: DataFrame, places: DataFrame) -> DataFrame:
    """path, line, code: lines first..last (from 1) of files (path, content)."""
    lines = files.join(places, "path").select("path", "first", "last", F.posexplode(F.split("content", "\n")).alias("n", "code"))
    return lines.where((F.col("n") + 1).between(F.col("first"), F.col("last"))).select("path", (F.col("n") + 1).alias("line"), F.rtrim("code").alias("code"))
