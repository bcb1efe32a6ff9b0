"""Train a model of symbols from nodes, edges and type tokens, keep it as tables, and ask it.

    model = train(nodes, edges, types, "/models/mine")
    model.similar(["function_main_0005@..."])     # the staged search, a batch of symbols at a time
    model.search("parse config")                  # by keywords
"""

from __future__ import annotations

import json
import math
import os
import shlex
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import text, vectors
from codelattice.functions.names import excluded
from codelattice.operators import graph, loading, models, retrieval
from codelattice.session import checkpointed
from codelattice.sources import tables

TABLES = ["embeddings", "nodes", "types", "postings", "subtokens", "type_tokens", "files", "settings"]


@dataclass(frozen=True)
class Settings:
    """What training takes; ``quick`` gives the shorter variant, ``legacy`` the rules of the older one."""

    graph_dim: int = 32
    context_dim: int = 32
    typed_dim: int = 16
    final_dim: int = 64
    automatic: bool = False  # dimensions by the sizes of the data
    walks: int = 10
    length: int = 80
    neighbours: int | None = 50
    p: float = 1.0
    q: float = 1.0
    common: bool = True
    window: int = 7
    epochs: int = 3
    depth: int = 3
    lines: int = 5
    capped: bool = True
    steps: tuple[str, ...] = ("calls", "lines", "scopes", "subtokens", "hierarchy")
    accumulated: bool = False  # line windows and the hierarchy as in the older variant, the adjacency not added up
    svd_steps: int = 5
    smoothing: int = 2
    beta: float = 0.35
    distinct: bool = False
    negatives: int = 5
    taus: int = 30
    tau_span: float = 1.0
    ratio: float = 0.8
    bonus: bool = True
    seed: int = 42

    def quick(self) -> Settings:
        return replace(
            self, walks=max(5, self.walks // 2), length=max(40, self.length // 2), window=3, lines=3, depth=2, smoothing=1, negatives=3, taus=20, ratio=min(0.9, self.ratio + 0.05)
        )

    def legacy(self) -> Settings:
        """Fixed values of the older variant: no limits, no scopes, its window, epochs, grid and smoothing."""
        steps = tuple(x for x in self.steps if x not in ("scopes", "subtokens"))
        return replace(
            self, neighbours=None, common=False, window=10, epochs=5, capped=False, steps=steps, accumulated=True, svd_steps=10, distinct=True, negatives=5, taus=50, tau_span=2.0, bonus=False
        )

    def fitted(self, nodes: int, types: int) -> Settings:
        return replace(self, **default_dimensions(nodes, types), automatic=False) if self.automatic else self


def default_dimensions(nodes: int, types: int = 0) -> dict[str, int]:
    """Dimensions that go with the logarithm of the nodes and the root of the type tokens. Bounds and factors."""
    log, root = math.log2(max(nodes, 1)), math.sqrt(types)
    graph = 32 if nodes < 50 else next(max(low, min(high, int(log * by))) for below, low, high, by in ((200, 32, 64, 8), (1000, 48, 96, 7), (math.inf, 64, 128, 6)) if nodes < below)
    typed = 32 if not types else 16 if types < 20 else max(16, min(32, int(root * 2))) if types < 50 else max(32, min(64, int(root * 2)))
    final = max(32, min(nodes - 1, 256, int((2 * graph + (typed if types else 0)) * 0.6)))
    return {"graph_dim": graph, "context_dim": graph, "typed_dim": typed, "final_dim": final}


def from_jsonl(spark: SparkSession, nodes: str, edges: str, types: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of JSON lines, flat and with defaults; lines that don't parse are left out."""
    n = tables.read_jsonl(spark, nodes, tables.NODE).where("id is not null")
    n = n.select(
        "id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("meta.file", F.lit("")).alias("file"),
        F.coalesce("meta.lineno", F.lit(-1)).alias("lineno"), F.col("meta.end_lineno").alias("end_lineno"),
    )
    e = tables.with_defaults(tables.read_jsonl(spark, edges, tables.EDGE).where("src is not null and dst is not null"))
    t = tables.read_jsonl(spark, types, tables.TYPE).where("symbol is not null and type_token is not null")
    return n, e, t.select("symbol", "type_token", F.coalesce("count", F.lit(1)).alias("count"))


def to_jsonl(nodes: DataFrame, edges: DataFrame, types: DataFrame, folder: str) -> None:
    """The inverse of ``from_jsonl``: folders nodes, edges and types."""
    meta = F.struct("file", "lineno", "end_lineno", F.array().cast("array<string>").alias("typing"))
    for name, rows in (("nodes", nodes.select("id", "kind", "name", meta.alias("meta"))), ("edges", edges), ("types", types)):
        tables.write_results(rows, f"{folder}/{name}")


def _with_subtokens(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, idx of nodes and, after them, of the subtokens in ``links``."""
    tokens = links.where("rel = 'has_subtoken'").select(F.col("dst").alias("id")).distinct()
    tokens = tokens.withColumn("ord", F.shiftrightunsigned(F.xxhash64("id"), 2))
    after = nodes.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    return nodes.select("id", "idx").unionByName(loading.ordinal(tokens, "ord", "idx").select("id", (F.col("idx") + after).alias("idx")))


def enrich(nodes: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Indexed edges with all derived ones, and id, idx of nodes and subtokens. The order matters: calls first, then
    line windows, then the weights of both by scope lengths, then subtokens and the hierarchy, whose pairs weigh what they
    weigh by then and more. nodes are indexed; edges go by id."""
    s, limits = settings, graph.CallLimits(neighbours=None)
    if s.capped:
        limits = graph.CallLimits.of(nodes.count(), edges.where("rel = 'calls'").count())
    links = graph.subtoken_edges(nodes)
    index = checkpointed(_with_subtokens(nodes, links if "subtokens" in s.steps else links.where("false")))
    out = edges
    if "calls" in s.steps:
        out = out.unionByName(graph.expand_calls(edges, s.depth, limits).withColumn("rel", F.lit("calls")).select("src", "dst", "rel", "weight"))
    out = loading.index_edges(out, index)
    caps = {} if s.capped else {"most_nodes": None, "most_pairs": None}
    if "lines" in s.steps:
        out = checkpointed(out)
        out = out.unionByName(graph.context_window(nodes, s.lines, added_to=out if s.accumulated else None, **caps))
    if "scopes" in s.steps:
        out = graph.scope_boost(out, nodes)
    own = out = checkpointed(out)
    if "subtokens" in s.steps:
        out = out.unionByName(loading.index_edges(links, index))
    if "hierarchy" in s.steps:
        out = out.unionByName(graph.hierarchy_edges(nodes, own, first=s.accumulated, **caps))
    return checkpointed(out), index


def type_cells(types: DataFrame) -> DataFrame:
    return checkpointed(graph.ppmi(types.select(F.col("idx").alias("i"), F.col("type_token").alias("j"), F.col("count").cast("double").alias("v"))))


def token_vectors(types: DataFrame, s: Settings) -> DataFrame:
    """token, vec: type tokens in the space of the typed view, by the SVD of the mirrored matrix."""
    cells = type_cells(types)
    if cells.isEmpty():
        return types.select(F.col("type_token").alias("token"), F.array(F.lit(0.0)).alias("vec")).where("false")
    mirrored = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return models.svd(mirrored, s.typed_dim, s.svd_steps, s.seed)[0].withColumnRenamed("i", "token")


def _embed(index: DataFrame, edges: DataFrame, types: DataFrame, s: Settings) -> DataFrame:
    """idx, vec of every row of ``index``: graph, context and typed view, fused and smoothed."""
    views = [index.select("idx", F.array(F.lit(0.0)).alias("vec"))]  # so that no node is missing
    if not edges.isEmpty():
        views.append(models.svd(checkpointed(graph.ppmi(graph.adjacency(edges, not s.accumulated))), s.graph_dim, s.svd_steps, s.seed)[0].withColumnRenamed("i", "idx"))
        walked = checkpointed(models.walks(edges, s.walks, s.length, s.neighbours, s.seed, s.p, s.q, s.common))
        views.append(models.skipgram(walked, s.context_dim, s.window, s.epochs, s.seed))
    cells = type_cells(types)
    if not cells.isEmpty():
        views.append(models.svd(cells, s.typed_dim, s.svd_steps, s.seed)[0].withColumnRenamed("i", "idx"))
    points = checkpointed(models.fuse(views, s.final_dim))
    for _ in range(s.smoothing):
        points = checkpointed(models.smooth_step(points, edges, s.beta, s.distinct))
    return points


def _temperature(points: DataFrame, held: DataFrame, nodes: DataFrame, s: Settings) -> float:
    """The temperature that tells held-out edges from others of the same folder best; 1 without any."""
    positives = held.select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")).where("src <> dst").distinct()
    name, folder, _ = text.hierarchy(F.col("file"))
    others = models.negatives(positives, nodes.select("idx", folder.alias("folder"), name.alias("file")), s.negatives, s.seed)
    every = positives.select("src", "dst", F.lit(True).alias("positive"), F.col("dst").alias("o"))
    every = every.unionByName(others.select("src", "dst", F.lit(False).alias("positive"), F.col("neg").alias("o")))
    p = points.select("idx", "vec")
    scored = every.join(p.select(F.col("idx").alias("src"), F.col("vec").alias("a")), "src").join(p.select(F.col("idx").alias("o"), F.col("vec").alias("b")), "o")
    scored = scored.select("src", "dst", "positive", vectors.dot(F.col("a"), F.col("b")).alias("score"))
    return models.best_tau(models.tau_grid(scored, -s.tau_span, s.tau_span, s.taus))


def train(nodes: DataFrame, edges: DataFrame, types: DataFrame, path: str, settings: Settings = Settings(), commit: str | None = None, commit_time: int | None = None) -> Model:
    """Fit all views and write the model's tables under ``path``. nodes: id, kind, name, file, lineno,
    end_lineno; edges: src, dst, rel, weight; types: symbol, type_token, count. Held-out edges only set the
    temperature."""
    s, spark = settings, nodes.sparkSession
    if "ord" not in nodes.columns:
        nodes = nodes.withColumn("ord", F.monotonically_increasing_id())
    indexed = checkpointed(loading.index_nodes(nodes))
    s = s.fitted(indexed.count(), types.select("type_token").distinct().count())
    parts = checkpointed(models.split(edges.select("src", "dst", "rel", "weight"), s.ratio, s.seed))
    rich, index = enrich(indexed, parts.where("train").drop("train"), s)
    known = types.join(indexed.select(F.col("id").alias("symbol")), "symbol", "left_semi")
    counts = loading.sum_types(graph.expanded_types(known), indexed)
    points = _embed(index, rich, counts, s)
    tau = _temperature(points, loading.index_edges(parts.where("not train"), indexed), indexed, s)
    norm = points.agg(F.avg(vectors.norm(F.col("vec")))).first()[0]
    written = {
        "embeddings": points.join(index, "idx").select("idx", "id", "vec"),
        "nodes": indexed,
        "types": known,
        "postings": retrieval.postings(indexed, known),
        "subtokens": graph.subtoken_edges(indexed).where("rel = 'has_subtoken'").select("src", "dst"),
        "type_tokens": token_vectors(counts, s),
        "files": loading.distinct_files(indexed),
        "settings": spark.createDataFrame([(float(tau), norm, commit, commit_time, int(time.time()), json.dumps(s.__dict__))], "tau double, mean_norm double, commit string, commit_time long, trained long, settings string"),
    }
    own = points.join(index, "idx").join(indexed.select("id"), "id", "left_semi").select("id", "vec")
    retrieval.write_index(retrieval.build_index(own, seed=s.seed), f"{path}/cells")
    tables.write_model(path, written)
    return Model(spark, path)


class Model:
    """A trained model, read from its folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.tables = tables.read_model(spark, path, TABLES)
        row = self.tables["settings"].first()
        self.tau, self.mean_norm, self.commit = row["tau"], row["mean_norm"], row["commit"]
        self.commit_time, self.trained = row["commit_time"], row["trained"]
        found = json.loads(row["settings"])
        self.settings = Settings(**found | {"steps": tuple(found["steps"])})

    def _described(self, found: DataFrame) -> DataFrame:
        return found.join(self.tables["nodes"].select("id", "kind", "name", "file", "lineno", "end_lineno"), "id")

    def similar(self, symbols: Sequence[str] | DataFrame, k: int = 10, without: Sequence[str] = ()) -> DataFrame:
        """query, id, rank, score, hybrid_score, distance and the node's columns, for symbols by id (a list, or a
        table with a column query). Symbols that aren't known have no rows; names in ``without`` are left out."""
        asked = symbols if isinstance(symbols, DataFrame) else self.spark.createDataFrame([(x,) for x in symbols], "query string")
        asked = asked.select("query").distinct()
        vec = self.tables["embeddings"].select("id", "vec")
        mine = asked.join(vec.withColumnRenamed("id", "query"), "query")
        parts = asked.join(self.tables["subtokens"].withColumnRenamed("src", "query"), "query").join(vec.withColumnRenamed("id", "dst"), "dst").select("query", "vec")
        nodes = self.tables["nodes"]
        if without:
            kept = ~F.lower("name").isin([x.lower() for x in without])
            own = asked.select(F.col("query").alias("id"), F.lit(True).alias("asked"))
            nodes = nodes.join(own, "id", "left").where(kept | F.col("asked")).drop("asked")
        own = vec.join(nodes.select("id"), "id", "left_semi")
        sizes = (500, 200, max(50, k), k)
        found = retrieval.cascade(nodes, own, self.tables["postings"], asked, self.tau, sizes, retrieval.expand_query(mine, parts), retrieval.type_vectors(self.tables["types"], self.tables["type_tokens"]))
        return self._described(found)

    def nearest(self, symbols: Sequence[str] | DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """query, id, score, rank by cosine alone, from the kept index of cells."""
        asked = symbols if isinstance(symbols, DataFrame) else self.spark.createDataFrame([(x,) for x in symbols], "query string")
        own = asked.select("query").distinct().join(self.tables["embeddings"].select(F.col("id").alias("query"), "vec"), "query")
        return retrieval.search_index(retrieval.read_index(self.spark, f"{self.path}/cells"), own, k, probes)

    def plain(self, symbols: Sequence[str] | DataFrame, k: int = 10) -> DataFrame:
        """The search without stages: cosine and what like scopes add."""
        asked = symbols if isinstance(symbols, DataFrame) else self.spark.createDataFrame([(x,) for x in symbols], "query string")
        nodes = self.tables["nodes"]
        own = self.tables["embeddings"].select("id", "vec").join(nodes.select("id"), "id", "left_semi")
        return self._described(retrieval.plain_search(own, nodes, asked, k, self.tau, self.settings.bonus))

    def search(self, phrase: str, k: int = 10, without: Sequence[str] = (), case_sensitive: bool = False) -> DataFrame:
        """id, score, rank and the node's columns for keywords: one by the ladder of matches, several by the
        intersection of their lists."""
        stop = excluded(without)
        words = [w for w in keywords(phrase, case_sensitive) if w.lower() not in stop]
        find = retrieval.keyword_intersection if len(words) > 1 else retrieval.keyword_search
        return self._described(find(self.tables["nodes"], self.tables["types"], words, k, stop, case_sensitive))

    def gather(self, phrases: Sequence[str], k: int = 10) -> DataFrame:
        """What up to three searches find together, the k best places; a search that is good enough is the last: three
        results, two of them with a score over 0.5. Fixed values. The part of the question loop that needs no language model."""
        tried, enough = None, False
        for phrase in phrases[:3]:
            found = self.search(phrase, k).select("id", "score")
            tried = found if tried is None else tried.unionByName(found)
            scores = [r["score"] for r in found.collect()]  # at most k
            enough = len(scores) >= 3 and sum(x > 0.5 for x in scores) >= 2
            if enough:
                break
        empty = self.spark.createDataFrame([], "id string, score double")
        return retrieval.gather_attempts(empty if tried is None else tried, self.tables["nodes"], k)


def keywords(phrase: str, case_sensitive: bool = False) -> list[str]:
    """Words of a phrase; quotes only hold off the shell's rules, commas part words too."""
    try:
        words = " ".join(shlex.split(phrase.replace(",", " "))).split()
    except ValueError:  # an open quote
        words = phrase.replace(",", " ").split()
    return words if case_sensitive else [w.lower() for w in words]


def discover(folder: str) -> list[str]:
    """Folders of models at or below a folder, itself first, hidden ones left out."""
    found = []
    for at, folders, _ in os.walk(folder):
        folders[:] = [f for f in folders if not f.startswith(".")]
        if all(os.path.isdir(os.path.join(at, t)) for t in ("embeddings", "nodes", "settings")):
            found.append(at)
    return sorted(found, key=lambda x: (x != folder, x))


def code_of(file: str, first: int, last: int | None, folder: str = ".") -> str | None:
    """The lines of a symbol, where its file is at hand."""
    path = file if os.path.isabs(file) else os.path.join(folder, file)
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return "".join(f.readlines()[max(first - 1, 0) : last or first]).rstrip()


def field_report(spark: SparkSession, nodes: str, edges: str, types: str) -> DataFrame:
    """place, problem, n: lines that don't parse, required fields that lack, and numbers that are none."""
    out = None
    for place, path, required, numbers in (("node", nodes, ["id", "kind", "name"], []), ("edge", edges, ["src", "dst", "rel"], ["weight"]), ("type", types, ["symbol", "type_token", "count"], ["count"])):
        rows = tables.read_jsonl(spark, path, ", ".join(f"{c} string" for c in {**dict.fromkeys(required), **dict.fromkeys(numbers)}))
        whole = F.col("_corrupt_record").isNull()
        counts = {"unreadable": F.count_if(~whole)} | {f"no {c}": F.count_if(whole & F.col(c).isNull()) for c in required}
        counts |= {f"{c} is no number": F.count_if(whole & loading.no_number(F.col(c))) for c in numbers}
        found = rows.agg(*[c.alias(name) for name, c in counts.items()])
        names = F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*[F.col(f"`{name}`") for name in counts]))
        found = found.select(F.lit(place).alias("place"), F.explode(names).alias("problem", "n"))
        out = found if out is None else out.unionByName(found)
    return out


def as_json(rows: Sequence[dict], query: dict) -> str:
    return json.dumps({"query": query, "results": list(rows)}, indent=2, default=str)


def as_toon(rows: Sequence[dict], query: dict) -> str:
    """The rows as one table in token-oriented notation: a header with the length and the columns, then a line
    a row. Strings are quoted where they would read as something else."""

    def value(x: object) -> str:
        if x is None or isinstance(x, bool):
            return json.dumps(x)
        if not isinstance(x, str):
            return str(x)
        plain = x and x == x.strip() and not any(c in x for c in ',:"\\[]{}\n\r\t') and x not in ("true", "false", "null") and not x.startswith("-")
        try:
            float(x)
        except ValueError:
            return x if plain else json.dumps(x, ensure_ascii=False)
        return json.dumps(x)

    head = ["query:", *[f"  {k}: {value(v)}" for k, v in query.items()]]
    if not rows:
        return "\n".join([*head, "results[0]:"])
    columns = list(rows[0])
    return "\n".join([*head, f"results[{len(rows)}]{{{','.join(columns)}}}:", *["  " + ",".join(value(r[c]) for c in columns) for r in rows]])
