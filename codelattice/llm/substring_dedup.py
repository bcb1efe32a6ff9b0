"""Removal of repeated lines, and of passages that repeat inside lines.

The units are lines first: a line of ``line_words`` words or more is normalised (lower case, one space between
words), its digest is grouped globally, the earliest occurrence by (doc_id, text digest, position) is kept and every
other one is removed. Shorter lines stay: they are stock phrases and remarks that most documents share. (On the
documents of sf0.1 lines of 16 words or more occur again in 1005 of 10,000 documents, all but 4 of which hold a
passage that repeats anyway; lines of 9 or more in 3006.)

A finer unit follows, for passages that are copied into a line: ``min_words`` words in a row (a window) that occur
before. Each repeated stretch of ``min_words`` words or more goes to its very ends, wherever it stands in a line or
a sentence. The offsets of the original text are retained. One or two words of a stretch that begins in mid-sentence
stay where a sentence or a line starts behind them: so short a lead-in recurs by chance.

A hash for every window of every text would be several times the input. So texts are told in runs: the windows
in a row that have the same anchor, the smallest hash of ``SHINGLE`` words in them (winnowing); a run starts
about every thirteen words. Equal windows have equal anchors. A run that occurs before as a whole goes as a
whole; windows are compared one by one only where an anchor has different runs, as at the edges of a passage,
and only in the earliest occurrence of each such run, so nothing that repeats is missed. Lines are runs of their own
with an anchor of their own. Runs and windows are counted with partial aggregation and only those that occur twice
are joined back, so a passage that a third of all documents share costs a few rows a task and a join that adaptive
execution splits. Texts without a repeat never enter a shuffle.

Null and empty texts have no unit and come back unchanged. Rows that agree in doc_id and text are treated
alike: they share one identity, so none of them is removed for the sake of the other. Rows without a doc_id come
first in the order and are cut like others. Texts may be of any length and are read whole; an empty table gives an
empty result. Other columns pass through, unless they are named spans or removed_words, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.common import _power_table, few, materialise, mix64, release, ship, word_hashes, written_so_far

LINE_WORDS, MIN_WORDS = 16, 32
#: Words of which an anchor is hashed.
SHINGLE = 8
#: Fewer words at the beginning of a stretch recur by chance.
TELLING = 3
WORD = re.compile(r"\S+")
#: Where a sentence or a line starts, seen from the white space before it.
STARTS = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|\s+(?=[A-ZÀ-ÖØ-Þ])")


def lines(text: str | None, line_words: int = LINE_WORDS) -> list[tuple[int, int, int]]:
    """(first word, words, digest) of the lines of ``line_words`` words or more."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = line.lower().split()
        if len(words) >= line_words:
            out.append((at, len(words), version(" ".join(words))))
        at += len(words)
    return out


class Windows:
    """The windows of a text: their digests, and the runs of windows that have the same anchor."""

    __slots__ = ("anchors", "down", "starts", "total", "width")

    def __init__(self, text: str | None, min_words: int = MIN_WORDS):
        w = word_hashes(" ".join(text.lower().split()).encode()) if text else np.zeros(0, np.uint64)
        self.width, n = min_words, len(w) - min_words + 1
        up, self.down = _power_table(len(w) + 1)
        self.total = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * up[: len(w)], out=self.total[1:])
        self.starts = np.zeros(1, np.int64)  # and behind them the number of windows
        self.anchors = np.zeros(0, np.int64)
        if n > 0:
            k = min(SHINGLE, min_words)
            at = np.arange(len(w) - k + 1)
            low, size, wide = self.hashes(at, at + k), 1, min_words - k + 1
            while size < wide:
                step = min(size, wide - size)
                low, size = np.minimum(low[:-step], low[step:]), size + step
            self.starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n]])
            self.anchors = low[self.starts[:-1]]

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from begin to end."""
        return mix64((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64)).view(np.int64)

    def digests(self) -> np.ndarray:
        at = np.arange(self.starts[-1])
        return self.hashes(at, at + self.width)

    def runs(self) -> np.ndarray:
        return self.hashes(self.starts[:-1], self.starts[1:] + (self.width - 1))


def _rows(batch: pa.RecordBatch, parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """parts: row of the batch, version, and the other columns."""
    sizes = [len(p[2]) for p in parts]
    ids = batch.column("doc_id").take(pa.array(np.repeat(np.array([p[0] for p in parts], np.int64), sizes)))
    versions = np.repeat(np.array([p[1] for p in parts], np.int64), sizes)
    more = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)])) for i in range(2, len(names))]
    return pa.RecordBatch.from_arrays([ids, pa.array(versions), *more], names)


def _runs(line_words: int, min_words: int):
    """place: the first word; n: words covered, by the run's windows or the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if own := lines(text, line_words):
                    place, n, digest = np.array(own, np.int64).T
                    parts.append((row, version(text), place, n, ~digest, digest, np.zeros(len(own), np.int64)))
                t = Windows(text, min_words)
                if not len(t.anchors):
                    continue
                inner = np.zeros(len(t.anchors), np.int64)
                found = t.digests()
                ranked = np.sort(found)
                if (ranked[1:] == ranked[:-1]).any():  # windows that repeat inside the text, perhaps in one run
                    order = np.argsort(found, kind="stable")
                    same = np.flatnonzero(found[order][1:] == found[order][:-1])
                    inside = np.searchsorted(t.starts, order, "right") - 1  # the run of each window
                    inner[inside[same][inside[same] == inside[same + 1]]] = 1
                parts.append((row, version(text), t.starts[:-1], np.diff(t.starts) + (min_words - 1), t.anchors, t.runs(), inner))
            yield _rows(batch, parts, ["doc_id", "version", "place", "n", "anchor", "run", "inner"])

    return run


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, (text, picks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("picks").to_pylist(), strict=True)):
                picked = {p["version"]: p["places"] for p in picks}.get(version(text)) if text else None
                if picked is None:
                    continue
                t = Windows(text, min_words)
                wanted = np.isin(t.starts[:-1], np.array(picked, np.int64))
                places = np.flatnonzero(np.repeat(wanted, np.diff(t.starts)))
                parts.append((row, version(text), places, t.hashes(places, places + min_words)))
            yield _rows(batch, parts, ["doc_id", "version", "place", "digest"])

    return run


def version(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def cut(text: str, later: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the words ``later`` (first, count); the spans removed; their words."""
    if not later:
        return text, [], 0
    at = [m.span() for m in WORD.finditer(text)]
    runs: list[list[int]] = []  # first word, word after the last
    for n, words in sorted(later):
        if runs and n <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], n + words)
        else:
            runs.append([n, n + words])

    def starts(n: int) -> bool:
        return n == 0 or STARTS.match(text, at[n - 1][1]) is not None

    for run in runs:
        if not starts(run[0]):
            run[0] = next((n for n in range(run[0] + 1, min(run[0] + TELLING, run[1])) if starts(n)), run[0])
    spans, kept, done = [(at[i][0], at[j - 1][1]) for i, j in runs], [], 0
    for a, b in spans:
        kept.append(text[done:a])
        done = b
    return "".join([*kept, text[done:]]), spans, sum(j - i for i, j in runs)


def _cutter(names: list[str]):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, words = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("__marks").to_pylist(), strict=True):
                later = {m["version"]: m["places"] for m in marks}.get(version(text)) if marks and text else None
                t, s, w = cut(text, [(m["place"], m["n"]) for m in later]) if later else (text, [], 0)
                texts.append(t)
                spans.append([{"start": a, "end": b} for a, b in s])
                words.append(w)
            cols = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(spans, span), pa.array(words, pa.int64())], [*names, "spans", "removed_words"])

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """materialise, and what the plan shuffled for it goes at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(key, before)


def dedup_passages(docs: DataFrame, *, line_words: int = LINE_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines and passages cut out of text, and the columns
    spans (array of start, end in code points of the original text) and removed_words."""
    ship(docs.sparkSession)
    since = written_so_far()
    docs = docs.drop("spans", "removed_words")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    who = F.struct("doc_id", "version", "place")

    def by_document(places: DataFrame, value, name: str) -> DataFrame:
        places = places.groupBy("doc_id", "version").agg(F.collect_set(value).alias("places"))
        return places.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("version", "places")).alias(name))

    def of(table: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return table.join(few(ids), table["doc_id"].cast("long").eqNullSafe(F.col("__id")), how)

    runs = written(slim.mapInArrow(_runs(line_words, min_words), "doc_id long, version long, place long, n long, anchor long, run long, inner long"), "runs")
    kinds = written(runs.groupBy("anchor", "run").agg(F.min(who).alias("first"), F.max(who).alias("last"), F.max("inner").alias("inner")), "kinds")
    # Tables of what is joined back stand apart, so that a hot key can be split in the join.
    mixed = written(kinds.groupBy("anchor").agg((F.count("*") + F.max("inner")).alias("n")).where("n > 1").select("anchor"), "mixed")
    picks = written(by_document(kinds.join(mixed, "anchor").select("first.*"), F.col("place"), "picks"), "picks")
    looked = of(slim, picks.select("__id"), "left_semi")
    looked = looked.join(picks, looked["doc_id"].eqNullSafe(F.col("__id"))).select("doc_id", "text", "picks")
    found = written(looked.mapInArrow(_windows(min_words), "doc_id long, version long, place long, digest long"), "windows")
    first = found.groupBy("digest").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("not first <=> last").select("digest", "first")
    first = written(first, "first")
    again = written(kinds.where("not first <=> last").select("run", "first", "anchor"), "again")
    later = runs.join(again, ["anchor", "run"]).where(~who.eqNullSafe(F.col("first"))).select("doc_id", "version", "place", "n")
    later = later.unionByName(found.join(first, "digest").where(~who.eqNullSafe(F.col("first"))).select("doc_id", "version", "place", F.lit(min_words).cast("long").alias("n")))
    marks = written(by_document(later, F.struct("place", "n"), "__marks"), "marks")
    release(since, marks)
    # Only texts with marks are shuffled to them; the others pass by.
    marked = of(docs, marks.select("__id"), "left_semi")
    marked = marked.join(marks, marked["doc_id"].cast("long").eqNullSafe(F.col("__id"))).drop("__id")
    added = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("removed_words", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields] + added)
    whole = of(docs, marks.select("__id"), "left_anti")
    whole = whole.withColumn("spans", F.array().cast(added[0].dataType)).withColumn("removed_words", F.lit(0).cast("long"))
    return marked.mapInArrow(_cutter(docs.columns), schema).unionByName(whole)
