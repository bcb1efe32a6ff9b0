"""Delta-maintained rollups of token counts.

A change of a document is an insert, a delete or a revision of its count. Each is a signed delta to
additive totals (documents, tokens, characters) by source, language and tokenizer version. A batch of
changes is folded to one row per key before it is stored, and committed under its batch id: the table of
deltas has a folder per batch, which counts only when its writer's success mark is there. A batch that is
committed already is left alone, one that was cut short is written again, so replays and lost executors or
drivers change nothing. ``compact`` folds committed batches into a snapshot that names them.

Sums are partially aggregated before the shuffle, so a source that holds a third of all rows costs one row
a task. Totals whose documents all went are kept out of the result. Null source, lang or text are values of
their own (a null text has 0 tokens). Repeated rows count each; extra columns are not read. Texts of any length are
counted whole. An empty batch is committed like others; an empty rollup has no rows. A batch id belongs to one
writer at a time: two that write the same id at once would overwrite each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import ship
from codelattice.llm.packing import encoder

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"
VERSION = "byte_bpe_50k"


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            n, c = [], []
            for t in batch.column("text"):
                t = t.as_py()
                n.append(len(enc.ids(t)))
                c.append(len(t or ""))
            keep = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(n, pa.int64()), pa.array(c, pa.int64())], [*keep, "tokens", "chars"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VERSION) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars per row of (doc_id, text, lang, source)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    found = slim.mapInArrow(_count(vocabulary), "doc_id long, source string, lang string, tokens long, chars long")
    return found.select("doc_id", "source", "lang", F.lit(vocabulary).alias("tokenizer"), "tokens", "chars")


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of new documents."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens", "chars")


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas of documents that go, given their counts as they were."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("chars")).alias("chars"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of documents that are counted anew; source, lang or tokenizer may change as well."""
    return deletes(before).unionByName(inserts(after))


def fold(deltas: DataFrame, *more: str) -> DataFrame:
    return deltas.groupBy(*more, *KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class Rollup:
    """Totals kept as committed batches of deltas in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, batch: str) -> str:
        if not batch or any(c in batch for c in "/\\") or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self) -> list[str]:
        """Ids of the committed batches and snapshots."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def _covered(self) -> tuple[str | None, set[str]]:
        """The latest snapshot's name and the batches in it."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return None, set()
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().startswith("snapshot="))
        for name in reversed(found):
            if self._fs.exists(self._path(f"{self.path}/{name}/rows/_SUCCESS")) and self._fs.exists(self._path(f"{self.path}/{name}/batches/_SUCCESS")):
                row = self.spark.read.text(f"{self.path}/{name}/batches").first()
                return name, set(json.loads(row[0]))
        return None, set()

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch; False if it is in already."""
        at = self._at(batch)
        if batch in self._covered()[1] or self._fs.exists(self._path(f"{at}/_SUCCESS")):
            return False
        fold(deltas).write.mode("overwrite").parquet(at)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars of all that is committed."""
        return self._totals(*self._covered(), self.committed())

    def _totals(self, snapshot: str | None, covered: set[str], batches: list[str]) -> DataFrame:
        paths = [self._at(b) for b in batches if b not in covered]
        if snapshot:
            paths.append(f"{self.path}/{snapshot}/rows")
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*paths)
        return fold(rows).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def compact(self) -> str:
        """Fold everything committed into a new snapshot; its batches stay known. Batches are listed once, so one that is
        committed meanwhile is neither in the rows nor in the list."""
        (snapshot, covered), batches = self._covered(), self.committed()
        number = int(snapshot.partition("=")[2]) + 1 if snapshot else 1
        name = f"snapshot={number:09d}"
        every = sorted(covered | set(batches))
        self._totals(snapshot, covered, batches).write.mode("overwrite").parquet(f"{self.path}/{name}/rows")
        self.spark.createDataFrame([(json.dumps(every),)], "batches string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}/batches")
        return name
