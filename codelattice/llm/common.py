"""What the operators share: scratch tables in the cluster's shared folder, code shipping, word hashing
and connected components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PACKAGE = __name__.split(".")[0]


# ---------------------------------------------------------------- session and shared folder
#: Arrow batches stay small, since texts have no bound of their own. Parquet's vectored reads pass whole column
#: chunks through direct buffers that each thread of a pool keeps for itself, up to the size of the heap in all.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "parquet.hadoop.vectored.io.enabled": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, in local mode, a temporary folder is made once per session. On a cluster that would be a
    folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="codelattice-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, also when it isn't on their PYTHONPATH, and bound what a
    task holds. The session keeps these settings, since results are lazy."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT in map(os.path.abspath, filter(None, on_path)) or getattr(spark.sparkContext, "_codelattice", None):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="codelattice-"), f"{PACKAGE}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(ROOT, PACKAGE)):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._codelattice = path


_scratch: list[tuple[SparkSession, str, int]] = []  # session, folder, thread


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path, _ in _scratch:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone by now
            return


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is removed when the process ends, if not before."""
    path = f"{shared_folder(spark).rstrip('/')}/{PACKAGE}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path, threading.get_ident()))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(since: int, *kept: DataFrame) -> None:
    """Remove the tables that this thread wrote after the first ``since``, but for those that a result still reads."""
    paths, me = {df._scratch for df in kept}, threading.get_ident()
    for entry in _scratch[since:]:
        if entry[2] == me and entry[1] not in paths:
            _remove(*entry[:2])
            _scratch.remove(entry)


def written_so_far() -> int:
    return len(_scratch)


#: Ids that may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Written ids, marked for a broadcast where they are few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- words and shingles
#: The white space that separates words: the ASCII space and the controls 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], dtype=np.uint64)
#: Bytes of text whose words are hashed at once.
SPAN = 1 << 17
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            t = _powers[key]
            step = np.uint64(pow(base, len(t), 1 << 64))
            _powers[key] = np.concatenate([t, t * step])
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased, in order."""
    a = np.frombuffer(text.lower(), dtype=np.uint8)  # bytes.lower() changes A-Z only
    if not len(a):
        return np.zeros(0, np.uint64)
    gap = np.ones(len(a) + 2, dtype=np.int8)
    gap[1:-1] = _SPACE[a]
    turn = np.diff(gap)
    begin, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # runs of words of about SPAN bytes, so that a long text needs no more memory
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SPAN, "right")))
        first, b, e = begin[i], begin[i:j] - begin[i], end[i:j] - begin[i]
        up, down = _power_table(int(e[-1]) + 1)
        total = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum((a[first : end[j - 1]].astype(np.uint64) + np.uint64(1)) * up[: e[-1]], out=total[1:])
        out[i:j] = mix64((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
        i = j
    return out


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, the whole sequence as one."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < k:
        s = np.array([len(w)], np.uint64)
        for i in range(len(w)):
            s = s * np.uint64(_BASE) + w[i : i + 1] * _FOLD[i % 8 : i % 8 + 1]
        return mix64(s ^ _FOLD[-1:])
    n = len(w) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s += w[i : i + n] * (_FOLD[i % 8] + np.uint64(2 * (i // 8)))
    return np.unique(mix64(s))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8."""
    return batch.column(name).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


# ---------------------------------------------------------------- connected components
FOREST = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links in a partition, only as many as keep its components together; up to FOREST nodes at once."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out() -> pa.RecordBatch:
        pairs = [(root(x), x) for x in list(parent) if parent[x] != x]
        parent.clear()
        u, v = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield out()
    yield out()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``links``; component is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al. 2014) on DataFrames: a minimum per node
    with partial aggregation, then a join that adaptive execution can split at a hot node. Links are
    never gathered on the driver. Null ends and self-links are ignored.
    """
    ship(links.sparkSession)
    e = links.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where("u < v")
    e = checkpointed(e.mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        least = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        small = large.join(least, F.col("v") == F.col("w")).select("u", "v", "m")
        e = small.select(F.col("m").alias("u"), "v").unionByName(small.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v")))
        e = checkpointed(e.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    top = e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return top.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
