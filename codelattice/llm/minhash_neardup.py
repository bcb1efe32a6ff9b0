"""MinHash near-duplicates with min-max hashing.

Each of ``permutations`` hash functions yields two signature values, its minimum and its maximum over a
document's shingles, so a signature of 2k values costs k hash evaluations per shingle. Minimum and maximum
each agree with probability J; their mean is an unbiased estimate of J with a lower variance than k minima.
Bands mix both kinds of value. Every link is confirmed on the full shingle sets.

A bucket (documents that agree in one band) is never expanded into pairs. Documents with equal shingle sets
are folded to one class; each member is compared with the bucket's smallest doc_id; and in buckets that
still hold several components, the members outside the largest one are compared with all others in blocks
of bounded size: a block's intersections are counted by a matrix product over its shared shingles, and only
a spanning forest of the links found leaves the task. So every pair of a bucket is either compared or
already in one component, whatever the bucket's size.

Null, empty and blank texts have the empty set (n_shingles 0) and link with nothing. Rows that repeat a
doc_id are one node: their links are pooled, and each row is returned. Rows without a doc_id have a null
component. Texts may be of any length: words are hashed in runs of bounded size. An empty table gives an
empty result. Equal similarities need no order, since links are a set. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import as_bytes, connected_components, few, materialise, release, shingle_set, ship, written_so_far

SHINGLE, PERCENT, PERMUTATIONS, BANDS, ROWS = 5, 80, 40, 20, 4
#: Pairs whose estimated similarity is this far under the threshold are not fetched in full: over five
#: standard deviations of an estimate from 80 values.
SLACK = 0.25
CHUNK = 4096
#: Classes of copies that may be broadcast: 8 MB. Beyond, documents are shuffled to them.
BROADCAST_CLASSES = 250_000
#: Shingles and documents on either side of a block, about.
BLOCK_SHINGLES, BLOCK_DOCS = 250_000, 2000


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20_240_601)
    return g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 1 << 63, n, dtype=np.uint64)


def min_max(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each hash function over a non-empty set, in chunks of bounded size."""
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mul), np.uint64)
    for i in range(0, len(s), CHUNK):
        h = s[None, i : i + CHUNK] * mul[:, None] + add[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return low, high


def _signer(k: int, permutations: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _family(permutations)
        place = (np.arange(bands)[:, None] + bands * np.arange(rows)[None, :]) % (2 * permutations)
        fold = _family(rows)[0]
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, d1, d2, sig, keys = [], [], [], [], []
            for text in as_bytes(batch, "text"):
                s = shingle_set(text, k)
                n.append(len(s))
                if not len(s):
                    d1.append(0), d2.append(0), sig.append(None), keys.append(None)
                    continue
                low, high = min_max(s, mul, add)
                values = np.concatenate([low, high])
                with np.errstate(over="ignore"):
                    key = (values[place] * fold).sum(axis=1, dtype=np.uint64) + salt
                    key ^= key >> np.uint64(29)
                    d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F) ^ (s >> np.uint64(17))).view(np.int64)))
                sig.append((values >> np.uint64(32)).astype(np.uint32).tobytes())
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "d1", "d2", "sig", "keys"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), as_bytes(batch, "text")
            for i in range(0, len(texts), 128):
                sets = [shingle_set(t, k).tobytes() for t in texts[i : i + 128]]
                yield pa.RecordBatch.from_arrays([ids.slice(i, 128).cast(pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "s"])

    return run


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(len(batch), -1) for c in ("sx", "sy"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(axis=1))], ["a", "b", "estimate"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, s) of the documents ``ids``. Few ids go to the texts, many meet them in a shuffle."""
    ids = few(materialise(ids.distinct(), "ids"))
    found = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, s binary")
    return materialise(found, "sets")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    size = reps.select("doc_id", "n_shingles", "sig")
    x = size.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sx"))
    y = size.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sy"))
    near = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = near.select("a", "b", "sx", "sy").mapInArrow(_estimate, "a long, b long, estimate double").where(F.col("estimate") >= percent / 100 - SLACK)
    near = materialise(near.select("a", "b"), "near")
    s = _sets_of(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))), docs, k)
    both = near.join(s.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return materialise(both.select("a", "b", "sa", "sb").mapInArrow(_verify(percent), "a long, b long"), "links")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    words = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
        hit = words[at] == flat
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    if len(words):
        (xa, xr), (ya, yr) = places(left), places(right)
        for i in range(0, len(words), 2048):
            parts = []
            for at, row, n in ((xa, xr, len(left)), (ya, yr, len(right))):
                lo, hi = np.searchsorted(at, [i, i + 2048])
                m = np.zeros((n, min(2048, len(words) - i)), np.float32)
                m[row[lo:hi], at[lo:hi] - i] = 1
                parts.append(m)
            out += parts[0] @ parts[1].T
    return out


def _links(ids: list[int], comp: list[int], side: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the components of a block."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    x, y = ([i for i, s in enumerate(side) if s == want] for want in (0, 1))
    if not x or not y:
        return []
    size, group = np.array([len(s) for s in sets]), np.array(comp)
    common = common_counts([sets[i] for i in x], [sets[i] for i in y])
    links = []
    for at in range(0, len(x), 256):  # rows at a time: the comparison's wide integers would be many times the counts
        mine = x[at : at + 256]
        part = common[at : at + 256].astype(np.int64)
        near = (100 * part >= percent * (size[mine][:, None] + size[y][None, :] - part)) & (group[mine][:, None] != group[y][None, :])
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = root(comp[mine[i]]), root(comp[y[j]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[mine[i]], ids[y[j]]))
    return links


def _compare(percent: int):
    """For rows sorted by block; one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, links = None, ([], [], [], []), []
        for batch in batches:
            blocks = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "kind")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "component", "side", "s")), strict=True)
            for block, (doc, comp, side, s) in zip(blocks, rows, strict=True):
                if block != now:
                    links += _links(*held, percent)
                    now, held = block, ([], [], [], [])
                for column, value in zip(held, (doc, comp, side, np.frombuffer(s, np.uint64)), strict=True):
                    column.append(value)
        links += _links(*held, percent)
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks(left: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of a bucket; left: key, doc_id, component."""
    sized = left.join(reps.select("doc_id", "n_shingles"), "doc_id")
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("top"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    cuts = lambda w, n: F.greatest(F.ceil(w / BLOCK_SHINGLES), F.ceil(n / BLOCK_DOCS), F.lit(1))
    main = main.select("key", F.col("top.component").alias("main"), cuts(F.col("top.w"), F.col("top.n")).alias("m"), cuts(F.col("w") - F.col("top.w"), F.col("n") - F.col("top.n")).alias("o"))
    main = materialise(main, "main")  # apart, so that a hot bucket can be split in the join
    rows = sized.join(main, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("component") == F.col("main"), F.col("m")).otherwise(F.col("o"))))
    # Blocks (i, j, kind): the i-th part of the others against the j-th part of the main component, or of the others.
    def unit(i, j, kind, side):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(kind).alias("kind"), F.lit(side).alias("side"))

    to = F.sequence(F.lit(0).cast("long"), F.col("o") - 1)
    inside = F.transform(to, lambda i: unit(i, F.col("own"), 0, 1))
    against = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: unit(F.col("own"), j, 0, 0))
    later = F.transform(F.filter(to, lambda j: j >= F.col("own")), lambda j: unit(F.col("own"), j, 1, 0))
    earlier = F.transform(F.filter(to, lambda i: i <= F.col("own")), lambda i: unit(i, F.col("own"), 1, 1))
    units = F.when(F.col("component") == F.col("main"), inside).otherwise(F.concat(against, later, earlier))
    rows = materialise(rows.select("key", "doc_id", "component", F.explode(units).alias("u")).select("key", "u.*", "doc_id", "component"), "units")
    # Blocks whose two sides hold the same single component need no look.
    busy = rows.groupBy("key", "i", "j", "kind").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    rows = rows.join(busy.where("low < high and s0 < s1").select("key", "i", "j", "kind"), ["key", "i", "j", "kind"], "left_semi")
    s = _sets_of(rows.select("doc_id"), docs, k)
    block = ["key", "i", "j", "kind"]
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(s, "doc_id").repartition(width, *block).sortWithinPartitions(*block)
    return materialise(rows.select(*block, "doc_id", "component", "side", "s").mapInArrow(_compare(percent), "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable by links of a Jaccard similarity of ``percent`` per cent
    or more, the document included; kept is true for that document.
    """
    if bands * rows > 2 * permutations:
        raise ValueError("bands * rows exceeds the signature")
    ship(docs.sparkSession)
    since = written_so_far()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(docs.mapInArrow(_signer(shingle, permutations, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, sig binary, keys array<long>"), "signed")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes.where("copies > 1").drop("copies"), "classes")  # apart, so that a hot class can be split in the join
    classes = few(classes, BROADCAST_CLASSES)
    row = ["doc_id", "d1", "d2", "n_shingles"]  # a doc_id may have other rows, which are no copies
    copies = full.join(classes, ["d1", "d2", "n_shingles"]).where("rep <> doc_id").select("rep", *row)
    folded = materialise(copies.distinct(), "copies")
    copies = folded.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    reps = full.join(folded.select(*row), row, "left_anti")
    slots = reps.select("doc_id", F.explode("keys").alias("key"))
    many = slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    slots = materialise(slots.join(many, "key").distinct(), "slots")

    centre = slots.groupBy("key").agg(F.min("doc_id").alias("a"))
    star = slots.join(centre, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = _confirmed(star, reps, docs, shingle, percent)
    component = materialise(connected_components(links), "components")
    left = slots.join(component, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = materialise(left.join(mixed, "key"), "left")
    more = _blocks(left, reps, docs, shingle, percent)
    every = copies.unionByName(links).unionByName(more)
    component = materialise(connected_components(every), "components")
    release(since, signed, component)
    out = signed.select("doc_id", "n_shingles").join(component, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
