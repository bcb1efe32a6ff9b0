"""Packing of documents into sequences by hierarchical tiers.

A document's ids (and a closing id 0) are cut into full windows of ``context`` ids and a remainder. Each
remainder is routed to the tier of the smallest power of two that holds it; a tier's windows are as long as that.
Windows are opened from the longest tier down and their gaps are filled from the tiers below, the longest
remainder that fits first; when nothing fits any more, the shortest remainder is cut to close the window exactly,
and its rest is routed anew. Where less is left at the end of a task than the window takes, the window is
the largest power of two that can be filled, so that no sequence is padded.

A step group holds sequences of one tier, ``step_tokens`` ids at most. Each tier's sequences are counted over all
tasks and dealt in turn to as few groups as hold them: the groups of a tier differ by one sequence at most.

Packing happens in the task that reads the documents: no state beyond a buffer of ``buffer`` remainders, and
sequence ids made of the partition's number and a counter. The pieces are written; only the counts of sequences by
task and tier are shuffled and joined back. Null texts are empty (one id, the closing 0). Repeated rows are packed
each for itself, also without a doc_id; remainders of one length go in the order of arrival. Texts of any length are
packed whole. Another order of the input makes other sequences of the same pieces. An empty table gives an empty result.
Other columns are not read.

Ids are those of the ``tokenizers`` file named by ``vocabulary``. Texts whose characters all lie in
``PLAIN`` are encoded by tiktoken from the same vocabulary as ranks (about four times as fast; the ids are
equal, and tests hold them against each other); all others by tokenizers itself.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import materialise, ship

CONTEXT, BUFFER, STEP_TOKENS = 1024, 4096, 65_536
#: Characters on which the two libraries are known to split alike.
PLAIN = "\\t\\n\\r -~¡-¬®-ɏ"
_OTHER = re.compile(f"[^{PLAIN}]")


class Encoder:
    """Ids of texts, by the vocabulary ``name`` of the public tokenizer files."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.exact.encode_special_tokens = True
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _OTHER.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens) into windows; ``rows`` gathers the result."""

    def __init__(self, context: int, buffer: int, first: int):
        self.context, self.buffer, self.next = context, buffer, first
        self.waiting: list[list[tuple[int, int]]] = [[] for _ in range(context.bit_length())]  # by tier: (length, index in self.held), sorted
        self.left = 0  # ids that wait
        self.closed: Counter[int] = Counter()  # sequences by length
        self.held: dict[int, tuple] = {}
        self.count = 0
        self.rows: list[tuple] = []

    def put(self, piece: tuple, offset: int, room: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, room, self.closed[room]))

    def close(self, room: int) -> None:
        self.next += 1
        self.closed[room] += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, c = len(ids), self.context
        whole = total // c * c
        for at in range(0, whole, c):
            self.put((doc, at, ids[at : at + c], total), 0, c)
            self.close(c)
        if whole < total:
            self.keep((doc, whole, ids[whole:], total))
            if len(self.held) >= self.buffer:
                self.drain(self.buffer // 2)

    def keep(self, piece: tuple) -> None:
        n = len(piece[2])
        self.held[self.count] = piece
        insort(self.waiting[(n - 1).bit_length()], (n, self.count))
        self.left += n
        self.count += 1

    def take(self, tier: int, i: int) -> tuple:
        n, index = self.waiting[tier].pop(i)
        self.left -= n
        return self.held.pop(index)

    def fitting(self, room: int) -> tuple | None:
        """The longest remainder of at most ``room`` ids."""
        for tier in range((room - 1).bit_length(), -1, -1):
            i = bisect_right(self.waiting[tier], (room, self.count)) - 1
            if i >= 0:
                return self.take(tier, i)
        return None

    def drain(self, leave: int) -> None:
        """Close windows, those of the longest tier first, until ``leave`` remainders wait."""
        while len(self.held) > leave:
            longest = max(tier for tier, those in enumerate(self.waiting) if those)
            size, at = min(1 << longest, 1 << (self.left.bit_length() - 1)), 0
            while at < size:
                room = size - at
                piece = self.fitting(room)
                if piece is None:  # nothing fits: cut the shortest that waits
                    doc, start, ids, total = self.take(min(tier for tier, those in enumerate(self.waiting) if those), 0)
                    self.keep((doc, start + room, ids[room:], total))
                    piece = (doc, start, ids[:room], total)
                self.put(piece, at, size)
                at += len(piece[2])
            self.close(size)

    def finish(self) -> None:
        self.drain(0)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, nth long, task long"


def _packing(context: int, buffer: int, vocabulary: str):
    def table(packer: Packer, task: int) -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 9)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([task] * len(rows), pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, enc = Packer(context, buffer, task << 33), encoder(vocabulary)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc, np.array([*enc.ids(text.as_py()), 0], dtype="<u4"))
                if len(packer.rows) > 50_000:
                    yield table(packer, task)
        packer.finish()
        yield table(packer, task)

    return run


def pack(docs: DataFrame, *, context: int = CONTEXT, buffer: int = BUFFER, step_tokens: int = STEP_TOKENS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of a document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (the sequence's length) and step_group."""
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(docs.mapInArrow(_packing(context, buffer, vocabulary), SCHEMA), "pieces")
    counts = pieces.where("offset = 0").groupBy("task", "tier").agg(F.count("*").alias("n"))
    of_tier = Window.partitionBy("tier")
    counts = counts.select("task", "tier", (F.sum("n").over(of_tier.orderBy("task")) - F.col("n")).alias("before"), F.sum("n").over(of_tier).alias("n"))
    groups = F.least("n", F.ceil(F.col("n") / F.greatest(F.floor(F.lit(step_tokens) / F.col("tier")), F.lit(1))))
    # A group's id: the tier's exponent, then the group's number.
    group = F.shiftleft(F.log2("tier").cast("long"), 40) + (F.col("before") + F.col("nth")) % F.col("groups")
    counts = F.broadcast(counts.select("task", "tier", "before", groups.cast("long").alias("groups")))
    return pieces.join(counts, ["task", "tier"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.cast("long").alias("step_group"))
