"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier for each bit reads hashed byte n-grams (1 to 3) of the
whole lower-cased text. Up to seven languages use the exhaustive code of 2**(k-1) - 1 bits, more use a
random code with a minimum distance. The classifiers are ridge regressions on the bits, fitted in closed
form on a sample of at most ``max_docs`` labelled documents, balanced over the languages (a documented
bound; all other work covers every document). Decoding weighs each bit's logistic loss by how well that
bit was learned (its leave-one-out accuracy), takes the nearest codeword and flags a document as ambiguous
when the runner-up is nearly as near.

Only text and lang of documents with crc32(doc_id) mod 4 != 2 are learned from; predictions read text
alone. Null texts and texts without a letter (Unicode's category L) are ``und`` with score 0; so is everything where no
document is labelled. A null doc_id is never learned from and not held out. The sample never exceeds ``max_docs``
rows, however often a doc_id repeats; every language gets as many rows as any other or all it has. Where there
are more languages than ``max_docs / 2``, the rarer ones can't be learned from so few rows and a warning names their
number. Repeated rows are predicted alike; of codewords equally near the first language by name wins. Texts of any
length are read whole, in chunks. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.common import ship

MAX_DOCS, BUCKETS, RIDGE, SHARPNESS, AMBIGUOUS = 1200, 8192, 0.02, 3.0, 0.6
LETTER = regex.compile(r"\p{L}")
CHUNK = 1 << 20


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams; the vector has length 1."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    counts = np.zeros(buckets)
    for i in range(0, len(data), CHUNK):  # chunks overlap by two bytes, so every n-gram counts once
        a = data[max(0, i - 2) : i + CHUNK].astype(np.uint32)
        two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
        fresh = min(i, 2)
        for grams, n in ((a * np.uint32(0x165667B1), 1), (two, 2), (three, 3)):
            grams = grams[max(0, fresh - n + 1) :]
            counts += np.bincount(((grams ^ (grams >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def code(k: int) -> np.ndarray:
    """k codewords of +1 and -1 as rows."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        n = (1 << (k - 1)) - 1
        bits = np.array([[1] * n, *([col >> (k - 1 - row) & 1 for col in range(n)] for row in range(1, k))])
        return bits * 2.0 - 1
    n, best, most = 10 * int(np.ceil(np.log2(k))), None, -1
    g = np.random.default_rng(5)
    for _ in range(50):
        c = g.integers(0, 2, (k, n)) * 2.0 - 1
        if abs(c.sum(axis=0)).max() == k:
            continue
        d = ((n - c @ c.T) / 2 + np.eye(k) * n).min()
        if d > most:
            best, most = c, d
    return best


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    trust: np.ndarray  # bits

    def decode(self, x: np.ndarray) -> tuple[int, float, float]:
        """Index of the nearest codeword, its probability, and that of the runner-up."""
        margin = self.weights @ x
        loss = np.logaddexp(0, -SHARPNESS * self.words * margin) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first = int(np.argmin(loss))
        return first, float(p[first]), float(np.delete(p, first).max(initial=0.0))


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Ridge regressions in the dual: documents are fewer than buckets."""
    words = code(len(languages))
    target = words[y]
    share = np.bincount(y, minlength=len(languages))
    gram = (x @ x.T).astype(np.float64)
    inverse = np.linalg.inv(gram + np.diag(RIDGE * share.mean() / share[y]))
    dual = inverse @ target
    left_out = target - dual / np.diag(inverse)[:, None]
    right = np.clip((np.sign(left_out) == target).mean(axis=0), 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right))
    trust = trust / trust.sum() * len(trust) if trust.sum() > 0 else np.ones(words.shape[1])
    weights = np.concatenate([dual.T @ x[:, i : i + 1024].astype(np.float64) for i in range(0, x.shape[1], 1024)], axis=1)
    return Model(languages, words, weights.astype(np.float32), trust)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])


def _below(bounds: dict[str, int]) -> Column:
    near = F.lit(False)
    for lang, h in bounds.items():
        near = near | ((F.col("lang") == lang) & (F.col("h") <= h))
    return near


def _bounds(own: DataFrame, counts: dict[str, int], most: int, order: WindowSpec) -> dict[str, int]:
    """Each language's ``most``-th smallest hash, or its largest. Hashes are even, so a few times ``most`` rows are expected
    under a small part of their range, and only these are ranked; where they are too few, the part is widened."""
    found, part, whole, left = {}, 4, (1 << 63) - 1, dict(counts)
    while left:
        upto = {lang: min(whole, (part * most << 64) // n - (1 << 63)) for lang, n in left.items()}
        least = own.where(_below(upto)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        rows = least.groupBy("lang").agg(F.max("h").alias("h"), F.count("*").alias("n")).collect()
        done = {r["lang"]: r["h"] for r in rows if r["n"] >= most or upto[r["lang"]] == whole}
        found |= done
        left = {lang: n for lang, n in left.items() if lang not in done and upto[lang] < whole}
        part *= 16
    return found


def train(docs: DataFrame, *, max_docs: int = MAX_DOCS) -> Model:
    """A model of the labelled documents that aren't held out."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    own = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    known = counts.count()
    if known > max_docs // 2:
        warnings.warn(f"{known - max_docs // 2} of {known} languages are left out: max_docs is {max_docs}", stacklevel=2)
    counts = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(max_docs // 2).collect()}
    if not counts:
        return Model([], np.zeros((0, 1)), np.zeros((1, BUCKETS), np.float32), np.ones(1))
    most = max(1, max_docs // len(counts))
    # The rows with the smallest hashes of each language: their bounds first, without texts, then the rows.
    own = own.where(F.col("lang").isin(*counts)).withColumn("h", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    bounds = _bounds(own.select("lang", "doc_id", "h"), counts, most, order)
    near = _below(bounds)
    chosen = own.where(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place", "h")
    rows = sorted(chosen.mapInArrow(_featurise, "doc_id long, lang string, x binary").collect(), key=lambda r: (r["lang"], r["doc_id"], r["x"]))
    languages = sorted({r["lang"] for r in rows})
    y = np.array([languages.index(r["lang"]) for r in rows])
    x = np.empty((len(rows), BUCKETS), np.float32)
    for i in range(len(rows)):  # rows are let go one by one
        x[i], rows[i] = np.frombuffer(rows[i]["x"], np.float16), None
    return fit(x, y, languages)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = [], [], []
            for text in batch.column("text").to_pylist():
                if not model.languages or not text or not LETTER.search(text):
                    lang.append("und"), score.append(0.0), unsure.append(True)
                    continue
                i, p, second = model.decode(features(text))
                lang.append(model.languages[i]), score.append(p), unsure.append(second > AMBIGUOUS * p)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(lang), pa.array(score), pa.array(unsure)], [*keep, "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous per document."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; columns of these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = docs.columns
    inner = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(inner(iter([pa.RecordBatch.from_arrays([batch.column("text")], ["text"])])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found.columns], [*names, *found.schema.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]))
