"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its share of all words by weight, at most ``cap`` times its own words; what a capped
source leaves over is shared again by weight. Each document of a source has the same expected number of
copies, target / source_size. Documents stand in order of size (then doc_id) within the source, the
expected copies are prefix-summed, one random offset is added, and a document is taken once for every
integer boundary that its interval crosses. Whole copies that every document gets are set apart before the
prefix sum, so rounding can't exceed the cap.

The prefix sum is a rank, since the step is constant. Ranks come from counts in three levels (sizes within
a source, slices of a size by a hash, documents of a slice of about ``slice_rows``), so a hot source or a
hot size is spread over many tasks and no window holds a whole source. Rows that agree in all that tells documents
apart are counted before any of this, with partial sums, so a doc_id that a third of all rows have, or none, is one
row with a count.

A null text has size 0. The null source is a source of its own, last in order. Rows that repeat a doc_id
are separate documents. Empty tables give empty results. Documents of size 0 are taken like others and add
no words. Texts of any length are counted whole. Other columns pass through ``mix`` untouched unless they are named like one of its results,
in which case they are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import materialise

WEIGHTS, CAP, SEED, SLICE_ROWS = (5, 2, 1), 3, 17, 1000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size); the table of sources is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("weight"))
    # Water level: sources fill up in the order of cap * size / weight. The first k are capped if the level
    # that the rest would reach lies above the k-th source's bound. From the first source on that isn't capped
    # the levels fall, so the first of them is the largest.
    bound = cap * F.col("source_size") / F.col("weight")
    upto = Window.orderBy("bound", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = s.withColumn("bound", bound).withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    s = s.withColumn("before", F.sum("source_size").over(upto) - F.col("source_size")).withColumn("weight_before", F.sum("weight").over(upto) - F.col("weight"))
    s = s.withColumn("level", (F.col("total") - cap * F.col("before")) / (F.col("all_weight") - F.col("weight_before")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(whole))
    target = F.when(F.col("bound") <= F.col("level"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source and seed, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies.

    Documents are told apart by doc_id and text here, so rows without a doc_id are drawn each for itself. Rows that
    agree in both and in source get the same number of copies, the least drawn for them.
    """
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(F.col("text")))
    docs = docs.withColumn("__version", F.xxhash64("text"))
    slim = _counted(docs, ["doc_id", "__version"])
    drawn = _places(slim, targets(_sizes(slim), weights, cap), seed, slice_rows, ["doc_id", "__version"])
    least = F.col("whole") + (_crossed(F.col("rank") + F.col("rows")) - _crossed(F.col("rank")) >= F.col("rows")).cast("long")
    drawn = drawn.select(F.col("doc_id").alias("__doc"), F.col("__version").alias("__v"), F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", least.alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")) & (F.col("__version") == F.col("__v"))
    return docs.join(drawn, same).drop("__doc", "__v", "__source", "__size", "__version")


def _counted(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, source, size and the number of rows that agree in them."""
    return materialise(docs.groupBy(*keys, "source", "size").agg(F.count("*").alias("rows")), "sizes")


def _sizes(slim: DataFrame) -> DataFrame:
    return slim.select("source", (F.col("size") * F.col("rows")).alias("size"))


def _crossed(rank: Column) -> Column:
    """The boundaries that the first ``rank`` rows of a source cross."""
    return F.floor(F.col("part") * rank + F.col("u"))


def _places(slim: DataFrame, plan: DataFrame, seed: int, slice_rows: int, keys: list[str]) -> DataFrame:
    """Rows of ``slim`` with rank (the rows before them in their source), whole, part and u."""
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    plan = plan.withColumn("u", offset(F.col("source"), seed)).withColumn("whole", F.floor(step).cast("long")).withColumn("part", step - F.floor(step))
    plan = plan.withColumnRenamed("source", "ps")
    cells = slim.groupBy("source", "size").agg(F.sum("rows").alias("cell"))
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell").over(below), F.lit(0)))
    cells = cells.withColumn("slices", F.ceil(F.col("cell") / slice_rows)).join(plan, F.col("source").eqNullSafe(F.col("ps")))
    cells = materialise(cells.drop("ps").withColumnsRenamed({"source": "cs", "size": "cz"}), "cells")
    rows = slim.join(cells, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz"))).drop("cs", "cz")
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    digest = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("cut", F.pmod(digest, F.col("slices")))
    counts = rows.groupBy("source", "size", "cut").agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("cut_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(F.col("source").alias("ks"), F.col("size").alias("kz"), F.col("cut").alias("kc"), "cut_before")
    own = Window.partitionBy("source", "size", "cut").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.coalesce(F.sum("rows").over(own), F.lit(0)))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("ks")) & (F.col("size") == F.col("kz")) & (F.col("cut") == F.col("kc")))
    rank = F.col("cell_before") + F.col("cut_before") + F.col("place")
    return rows.select(*keys, "source", "size", "rows", "source_size", "target", "whole", "part", "u", rank.alias("rank"))


def taken(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), source, copies."""
    slim = _counted(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), ["doc_id"])
    out = _places(slim, targets(_sizes(slim), weights, cap), seed, slice_rows, ["doc_id"])
    # Every row on its own again, in blocks, so that no array holds all of a hot doc_id.
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / slice_rows)))).withColumn("nth", F.col("nth") * slice_rows)
    out = out.withColumn("nth", F.explode(F.sequence(F.col("nth") + 1, F.least(F.col("nth") + slice_rows, F.col("rows")))))
    crossed = _crossed(F.col("rank") + F.col("nth")) - _crossed(F.col("rank") + F.col("nth") - 1)
    out = out.withColumn("copies", (F.col("whole") + F.least(crossed, F.lit(1))).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
