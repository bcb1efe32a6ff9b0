"""Edges that are derived from nodes and edges, the adjacency, and pointwise mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions import scores, text

HALVING = 0.5


@dataclass(frozen=True)
class CallLimits:
    """How far calls are expanded: callers to start from, new edges in all, callees a caller, nodes a start expands."""

    starts: int | None = None
    edges: int | None = None
    neighbours: int | None = 30
    queue: int | None = None

    @classmethod
    def of(cls, nodes: int, calls: int) -> CallLimits:
        """The limits for a graph of so many nodes and calls. Sizes, counts and shares."""
        if nodes < 1000:
            return cls(100, min(5 * calls, 1000), 20, 200)
        if nodes < 5000:
            return cls(max(200, nodes // 20), 7 * calls, 30, 500)
        return cls(max(5000, nodes // 10), 10 * calls, 50, 1000)


def top_callers(calls: DataFrame, most: int) -> DataFrame:
    """src, n: the callers of most different callees."""
    return calls.groupBy("src").agg(F.countDistinct("dst").alias("n")).orderBy(F.desc("n"), "src").limit(most)


def expand_calls(edges: DataFrame, depth: int = 3, limits: CallLimits = CallLimits()) -> DataFrame:
    """Callees at a distance of 2 to ``depth``: src, dst, weight. Weights are products along the path of first
    discovery, halved once more with each step; callees of a caller are tried in order of dst, callers in order of
    their number of callees. Limits are part of the feature; None means none."""
    calls = edges.where("rel = 'calls'").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ranked = calls.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    first = ranked if limits.starts is None else ranked.join(top_callers(calls, limits.starts).select("src"), "src")
    near = F.lit(True) if limits.neighbours is None else F.col("pos") <= limits.neighbours
    capped = ranked.where(near).select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("weight").alias("w"), "pos")
    front = first.where(near & (F.col("src") != F.col("dst"))).select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("pos").alias("rank"), F.col("weight").alias("cum"))
    seen, found, factor = front.select("start", "node"), None, 1.0
    place = F.col("rank")  # in the start's queue, behind the start itself
    for level in range(2, depth + 1):
        factor *= HALVING
        step = front if limits.queue is None else front.where(place < limits.queue)
        step = step.join(capped, "node").where((F.col("next") != F.col("start")) & (F.col("cum") * F.col("w") * factor > 1e-6))
        step = step.join(seen.select("start", F.col("node").alias("next")), ["start", "next"], "left_anti")
        best = step.groupBy("start", "next").agg(F.min_by(F.struct(F.col("cum"), F.col("w"), F.col("rank"), F.col("pos")), F.struct("rank", "pos")).alias("x"))
        best = best.select("start", F.col("next").alias("node"), (F.col("x.cum") * F.col("x.w") * factor).alias("cum"), F.col("x.rank").alias("r"), F.col("x.pos").alias("p"))
        front = best.select("start", "node", F.row_number().over(Window.partitionBy("start").orderBy("r", "p")).alias("rank"), "cum", F.lit(level).alias("level"))
        if limits.queue is not None:
            front = front.join(seen.groupBy("start").agg(F.count("*").alias("before")), "start")
            place = F.col("before") + F.col("rank")
        seen = seen.unionByName(front.select("start", "node"))
        own = front.select("start", "node", "level", "rank", "cum")
        found = own if found is None else found.unionByName(own)
    new = found.select(F.col("start").alias("src"), F.col("node").alias("dst"), F.col("cum").alias("weight"), "level", "rank")
    new = new.join(calls.select("src", "dst"), ["src", "dst"], "left_anti")
    if limits.edges is not None:
        new = _within_budget(new, calls, limits.edges)
    return new.select("src", "dst", "weight")


def _within_budget(new: DataFrame, calls: DataFrame, most: int) -> DataFrame:
    """The first ``most`` edges: callers by their number of callees, then by name. Counts come per number of callees
    first, so no window holds all callers."""
    per = new.groupBy("src").agg(F.count("*").alias("edges")).join(calls.groupBy("src").agg(F.count("*").alias("n")), "src")
    ahead = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = per.groupBy("n").agg(F.sum("edges").alias("edges")).select("n", F.coalesce(F.sum("edges").over(ahead), F.lit(0)).alias("ahead"))
    among = Window.partitionBy("n").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("mine", F.coalesce(F.sum("edges").over(among), F.lit(0))).join(sizes, "n").where(F.col("ahead") + F.col("mine") < most)
    place = F.row_number().over(Window.partitionBy("src").orderBy("level", "rank"))
    return new.withColumn("place", place).join(before.select("src", (F.col("ahead") + F.col("mine")).alias("before")), "src").where(F.col("before") + F.col("place") <= most)


def locations(nodes: DataFrame) -> DataFrame:
    """idx, file, lineno of the nodes that have a line."""
    return nodes.where("lineno >= 0").select("idx", "file", "lineno")


def strided(nodes: DataFrame, most: int = 500) -> DataFrame:
    """Of each file's located nodes in line order (rn from 0; n in all) all, or ``most`` by a stride."""
    order = Window.partitionBy("file").orderBy("lineno", "idx")
    n = locations(nodes).withColumn("rn", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("file")))
    step = F.greatest(F.floor(F.col("n") / most), F.lit(1))
    return n.where((F.col("n") <= most) | ((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < most)))


def _own_weight(edges: DataFrame, first: bool) -> DataFrame:
    """idx, idx2, own: the largest weight of each unordered pair, or that of its first edge."""
    weight = F.min_by("weight", F.struct(*EDGE_ORDER)) if first else F.max("weight")
    return edges.groupBy(F.least("src_idx", "dst_idx").alias("idx"), F.greatest("src_idx", "dst_idx").alias("idx2")).agg(weight.alias("own"))


def context_window(nodes: DataFrame, window: int = 5, most_nodes: int | None = 500, most_pairs: int | None = 5000, added_to: DataFrame | None = None) -> DataFrame:
    """Pairs of nodes of a file at most ``window`` lines apart, both ways, weight 1, or 1 more than the pair's largest
    edge in ``added_to``. Large files are sampled by a stride, and a file gives at most min(nodes * window, most_pairs)
    pairs: limits of the feature itself; None lifts them."""
    n = strided(nodes, most_nodes or 1 << 62)
    n = n.withColumn("bin", F.floor(F.col("lineno") / (window + 1)))
    other = n.select("file", F.col("idx").alias("idx2"), F.col("lineno").alias("line2"), F.col("rn").alias("rn2"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"))
    if most_pairs is not None:
        cap = F.least(F.least(F.col("n"), F.lit(most_nodes or 1 << 62)) * window, F.lit(most_pairs))
        # How many pairs a node begins follows from counts of lines, so only nodes that begin pairs under the cap are joined.
        order = Window.partitionBy("file").orderBy("lineno", "idx")
        upto = F.count("*").over(Window.partitionBy("file").orderBy("lineno").rangeBetween(Window.unboundedPreceding, window))
        n = n.withColumn("own", upto - F.row_number().over(order))
        n = n.withColumn("before", F.sum("own").over(order) - F.col("own")).withColumn("cap", cap).where(F.col("before") < F.col("cap"))
    pairs = n.join(other, ["file", "bin"]).where((F.col("rn2") > F.col("rn")) & (F.col("line2") - F.col("lineno") <= window))
    if most_pairs is not None:
        place = F.row_number().over(Window.partitionBy("file", "rn").orderBy("rn2"))
        pairs = pairs.withColumn("pair", F.col("before") + place).where(F.col("pair") <= F.col("cap"))
    weight = F.lit(1.0)
    if added_to is not None:
        pairs = pairs.join(_own_weight(added_to, False).withColumnsRenamed({"idx": "lo", "idx2": "hi"}), (F.least("idx", "idx2") == F.col("lo")) & (F.greatest("idx", "idx2") == F.col("hi")), "left")
        weight = F.coalesce("own", F.lit(0.0)) + 1.0
    pairs = pairs.withColumn("weight", weight)
    ways = F.explode(F.array(F.struct(F.col("idx").alias("src_idx"), F.col("idx2").alias("dst_idx")), F.struct(F.col("idx2").alias("src_idx"), F.col("idx").alias("dst_idx"))))
    return pairs.select(ways.alias("e"), "weight").select("e.*", F.lit("context_window").alias("rel"), "weight")


#: The order of edges where they bring none of their own.
EDGE_ORDER = ("rel", "src_idx", "dst_idx", "weight")


def scope_boost(edges: DataFrame, nodes: DataFrame, order: Sequence[str] = EDGE_ORDER) -> DataFrame:
    """Edges between scopes of like length (ratio 0.3 at least) weigh 1 + 0.2 * ratio times as much as the last
    edge of their pair, either way round; the others keep their weight."""
    length = nodes.select("idx", scores.scope_length(F.col("lineno"), F.col("end_lineno")).alias("len"))
    e = edges.join(length.withColumnsRenamed({"idx": "src_idx", "len": "a"}), "src_idx", "left").join(length.withColumnsRenamed({"idx": "dst_idx", "len": "b"}), "dst_idx", "left")
    pair = Window.partitionBy(F.least("src_idx", "dst_idx"), F.greatest("src_idx", "dst_idx"))
    sim = F.coalesce(scores.scope_similarity(F.col("a"), F.col("b"), 0.3), F.lit(0.0))
    last = F.max_by("weight", F.struct(*order)).over(pair)
    return e.withColumn("sim", sim).withColumn("last", last).select("src_idx", "dst_idx", "rel", F.when(F.col("sim") > 0, F.col("last") * (1 + 0.2 * F.col("sim"))).otherwise(F.col("weight")).alias("weight"))


def subtoken_edges(nodes: DataFrame) -> DataFrame:
    """Edges between nodes and their normalised subtokens (1), and among a node's subtokens (0.25), by name."""
    n = nodes.select("id", F.posexplode(text.normalised(F.col("name"))).alias("pos", "token"))
    token = F.concat(F.lit("subtoken:"), F.col("token"))
    own = n.select("id", token.alias("t"), "pos")
    up = own.select(F.col("id").alias("src"), F.col("t").alias("dst"), F.lit("has_subtoken").alias("rel"), F.lit(1.0).alias("weight"))
    down = own.select(F.col("t").alias("src"), F.col("id").alias("dst"), F.lit("subtoken_of").alias("rel"), F.lit(1.0).alias("weight"))
    both = own.join(own.select("id", F.col("t").alias("t2"), F.col("pos").alias("pos2")), "id").where("pos <> pos2")
    among = both.select(F.col("t").alias("src"), F.col("t2").alias("dst"), F.lit("co_subtoken").alias("rel"), F.lit(0.25).alias("weight"))
    return up.unionByName(down).unionByName(among).groupBy("src", "dst", "rel").agg(F.max("weight").alias("weight"))


def hierarchy_edges(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = 50, most_pairs: int | None = 500, first: bool = False) -> DataFrame:
    """Pairs of nodes of one file name, directory or package; weight: the pair's own (its largest, or its ``first``
    edge's) plus 3, 2 or 1. The first 50 nodes and 500 pairs of a group count: limits of the feature itself; None
    lifts them, and then the result grows with the square of a group."""
    name, folder, top = text.hierarchy(F.col("file"))
    levels = [("same_file", name, 3.0), ("same_directory", folder, 2.0), ("same_package", top, 1.0)]
    keys = F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), k.alias("grp"), F.lit(w).alias("add")) for r, k, w in levels]))
    n = nodes.select("idx", keys.alias("k")).select("idx", "k.*").where("grp <> ''")
    n = n.withColumn("rn", F.row_number().over(Window.partitionBy("rel", "grp").orderBy("idx")))
    n = n if most_nodes is None else n.where(F.col("rn") <= most_nodes)
    pairs = n.join(n.select("rel", "grp", F.col("idx").alias("idx2"), F.col("rn").alias("rn2")), ["rel", "grp"]).where("rn < rn2")
    if most_pairs is not None:
        pairs = pairs.withColumn("pair", F.row_number().over(Window.partitionBy("rel", "grp").orderBy("rn", "rn2"))).where(F.col("pair") <= most_pairs)
    out = pairs.join(_own_weight(edges, first), ["idx", "idx2"], "left").withColumn("weight", F.coalesce("own", F.lit(0.0)) + F.col("add"))
    ways = F.explode(F.array(F.struct(F.col("idx").alias("src_idx"), F.col("idx2").alias("dst_idx")), F.struct(F.col("idx2").alias("src_idx"), F.col("idx").alias("dst_idx"))))
    return out.select(ways.alias("e"), "rel", "weight").select("e.*", "rel", "weight")


def adjacency(edges: DataFrame, added: bool = True) -> DataFrame:
    """i, j, v: the largest weight of each directed pair, added to its mirror image; not ``added``, the larger of the two."""
    most = edges.groupBy(F.col("src_idx").alias("i"), F.col("dst_idx").alias("j")).agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("v"))
    both = most.unionByName(most.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.groupBy("i", "j").agg((F.sum if added else F.max)("v").alias("v"))


def ppmi(cells: DataFrame) -> DataFrame:
    """Positive pointwise mutual information of (i, j, v); only positive cells are kept."""
    cells = cells.where("v > 0")
    rows, cols = cells.groupBy("i").agg(F.sum("v").alias("ri")), cells.groupBy("j").agg(F.sum("v").alias("cj"))
    total = cells.agg(F.sum("v").alias("total"))
    x = cells.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(total))  # one row
    p = (F.col("v") / F.col("total")) / (F.col("ri") / F.col("total") * F.col("cj") / F.col("total") + 1e-10)
    return x.select("i", "j", F.log(p + 1e-10).alias("v")).where("v > 0")


def expanded_types(types: DataFrame) -> DataFrame:
    """Type tokens with half their count for each constructor in them and a quarter for each primitive."""
    t = F.col("type_token")
    parts = F.concat(F.transform(text.type_constructors(t), lambda x: F.struct(x.alias("t"), F.lit(0.5).alias("f"))), F.transform(text.type_primitives(t), lambda x: F.struct(x.alias("t"), F.lit(0.25).alias("f"))))
    more = types.select("symbol", "count", F.explode(parts).alias("p")).select("symbol", F.col("p.t").alias("type_token"), F.floor(F.col("count") * F.col("p.f")).cast("long").alias("count"))
    every = types.select("symbol", "type_token", F.col("count").cast("long").alias("count")).unionByName(more)
    return every.groupBy("symbol", "type_token").agg(F.sum("count").alias("count")).where("count > 0")
