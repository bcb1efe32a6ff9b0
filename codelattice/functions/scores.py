"""Scores of symbols: scope lengths, namespaces, hybrid scores, the keyword ladder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of dense, lexical, type and namespace scores.
HYBRID = (0.5, 0.2, 0.15, 0.15)


def scope_length(first: Column, last: Column) -> Column:
    return F.when(last > first, last - first).when(first >= 0, F.lit(1))


def scope_similarity(x: Column, y: Column, least: float = 0.2) -> Column:
    """Ratio of two scope lengths, 0 where unknown or below ``least``."""
    ratio = F.least(x, y) / F.nullif(F.greatest(x, y).cast("double"), F.lit(0.0))
    return F.when(x.isNotNull() & y.isNotNull() & (ratio >= least), ratio).otherwise(F.lit(0.0))


def common_prefix(x: Column, y: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def namespace(name1: Column, dir1: Column, top1: Column, name2: Column, dir2: Column, top2: Column) -> Column:
    """1 in one file, 0.7 in one directory, 0.4 in one package, else 0.2 times the shared part of the path."""
    a, b = F.split(dir1, "/"), F.split(dir2, "/")
    share = 0.2 * common_prefix(a, b) / F.greatest(F.size(a), F.size(b))
    near = lambda x, y: (x == y) & (x != "")
    return F.when(near(name1, name2), F.lit(1.0)).when(near(dir1, dir2), F.lit(0.7)).when(near(top1, top2), F.lit(0.4)).when((dir1 != "") & (dir2 != ""), share).otherwise(F.lit(0.0))


def hybrid(dense: Column, lexical: Column, types: Column, place: Column) -> Column:
    return sum((w * c for w, c in zip(HYBRID[1:], (lexical, types, place), strict=True)), HYBRID[0] * dense)


def plain_hybrid(cosine: Column, norm: Column, mean_norm: float | None, context: Column) -> Column:
    """Cosine less 0.05 for each unit that the norm lies above the mean, and 0.15 times the likeness of scopes. Fixed values."""
    over = F.greatest(F.coalesce(norm - F.lit(mean_norm).cast("double"), F.lit(0.0)), F.lit(0.0))
    return cosine - 0.05 * over + 0.15 * context


def softmax(x: Column, tau: Column) -> Column:
    """Probabilities of an array of scores at a temperature."""
    most = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - most) / tau))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def jaccard(x: Column, y: Column) -> Column:
    a, b = F.split(x, r"\s+"), F.split(y, r"\s+")
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def keyword_score(name: Column, kind: Column, types: Column, words: list[str]) -> Column:
    """The ladder of matches of a phrase, then of its words, with name, kind and type tokens. Its scores."""
    phrase, n = " ".join(words), len(words)
    has = lambda c, w: F.contains(c, F.lit(w))
    count = lambda test: sum((test(w).cast("int") for w in words), F.lit(0))
    in_name, in_kind, in_types = count(lambda w: has(name, w)), count(lambda w: has(kind, w)), count(lambda w: has(types, w))
    nk, some = count(lambda w: has(name, w) | has(kind, w)), count(lambda w: has(name, w) | has(kind, w) | has(types, w))
    out = F.when(name == phrase, F.lit(1.0)).when(name.startswith(phrase), F.lit(0.8)).when(has(name, phrase), F.lit(0.6))
    if n > 1:
        out = out.when(in_name == n, F.lit(0.7)).when((nk > 0) & (in_types > 0), 0.4 + 0.2 * (nk + in_types) / n)
        return out.when(in_kind == n, F.lit(0.3)).when(in_types == n, F.lit(0.35)).when(some > 0, 0.1 + 0.15 * some / n).otherwise(F.lit(0.0))
    return out.when(kind == phrase, F.lit(0.4)).when(has(kind, phrase), F.lit(0.2)).when(has(types, phrase), F.lit(0.3)).otherwise(F.lit(0.0))
