"""String functions on columns: subtokens, stems, paths, names and type tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order in which they are tried.
SUFFIXES = ("ing", "ed", "er", "est", "ly", "tion", "sion", "ness", "ment", "able", "ible", "ful", "less", "ize", "ise")
#: Fixed value: ASCII punctuation, as it is stripped from both ends of a subtoken.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CAMEL = r"(\p{Lu}+(?![\p{Ll}\p{Nd}])|\p{Lu}?[\p{Ll}\p{Nd}]+)"


def full(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def camel(s: Column) -> Column:
    """Parts of a camel-case name; an acronym stays whole, its last capital goes to what follows."""
    return F.regexp_extract_all(s, F.lit(_CAMEL), 1)


def snake(s: Column) -> Column:
    return full(F.split(s, "_"))


def kebab(s: Column) -> Column:
    return full(F.split(s, "-"))


def numeric(s: Column) -> Column:
    """Runs of digits, and the camel-case parts of what lies between."""
    runs = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.flatten(F.transform(runs, lambda x: F.when(x.rlike(r"^[0-9]"), F.array(x)).otherwise(camel(x))))


def subtokens(s: Column) -> Column:
    """Distinct subtokens of a name, sorted: camel and numeric parts of its pieces, and its snake and kebab parts."""
    pieces = full(F.split(s, r"[_\-\s.]+"))
    parts = F.flatten(F.transform(pieces, lambda p: F.concat(camel(p), numeric(p))))
    return F.array_sort(F.array_distinct(full(F.concat(parts, snake(s), kebab(s)))))


def stem(s: Column) -> Column:
    """Lower case, less the first suffix in order that leaves more than two letters; short words stay as they are."""
    low = F.lower(s)
    out = low
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(low.endswith(suffix) & (F.length(low) > n + 2), low.substr(F.lit(1), F.length(low) - n)).otherwise(out)
    return F.when(F.length(s) <= 3, s).otherwise(out)


def normalised(s: Column) -> Column:
    """Stems of the subtokens, lower-cased and stripped of punctuation; repeats stay."""
    return full(F.transform(subtokens(s), lambda x: F.lower(stem(F.btrim(x, F.lit(PUNCTUATION))))))


def hierarchy(path: Column) -> tuple[Column, Column, Column]:
    """File name, directory and first package of a path."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    top = F.get(F.filter(parts, lambda x: ~x.isin("", ".", "..")), 0)
    return name, folder, F.coalesce(top, F.lit(""))


def sanitised(s: Column) -> Column:
    """A name as part of an id: ASCII letters and digits, others folded to one underscore, 50 characters at most."""
    x = F.btrim(F.regexp_replace(s, r"[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.lower(F.coalesce(F.nullif(F.substring(x, 1, 50), F.lit("")), F.lit("unnamed")))


#: Words of a question that say nothing.
QUESTION = "how what where when why who which do does did is are was were the a an to in on at for of with by from as i you we they it this that".split()


def question_keywords(s: Column) -> Column:
    """Words of a question of three letters or more that say something, 50 characters at most; else its beginning."""
    words = F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: ~w.isin(*QUESTION) & (F.length(w) > 2))
    return F.coalesce(F.nullif(F.substring(F.array_join(words, " "), 1, 50), F.lit("")), F.substring(s, 1, 50))


def type_constructors(t: Column) -> Column:
    """Names that open a bracket in a type token, in order."""
    return F.regexp_extract_all(t, F.lit(r"([A-Z]\w*)\s*\["), 1)


def type_primitives(t: Column) -> Column:
    """Names in a type token that open no bracket, in order."""
    return F.regexp_extract_all(t, F.lit(r"([A-Za-z_]\w*)(?![\w\s]*\[)(?!\w)"), 1)


def inner_types(t: Column) -> Column:
    """Lower-cased parts between the first and the last bracket of a type token."""
    return full(F.transform(F.split(F.regexp_extract(t, r"^[^\[]*\[(.*)\]", 1), ","), lambda x: F.lower(F.trim(x))))
