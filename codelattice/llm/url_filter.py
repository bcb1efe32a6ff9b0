"""URL filter: host and path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

A url's host lies after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path
follows up to ``?``, ``#`` or the end. A url that is null or has no ``://`` has an empty host and path.
A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's; the
longest rule that fits decides. Where none fits, terms decide: a term counts where the characters beside
it are no letters or digits; one strict term or ``soft_limit`` distinct soft terms block the url.
Letters and digits are those of ASCII, here as in the SQL of the query.
The vocabulary is a file of terms with their weight, ``strict`` or ``soft`` (``url_terms.tsv`` beside this module, or
one's own by ``read_terms``). The automaton is built once a task from it, and urls pass through it once, in a map without
a shuffle. Empty urls are allowed. Urls of any length are read whole; repeated rows are judged each for itself, also
without a page_id; of rules of one length the last by code point wins. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import ship

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
TERMS, SOFT_LIMIT = Path(__file__).with_name("url_terms.tsv"), 2
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def read_terms(path: str | Path) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a file with a term, a tab and its weight on each line; # starts a remark."""
    found: dict[str, list[str]] = {"strict": [], "soft": []}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if line.strip() and not line.startswith("#"):
            term, _, weight = line.partition("\t")
            found[weight.strip()].append(term)
    return tuple(found["strict"]), tuple(found["soft"])


STRICT, SOFT = read_terms(TERMS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, by built-in functions."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), F.substr(url, F.instr(url, "://") + 3)), "#", 1))
    rest = F.coalesce(F.substr(after, F.lit(2)), F.lit(""))
    no_query = F.substring_index(rest, "?", 1)
    host = F.substring_index(no_query, "/", 1)
    path = F.substr(no_query, F.length(host) + 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for t in terms:
            a.add_word(t, (t, weight))
    a.make_automaton()
    return a


def hits(url: str | None, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Strict and soft terms that stand between boundaries in a url."""
    found: tuple[set[str], set[str]] = (set(), set())
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    for end, (term, weight) in a.iter(low):
        before, after = end - len(term), end + 1
        if (before < 0 or low[before] not in _ALNUM) and (after >= len(low) or low[after] not in _ALNUM):
            found[weight].add(term)
    return found[1], found[0]


def _scan(strict: tuple[str, ...], soft: tuple[str, ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for batch in batches:
            rows = [hits(u, a) for u in batch.column("url").to_pylist()]
            cols = [batch.column(n) for n in batch.schema.names if n != "url"]
            more = [pa.array([sorted(x[i]) for x in rows], pa.list_(pa.string())) for i in (0, 1)]
            bad = pa.array([bool(x[0]) or len(x[1]) >= limit for x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([*cols, *more, bad], [*(n for n in batch.schema.names if n != "url"), "strict_hits", "soft_hits", "bad"])

    return run


def judge(pages: DataFrame, *, rules: Mapping[str, str] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict ('allow' or 'block'), strict_hits, soft_hits per row of (page_id, url)."""
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    found = found.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    kind = dict(pages.dtypes)["page_id"]
    found = found.select("page_id", "host", "path", "rule", "url").mapInArrow(_scan(tuple(strict), tuple(soft), soft_limit), f"page_id {kind}, host string, path string, rule string, strict_hits array<string>, soft_hits array<string>, bad boolean")
    verdict = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "strict_hits", "soft_hits")
