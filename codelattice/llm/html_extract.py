"""Main text of web pages, with the site's template removed.

Pages are parsed into elements. Every element's subtree outside articles is hashed (tag and contents), subtrees are
counted per host in Spark, and those that stand on at least ``share`` of a host's distinct pages, three at least, are
deleted: fewer than three pages can't tell a template from a copy. A page counts by its contents, so neither repeated
rows nor copies of a page make a template of it. What stands in a page's article or main is its own and never goes by
counts, however often it recurs. (Stock sentences recur on up to a tenth of the pages of the given tables, blocks of a
template on all pages of their design; ``share`` lies between.)

What else is not article text goes by markup: navigation, headers, footers, sidebars, forms, scripts, styles, and
elements whose class, id or role names a notice, an advert, a menu or reader comments (whole tokens, as in
cookie-notice, but not has-sidebar or share-price; headings only go as adverts or comments). A wrapper so named that
holds the page's article or main stays. Where a page has article elements (else a main element), only what stands in
them counts.

Recurring subtrees of a host number at most 1/share times the mean count of subtrees of its pages. They
are broadcast where they are few in all (``BROADCAST_ROWS``) and joined by host otherwise; the pages
themselves are parsed twice instead of being shuffled.

Character references are decoded, white space in a block becomes one space, blocks are joined by line
feeds in page order. Null or empty html gives an empty text. Repeated rows are extracted each for itself. Rows without
a url or a host are one site with an empty name. Pages of any length are read whole, in time linear in it, hostile
markup included. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import few, materialise, ship
from codelattice.llm.url_filter import host_and_path

SHARE, LEAST, BROADCAST_ROWS = 0.35, 3, 200_000

NAME, STOP = re.compile(r"(/?)([a-zA-Z][\w:-]*)"), re.compile("[>\"']")
#: Element names with a meaning of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes template".split())
ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select", "tbody": "table", "thead": "table", "tfoot": "table"}
#: Elements that the end of an inline element around them closes too.
UNCLOSED = INLINE | SIBLINGS.keys() | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP = frozenset("aside button canvas dialog footer form head header menu nav object search select svg".split())
#: Words that name what is none of the article; those of OTHERS hold articles of their own, not the page's.
OTHERS = "ad|ads|adv|advert|adverts|advertisement|advertising|comments?|commentlist|disqus|promo|promoted|related|replies|respond|sponsor|sponsored|widget"
NAMES = f"{OTHERS}|banner|breadcrumbs?|consent|cookies?|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|share|sharing|sidebar|signup|skip|social|subscribe|toolbar"
#: Words that may stand beside them in a name.
BESIDE = "area|bar|block|bottom|box|button|buttons|container|form|global|icons|inner|item|left|link|links|list|main|message|mobile|overlay|page|policy|posts|primary|right|secondary|section|site|slot|top|unit|wrap|wrapper"
NAMED, FOREIGN = (re.compile(rf"(?:(?:{BESIDE})[_-]+)*(?:{names})\d*(?:[_-]+(?:{NAMES}|{BESIDE}|\d+)\d*)*", re.IGNORECASE) for names in (NAMES, OTHERS))
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s>]+)))?""")
ROLES = frozenset("banner navigation complementary contentinfo search form menu menubar toolbar dialog alertdialog alert".split())


def dropped(tag: str, attributes: str) -> int:
    """Whether an element is none of the article, by its own markup: 0 no, 1 unless it holds the page's article, 2 yes."""
    if tag in DROP:
        return 1 if tag in ("form", "header") else 2
    if not attributes or tag in ("html", "body"):
        return 0
    bad, names = 0, FOREIGN if tag in HEADINGS else NAMED
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for token in value.split():
                if names.fullmatch(token):
                    bad = max(bad, 2 if FOREIGN.fullmatch(token) else 1)
        elif name == "role":
            if value.lower() in ROLES:
                bad = max(bad, 1)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            bad = max(bad, 1)
    return bad


def tokens(source: str) -> Iterator[tuple[int, int, str, bool, str] | int]:
    """(start, end, tag, whether it closes, attributes) of the tags of a page; of comments and the like, the tag is empty.
    Takes, by send, where to go on. Quotes that never end count as plain characters; that such a quote was met is kept
    in mind, so that no part of a page is read again and again."""
    last, at, hopeless = source.rfind(">"), 0, set()

    def end_of(begin: int) -> int:
        i, opened = begin, []
        while m := STOP.search(source, i):
            if m[0] == ">":
                return m.start()
            close = -1 if m.start() in hopeless else source.find(m[0], m.end())
            opened.append(m.start())
            if close < 0:
                break
            i = close + 1
        hopeless.update(opened)
        return source.find(">", begin)

    while 0 <= (at := source.find("<", at)) < last:
        if source.startswith("<!--", at):
            close = source.find("-->", at + 4)
            token = at, len(source) if close < 0 else close + 3, "", False, ""
        elif m := NAME.match(source, at + 1):
            end = end_of(m.end())
            token = at, end + 1, m[2].lower(), bool(m[1]), source[m.end() : end]
        elif source[at + 1] in "!?/":
            token = at, source.find(">", at) + 1, "", False, ""
        else:
            at += 1
            continue
        at = (yield token) or token[1]


class Page:
    """Blocks of text with the elements they stand in, and the digest of each element's subtree."""

    __slots__ = ("above", "blocks", "digests", "roots", "tags")

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, int]] = []  # text, element or -1, kept by markup, root
        self.digests: list[int] = []
        self.tags: list[str] = []
        stack: list[tuple[str, int, list]] = []  # tag, number, children
        self.above = above = []  # each element's parent, or -1
        bad: list[int] = []  # each element's dropped()
        found: list[tuple[str, int]] = []
        text: list[str] = []
        opened: Counter[str] = Counter()  # elements on the stack
        tops: list = []

        def flush() -> None:
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if line:
                    (stack[-1][2] if stack else tops).append(line)
                    found.append((line, stack[-1][1] if stack else -1))

        def close() -> None:
            tag, number, children = stack.pop()
            opened[tag] -= 1
            d = xxhash.xxh64_intdigest(f"{tag}\x00" + "\x01".join(map(str, children))) - (1 << 63) if children else 0
            self.digests[number] = d
            if children:
                (stack[-1][2] if stack else tops).append(d)

        def close_to(tag: str, limits: tuple[str, ...] = ()) -> None:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    while len(stack) > i:
                        close()
                    return
                if stack[i][0] in limits:
                    return

        reader, at, go = tokens(source), 0, None
        while token := next(reader, None) if go is None else self._from(reader, go):
            start, end, tag, closes, attributes = token
            if start > at:
                text.append(source[at:start])
            at, go = end, None
            if not tag:
                continue
            if closes:
                if tag in INLINE:
                    for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                        if stack[i][0] == tag:
                            flush()
                            close_to(tag)
                            break
                        if stack[i][0] not in UNCLOSED:
                            break
                    continue
                flush()
                close_to(tag)
                continue
            if tag in RAW:
                if tag not in ("title", "textarea"):
                    flush()
                shut = ENDS[tag].search(source, at)
                at = go = shut.start() if shut else len(source)
                continue
            if tag == "br":
                text.append(" ")
                continue
            # Inline elements count only where they are rejected, and in a rejected one of their name, whose end isn't theirs.
            if tag in INLINE and not (attributes and dropped(tag, attributes)) and not opened[tag]:
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            if tag in CLOSES_P:
                close_to("p", ("article", "div", "section", "td", "th", "li", "body", "blockquote", "main"))
            if tag in SIBLINGS:
                close_to(tag, tuple(SIBLINGS[tag].split()))
            opened[tag] += 1
            above.append(stack[-1][1] if stack else -1)
            bad.append(dropped(tag, attributes))
            stack.append((tag, len(self.digests), []))
            self.digests.append(0)
            self.tags.append(tag)
        text.append(source[at:])
        flush()
        while stack:
            close()
        self._judge(found, above, bad)

    @staticmethod
    def _from(reader: Iterator, at: int):
        try:
            return reader.send(at)
        except StopIteration:
            return None

    def _judge(self, found: list[tuple[str, int]], above: list[int], bad: list[int]) -> None:
        """Sets blocks. What was named like a part of the template stays if it holds main, or article where none stands elsewhere."""
        worst: list[int] = []  # of each element and those around it
        for up, own in zip(above, bad, strict=True):
            worst.append(max(own, worst[up] if up >= 0 else 0))
        roots = [n for n, t in enumerate(self.tags) if t in ("article", "main") and not bad[n]]
        clean, lifted = any(not worst[n] and self.tags[n] == "article" for n in roots), set()
        for n in roots:
            if worst[n] == 1 and (self.tags[n] == "main" or not clean):
                up = above[n]
                while up >= 0 and up not in lifted:
                    lifted.add(up)
                    up = above[up]
        gone, root = [], []
        for n, (up, tag) in enumerate(zip(above, self.tags, strict=True)):
            gone.append(bad[n] == 2 or bad[n] == 1 and n not in lifted or up >= 0 and gone[up])
            root.append(max(root[up] if up >= 0 else 0, 0 if gone[n] else {"article": 2, "main": 1}.get(tag, 0)))
        self.roots = root
        for line, n in found:
            self.blocks.append((line, n, n < 0 or not gone[n], root[n] if n >= 0 else 0))

    def subtrees(self) -> set[int]:
        """Digests of the elements that have contents and neither are nor stand in roots of the page or of an article."""
        return {d for d, t, r in zip(self.digests, self.tags, self.roots, strict=True) if d and not r and t not in ("html", "body")}

    def main_text(self, recurring: set[int]) -> str:
        out: list[bool] = []  # whether each element is of the template, or in one that is
        for up, d, r in zip(self.above, self.digests, self.roots, strict=True):
            out.append(not r and (d in recurring or up >= 0 and out[up]))
        kept = [b for b in self.blocks if b[2]]
        best = max((b[3] for b in kept), default=0)
        return "\n".join(b[0] for b in kept if b[3] == best and not (b[1] >= 0 and out[b[1]]))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows, digests = [n for n in batch.schema.names if n != "html"], [], []
        for row, source in enumerate(batch.column("html").to_pylist()):
            found = Page(source).subtrees() if source else ()
            rows += [row] * len(found)
            digests += found
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in keys), pa.array(digests, pa.int64())], [*keys, "digest"])


def template_counts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, digest, n) and (host, pages) of (host, html): on how many distinct pages of its host a subtree stands, and how
    many there are. Pages that don't repeat, nearly all, are counted with partial sums; the others by contents."""
    pages = pages.where("html <> ''").select("host", "html", F.xxhash64("html").alias("content"))
    kinds = materialise(pages.groupBy("host", "content").agg(F.count("*").alias("rows")), "contents")
    sizes = kinds.groupBy("host").agg(F.count("*").alias("pages"))
    again = few(materialise(kinds.where("rows > 1").select("host", "content"), "again"))
    once = pages.join(again, ["host", "content"], "left_anti").select("host", "html").mapInArrow(_hash, "host string, digest long")
    copies = pages.join(again, ["host", "content"], "left_semi").select("host", "content", "html").mapInArrow(_hash, "host string, content long, digest long")
    every = once.unionByName(copies.distinct().select("host", "digest"))
    return every.groupBy("host", "digest").agg(F.count("*").alias("n")), sizes


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cache: dict[str, set[int]] = {}
        texts = []
        for host, source, recurring in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("recurring"), strict=True):
            if host not in cache:
                cache[host] = set(recurring.as_py() or ())
            texts.append(Page(source).main_text(cache[host]) if source else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, share: float = SHARE, least: int = LEAST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    pages = pages.select("page_id", "url", "html").withColumn("host", host)
    counts, sizes = template_counts(pages)
    often = counts.where(F.col("n") >= least).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    recurring = materialise(often.groupBy("host").agg(F.collect_list("digest").alias("recurring")), "recurring")
    total = recurring.agg(F.sum(F.size("recurring"))).first()[0] or 0
    joined = pages.join(F.broadcast(recurring) if total <= broadcast_rows else recurring, "host", "left")
    kind = dict(pages.dtypes)["page_id"]
    return joined.select("page_id", "url", "host", "html", "recurring").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
