"""Main text of web pages by removal of site templates.

1. Each page is parsed once, in its task, into elements, each of which names the one it's in, and blocks of text. Every element that ends
   blocks has a subtree hash (tag, texts, inner hashes). One whose class or id consists of words for page furniture (``NAMES``: ``ad``,
   ``site-footer``) also has a shape hash (tag, names; not its texts), by which adverts and boxes that differ from page to page are one subtree.
2. Spark counts, per host, on how many different pages each subtree recurs. Pages
   whose content is the same count once, so that copies of an article don't turn it
   into a template.
3. A subtree on at least ``SHARE`` of a host's pages is template, and a shape on ``SHAPE_SHARE`` of them, both on ``MIN_PAGES`` at least. Hosts of fewer
   pages can't show what recurs; of these, shapes are counted together, as of one host. All blocks in a template go.
4. Of what is left, what the standard says is no content (scripts, styles, navigation, footers, asides, forms, hidden elements and the like) goes as well, and the
   text of ``article`` elements, else of ``main``, else of the body is kept. A form or header that holds an article or ``main``, and a form that holds most of a page's text in
   paragraphs or headings, are kept as what they hold; so is a heading in an article's header.

No name drops anything without a count, and a name counts only if all its words are furniture
(``post-with-sidebar``, ``article-header`` and ``share-results`` are none). Inline elements never end a block; what the standard leaves out of a line (buttons, say) isn't in it.

A common host is counted with partial sums, and its pages are never gathered. A host
has at most ``1 / SHARE`` times as many text templates as an average page has elements, and ``1 / SHAPE_SHARE`` times as many shapes.

Null html is empty; pages without url share the empty host. Unclosed and stray tags
are closed or skipped as browsers do; undecodable references stay as they are. White
space is Unicode's. Repeated rows are each a page. Pages are parsed whole, in time and memory linear in their
length, however long and however deep they nest. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import bound_batches, materialise, read
from skyloom.llm.url_filter import host_of

SHARE, SHAPE_SHARE, MIN_PAGES = 0.5, 0.01, 10
#: Hosts' templates are broadcast up to so many; beyond, pages and templates are shuffled by host.
BROADCAST_TEMPLATES = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside isn't markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content.
DROPPED = frozenset("head nav header footer aside form script style textarea title noscript template iframe button select menu dialog svg canvas object embed audio video xmp noembed noframes datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
#: Words for page furniture, in classes and ids.
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside header masthead footer comment comments respond disqus share sharing social newsletter subscribe subscription popup modal overlay related recommended widget form login signup search pagination pager skip toolbar".split()
)
#: Words that may stand beside them in a name without making it another thing.
BESIDE = frozenset("site page main global top bottom left right primary secondary box bar block list links link item items container wrapper wrap inner outer area section slot unit desktop mobile sticky fixed".split())
#: What opening one of these closes, if it is open, before anything else is opened.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Rules:
    """Tags and roles that are no content by the standard, and words that make a name furniture."""

    tags: frozenset[str] = DROPPED
    roles: frozenset[str] = DROPPED_ROLES
    names: frozenset[str] = NAMES


STANDARD = Rules()


def _is_furniture(name: str, names: frozenset[str]) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return not names.isdisjoint(words) and all(w in names or w in BESIDE for w in words)


def _said(tag: str, attributes: str, rules: Rules) -> tuple[bool, int]:
    """Whether the standard says that an element isn't content, and its shape hash (0: no name says that it may be furniture)."""
    names, role, no_content = [], "", tag in rules.tags
    if tag in ("html", "body"):
        return False, 0
    for name, *values in _ATTRIBUTES.findall(attributes):
        value, name = "".join(values).lower() if name.lower() not in ("class", "id") else "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            no_content = True
        elif name == "role":
            role = value
            no_content = no_content or role in rules.roles
        elif name in ("class", "id"):
            names += value.split()
    furniture = {n.lower() for n in names if _is_furniture(n, rules.names)} if tag in BLOCK else ()
    return no_content, _hash("shape", tag, role, *sorted(furniture)) if furniture else 0


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: No content by their tag, unless they hold it.
MAY_HOLD = ("form", "header")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Page:
    """Elements that end blocks, the root first and each after the one it's in: ``parents`` (their places), ``hashes`` and ``shapes`` (0: none). ``blocks``: all texts, each
    with its element's place, whether it's in an article (2), in main (1) or in neither (0), and whether it may be content by the standard; ``whole``: the
    hash of the content that tags alone leave."""

    parents: list[int]
    hashes: list[int]
    shapes: list[int]
    blocks: list[tuple[str, int, int, bool]]
    whole: int


class _Parser:
    """Open elements are on a stack: tag, place among the elements that end blocks (of the nearest one, for others), and whether the standard leaves it, as an inline one, out of its line."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.tags, self.at, self.silent, self.inline = [""], [0], [False], [False]
        self.open: dict[str, list[int]] = {}
        self.names, self.parents, self.hashes, self.shapes, self.off, self.inside = [""], [-1], [0], [0], [False], [[]]
        self.texts: list[tuple[str, int]] = []
        self.held: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            self.inside[self.at[-1]].append(text)
            self.texts.append((text, self.at[-1]))

    def push(self, tag: str, no_content: bool, shape: int) -> None:
        ends = tag in BLOCK
        self.open.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        if ends:
            # within an inline element that is no content, neither is this
            self.parents.append(self.at[-1]), self.hashes.append(0), self.shapes.append(shape), self.off.append(no_content or self.silent[-1]), self.names.append(tag), self.inside.append([])
        self.at.append(len(self.parents) - 1 if ends else self.at[-1])
        self.silent.append(not ends and (no_content or self.silent[-1]))
        self.inline.append(not ends)

    def pop(self) -> None:
        inline = self.inline.pop()
        if not inline:
            self.flush()
        tag, at = self.tags.pop(), self.at.pop()
        self.silent.pop()
        self.open[tag].pop()
        if not inline and self.inside[at]:
            self.hashes[at] = _hash(tag, *self.inside[at])
            self.inside[self.parents[at]].append(f"{self.hashes[at]:x}")
        if not inline:
            self.inside[at] = []

    def last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close_to(self, tags, barriers=()) -> None:
        """Close the last open element of ``tags``, unless a barrier was opened since."""
        place = self.last(tags)
        if place > self.last(barriers):
            while len(self.tags) > place:
                self.pop()

    def page(self) -> Page:
        """Elements come after those they're in: what they hold is added up from the last one, and what they're in goes down from the first."""
        n = len(self.parents)
        length, main, prose = [0] * n, [False] * n, [False] * n
        for text, at in self.texts:
            length[at] += len(text)
        for i in range(n - 1, 0, -1):
            if self.off[i] and self.names[i] not in MAY_HOLD:
                continue  # what it holds is no content either
            up = self.parents[i]
            length[up] += length[i]
            main[up] |= main[i] or self.names[i] in ("article", "main")
            prose[up] |= prose[i] or self.names[i] == "p" or self.names[i] in HEADINGS
        off, region, headed = [False] * n, [0] * n, [False] * n
        for i in range(1, n):
            up, tag = self.parents[i], self.names[i]
            own = self.off[i] and not (tag in MAY_HOLD and main[i] or tag == "form" and prose[i] and 2 * length[i] > length[0])
            if own and tag == "header" and not off[up] and region[up]:
                own, headed[i] = False, True  # of an article's header, headings are content
            headed[i] = headed[i] or headed[up]
            off[i] = off[up] or own
            region[i] = region[up] if off[i] else max(region[up], {"article": 2, "main": 1}.get(tag, 0))
        heading = [False] * n
        for i in range(1, n):
            heading[i] = heading[self.parents[i]] or self.names[i] in HEADINGS
        blocks = [(text, at, region[at], not off[at] and (not headed[at] or heading[at])) for text, at in self.texts]
        regions = max((region for _, _, region, content in blocks if content), default=0)
        return Page(self.parents, self.hashes, self.shapes, blocks, _hash(*[text for text, _, region, content in blocks if content and region == regions]))


def parse(page: str | None, rules: Rules = STANDARD) -> Page:
    page, p = page or "", _Parser(rules)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not p.silent[-1] and (m.start() if m else n) > at:
            p.held.append(html.unescape(page[at : m.start() if m else n]))
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                p.flush()
            else:
                p.close_to((tag,))
            continue
        if tag in BLOCK:
            p.flush()
            if tag != "br":
                p.close_to(("p",), ("td", "th", "table", "button", "object"))
        if tag in CLOSES:
            tags, barriers = CLOSES[tag]
            p.close_to(tags.split(), barriers)
            if tag == "tr":
                p.close_to(("tr",), ("table",))
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            over = _ends(tag).search(page, at)
            at = over.end() if over else n
            continue
        p.push(tag, *_said(tag, attributes, rules))
    while len(p.tags) > 1:
        p.pop()
    p.flush()
    return p.page()


@functools.cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def left(parents, hashes, shapes, blocks, templates) -> list[str]:
    """The texts of a page's blocks without templates, in the innermost region that has any."""
    gone = [False] * len(parents)
    for i, up in enumerate(parents):
        gone[i] = i > 0 and gone[up] or hashes[i] in templates or shapes[i] in templates
    kept = [(text, region) for text, at, region, content in blocks if content and not gone[at]]
    inner = max((region for _, region in kept), default=0)
    return [text for text, region in kept if region == inner]


BLOCKS = "array<struct<text:string,at:int,region:int,content:boolean>>"


def blocks_of(pages: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """``page_id, url, host, whole, parents, hashes, shapes, blocks`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("region", pa.int32()), ("content", pa.bool_())]))
        for batch in batches:
            parsed = [parse(page, rules) for page in batch.column(3).to_pylist()]
            columns = {"whole": pa.array([p.whole for p in parsed], pa.int64())}
            columns |= {c: pa.array([getattr(p, c) for p in parsed], pa.list_(k)) for c, k in (("parents", pa.int32()), ("hashes", pa.int64()), ("shapes", pa.int64()))}
            columns["blocks"] = pa.array([[dict(zip(("text", "at", "region", "content"), b)) for b in p.blocks] for p in parsed], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns.values()], names=["page_id", "url", "host", *columns])

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    bound_batches(pages.sparkSession)
    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, whole long, parents array<int>, hashes array<long>, shapes array<long>, blocks {BLOCKS}")


def templates_of(blocks: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, shape_share: float = SHAPE_SHARE) -> DataFrame:
    """``host, subtree``: subtrees on at least ``share`` of a host's different pages, and shapes on ``shape_share``, both on ``min_pages`` at least. Shapes of
    hosts that have fewer pages are counted together and have no host."""
    # of pages with one content, always the same one counts
    once = lambda c: F.array_remove(F.array_distinct(c), F.lit(0).cast("long"))
    one = F.min(F.struct(F.xxhash64("hashes", "shapes"), "hashes", "shapes")).alias("one")
    different = blocks.groupBy("host", "whole").agg(one).select("host", once(F.col("one.hashes")).alias("hashes"), once(F.col("one.shapes")).alias("shapes"))
    sizes = materialise(different.groupBy("host").agg(F.count("*").alias("pages")))
    small = F.col("pages") < min_pages
    marked = lambda hashes, named: F.transform(hashes, lambda h: F.struct(h.alias("subtree"), F.lit(named).alias("named")))
    every = different.select("host", F.inline(F.concat(marked(F.col("hashes"), False), marked(F.col("shapes"), True))))
    counts = every.groupBy("host", "subtree", "named").agg(F.count("*").alias("held")).where(F.col("named") | (F.col("held") >= min_pages))
    counts = counts.join(sizes, "host")
    together = sizes.where(small).agg(F.sum("pages")).first()[0] or 0
    own = counts.where(~small & (F.col("held") >= min_pages) & (F.col("held") >= F.when(F.col("named"), shape_share).otherwise(share) * F.col("pages")))
    pooled = counts.where(small & F.col("named")).groupBy("subtree").agg(F.sum("held").alias("held")).where(F.col("held") >= max(min_pages, shape_share * together))
    return own.select("host", "subtree").unionByName(pooled.select(F.lit(None).cast("string").alias("host"), "subtree"))


def extract(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, rules: Rules = STANDARD, templates: DataFrame | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; ``templates`` are those of ``templates_of`` if they aren't given."""
    blocks = materialise(blocks_of(pages, rules))
    templates = materialise(templates_of(blocks, share, min_pages) if templates is None else templates)
    # at most 1 / SHAPE_SHARE times as many as a page has
    pooled = frozenset(r[0] for r in templates.where("host is null").select("subtree").distinct().collect())
    whole = blocks.groupBy("host", "whole").count().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).select("host")
    by_host = materialise(whole.join(templates.groupBy("host").agg(F.collect_list("subtree").alias("templates")), "host", "left").select("host", F.coalesce("templates", F.array().cast("array<long>")).alias("templates")))
    if (by_host.agg(F.sum(F.size("templates") + 1)).first()[0] or 0) <= BROADCAST_TEMPLATES:
        by_host = F.broadcast(by_host)
    rows = blocks.select("page_id", "url", "host", "parents", "hashes", "shapes", "blocks").join(by_host, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for parents, hashes, shapes, own, known in zip(*[batch.column(c).to_pylist() for c in ("parents", "hashes", "shapes", "blocks", "templates")]):
                texts.append("\n".join(left(parents, hashes, shapes, [tuple(b.values()) for b in own], pooled if known is None else set(known))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
