"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree of style nodes (path of tags with classes from the root).
A text block's node is important as far as its content differs over the host's distinct pages (the
entropy of its values by the logarithm of their number), an inner node by the weighted importance of
the blocks below and the entropy of its presentations (sequences of child tags). Branches that are,
with all blocks in them, below a threshold are removed from each page, in article elements too, and so
are elements whose tag, role or class says that they are no article text. On a page with an article element
a block outside it stays where the tree has seen enough of its node to know it as important.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Importance below which a branch is noise; values that a node must have shown; share of the presentation in an inner node's importance.
THRESHOLD, LEAST_SEEN, PRESENTATION = 0.65, 8, 0.1
#: Elements nested deeper belong to the style node of their ancestor at this depth; their text stays their own.
DEPTH = 128
#: Node ids, over all hosts, that are broadcast; beyond that tasks a host's pages are dealt to.
BROADCAST_NODES, SALTS = 1_000_000, 32
#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SKIP = frozenset("head script style title noscript template iframe svg textarea select option button form nav footer aside menu dialog object canvas".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NOISE_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus replies pagination pager widget".split()
)
#: Of names in parts, such as cookie-banner: those that say it in any of the first or last part, and first parts that only qualify.
NOISE_PARTS = frozenset("ad ads advert adverts breadcrumb breadcrumbs comment comments cookie cookies footer menu nav navbar newsletter sidebar".split())
QUALIFIERS = frozenset("has no not with without is in".split())
#: Elements that are never noise by their name.
FRAMES = frozenset("html body main article".split())
# A quote counts right after = only.
_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _key(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def named_noise(name: str) -> bool:
    """Whether a class or id says that its element is no article text: a word of NOISE_CLASSES, or a name that begins or ends with one."""
    parts = re.split(r"[_\-]+", name)
    return name in NOISE_CLASSES or (len(parts) > 1 and parts[0] not in QUALIFIERS and (parts[0] in NOISE_PARTS or parts[-1] in NOISE_CLASSES))


class _Node:
    """key: of the path from the root, made from the parent's key and the name; style: itself, or its ancestor at DEPTH;
    gone: whether it or an element around it was removed, if known."""

    __slots__ = ("article", "children", "depth", "gone", "hash", "noise", "style", "tag", "up")

    def __init__(self, tag: str, name: str, up: _Node | None, noise: bool, article: bool) -> None:
        self.tag, self.up, self.noise, self.article = tag, up, noise, article
        self.depth = up.depth + 1 if up else 0
        self.style = up.style if up and self.depth > DEPTH else self
        self.hash = 0 if not up else up.hash if self.depth > DEPTH else xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed=up.hash)
        self.children: list[str] = []
        self.gone: bool | None = None

    @property
    def key(self) -> int:
        return _signed(self.hash)

    def removed(self, noise: set[int]) -> bool:
        """Whether this or an element around it is among the noise."""
        way, node = [], self
        while node.up and node.gone is None:
            way.append(node)
            node = node.up
        gone = bool(node.gone)
        for node in reversed(way):
            gone = node.gone = gone or node.key in noise
        return gone


class Page:
    """blocks: (style node, text) in page order; nodes: all non-inline elements."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[_Node, str]] = []
        self.nodes: list[_Node] = []
        self.here = _Node("", "", None, False, False)
        self.open: list[tuple[str, _Node]] = [("", self.here)]
        self.count: Counter = Counter()
        self.parts: list[str] = []
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            self.start(tag, m[3] or "")
            if tag in _END_RAW and not (m[3] or "").endswith("/"):
                end = _END_RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                self.close(tag)
        if at < len(source):
            self.text(source[at:])
        self.flush()

    def text(self, piece: str) -> None:
        self.parts.append(entities.unescape(piece) if "&" in piece else piece)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.here, text))
            self.parts = []

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag not in VOID:
                self.open.append((tag, self.here))
                self.count[tag] += 1
            return
        if tag == "br":
            self.parts.append("\n")
            return
        self.flush()
        if tag in CLOSES_P:
            self.close("p", until=("article", "div", "section", "td", "li", "blockquote", "button"))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close(tag, until=("ul", "ol", "dl", "table", "select", "article"))
        if tag in VOID:
            return
        names, own, role = [], [], ""
        for m in _ATTR.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "role":
                role = value
            else:
                names += value.split()
                own += value.split() if kind == "class" else [re.sub(r"\d+", "0", value)]  # ids count pages and posts
        up = self.here
        noise = up.noise or tag in SKIP or role in NOISE_ROLES or (tag not in FRAMES and any(map(named_noise, names))) or (tag == "header" and not up.article)
        label = tag + "".join(f".{n}" for n in sorted(own))
        up.children.append(label)
        self.here = _Node(tag, label, up, noise, up.article or ((tag in ("article", "main") or role == "main") and not noise))
        self.nodes.append(self.here)
        self.open.append((tag, self.here))
        self.count[tag] += 1

    def close(self, tag: str, until: tuple[str, ...] = ()) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            name, node = self.open[i]
            if name == tag:
                if tag not in INLINE:
                    self.flush()
                    self.here = node.up
                for t, _ in self.open[i:]:
                    self.count[t] -= 1
                del self.open[i:]
                return
            if name in until or (tag in INLINE and name not in INLINE):  # an inline end tag closes no block
                return


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: host, a hash of the page, content values (node, ancestors, value) and presentations (node, value)."""
    content = pa.list_(pa.struct([("node", pa.int64()), ("above", pa.list_(pa.int64())), ("value", pa.int64()), ("loose", pa.bool_())]))
    shown = pa.list_(pa.struct([("node", pa.int64()), ("value", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            urls, sources = (batch.column(i).slice(at, 500).to_pylist() for i in (0, 1))
            rows: list[list] = [[], [], [], []]
            for url, source in zip(urls, sources):
                page, values = Page(source or ""), []
                some = any(n.article and not n.noise for n, _ in page.blocks)
                for node, text in page.blocks:
                    if not node.noise:
                        above, up = [], node.style
                        while up.up:
                            above.append(up.key)
                            up = up.up
                        values.append({"node": node.key, "above": above, "value": _key(text), "loose": some and not node.article})
                rows[0].append(host_of(url))
                rows[1].append(_key(source or ""))
                rows[2].append(values)
                rows[3].append([{"node": n.key, "value": _key(" ".join(n.children))} for n in page.nodes if not n.noise and n.depth <= DEPTH])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], content), pa.array(rows[3], shown)], ["host", "page", "content", "shown"])


def noise_nodes(pages: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_SEEN) -> DataFrame:
    """(host, noise, important): the style nodes of each host that are below the threshold, and those above it that have blocks outside a page's article elements, over its distinct pages."""
    parsed = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        _stats, "host string, page long, content array<struct<node:long,above:array<long>,value:long,loose:boolean>>, shown array<struct<node:long,value:long>>"
    )
    distinct = parsed.groupBy("host", "page").agg(F.first("content").alias("content"), F.first("shown").alias("shown"))
    pairs = distinct.select("host", F.explode(F.concat(
        F.transform("content", lambda x: F.struct(F.lit(0).alias("kind"), x["node"].alias("node"), x["value"].alias("value"), x["above"].alias("above"), x["loose"].alias("loose"))),
        F.transform("shown", lambda x: F.struct(F.lit(1).alias("kind"), x["node"].alias("node"), x["value"].alias("value"), F.lit(None).cast("array<bigint>").alias("above"), F.lit(False).alias("loose"))),
    )).alias("x")).select("host", "x.*")
    counts = pairs.groupBy("host", "kind", "node", "value").agg(F.count("*").cast("double").alias("n"), F.first("above").alias("above"), F.max("loose").alias("loose"))
    sums = counts.groupBy("host", "kind", "node").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.first("above").alias("above"), F.max("loose").alias("loose"))
    share = (F.log("seen") - F.col("nlogn") / F.col("seen")) / F.log("seen")
    sums = sums.withColumn("importance", F.when(F.col("seen") > 1, share).otherwise(1.0))
    both = sums.select("host", "kind", "seen", "importance", F.when(F.col("loose"), F.col("node")).alias("own"), F.explode(F.when(F.col("kind") == 0, F.col("above")).otherwise(F.array("node"))).alias("node"))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c))
    nodes = both.groupBy("host", "node").agg(of(0, F.col("seen")).alias("seen"), of(0, F.col("seen") * F.col("importance")).alias("sum"), F.max(F.when(F.col("kind") == 0, F.col("importance"))).alias("most"), of(1, F.col("importance")).alias("shown"), F.max(F.col("own").eqNullSafe(F.col("node"))).alias("loose"))
    whole = (1 - PRESENTATION) * F.col("sum") / F.col("seen") + PRESENTATION * F.coalesce("shown", F.lit(0.0))
    low = (whole < threshold) & ((1 - PRESENTATION) * F.col("most") < threshold)
    judged = nodes.where(F.col("seen") >= least).select("host", "node", low.alias("low"), (F.col("loose") & (whole >= threshold)).alias("high"))
    return judged.groupBy("host").agg(F.collect_list(F.when(F.col("low"), F.col("node"))).alias("noise"), F.collect_list(F.when(F.col("high"), F.col("node"))).alias("important"))


def main_text(source: str | None, noise: set[int], important: set[int] = frozenset()) -> str:
    """Article text of a page: its blocks but noise, in page order, joined by one space; of a page with an
    article element, the blocks outside it only where they are important."""
    page = Page(source or "")
    blocks = [(n, t) for n, t in page.blocks if not n.noise]
    if any(n.article for n, _ in blocks):
        blocks = [(n, t) for n, t in blocks if n.article or n.key in important]
    return " ".join(t for n, t in blocks if not n.removed(noise))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(s, set(n or ()), set(i or ())) for s, n, i in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of pages.

    Null html is empty: empty text. A null or odd url belongs to the host "". Repeated rows keep their
    rows and count once in the tree; other columns are ignored; an empty table gives an empty result.
    """
    noise = stash(noise_nodes(pages), "html-noise")
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    nodes = noise.agg(F.sum(F.size("noise") + F.size("important") + 1)).first()[0] or 0
    if nodes <= BROADCAST_NODES:
        both = rows.join(F.broadcast(noise), "host", "left")
    else:  # a host's pages are dealt to SALTS tasks, each with a copy of its nodes
        salted = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "noise", "important").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Whole pages table."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
