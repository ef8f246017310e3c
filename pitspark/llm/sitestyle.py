"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged by path (tag and class from the root down). A path's importance has two parts.
Presentation: how much the pages differ in the child sequence below it (entropy over styles). Content: how little its
text repeats (one minus the mean entropy of its texts over the host's pages; a text on one page alone counts 1, one on
all pages 0). Both are counted relationally per host and path, pre-aggregated, so a host of any size is spread over
tasks. Branches of low importance are removed from each page, as are branches whose element or name says that they are
no article text (their prior importance is 0); what is left of the article is put out block by block.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is passed over: plain text up to the next end tag, and elements that may hold others of their kind.
RAW_TEXT = frozenset("script style textarea title iframe xmp noframes".split())
RAW_NESTED = frozenset("noscript template svg math canvas object".split())
RAW = RAW_TEXT | RAW_NESTED
NOISE = frozenset("nav footer aside form header menu dialog button select fieldset head".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that carry text themselves; low importance removes containers, never a paragraph for being repeated.
CONTENT = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Names in class, id or role that mark what is no article text.
NOISE_NAMES = re.compile(
    r"^(ad|ads|advert.*|adbox|adslot|banner|sponsor.*|promo.*|menu.*|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|site-?header|masthead|header|"
    r"comments?|comment-.*|respond|replies|cookies?|cookie-.*|consent|notice|notices|gdpr|newsletter|subscribe|share|sharing|social|related|widget|popup|modal|"
    r"disclaimer|copyright|legal|complementary|contentinfo|search)$")
TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
RAW_TAG = re.compile(r"<!--|<(/?)(" + "|".join(sorted(RAW)) + r")(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


class RawEnds:
    """Where the content of a page's RAW elements ends; every part of the page is searched once, however many there are."""

    def __init__(self, page: str):
        self.page, self.next, self.spans = page, {}, None

    def text_end(self, tag: str, at: int, attrs: str) -> int:
        """Behind the next end tag. Without one the rest of the page is content, but a self-closed element and a frame are empty."""
        if tag not in self.next or self.next[tag] is not None and self.next[tag].start() < at:
            self.next[tag] = RAW_END[tag].search(self.page, at)
        if self.next[tag] is None:
            return at if tag == "iframe" or attrs.endswith("/") else len(self.page)
        return self.page.find(">", self.next[tag].end()) + 1 or len(self.page)

    def after(self, tag: str, start: int, at: int, attrs: str) -> int:
        """Position behind the element whose start tag runs from ``start`` to ``at``; one that is never closed is empty."""
        if tag in RAW_TEXT:
            return self.text_end(tag, at, attrs)
        if self.spans is None:
            self.spans = self.nested()
        return self.spans.get(start, at)

    def nested(self) -> dict[int, int]:
        """Start of each closed RAW_NESTED element to the position behind its end tag."""
        page, at, found = self.page, 0, {}
        opened: dict[str, list[int]] = {tag: [] for tag in RAW_NESTED}
        self.next = {}
        while m := RAW_TAG.search(page, at):
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                close = page.find("-->", at)
                at = close + 3 if close >= 0 else len(page)
            elif tag in RAW_TEXT:
                at = at if m[1] else self.text_end(tag, at, m[3])
            elif m[1]:
                if opened[tag]:
                    found[opened[tag].pop()] = at
            elif not (tag in ("svg", "math") and m[3].endswith("/")):
                opened[tag].append(m.start())
        self.next = {}
        return found


def blocks(page: str | None) -> tuple[list[tuple[str, str, bool, bool]], list[tuple[str, str]]]:
    """The page's text blocks ``(path, text, in noise, in article)`` in order, and ``(path, child sequence)`` of its elements.

    Missing end tags are supplied: a block element closes an open paragraph, an end tag closes what is open inside it,
    and an end tag without a start is passed over. Text of script, style and similar elements is left out; nothing in them
    counts as a tag or comment of the page. A svg, math, canvas, object, template, noscript or iframe that is never closed is
    empty; an unclosed script, style, title or textarea takes the rest of the page, as in browsers.
    """
    found: list[tuple[str, str, bool, bool]] = []
    styles: list[tuple[str, str]] = []
    stack: list[list] = [["", "", False, False, []]]  # tag, path, noise, article, children
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                holder = next(x for x in reversed(stack) if x[0] not in INLINE)
                found.append((holder[1], whole, stack[-1][2], holder[3]))

    def close() -> None:
        tag, path, _, _, children = stack.pop()
        if tag not in INLINE:
            styles.append((path, " ".join(c for i, c in enumerate(children) if not i or c != children[i - 1])))

    at, page = 0, page or ""
    raw_ends = RawEnds(page)
    while m := TAG.search(page, at):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(x[0] == tag for x in stack):
                if tag not in INLINE:
                    flush()
                while True:
                    last = stack[-1][0]
                    close()
                    if last == tag:
                        break
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and any(x[0] == "p" for x in stack):
            while True:
                last = stack[-1][0]
                close()
                if last == "p":
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            for x in reversed(stack):
                if x[0] in ("ul", "ol", "dl", "table", "select", ""):
                    break
                if x[0] in peers:
                    while stack[-1] is not x:
                        close()
                    close()
                    break
        parent = stack[-1]
        attrs = m[3]
        noisy, label = parent[2], tag
        if "=" in attrs:
            for a in NAMES.finditer(attrs):
                noisy = noisy or any(NOISE_NAMES.match(n) for n in (a[1] or a[2] or a[3] or "").lower().split())
            c = CLASS.search(attrs)
            if c and tag not in INLINE:
                label += "." + ".".join((c[1] or c[2] or c[3] or "").lower().split())
        if tag not in INLINE:
            parent[4].append(label)
        if tag in VOID or attrs.endswith("/") and (tag not in RAW or tag in ("svg", "math")):
            continue
        if tag in RAW:
            at = raw_ends.after(tag, m.start(), at, attrs)
            continue
        noisy = noisy or tag in NOISE
        article = parent[3] or (tag in ("article", "main") and not noisy)
        stack.append([tag, parent[1] if tag in INLINE else f"{parent[1]}/{label}", noisy, article, []])
    text.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    return found, styles


def main_text(page: str | None, removed: frozenset[str]) -> str:
    """The page's article without noise and without the branches whose paths are given; all that is left where no article is marked."""
    kept = [b for b in blocks(page)[0] if not b[2]]
    if removed:
        def gone(path: str) -> bool:
            while path:
                above, _, label = path.rpartition("/")
                if path in removed and label.partition(".")[0] not in CONTENT:
                    return True
                path = above
            return False
        kept = [b for b in kept if not gone(b[0])]
    if any(b[3] for b in kept):
        kept = [b for b in kept if b[3]]
    return "\n".join(b[1] for b in kept)


def host(url: Column) -> Column:
    """Host of an address, lower case, without user and port; a null or other text is the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame, damping: float = 0.9, evidence: int = 8) -> DataFrame:
    """Merged paths of every host: ``host, path, pages, style, content, importance``.

    ``style`` is the entropy of child sequences over the path's pages, ``content`` one minus the mean entropy of its
    texts, both with the number of the path's pages as base (1 where a single page has it); for content ``evidence``
    pages are added to that number, so that a few equal pages prove nothing. A branch's content is the mean over all
    texts in it. importance = (1 - damping^l) * style + damping^l * content, l being the number of styles.
    """
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple] = []
            for page, site, text in zip(part["page"], part["host"], part["html"]):
                found, styles = blocks(text)
                for path, sequence in dict(styles).items():
                    out.append((site, path, 0, sequence, page))
                for path, content, noisy, _ in found:
                    if not noisy:
                        out.append((site, path, 1, content, page))
            yield pd.DataFrame(out, columns=["host", "path", "kind", "value", "page"])

    raw = pages.select(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("page"), host(F.col("url")).alias("host"), F.col("html"))
    nodes = raw.mapInPandas(emit, "host string, path string, kind int, value string, page long").withColumn("value", F.xxhash64("value"))
    values = stored(nodes.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c")), "site-values")
    # texts count for every branch above them
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    texts = values.where("kind = 1").withColumn("path", F.explode(above)).groupBy("host", "path", "value").agg(F.sum("c").alias("c"))
    styles = values.where("kind = 0").groupBy("host", "path").agg(F.sum("c").alias("pages"), F.count(F.lit(1)).alias("styles"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    log_m = F.log(F.col("pages").cast("double"))
    styles = styles.withColumn("style", F.when(F.col("pages") > 1, (log_m - F.col("clogc") / F.col("pages")) / log_m).otherwise(1.0))
    # a text on c of m pages has entropy log c / log m
    means = texts.groupBy("host", "path").agg(F.avg(F.log("c")).alias("logc"))
    tree = styles.join(means, ["host", "path"])
    content = F.when(F.col("pages") > 1, 1 - F.col("logc") / F.log(F.col("pages") + evidence)).otherwise(1.0)
    weight = F.pow(F.lit(damping), F.col("styles"))
    return tree.select("host", "path", "pages", "style", content.alias("content"), ((1 - weight) * F.col("style") + weight * content).alias("importance"))


def extract(pages: DataFrame, least: float = 0.2, damping: float = 0.9) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Containers whose importance on their host is under ``least`` are removed. A
    null html gives the empty text, as does a page without text; pages without an address share the empty host.
    Repeated rows are separate results; other columns are ignored; an empty table gives no rows.
    """
    slim = bounded_batches(pages).select("page_id", "url", "html")
    low = style_tree(slim, damping).where(F.col("importance") < least)
    low = low.groupBy("host").agg(F.collect_set("path").alias("removed"))
    low = stored(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), "site-removed")
    salted = slim.withColumn("_host", host(F.col("url"))).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(32)).cast("int"))
    with_low = salted.join(low, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")), "left")

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(r) if r is not None else frozenset()) for h, r in zip(htmls, removed)], dtype=object)

    return with_low.select("page_id", "url", text_of("html", "removed").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
