"""Main text of web pages by a site style tree.

Each page is parsed into content blocks; a block's style path is the chain of
its elements (tag, id and class).  The pages of a host are merged: for every
style path the tree holds the number of pages with it and, below it, how many
pages repeat each content.  The importance of a content node is
``1 - log_m(n)`` for a content found on ``n`` of the ``m`` pages that have
the path (0: every page repeats it, 1: no other page has it), a presentation
node's importance is the entropy (base m) of what the pages show there, and a
branch of a page scores the mean over its blocks, weighted by length.  A
branch that scores low is removed from the page, and so is a block that is low
by itself.

Few pages of a host say little about what repeats, so markup counts too:
elements and names that mean navigation, adverts, forms and the like are
removed.  The tree decides for all other blocks of every page; what stands in
an article (or main) element has ``MAIN_PRIOR`` added to its importance, so it
stays unless much of the host repeats it.

The tree is an aggregate over (host, path, content), not one object per host:
a host with a third of all pages is counted in parts like any other, and no
task holds a host.

Defined cases: null or empty html has an empty text; a null url is a host of
its own; malformed and cut pages are read to their end; repeated rows each
get their row; pages of a host that show the same blocks count once in the
tree; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small

MIN_IMPORTANCE = 0.35    # branches below are removed
MIN_PAGES = 3            # a path on fewer pages of the host is judged by markup alone
MAIN_PRIOR = 0.2         # added to the importance of what stands in an article (or main) element

# fixed values: element kinds
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var"}
NOISE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "iframe", "svg", "button", "select", "textarea",
         "template", "dialog", "menu", "object", "canvas", "audio", "video", "head", "title", "option", "fieldset"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
            "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "main", "body"}
NOISE_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|banner|"
    r"side-?bar|nav(?:igation|bar)?|menus?|breadcrumbs?|comments?(?:-?list)?|disqus|respond|repl(?:y|ies)|share|sharing|social|"
    r"related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|sign-?up|login|footer|masthead|site-?header|"
    r"page-?header|pop-?up|modal|overlay|skip-?link|pagination|pager|widget|toolbar|alert)(?:$|[-_ 0-9])", re.I)
#: names of wrappers that say what the page around them has or lacks
WRAPPER_NAME = re.compile(r"(?:has|no|with|without)[-_]", re.I)
NOISE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
RAW = re.compile(r"</(script|style|textarea|title|noscript|iframe|template)\s*>", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "style", "noise", "main", "inline", "named")

    def __init__(self, tag, style, noise, main, inline, named):
        self.tag, self.style, self.noise, self.main, self.inline, self.named = tag, style, noise, main, inline, named


def blocks(html: str) -> list[tuple[str, bool, bool, str]]:
    """``(style path, noise by markup, inside article, text)`` in page order.

    Noise is what stands under an element, name or role that is never main
    text; a ``header`` is noise unless it is part of an article.  An element
    that is noise by its name only, but holds the page's first article, is
    none.
    """
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[_Node] = []
    parts: list[str] = []

    def flush():
        if parts:
            text = _SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                chain = [n for n in stack if not n.inline]
                out.append((">".join(n.style for n in chain), any(n.noise for n in stack), any(n.main for n in stack), text))

    def pop_to(index):
        flush()
        del stack[index:]

    pos, end, seen_main = 0, len(html), False
    while pos < end:
        m = _TAG.search(html, pos)
        if m is None:
            parts.append(html[pos:])
            break
        if m.start() > pos:
            parts.append(html[pos:m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                parts.append(htmllib.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                parts.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    if all(n.inline for n in stack[k:]) and not stack[k].noise:
                        del stack[k]
                    else:
                        pop_to(k)
                    break
                if stack[k].tag in ("article", "main") and tag not in ("body", "html", "article", "main"):
                    break
            continue
        attrs = {a.group(1).lower(): (a.group(2) or a.group(3) or a.group(4) or "") for a in _ATTR.finditer(m.group(3) or "")}
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        names = " ".join((attrs.get("class", ""), attrs.get("id", ""))).strip()
        noise = (tag in NOISE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                 or attrs.get("role", "").lower() in NOISE_ROLE
                 or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)))
        named = (not noise and tag not in ("article", "main", "body", "html") and bool(names)
                 and any(NOISE_NAME.search(x) and not WRAPPER_NAME.match(x) for x in names.split()))
        noise = noise or named
        in_main = any(n.main for n in stack)
        if tag == "header" and not in_main:
            noise = True
        main = tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody"
        inline = tag in INLINE and not noise
        if not inline:
            flush()
        if main and not seen_main:
            seen_main = not any(n.noise and not n.named for n in stack)
            for n in stack:
                n.noise = n.noise and not n.named
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if not stack[k].inline:
                        break
            if tag in CLOSES_SELF:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in CLOSES_SELF[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPE:
                        break
        if m.group(3) and m.group(3).rstrip().endswith("/") and tag not in NOISE and not inline:
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = close.end() if close else end
            continue
        stack.append(_Node(tag, f"{tag}.{'.'.join(sorted(names.split()))}" if names else tag, noise, main, inline, named))
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return (m.group(1).rpartition("@")[2].partition(":")[0].lower() if m else "")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


LIGHT = ("host string, page long, "
         "blocks array<struct<pos:int,path:long,content:long,size:int,main:boolean,new:boolean,first:boolean>>")
_BLOCK = pa.list_(pa.struct([("pos", pa.int32()), ("path", pa.int64()), ("content", pa.int64()), ("size", pa.int32()), ("main", pa.bool_()),
                             ("new", pa.bool_()), ("first", pa.bool_())]))
TEXTS = "page_id long, url string, host string, page long, texts binary"


def _page(html: str | None):
    """The blocks that markup doesn't call noise, as ``(path, content, inside
    article, text)``, and a number of their list."""
    rows = [(_digest(p), _digest(t), m, t) for p, n, m, t in blocks(html or "") if not n]
    return rows, _digest(repr([r[:3] for r in rows]))


def _light(it):
    """Distinct pages of a slice, without texts; ``new`` and ``first`` mark
    the first block of the page with its path and content, and with its path."""
    for batch in it:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            out = {}
            for url, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                rows, page = _page(h)
                if not rows or (host_of(url), page) in out:
                    continue
                both, paths, light = set(), set(), []
                for pos, (p, c, m, t) in enumerate(rows):
                    light.append({"pos": pos, "path": p, "content": c, "size": len(t), "main": m, "new": (p, c) not in both, "first": p not in paths})
                    both.add((p, c))
                    paths.add(p)
                out[host_of(url), page] = light
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in out], pa.string()), pa.array([p for _, p in out], pa.int64()), pa.array(list(out.values()), _BLOCK)],
                names=["host", "page", "blocks"])


def _texts(it):
    """The pages' block texts, packed: they cross the shuffle."""
    for batch in it:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            pages = [_page(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([host_of(u) for u in part.column(1).to_pylist()], pa.string()),
                 pa.array([page for _, page in pages], pa.int64()), pa.array([pack([r[3] for r in rows]) for rows, _ in pages], pa.binary())],
                names=["page_id", "url", "host", "page", "texts"])


def pack(texts: list[str]) -> bytes:
    """Block texts as compressed bytes; white space in a block is one space,
    so none has a line feed."""
    return zlib.compress("\n".join(texts).encode("utf-8"), 1)


def _joined(it):
    """Texts of the blocks that stay."""
    for batch in it:
        texts = []
        for packed, kept in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            blocks_ = zlib.decompress(packed).decode("utf-8").split("\n") if kept else []
            texts.append("\n\n".join(blocks_[k] for k in kept or []))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def style_tree(seen: DataFrame) -> DataFrame:
    """``host, path, content, m, node, leaf`` of the blocks ``seen`` on
    distinct pages: pages with the path, the path's own importance and that
    of the content."""
    per = (seen.groupBy("host", "path", "content")
           .agg(F.sum(F.col("new").cast("long")).alias("n"), F.sum(F.col("first").cast("long")).alias("k")))
    ln = lambda c: F.log(c.cast("double"))
    m, base = F.col("m"), ln(F.greatest(F.col("m"), F.lit(2)))
    node = (per.groupBy("host", "path").agg(F.sum("k").alias("m"), F.sum("n").alias("s"), F.sum(F.col("n") * ln(F.col("n"))).alias("e"))
            .select("host", "path", "m", F.least((F.col("s") * ln(m) - F.col("e")) / (m * base), F.lit(1.0)).alias("node")))
    # a row per host and path: a host with a third of all contents is not dealt to one task
    node = small(cut_lineage(node))
    return (per.join(node, ["host", "path"])
            .select("host", "path", "content", "m", "node",
                    F.when(m >= MIN_PAGES, 1 - ln(F.col("n")) / base).otherwise(1.0).alias("leaf")))


def verdicts(light: DataFrame) -> DataFrame:
    """``host, page, kept``: the places of the blocks that stay, in order."""
    seen = light.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.*")
    judged = (seen.join(style_tree(seen), ["host", "path", "content"])
              .withColumn("prior", F.when(F.col("main"), MAIN_PRIOR).otherwise(0.0)))
    # one exchange deals the pages out for both levels
    branch = (judged.repartition("host", "page").groupBy("host", "page", "path")
              .agg((F.sum(F.col("leaf") * F.col("size")) / F.sum("size")).alias("score"),
                   F.first("node").alias("node"), F.first("m").alias("m"), F.max("prior").alias("prior"),
                   F.collect_list(F.struct("pos", (F.col("leaf") + F.col("prior")).alias("own"))).alias("parts")))
    importance = F.when(F.col("m") >= MIN_PAGES, (F.col("score") + F.least(F.col("node"), F.col("score"))) / 2).otherwise(1.0)
    return (branch.filter(importance + F.col("prior") >= MIN_IMPORTANCE)
            .select("host", "page", F.explode(F.filter("parts", lambda t: t["own"] >= MIN_IMPORTANCE)).alias("t"))
            .groupBy("host", "page").agg(F.array_sort(F.collect_list("t.pos")).alias("kept")))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    # pages are read twice, so that what is kept and dealt out for the tree has no texts
    light = cut_lineage(src.mapInArrow(_light, LIGHT).dropDuplicates(["host", "page"]))
    both = src.mapInArrow(_texts, TEXTS).join(verdicts(light), ["host", "page"], "left")
    return (both.select("page_id", "url", "texts", "kept").mapInArrow(_joined, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
