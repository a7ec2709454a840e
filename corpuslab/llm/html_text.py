"""Main text of web pages, with the template of each site removed.

Each page is parsed in a Spark task.  A first pass hashes element subtrees that
could be template; Spark counts for every host in how many different articles each
subtree occurs.  A subtree is template where it is found in `min_pages` different
articles of its host at least, a number that grows with the logarithm of the number of the
host's articles only; a block of content inside an article (a paragraph, a list
item) where in `content_share` of all of them, ten at least.  The second pass leaves
out template subtrees and whatever its tag, role or class says is navigation,
notice, advert, form, comment or markup, and returns the remaining blocks.

Articles that begin with the same block count once, so copies and revisions of an
article are not taken for template (pages without an article element: those with the
same text).  An element that is an article, or holds the
only one of its page, is never left out for its class.

Null html is an empty page with empty text; pages without a host (null or odd
url) have no template; repeated rows and null ids pass through; an empty table
gives an empty result; other columns are ignored, whatever their names.  Broken
markup never fails: what cannot be read as a tag is text.  The time of a page is
linear in its length, whatever it holds.

Up to `BROADCAST_ROWS` template subtrees go to all tasks as hashes; beyond, the
subtrees of pages are joined with them in Spark, with the same result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import wordhash as W
from corpuslab.llm.batches import bound, written

MIN_PAGES, CONTENT_SHARE, BROADCAST_ROWS = 3, 0.5, 2_000_000

# Tags by role.
_RAW = frozenset("script style textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head script style title noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video dialog menu label fieldset xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head title".split())
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody thead caption figcaption".split())
_MAIN = ("article", "main")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
# Words of class names that mark what is not content, wherever they stand in a name or only by themselves and with words of layout.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr popup modal "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead comments disqus newsletter toolbar "
    "adsbygoogle werbung anzeige anzeigen publicidad anuncio anuncios publicite".split()
)
_WEAK = frozenset("notice notices alert side header comment replies respond responses share sharing social related recommended subscribe signup login widget widgets skip".split())
_LAYOUT = frozenset("area articles bar block box buttons button container content form icons inner items link links list panel posts section site top bottom page site wrap wrapper main global left right".split())
#: Further words of layout; and ids that a section or a heading of an article bears for what they are, not for its title.
_PLACES = _LAYOUT | frozenset("article blog entry inline page post slot thread unit zone placement".split())
_OWN_IDS = frozenset("comments respond responses disqus_thread".split())
_TITLED = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre blockquote figure".split())
_STATES = frozenset("has no with without is open closed enabled disabled hide show".split())

_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of a tag, each character looked at once.
_ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_PART = re.compile(r"[-_]+")
_ATTR = re.compile(r"(?<![\w-])(?P<k>class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)'|(?P<b>[^\s\"'>]+)))?", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in _RAW}


class Node:
    """An element: tag, whether its tag or its marks say it is not content, children (nodes and texts) and subtree hash."""

    __slots__ = ("children", "digest", "drop", "marked", "tag")

    def __init__(self, tag: str, drop: bool, marked: bool):
        self.tag, self.drop, self.marked, self.children, self.digest = tag, drop, marked, [], 0

    def close(self) -> None:
        parts = [self.tag]
        for c in self.children:
            parts.append(f"<{c.digest:x}>" if isinstance(c, Node) else "" if c is _BREAK else " ".join(c.split()))
        self.digest = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) >> 1


class _Break:
    """Stands where a stray end tag parts two blocks."""


_BREAK = _Break()


def _named(name: str, inside: bool) -> bool:
    """Whether a class or an id marks what is not content.

    In an article words of its subject stand in names too (a guide to menus, a
    recipe of cookies), so there each part of a name has to be such a word or one
    of layout; its own header is content.
    """
    parts = [p for p in _PART.split(name.lower()) if p]
    if _STATES & set(parts) or (inside and ("header" in parts or "masthead" in parts)):
        return False
    if inside:
        return any(p in _STRONG or p in _WEAK for p in parts) and all(p in _STRONG or p in _WEAK or p in _PLACES or p.isdigit() or len(p) == 1 for p in parts)
    return any(p in _STRONG for p in parts) or (any(p in _WEAK for p in parts) and all(p in _WEAK or p in _LAYOUT for p in parts))


def _marked(attrs: str, inside: bool, tag: str) -> bool:
    """Whether class, id, role or a hidden mark say that an element is not content.

    Ids in an article are anchors made from titles, so those of sections and
    headings count only where they name the readers' comments, and those of other
    elements only if they are more than one word or such a name.
    """
    for m in _ATTR.finditer(attrs):
        key, value = m["k"].lower(), m["d"] or m["s"] or m["b"] or ""
        if key == "role":
            if value.lower() in _ROLES:
                return True
        elif key == "id" and inside:
            own = value.strip().lower()
            headed = tag not in _TITLED and len(_PART.split(own)) > 1
            if (own in _OWN_IDS and tag not in _CONTENT) or (headed and _named(own, inside)):
                return True
        elif key in ("class", "id"):
            if any(_named(x, inside) for x in value.split()):
                return True
        elif key == "hidden" or value.lower() == "true":
            return True
    return False


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def pop_to(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            node.close()
            self.places[node.tag].pop()

    def last(self, tag: str, fences: frozenset[str]) -> int:
        """Place of the innermost open `tag` that no fence hides, or 0."""
        at = self.places[tag]
        return at[-1] if at and all(self.places[f][-1] <= at[-1] for f in fences if self.places[f]) else 0


def _tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, attributes) of each tag, comments and the like with an empty name; a caller may send where to go on."""
    at, last_end, quotes = 0, html.rfind(">"), True
    while (start := html.find("<", at)) >= 0:
        name, ends, attrs = "", False, ""
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            end = stop + 3 if stop >= 0 else len(html)
        elif html.startswith("<![CDATA[", start):
            stop = html.find("]]>", start + 9)
            end = stop + 3 if stop >= 0 else len(html)
            attrs = html[start + 9 : stop if stop >= 0 else len(html)]
            name = "#text"
        elif html.startswith(("<!", "<?"), start):
            stop = html.find(">", start) if start < last_end else -1
            end = stop + 1 if stop >= 0 else len(html)
        elif start < last_end and (m := _TAG_NAME.match(html, start)):
            whole = _ATTRIBUTES.match(html, m.end()) if quotes else None
            # quotes that never end are no quotes, here and in all that follows
            quotes = whole is not None
            end = whole.end() if whole else html.find(">", m.end()) + 1
            if not end:
                at = start + 1
                continue
            name, ends, attrs = m[1].lower(), html[start + 1] == "/", html[m.end() : end - 1]
        else:
            at = start + 1
            continue
        sent = yield start, end, name, ends, attrs
        at = end if sent is None else sent


def parse(html: str) -> Node:
    """The tree of a page; implied ends of p and li, unclosed and stray tags are tolerated."""
    root = Node("#root", False, False)
    stack, at = _Open(root), 0

    def text(piece: str) -> None:
        if piece:
            stack.nodes[-1].children.append(unescape(piece))

    tags = _tags(html)
    found = next(tags, None)
    while found:
        start, end, tag, ends, attrs = found
        text(html[at:start])
        at, jump = end, None
        if tag == "#text":
            stack.nodes[-1].children.append(attrs)
        elif tag and ends:
            if k := stack.last(tag, _FENCES.get(tag, _NO_FENCE)):
                stack.pop_to(k)
            elif tag in _BLOCK:
                stack.nodes[-1].children.append(_BREAK)
        elif tag:
            if tag in _BLOCK and (k := stack.last("p", _P_FENCES)):
                stack.pop_to(k)
            if tag == "li" and (k := stack.last("li", _LIST_FENCES)):
                stack.pop_to(k)
            inside = bool(stack.places["article"] or stack.places["main"])
            marked = bool(attrs.strip()) and tag not in ("body", "html") and _marked(attrs, inside, tag)
            node = Node(tag, tag in _DROP or (tag == "header" and not inside), marked)
            stack.nodes[-1].children.append(node)
            if tag in _RAW:
                stop = _RAW_END[tag].search(html, at)
                node.children.append(html[at : stop.start() if stop else len(html)])
                node.close()
                at = jump = stop.end() if stop else len(html)
            elif tag in _VOID:
                node.close()
            else:
                stack.push(node)
        try:
            found = tags.send(jump)
        except StopIteration:
            found = None
    text(html[at:])
    stack.pop_to(1)
    root.close()
    return root


_NO_FENCE: frozenset[str] = frozenset()
_P_FENCES = frozenset("table td th caption button object li div section article aside body main blockquote".split())
_LIST_FENCES = frozenset("ul ol menu table body".split())
_FENCES = {"p": _P_FENCES, "li": _LIST_FENCES} | dict.fromkeys(("b", "i", "em", "strong", "a", "span", "u", "font", "small", "code"), frozenset("td th article main body section".split()))


def mains(root: Node) -> list[Node]:
    """The outermost article elements that are content, be it for their tags alone where marks leave none; else main elements; else the whole page."""
    for tag in _MAIN:
        for strict in (True, False):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if (node.drop and (strict or node.tag != "form")) or (strict and node.marked):
                    continue
                if node.tag == tag:
                    found.append(node)
                else:
                    todo += [c for c in reversed(node.children) if isinstance(c, Node)]
            if found:
                return found
    return [root]


def blocks(nodes: list[Node], template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below `nodes`, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (joined := " ".join("".join(run).split())):
            out.append(joined)
        run.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is _BREAK:
                flush()
            elif isinstance(x, str):
                run.append(x)
            elif x is top or not (x.drop or x.marked or (x.digest in template and x.tag not in _MAIN)):
                if x.tag == "br":
                    run.append(" ")
                elif x.tag in _BLOCK:
                    flush()
                    todo.append(_BREAK)
                todo += reversed(x.children)
        flush()
    return out


def candidates(root: Node) -> dict[int, bool]:
    """Hashes of subtrees that may be template, and whether each is a block of content within the article."""
    inside = {id(n) for n in mains(root)}
    found: dict[int, bool] = {}
    todo = [(root, id(root) in inside and root.tag in _MAIN)]
    while todo:
        node, within = todo.pop()
        within = within or (id(node) in inside and node.tag in _MAIN)
        if node.tag in _BLOCK and node.tag not in ("html", "body", "head", *_MAIN) and node.children:
            content = within and node.tag in _CONTENT
            found[node.digest] = found.get(node.digest, True) and content
        if node.tag != "head":
            todo += [(c, within) for c in node.children if isinstance(c, Node)]
    return found


def _identity(root: Node) -> str:
    """What tells an article from others: its first block, or all text of a page that has no article element."""
    found = mains(root)
    text = blocks(found)
    return "\n".join(text[:1] if found[0].tag in _MAIN else text)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.when(host != "", host)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(host, subtree): hashes of the subtrees that are template of each host."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            hosts, subtrees, contents, articles = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page or "")
                found = candidates(root) | {0: False}
                hosts += [host] * len(found)
                subtrees += found
                contents += found.values()
                articles += [_hash(_identity(root))] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(contents, pa.bool_()), pa.array(articles, pa.int64())], ["host", "subtree", "content", "article"])

    bound(pages.sparkSession)
    seen = pages.select(host_of(F.col(url)).alias("host"), F.col(html)).where("host is not null").mapInArrow(hashes, "host string, subtree long, content boolean, article long")
    counts = written(seen.groupBy("host", "subtree").agg(F.countDistinct("article").alias("n"), F.bool_and("content").alias("content")).where(f"n >= {min_pages}"), "subtrees")
    # subtree 0 stands for the page itself: the number of different articles of the host
    per_host = counts.where("subtree = 0").select("host", F.col("n").alias("articles"))
    least = F.when(F.col("content"), F.greatest(F.lit(10), F.ceil(F.col("articles") * content_share))).otherwise(F.greatest(F.lit(min_pages), F.ceil(F.log2(F.col("articles") + 1))))
    return counts.where("subtree <> 0").join(per_host, "host").where(F.col("n") >= least).select("host", "subtree")


def _of_host(host: str | None) -> int:
    return 0 if host is None else _hash(host)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, content_share: float = CONTENT_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    templates = written(site_templates(pages, url, html, min_pages, content_share), "templates")
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    kinds = [f"{c} {own.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    result = ", ".join([*kinds, "text string", "n_chars long"])

    def record(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        texts = [x.replace("\x00", "\ufffd") for x in texts]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if templates.count() > broadcast_rows:
        return _joined(own, templates, record, result)
    table = templates.toArrow()
    known = np.array([_of_host(h) ^ t for h, t in zip(table["host"].to_pylist(), table["subtree"].to_pylist(), strict=True)], np.int64)
    shared = pages.sparkSession.sparkContext.broadcast(np.unique(known))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in W.parts(batches):
            out = []
            for page, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
                root = parse(page or "")
                found = np.fromiter(candidates(root) if host is not None and len(known) else (), np.int64)
                at = found ^ np.int64(_of_host(host))
                template = set(found[known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at].tolist()) if len(found) else set()
                out.append("\n\n".join(blocks(mains(root), template)))
            yield record(batch, out)

    return own.mapInArrow(texts, result)


def _joined(own: DataFrame, templates: DataFrame, record, result: str) -> DataFrame:
    """The same for any number of templates: the subtrees of each different page meet those of its host in a join."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            found = [list(candidates(parse(page or ""))) for page in batch.column("html").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("host").take(at), pa.array([y for x in found for y in x], pa.int64())], ["key", "host", "subtree"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches):
            pages = zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)
            yield record(batch, ["\n\n".join(blocks(mains(parse(page or "")), set(template or ()))) for page, template in pages])

    keyed = own.withColumn("key", F.xxhash64("host", "html"))
    found = keyed.where("host is not null").select("key", "host", "html").mapInArrow(subtrees, "key long, host string, subtree long").distinct()
    own_templates = found.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_list("subtree").alias("template"))
    return keyed.join(own_templates, "key", "left").select("page_id", "url", "html", "template").mapInArrow(texts, result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
