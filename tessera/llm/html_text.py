"""HTML extraction with site template removal.

Every element subtree has a hash of its tags and texts, inside articles too.  Spark counts on how many pages of a host each hash
occurs; subtrees that recur on many pages of their host are its template and are deleted.  What remains is cut down to the articles
of the page (else its main element), without elements whose tag, role or class says that they are not content.

Exact copies of a page count once.  Inside articles the rule is stricter, as articles may quote or copy each other: only blocks are
candidates, the share is higher, and what counts is in how many different articles a block stands, told apart by their longest text
outside the block.

On large hosts a share of the pages is many pages, so a block that keeps its place in its parent (from its start or its end) is
template from a fixed number of pages on.  Quoted passages have no fixed place.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, small_batches, written

#: A subtree is template from this many pages of its host, and this share of them, on.
LEAST_PAGES, LEAST_SHARE = 3, 0.3
#: The same for blocks inside articles: this share of the pages.
INSIDE_SHARE = 0.5
#: Blocks that keep their place are template from this many pages of their host on (inside articles: articles), whatever their share.
PLACED_PAGES = 30
#: Template hashes are sent to all workers up to this many (8 bytes each); beyond it they are joined to their pages.
BROADCAST_HASHES = 500_000
#: Hashes that occur on LEAST_PAGES pages are sent to all workers up to this many (8 bytes each) before different pages are counted.
BROADCAST_CANDIDATES = 2_000_000

# HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that are template candidates inside articles: blocks that stand alone, no headings, items, cells or inline elements.
ALONE = frozenset("address aside blockquote center details dialog div dl fieldset figure footer form header menu nav ol p pre section table ul".split())
ASIDE = frozenset("aside nav".split())
DROP = frozenset("aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe input map menu nav noembed noframes noscript object option script select style svg template textarea title video xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html main aside nav footer header form td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Words of class and id names of what is no content.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion related recommended recommendations replies reply respond share sharing sidebar sidenav social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# Words that with those make the name of a part of a page ("share-buttons", "site-footer"); other words with them do
# not ("market-share", "notice-period").
PARTS = frozenset("a area bar block body bottom box btn button buttons card close col column container content desktop entry fixed form full global group head header heading hide icon icons inline inner item items js large left link links list main message mini mobile module more nav outer overlay page panel post posts primary right row secondary section signup site slot small sticky tab text title tools top unit us wrap wrapper".split())
# Those of them that tell a reader's comment from an article.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())

# Possessive runs: no text makes a pattern go back over what it read.  The last part is a tag that never ends.
TAG = r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
TOKEN = re.compile(rf"{OTHER}|{TAG}|<(?=/?[a-zA-Z])", re.S)
PLAIN = re.compile(rf"{OTHER}|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<(?=/?[a-zA-Z])", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip() else {}


def parse(html: str) -> Node:
    """A tolerant tree: unclosed elements end with their parent, stray end tags are left out, and so is a tag that the page's end
    cuts off.  In linear time: once quotes do not match up to the end, the rest is read without regard to them."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    open_: Counter = Counter()
    tokens = TOKEN

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while at < n:
        m = tokens.search(html, at)
        if not m:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m.end() == m.start() + 1:  # a tag that never ends, by its quotes or at all
                if tokens is PLAIN:
                    break
                tokens, at = PLAIN, m.start()
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in SCOPE and stack[k].tag in SCOPE:
                    break
            continue
        if tag in BLOCK and tag != "br" and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        ends = CLOSES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in ends) else ():
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in SCOPE:
                break
        if tag in ("html", "body") and (tag == "html" or open_[tag]):
            continue
        node = Node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 if end else 0
            at = at or n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def unwanted(node: Node, inside: bool) -> bool:
    """Whether tag, role or names say that this is no content; inside: within an article, whose own header is kept."""
    if node.tag in DROP or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    a = node.attributes()
    words = NAMES
    if node.tag == "article":
        words = COMMENTS
    elif "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or HIDDEN.search(a.get("style", "")):
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        said = [x.lower() for x in re.split(r"[\d_-]+|(?<=[a-z])(?=[A-Z])", name) if x]
        if any(x in words for x in said) and all(x in NAMES or x in PARTS for x in said):
            return True
    return False


def text_of(node: Node, inside: bool = False, deleted: frozenset | set = frozenset()) -> str:
    """Texts of what is left and wanted, blocks apart, white space as one space."""
    out: list[str] = []
    work: list = [(node, inside)]
    while work:
        x, within = work.pop()
        if x.__class__ is str:
            out.append(x)
            continue
        if x is not node and (id(x) in deleted or unwanted(x, within)):
            out.append(" " if x.tag in BLOCK else "")
            continue
        within = within or x.tag == "article"
        if x.tag in BLOCK:
            out.append(" ")
            work.append((" ", within))
        work += [(p, within) for p in reversed(x.parts)]
    return " ".join(unescape("".join(out)).split())


class Subtree:
    __slots__ = ("node", "up", "article", "state", "digest", "start", "end", "children", "place")

    def __init__(self, node: Node, up: int, article: int, start: int):
        self.node, self.up, self.article, self.start, self.end = node, up, article, start, start
        self.state, self.digest = blake2b(node.tag.encode(), digest_size=8), b""
        self.children = self.place = 0


def _long(b: bytes) -> int:
    return int.from_bytes(b, "little", signed=True)


def _longest_outside(texts: list[str], inner: tuple[int, int], outer: tuple[int, int], top: dict) -> str:
    """The longest of texts[outer] that is not in texts[inner]; "" for none.  top holds what was found for whole articles."""
    if outer not in top:
        top[outer] = sorted(range(*outer), key=lambda i: (-len(texts[i]), texts[i]))
    return next((texts[i] for i in top[outer] if not inner[0] <= i < inner[1]), "")


def subtree_hashes(root: Node) -> tuple[int, list[tuple[int, int, int]]]:
    """Hash of the page, and (id(), hash, context) of every template candidate, made from the leaves up: a hash of the subtree and,
    for blocks that stand alone, two of the subtree and its place.

    The lowest bit of a hash tells candidates inside articles, the next one those with a place.  The context tells pages, or
    articles, apart."""
    all_: list[Subtree] = []
    texts: list[str] = []
    work: list = [(root, -1, -1)]
    while work:
        x, up, article = work.pop()
        if x is None:
            t = all_[up]
            t.end, t.digest = len(texts), t.state.digest()
            if t.up >= 0:
                all_[t.up].state.update(b"<" + t.digest)
                if t.end > t.start:
                    t.place = all_[t.up].children
                    all_[t.up].children += 1
        elif x.__class__ is str:
            if x and not x.isspace():
                texts.append(" ".join(x.split()))
                all_[up].state.update(b"t" + texts[-1].encode())
        else:
            n = len(all_)
            all_.append(Subtree(x, up, article, len(texts)))
            inner = n if article < 0 and x.tag == "article" else article
            work.append((None, n, 0))
            work += [(p, n, inner) for p in reversed(x.parts)]
    page = _long(all_[0].digest)
    out, top, contexts = [], {}, {}
    for t in all_:
        if t.end == t.start or t.node.tag in ("html", "body", "main", "article"):
            continue
        if t.article < 0:
            inside, context = 0, page
        elif t.node.tag in ALONE:
            a = all_[t.article]
            other = _longest_outside(texts, (t.start, t.end), (a.start, a.end), top)
            if other not in contexts:
                contexts[other] = _long(blake2b(other.encode(), digest_size=8).digest())
            inside, context = 1, contexts[other]
        else:
            continue
        out.append((id(t.node), _long(t.digest) & ~3 | inside, context))
        if t.node.tag in ALONE or t.node.tag in ASIDE:
            up = all_[t.up]
            for place in (b"+%d" % t.place, b"-%d" % (up.children - t.place)):
                h = _long(blake2b(t.digest + up.node.tag.encode() + place, digest_size=8).digest())
                out.append((id(t.node), h & ~3 | 2 | inside, context))
    return page, out


def _find(root: Node, want, deleted: frozenset | set = frozenset()) -> list[Node]:
    """Outermost elements for which want() holds, in page order."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if id(x) in deleted:
            continue
        if x is not root and want(x):
            out.append(x)
        elif x is root or not unwanted(x, False):
            work += [p for p in reversed(x.parts) if p.__class__ is Node]
    return out


def main_text(root: Node, template: frozenset | set) -> str:
    """The text of all articles that are not comments; if they have none that of the longest main element; else of the whole page.
    Template subtrees are deleted first."""
    deleted = {i for i, h, _ in subtree_hashes(root)[1] if h in template} if template else frozenset()
    articles = _find(root, lambda x: x.tag == "article" and not unwanted(x, True), deleted)
    text = " ".join(filter(None, (text_of(a, True, deleted) for a in articles)))
    if text:
        return text
    mains = _find(root, lambda x: x.tag == "main" or 'role="main"' in x.attrs, deleted)
    return max((text_of(a, False, deleted) for a in mains or [root]), key=len)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(pages: DataFrame) -> DataFrame:
    """host, page (hash), and of its template candidates: k (hash of host and subtree), h (hash), p and q (hashes with the place, or 0),
    c (context), of every row (url, html): what is counted, as numbers, so that pages are read once for all counts."""

    def run(batches):
        for batch in batches:
            rows = []
            for u, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(u)
                salt = int.from_bytes(blake2b(host.encode(), digest_size=8).digest(), "little")
                page, found = subtree_hashes(parse(html or ""))
                nodes: list[list[int]] = []
                for _, h, c in found:
                    if h & 2:
                        nodes[-1][3 if nodes[-1][2] else 2] = h
                    else:
                        k = ((h ^ salt) * 0x9E3779B97F4A7C15 ^ salt >> 7) & (1 << 64) - 1
                        nodes.append([k - (k >> 63 << 64), h, 0, 0, c])
                rows.append((host, page, *([x[i] for x in nodes] for i in range(5))))
            types = (pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["host", "page", "k", "h", "p", "q", "c"])

    return pages.mapInArrow(run, "host string, page long, k array<bigint>, h array<bigint>, p array<bigint>, q array<bigint>, c array<bigint>")


def template_hashes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, hash of subtrees that recur on LEAST_PAGES different pages and LEAST_SHARE (inside articles INSIDE_SHARE) of the pages
    of their host, or keep their place on PLACED_PAGES of them.

    The first count is of rows and leaves hashes that can be template; the second counts different pages of those.  Counts are
    combined before each shuffle, so a host with most pages is no hot task."""
    spark = pages.sparkSession
    subtrees = written(_subtrees(pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))), "subtrees")
    seen = written(subtrees.select(F.explode(F.array_distinct("k")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).select("k"), "candidates")
    few = seen.count() <= BROADCAST_CANDIDATES
    among = spark.sparkContext.broadcast(np.sort(np.fromiter((r.k for r in seen.toLocalIterator()), np.int64)) if few else None)

    def run(batches):
        for batch in batches:
            flat = [batch.column(i).flatten().to_numpy() for i in range(2, 7)]
            n = np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            k = flat[0]
            if among.value is not None:
                at = np.searchsorted(among.value, k)
                kept = np.zeros(len(k), bool) if not len(among.value) else among.value[np.minimum(at, len(among.value) - 1)] == k
            else:
                kept = np.ones(len(k), bool)
            rows = [np.arange(len(n))]  # a null hash stands for the page
            hashes, contexts = [pa.nulls(len(n), pa.int64())], [batch.column(1)]
            for h in flat[1:4]:
                some = kept & ((h != 0) | (h is flat[1]))
                rows.append(row[some])
                hashes.append(pa.array(h[some]))
                contexts.append(pa.array(flat[4][some]))
            host = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([host, pa.concat_arrays(hashes), pa.concat_arrays(contexts)], names=["host", "hash", "context"])

    counts = written(subtrees.mapInArrow(run, "host string, hash long, context long").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_PAGES) | F.col("hash").isNull()), "counts")
    total = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("hash").bitwiseAND(1) == 1, INSIDE_SHARE).otherwise(LEAST_SHARE) * F.col("pages")
    least = F.when(F.col("hash").bitwiseAND(2) == 2, F.lit(PLACED_PAGES)).otherwise(share)
    out = written(counts.where("hash is not null").join(total, "host").where(F.col("n") >= least).select("host", "hash"), "template")
    for d in (subtrees, seen, counts):
        drop_written(d)
    return out


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep and text of every page (null or empty html: empty text).  Repeated rows stay as they are."""
    spark = pages.sparkSession
    small_batches(spark)
    template = template_hashes(pages, url, html)
    src = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    if template.count() <= BROADCAST_HASHES:
        by_host: dict[str, set[int]] = {}
        for host, h in template.collect():
            by_host.setdefault(host, set()).add(h)
        shared = spark.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})
        src = src.withColumn("own", F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        row = F.xxhash64("u", "h")

        def rows(batches):
            for batch in batches:
                for r, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                    mine = list({x for _, x, _ in subtree_hashes(parse(h or ""))[1]})
                    yield pa.RecordBatch.from_arrays([pa.array([r] * len(mine), pa.int64()), pa.array([host_of(u)] * len(mine), pa.string()), pa.array(mine, pa.int64())], names=["row", "host", "hash"])

        own = src.select(row.alias("row"), "u", "h").mapInArrow(rows, "row long, host string, hash long").distinct().join(template, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("own"))
        src = src.withColumn("row", row).join(own, "row", "left").drop("row")

    def run(batches):
        none: frozenset = frozenset()
        for batch in batches:
            urls, htmls, own = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            for s, e in slices([len(x or "") for x in htmls]):
                done = [main_text(parse(h or ""), shared.value.get(host_of(u), none) if shared else frozenset(o or ())) for u, h, o in zip(urls[s:e], htmls[s:e], own[s:e])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(s, e - s) for i in range(len(keep))), pa.array(done, pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "text"])

    types = ", ".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return src.mapInArrow(run, f"{types}, text string").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def op3_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html gives the empty text; a null url is a host of its own; pages are whole however long; repeated rows stay and
    count once as pages of their host; of main elements of one length the first is taken; other columns take no part, whatever
    their names; an empty table gives no rows."""
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
