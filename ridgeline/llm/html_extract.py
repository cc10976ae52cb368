"""Main text of web pages, with site template removal.

A page becomes a tree. Subtrees that are no content by their nature (scripts,
menus, forms, sidebars, notices, adverts, comments of readers) go at once, unless one that goes by its name or as a form
holds the title or most of the page. Of what is left, every
block with text that stands for itself is hashed, and Spark counts per host how many different pages hold
each hash, near copies as one; blocks that recur across many pages of their host are deleted. Then the article, or
else main, or else the body, where the narrower one holds enough of the text, is read off block by block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .near_dedup import WordHash, components, hashed_shingles, permutations, signature

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.DOTALL)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
DROPPED = frozenset("head nav aside footer button select option dialog menu svg math object canvas audio video".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Pieces that mean something only within their table, list or section: they go with the whole or not at all.
PIECES = frozenset("br hr h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption summary legend option".split())
ENDS_P = BLOCK - {"br"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main body section div select".split())
#: Words of class, id and role that name what an article does not hold.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup paywall sidebar side aside widget menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer foot masthead topbar toolbar header share sharing social related recommended comment comments commentlist discussion disqus "
    "replies respond login search searchbox complementary contentinfo skip".split())

#: Of these, what readers and advertisers write and what asks for consent: it goes whatever its size.
SURE = frozenset(
    "comment comments commentlist discussion disqus replies respond ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored "
    "cookie cookies consent gdpr".split())
#: First words of a name that tell what a wrapper has or lacks, not what it is.
STATE = frozenset("with without has have no not hide show".split())
KEPT, DOUBTFUL, GONE = 0, 1, 2
MAIN_SHARE, BODY_SHARE = 2, 8  # articles that hold less than a half of main, or less than an eighth of the page, are teasers


@dataclass
class Node:
    tag: str
    drop: int = KEPT
    title: bool = False  # holds the first h1 of the page, or is a form around an article
    dropped: bool = False
    own: int = 0  # code points of the texts right below
    size: int = 0  # and of all below that are not dropped
    parts: list = field(default_factory=list)  # text or Node
    hash: int = 0
    text: bool = False  # any below
    piece: bool = False


def no_content(tag: str, attrs: str, inside_article: bool, inside_form: bool) -> int:
    """How surely an element is no content: by its tag, hidden, comments or adverts (GONE), by another name or as a form (DOUBTFUL)."""
    if tag in DROPPED or tag == "header" and not inside_article or tag == "label" and inside_form:
        return GONE
    doubt = DOUBTFUL if tag in ("form", "fieldset") else KEPT
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs:
        return doubt
    if HIDDEN.search(attrs):
        return GONE
    for m in NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            named = NOT_CONTENT.intersection(words)
            if inside_article or tag == "header":
                named -= {"header"}  # the heading of an article or of its section
            if named and words[0] not in STATE:
                if named & SURE:
                    return GONE
                doubt = DOUBTFUL
    return doubt


class Judged(dict):
    """``no_content`` remembered for up to 4,096 tags with attributes of up to 200 characters."""

    def __missing__(self, key: tuple) -> int:
        if len(self) >= 4096:
            self.clear()
        got = no_content(*key)
        if len(key[1]) <= 200:
            self[key] = got
        return got


judge = Judged()


def build(page: str) -> Node:
    """Tree of a page. Open paragraphs, items and cells end where HTML says they do; stray end tags are ignored."""
    root = Node("html")
    stack = [root]
    articles, forms, titled, pos, n = 0, 0, False, 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal articles, forms
        while len(stack) > depth:
            tag = stack.pop().tag
            articles -= tag in ("article", "main")
            forms -= tag == "form"

    def close(tags, scope) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop_to(i)
                return
            if stack[i].tag in scope:
                return

    while pos < n:
        m = MARKUP.search(page, pos)
        if m is None:
            stack[-1].parts.append(page[pos:])
            break
        if m.start() > pos:
            stack[-1].parts.append(page[pos:m.start()])
        pos = m.end()
        if m["cdata"] is not None:
            stack[-1].parts.append(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at:
                pop_to(at)
            elif tag == "br":
                stack[-1].parts.append(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"}, ())
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in ENDS_P:
            close({"p"}, SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE - {"div"})
        attrs = m["attrs"] or ""
        drop = judge[tag, attrs, articles > 0, forms > 0]
        if tag in ("article", "main") and not drop:
            for i, open_ in enumerate(stack):  # an unclosed menu or advert does not hold the article
                if open_.tag in ("form", "fieldset"):
                    open_.title = True
                elif open_.drop:
                    pop_to(i)
                    break
        if tag == "h1" and not titled and not drop and all(x.drop != GONE for x in stack):
            titled = True
            for x in stack:
                x.title = True
        node = Node(tag, drop)
        stack[-1].parts.append(node)
        if tag not in VOID and not page[m.end() - 2:m.end()] == "/>":
            stack.append(node)
            articles += tag in ("article", "main")
            forms += tag == "form"
    settle(root)
    return root


def settle(root: Node) -> None:
    """Set ``dropped`` and ``size``: a doubtful element stays if it holds the title or more than half of the text that is not surely gone."""
    nodes, todo, doubt = [], [root], False
    while todo:
        node = todo.pop()
        nodes.append(node)
        for p in node.parts:
            if isinstance(p, str):
                node.own += len(p.strip())
            elif p.drop == GONE:
                p.dropped = True
            else:
                doubt |= p.drop == DOUBTFUL
                todo.append(p)
    for node in reversed(nodes):  # with all that is doubtful
        node.size = node.own + sum(p.size for p in node.parts if isinstance(p, Node) and not p.dropped)
    if not doubt:
        return
    whole = root.size
    for node in nodes:
        node.dropped = node.drop == DOUBTFUL and not node.title and 2 * node.size <= whole
    for node in reversed(nodes):  # and without what goes
        node.size = node.own + sum(p.size for p in node.parts if isinstance(p, Node) and not p.dropped)


def outermost(root: Node, wanted: str) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == wanted:
            found.append(node)
        else:
            todo += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped]
    return found


def kept_roots(root: Node) -> list[Node]:
    """Outermost articles that are not dropped, else mains, else the whole page; ones too small beside what is around them are passed over."""
    articles, mains = outermost(root, "article"), outermost(root, "main")
    size = lambda found: sum(x.size for x in found)
    for found in (articles, mains):
        if not found or BODY_SHARE * size(found) < root.size:
            continue
        if found is articles and mains and MAIN_SHARE * size(articles) < size(mains):
            continue
        return found
    return [root]


def post_order(top: Node) -> list[Node]:
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in node.parts if isinstance(p, Node) and not p.dropped]
    return out[::-1]


def hash_subtrees(top: Node) -> list[Node]:
    """Set ``hash`` of all kept elements below (tags, texts without surplus space, order), ``text`` and ``piece``; the top comes last."""
    nodes = post_order(top)
    for node in nodes:
        h = blake2b(node.tag.encode(), digest_size=8)
        for p in node.parts:
            if isinstance(p, Node):
                h.update(b"" if p.dropped else b"\x01" + p.hash.to_bytes(8, "little"))
                node.text |= p.text and not p.dropped
            elif s := " ".join(p.split()):
                h.update(b"\x02" + s.encode("utf-8", "surrogatepass"))
                node.text = True
        node.hash = int.from_bytes(h.digest(), "little") >> 1
    for node in reversed(nodes):  # what fills a piece alone is as much a piece
        node.piece |= node.tag in PIECES
        if node.piece:
            inner = [p for p in node.parts if (p.text and not p.dropped if isinstance(p, Node) else p.strip())]
            if len(inner) == 1 and isinstance(inner[0], Node):
                inner[0].piece = True
    return nodes


def stands_alone(node: Node) -> bool:
    """Whether a subtree may be a template: a block with text that is no piece. Inline elements belong to their sentence."""
    return node.text and not node.piece and node.tag in BLOCK


def read(top: Node, templates) -> str:
    """Text of a subtree without template subtrees; blocks, removed ones too, are parted by space, inline elements are not."""
    out: list[str] = []
    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.dropped or x is not top and x.hash in templates and stands_alone(x):
            out.append(" " if x.tag in BLOCK else "")
        else:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo += reversed(x.parts)
    return html.unescape("".join(out))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


BANDS, ROWS, SHINGLE, ALIKE = 24, 4, 2, 0.8


def near_copies(each: DataFrame) -> DataFrame:
    """id, comp: groups of different pages of one host with nearly the same text, by their sketches (``each``: id, host, article, sig).

    As in op9, texts are near copies from a similarity of 0.8 of their two-word shingles. Pages that share a band are compared with
    one page of it, drawn by a hash, so the pairs grow with the pages; 24 bands of 4 rows miss a pair at 0.8 with probability 3e-6.
    """
    @F.pandas_udf("array<long>")
    def keys(sig: pd.Series) -> pd.Series:
        x = [np.frombuffer(v, dtype="<u2").reshape(BANDS, ROWS).astype(np.int64) for v in sig]
        return pd.Series([v[:, 0] << 48 | v[:, 1] << 32 | v[:, 2] << 16 | v[:, 3] for v in x])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        same = [(np.frombuffer(x, dtype="<u2") == np.frombuffer(y, dtype="<u2")).mean() for x, y in zip(a, b, strict=True)]
        return pd.Series([x >= ALIKE for x in same], dtype=bool)

    bands = each.where("sig IS NOT NULL").select("id", "host", "article", F.posexplode(keys("sig")).alias("i", "k"))
    bands = common.written(bands.select("id", F.xxhash64("host", "article", "i", "k").alias("band")), "html-bands")
    hubs = bands.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "id").alias("x"), "id"))["id"].alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = bands.join(hubs, "band").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    side = lambda x: each.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(alike("sig_a", "sig_b")).select("a", "b")
    return components(common.written(links, "html-links")).select(F.col("v").alias("id"), "comp")


def templates_of(pages: DataFrame, least_pages: int = 20, share: float = 0.8, body_pages: int = 4) -> DataFrame:
    """host, templates: hashes of blocks that recur across many different pages of their host.

    Pages with the same content, and near copies (``near_copies``), count once. A block must be on ``share`` of at least
    ``least_pages`` different pages, so that passages which many articles share stay. Hosts with fewer pages have no templates within
    articles; outside, a block must then be on every one of at least ``body_pages``. A row is (host, hash, page content):
    partial sums meet hot hosts and hot blocks before the shuffle.
    """
    @F.pandas_udf("content long, article boolean, hashes array<long>, sig binary")
    def subtrees(page: pd.Series) -> pd.DataFrame:
        flip, factor = permutations(BANDS * ROWS)
        known, rows = WordHash(), []
        for p in page:
            tops = kept_roots(build(p or ""))
            lists = [hash_subtrees(t) for t in tops]
            own = {x.hash for nodes in lists for x in nodes[:-1] if stands_alone(x)}
            whole = int.from_bytes(blake2b(b"".join(t.hash.to_bytes(8, "little") for t in tops), digest_size=8).digest(), "little") >> 1
            u = hashed_shingles(" ".join(read(t, ()) for t in tops), SHINGLE, known)
            rows.append((whole, tops[0].tag != "html", sorted(own), signature(u, flip, factor).tobytes() if len(u) else None))
        return pd.DataFrame(rows, columns=["content", "article", "hashes", "sig"])

    # One page for each different content; a hash is then counted by plain sums.
    each = pages.select(host_of(F.col("url")).alias("host"), subtrees(F.col("html")).alias("s")).select("host", "s.*")
    each = common.written(each.dropDuplicates(["host", "content"]).withColumn("id", F.xxhash64("host", "content")), "html-subtrees")
    least = F.when(F.col("article"), least_pages).otherwise(body_pages)
    able = each.groupBy("host", "article").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("host", "article")
    each = each.join(able, ["host", "article"])
    each = common.written(each.join(near_copies(each), "id", "left"), "html-groups")
    hosts = each.groupBy("host", "article").agg((F.count_if(F.col("comp").isNull()) + F.count_distinct("comp")).alias("pages"))
    many = hosts.where(F.col("pages") >= least)
    rows = each.select("host", "article", "comp", F.explode("hashes").alias("hash"))
    rows = rows.where("comp IS NULL").unionByName(rows.where("comp IS NOT NULL").distinct())
    often = rows.groupBy("host", "article", "hash").agg(F.count("*").alias("n")).join(many, ["host", "article"])
    often = often.where(F.col("n") >= F.when(F.col("pages") >= least_pages, F.col("pages") * share).otherwise(F.col("pages")))
    return common.written(often.groupBy("host").agg(F.collect_set("hash").alias("templates")), "html-templates")


def extract_pages(pages: DataFrame, **limits) -> DataFrame:
    """All columns of ``pages`` plus ``main_text`` (replaced if there).

    Needs url and html; a null url is a host of its own, null html is empty, pages without content give an empty
    text. Repeated pages count once for templates. The table of templates has one row a host that has any:
    it is written first, so Spark broadcasts it only below its size limit.
    """
    common.bound_batches(pages.sparkSession)
    found = templates_of(pages, **limits)

    @F.pandas_udf("string")
    def text(page: pd.Series, templates: pd.Series) -> pd.Series:
        def one(p, known):
            known = frozenset() if known is None else frozenset(np.asarray(known).tolist())
            out = []
            for top in kept_roots(build(p or "")):
                if known:
                    hash_subtrees(top)
                out.append(read(top, known))
            return " ".join(" ".join(out).split())
        return pd.Series([one(p, t) for p, t in zip(page, templates, strict=True)], dtype=object)

    cols = [c for c in pages.columns if c != "main_text"]
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), host_of(F.col("url")).alias("host"))
    out = packed.join(found, "host", "left").select("row", text(F.col("row.html"), F.col("templates")).alias("main_text"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols], "main_text")


def op6_html(pages: DataFrame) -> DataFrame:
    out = extract_pages(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
