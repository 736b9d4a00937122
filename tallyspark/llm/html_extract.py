"""Main text of pages by a site style tree.

Pages of a host are merged into one tree: a node is a path of styles (tag and
class, digits out). Over the host's pages, a node's importance joins

- presentation: the entropy of the child-style sequences it shows, in units of
  log(pages); a node that always looks alike says little;
- content: one less the mean normalised entropy of its texts; a text spread
  over many pages has high entropy, one of a single page none.

A node that shows the same few texts on most pages gets low importance, and its
branch is removed from each page of the host. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments that their
markup declares go on every page, also where a host has too few pages to tell.
Only `article` or `main` is kept where a page has one with a share of its text;
there fewer names declare, so the heading in `article-header` stays. A form as
wide as the page is looked into: an article in it is kept, and where there is no
other text its paragraphs.

Rows of a host with the same blocks count as one page, so a copied page is not
taken for a text that is spread over pages. Copies are found by host and a hash
of the blocks, then counts are grouped by host, node and text, both combined
before their shuffles, so a host with a third of all pages is spread over its
pages, nodes and texts. The few removed nodes are broadcast to all rows, or, past
BROADCAST_NODES of them, joined with salted hosts; html is not shuffled by host.

A null page or one without text gives an empty text and 0 characters. A null or
unreadable url is a host of its own kind, without tree. Repeated rows come back
each. No pages give no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import checkpointed

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_DROPPED = frozenset("head nav footer aside form button dialog menu title".split())
#: Words of a class, id or role that declare what is not the article.
_DECLARED = frozenset(
    "ad ads advert advertisement adverts adbox sponsor sponsored promo promotion nav navbar navigation menu header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup share sharing social comment comments disqus reply replies related recommended breadcrumb breadcrumbs pagination pager widget login search toolbar complementary contentinfo".split()
)
#: Words that with a declared one still declare, and those of an article's own header.
_FURNITURE = frozenset("slot box block list lists link links post posts item items area section wrapper wrap container inner widget bar button buttons icon icons thread form group panel unit media count body author meta".split())
_OWN = frozenset("post article entry story content".split())
#: Characters of a paragraph in a form that make the form the page's text, if it has no other; share of the text that articles must have to be all of it.
FORM_PARAGRAPH, ARTICLE_SHARE = 80, 0.25
#: A start tag closes these, up to what holds it.
_CLOSES = {x: ({x} if x in ("li", "option", "tr") else {"dt", "dd"} if x in ("dt", "dd") else {"td", "th"} if x in ("td", "th") else {"p"}) for x in "p div ul ol dl li dt dd table tr td th h1 h2 h3 h4 h5 h6 section article main header footer nav aside form blockquote pre figure hr option".split()}
_HOLDS = frozenset("ul ol dl table article section main body div td blockquote select nav aside header footer".split())
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Za-z]+")
#: What follows a name without changing it.
_DIGITS = re.compile(r"[0-9]+$")
#: Removed nodes of all hosts that are broadcast at most (16 MB); beyond, hosts are salted into so many parts.
BROADCAST_NODES, SALTS = 1_000_000, 32


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def declared(name: str, inside: bool) -> bool:
    """Whether a class, id or role says that its element isn't the article's: by its whole name, or by a part of one.

    In the article other parts must be furniture (`ad-slot`), as they may be the
    article's own words (`article-header`, `social-science`); outside only the
    header of something of the article's, and `social` with other words, aren't.
    """
    name = _DIGITS.sub("", name)
    if name in _DECLARED:
        return True
    parts = set(_WORD.findall(name))
    hits = parts & _DECLARED
    rest = parts - _DECLARED
    if not hits:
        return False
    if inside:
        return rest <= _FURNITURE and _WORD.findall(name)[0] in _DECLARED
    return not (hits == {"header"} and rest & _OWN) and (hits != {"social"} or rest <= _FURNITURE)


def article_only(found: list[tuple[str, bool, str]]) -> list[tuple[str, bool, str]]:
    """Of a page's blocks those in an article, if they have a share of the text; else all, as a teaser isn't the page's text."""
    own = sum(len(x[2]) for x in found if x[1])
    return [x for x in found if x[1]] if own and own >= ARTICLE_SHARE * sum(len(x[2]) for x in found) else found


def blocks(page: str) -> list[tuple[str, bool, str]]:
    """(style path, in the article, text) of the text blocks that markup doesn't declare to be something else, in order."""
    out: list[tuple[str, bool, str]] = []
    # of each open element: tag, path, declared as dropped (or only as a form), inside an article
    stack: list[tuple[str, str, bool | str, bool]] = [("", "", False, False)]
    in_form: list[tuple[str, bool, str]] = []
    text: list[str] = []
    where = stack[-1]

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if block and where[2] is not True:
                (in_form if where[2] else out).append((where[1], where[3], block))

    def add(raw: str) -> None:
        nonlocal where
        if not raw or stack[-1][2] is True:
            return
        if not text:
            where = next((x for x in reversed(stack) if x[0] not in _INLINE), stack[0])
        text.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if any(x[0] == tag for x in stack):
                if tag not in _INLINE:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag not in _INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] in _HOLDS:
                    break
        if tag in _VOID:
            continue
        _, path, dropped, inside = stack[-1]
        names = " ".join(x[1].strip("\"'") for x in _ATTRIBUTE.findall(m[4])).lower() if m[4] else ""
        if tag == "form" and not dropped and not inside:
            # an article may be in a form that is as wide as the page
            dropped = "form"
        elif dropped is not True and tag in _DROPPED or tag == "header" and not inside:
            dropped = True
        elif dropped is not True and names and tag not in ("html", "body", "main", "form") and any(declared(x, inside or tag == "article") for x in names.split()):
            dropped = True
        elif dropped == "form" and tag in ("article", "main"):
            dropped = False
        style = f"{tag}.{re.sub('[0-9]+', '', names)}" if names else tag
        stack.append((tag, f"{path}/{style}" if tag not in _INLINE else path, dropped, inside or tag in ("article", "main")))
    add(page[at:])
    flush()
    if not out and any(path.endswith("/p") and len(text) >= FORM_PARAGRAPH for path, _, text in in_form):
        return in_form
    return out


def _tree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, page, shows) of each row with text: page tells its blocks, shows are the (node, what, value) of its nodes' texts and child sequences."""
    for f in frames:
        rows = []
        for host, page in zip(f["host"], f["html"], strict=True):
            own, children = set(), {}
            found = blocks(page)
            for path, _, text in found:
                own.add((_key(path), "text", _key(text)))
                parent, _, style = path.rpartition("/")
                children.setdefault(parent, []).append(style)
            own |= {(_key(path), "look", _key(*styles)) for path, styles in children.items()}
            if own:
                rows.append((host, _key(*(y for path, inside, text in found for y in (path, str(inside), text))), [dict(zip(("node", "what", "value"), x, strict=True)) for x in own]))
        yield pd.DataFrame(rows, columns=["host", "page", "shows"])


def importance(pages: DataFrame, least_pages: int = 8) -> DataFrame:
    """(host, node, importance) of the nodes that least_pages different pages of their host show."""
    shown = pages.select("host", "html").mapInPandas(_tree, "host string, page long, shows array<struct<node:long,what:string,value:long>>")
    # rows of one host with the same blocks are one page
    different = shown.dropDuplicates(["host", "page"]).select("host", F.inline("shows"))
    values = different.groupBy("host", "node", "what", "value").agg(F.count("*").alias("pages"))

    def of(what: str, value: Column) -> Column:
        return F.when(F.col("what") == what, value)

    n = F.col("pages")
    # a text on k of the pages has entropy log(k); shown by all it is log(m), a text of one page 0
    nodes = values.groupBy("host", "node").agg(
        *(F.sum(of(x, n)).alias(f"{x}_shown") for x in ("text", "look")), *(F.sum(of(x, n * F.log(n))).alias(f"{x}_weighed") for x in ("text", "look")), F.max(of("text", n)).alias("most"), F.avg(of("text", F.log(n))).alias("log_pages")
    )
    entropy = {x: F.log(f"{x}_shown") - F.col(f"{x}_weighed") / F.col(f"{x}_shown") for x in ("text", "look")}
    unit = {x: F.log(F.greatest(f"{x}_shown", F.lit(2))) for x in ("text", "look")}
    presentation = F.coalesce(entropy["look"] / unit["look"], F.lit(0.0))
    content = F.least(1 - F.col("log_pages") / F.log(F.greatest("most", F.lit(2))), entropy["text"] / unit["text"])
    return nodes.where(F.col("most") >= least_pages).select("host", "node", (0.1 * presentation + 0.9 * content).alias("importance"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = 0.2, least_pages: int = 8) -> DataFrame:
    """(id, url, text, n_chars) of every row; see the module."""
    host = F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.when(host != "", host).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    low = importance(rows.where("host is not null"), least_pages).where(F.col("importance") < least_importance)
    low = checkpointed(low.groupBy("host").agg(F.collect_set("node").alias("low")))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for page, low_nodes in zip(f["html"], f["low"], strict=True):
                found = blocks(page)
                found = article_only(found)
                if low_nodes is not None and len(low_nodes):
                    gone = set(low_nodes)
                    found = [x for x in found if not any(_key(x[0][:i]) in gone for i in [*(k for k, ch in enumerate(x[0]) if ch == "/" and k), len(x[0])])]
                texts.append(" ".join(x[2] for x in found))
            yield pd.DataFrame({"id": f["id"], "url": f["url"], "text": texts})

    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) + low.count() <= BROADCAST_NODES:
        both = rows.join(F.broadcast(low), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("id", "url", "html"), F.lit(SALTS)).alias("salt")
        both = rows.select("*", salt).join(low.withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS))))), ["host", "salt"], "left")
    out = both.select("id", "url", "html", "low").mapInPandas(cut, f"id {dict(rows.dtypes)['id']}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
