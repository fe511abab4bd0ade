"""Main text of web pages by equivalence-class template deduction over the pages of a host.

Tokens of a page are its block elements (by their path, with classes) and its text runs
(by path and text). The occurrence vector of a token has its number in each distinct page
of the host; vectors are compared by a fingerprint that Spark aggregates, so no vector is
ever collected. Tokens with one vector form an equivalence class. A class is valid if it
has support (elements in SUPPORT of the pages, text runs in TEXT_SUPPORT) and more than one
token. An element stands in its parent, whose class has no less support, so valid classes
nest by their paths into the host's template. Text runs of valid classes are template
text; what is left of the text in a template's element is a slot.

The content is found in the template: from the outermost element the walk goes down to
the element that holds most of the slots' text (not counting that of links), as long as
that is nearly all of it, and stops where headings or paragraphs stand beside it. A page's
text is that of the slots in the content: without template text, and without elements that
the template repeats and whose class or role names boilerplate. Standard elements for menus,
footers, sidebars, forms, scripts and styles are left out wherever they stand.

Hosts with fewer than MIN_PAGES distinct pages, and pages that don't have their host's
content, have no template: there the elements that HTML has for content (article, main,
else body) are taken, without elements that class or role mark.

Templates are broadcast if they hold at most BROADCAST_BYTES, else joined to the pages.
Null and empty pages have the empty text; repeated pages are extracted row by row and
count once in vectors. An empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import cut, map_batches

#: A template needs so many distinct pages; its elements occur in this share of them.
MIN_PAGES, SUPPORT = 4, 0.5
#: The same for template text, where a few pages that agree say less.
MIN_TEXT_PAGES, TEXT_SUPPORT = 8, 0.9
#: Share of an element's slot text that one of its parts must hold for the walk to go there:
#: from the page's outer elements, and from others.
OUTER_SHARE, INNER_SHARE = 0.5, 0.9
BROADCAST_BYTES = 32 << 20
#: Parts that a host's tokens are dealt to where they meet its row.
HOST_PARTS = 32

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body div html main section td table tbody tr center".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button object".split())
DROPPED = frozenset("nav footer aside form dialog menu head".split())
_CLOSED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}
#: Classes and roles (whole ones) that name boilerplate.
_MARKS = frozenset(
    "ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr "
    "header menu modal navbar nav navigation newsletter notice notification pagination pager popup promo promoted related replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
#: A tag never runs over another one, so an open quote or tag costs no more than its length.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: Any attribute with its value, so that no name is found within another's value.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ARTICLE, _MAIN = (re.compile(rf"/{name}(?=[./]|$)") for name in ("article", "main"))


def _hidden(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Left out by the element itself, with or without a template."""
    return name in DROPPED or (name == "header" and not inside) or "hidden" in attrs or attrs.get("aria-hidden") == "true"


def _marked(name: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether class, role or id name boilerplate. Prose never is; ids of sections are names of chapters."""
    if name in PROSE or name in ("html", "body", "article", "main"):
        return False
    marks = f"{attrs.get('class', '')} {attrs.get('role', '')} {'' if name == 'section' else attrs.get('id', '')}".lower().split()
    if inside:  # whole names only, and a header there holds the title
        return any(m in _MARKS and m != "header" for m in marks)
    return any(m in _MARKS or m in ("page-header", "site-header") or (set(m.split("-")) - {"header"}) & _MARKS for m in marks)


class Block(NamedTuple):
    """Text of a block element: its path, how much of it is in links, the outermost marked
    path around it, and the paths of elements opened since the block before."""

    path: str
    text: str
    linked: int
    marked: str | None
    opened: list[str]


def blocks(html: str | None):
    """Every block with text that isn't hidden, in page order."""
    html = html or ""
    stack: list[tuple[str, str, bool, str | None]] = []  # block elements: name, path, hidden, outermost marked path
    parts: list[str] = []
    at, n, links, linked = 0, len(html), 0, 0
    unclosed: set[str] = set()
    opened: list[str] = []

    def flush():
        nonlocal linked, opened
        text, held = " ".join("".join(parts).split()), linked
        parts.clear()
        linked = 0
        if text and not (stack and stack[-1][2]):
            yield Block(stack[-1][1] if stack else "", text, min(held, len(text)), stack[-1][3] if stack else None, opened)
            opened = []

    while at < n:
        m = _TAG.search(html, at)
        run = unescape(html[at : m.start() if m else n])
        parts.append(run)
        if links:
            linked += len(run)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW or name == "head":
            if not closing and not m[3].endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
                    if name in ("script", "style"):
                        at = n
            continue
        if name not in BLOCKS:
            if name in ("br", "img"):
                parts.append(" ")
            elif name == "a":
                links = 0 if closing else 1
            continue
        yield from flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {}
        inside = any(s[0] in ("article", "main") for s in stack)
        path = (stack[-1][1] if stack else "") + "/" + name + ("." + ".".join(sorted(attrs["class"].replace("/", "").split())) if attrs.get("class", "").strip() else "")
        if name not in VOID:
            hidden = bool(stack and stack[-1][2]) or _hidden(name, attrs, inside)
            outer = stack[-1][3] if stack else None
            stack.append((name, path, hidden, outer or (path if _marked(name, attrs, inside) else None)))
            opened.append(path)
    yield from flush()


def host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _ancestors(path: str) -> list[str]:
    """The path and those of the elements around it, innermost first."""
    out = []
    while path:
        out.append(path)
        path = path[: path.rindex("/")]
    return out


def _tokens(host_: str, html: str | None):
    """``(host, path, token, n, chars, linked, marked, page)``: elements (token 0) with the
    text in and below them, text runs with their hash, and one row for the page."""
    page = xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass")) - (1 << 63)
    held = list(blocks(html))
    elements: dict[str, list[int]] = {}
    marked: set[str] = set()
    for b in held:
        for p in _ancestors(b.path):
            row = elements.setdefault(p, [0, 0, 0])
            row[1] += len(b.text)
            row[2] += b.linked
        for p in b.opened:
            elements.setdefault(p, [0, 0, 0])[0] += 1
        if b.marked:
            marked.add(b.marked)
    yield host_, "", 0, 1, 0, 0, False, page
    for p, (n, chars, linked) in elements.items():
        yield host_, p, 0, n, chars, linked, p in marked, page
    for (p, t), n in Counter((b.path, b.text) for b in held).items():
        yield host_, p, _hash(p, t), n, len(t) * n, 0, False, page


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``host, content, marked, boilerplate``: per host with enough pages the path of the
    content (null if the template has none), the repeated paths in it that are boilerplate, and
    the hashes of template text."""

    def tokens(batches):
        for batch in batches:
            rows = [t for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()) for t in _tokens(host(url), html)]
            yield dict(zip(("host", "path", "token", "n", "chars", "linked", "marked", "page"), zip(*rows) if rows else [[]] * 8))

    schema = "host string, path string, token long, n int, chars long, linked long, marked boolean, page long"
    # a page that is there twice counts once: its rows are equal
    seen = map_batches(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), tokens, schema).distinct()
    vector = F.bit_xor(F.xxhash64("page", "n"))
    known = seen.groupBy("host", "path", "token").agg(F.count("*").alias("support"), vector.alias("vector"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("marked").alias("marked"))
    known = cut(known.where(F.col("support") >= MIN_PAGES))
    sizes = known.where("path = ''").select("host", F.col("support").alias("pages"))
    text = F.col("token") != 0
    enough = F.when(text, F.greatest(F.lit(MIN_TEXT_PAGES), TEXT_SUPPORT * F.col("pages"))).otherwise(SUPPORT * F.col("pages"))
    judged = _with_host(known.where("path <> ''"), sizes, F.xxhash64("path", "token")).where(F.col("marked") | (F.col("support") >= enough))
    # at most as many rows for a host as its pages have tokens, by the shares of support
    return judged.groupBy("host").applyInPandas(_template, "host string, content string, marked array<string>, boilerplate array<long>")


def _name(path: str) -> str:
    return path[path.rindex("/") + 1 :].split(".")[0]


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """Nests the classes of one host and picks its content."""
    is_text = rows["token"] != 0
    valid = set(rows["path"][~is_text & (rows["support"] >= SUPPORT * rows["pages"])])
    tokens_of = rows["vector"].map(rows["vector"].value_counts())
    texts = rows[is_text & (tokens_of > 1)]
    slot = {p: c - k for p, c, k in zip(rows["path"][~is_text], rows["chars"][~is_text], rows["linked"][~is_text])}
    once = {p for p, n, k in zip(rows["path"][~is_text], rows["n"][~is_text], rows["support"][~is_text]) if n == k}
    for p, c in zip(texts["path"], texts["chars"]):
        for up in _ancestors(p):
            slot[up] = slot.get(up, 0) - c
    marked = sorted(set(rows["path"][rows["marked"]]))
    for p in marked:
        for up in _ancestors(p)[1:]:
            slot[up] = slot.get(up, 0) - slot.get(p, 0)
    parts: dict[str, list[str]] = {}
    for p in valid - set(marked):
        parts.setdefault(p[: p.rindex("/")], []).append(p)
    at = ""
    while _name(at or "/") not in ("article", "main") and not any(_name(p) in PROSE for p in parts.get(at, ())):
        best = max((p for p in parts.get(at, ()) if _name(p) in CONTAINERS and p in once), key=lambda p: (slot.get(p, 0), p), default=None)
        if best is None or slot.get(best, 0) <= 0:
            break
        share = OUTER_SHARE if _name(best) in ("article", "main") or _name(at or "/") in ("", "html", "body") else INNER_SHARE
        if at and slot[best] < share * slot[at]:
            break
        at = best
    at = None if _name(at or "/") in ("", "html", "body") else at  # nothing stands out
    inner = [p for p in marked if at and p.startswith(at + "/")]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "content": [at], "marked": [inner], "boilerplate": [[int(t) for t in texts["token"]]]})


def _with_host(rows: DataFrame, hosts: DataFrame, spread: Column) -> DataFrame:
    """Inner join with one row for each host; a host's rows are dealt to HOST_PARTS parts by ``spread``."""
    dealt = rows.withColumn("part", F.pmod(F.hash(spread), F.lit(HOST_PARTS)))
    copies = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    return dealt.join(copies, ["host", "part"]).drop("part")


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def main_text(html: str | None, content: str | None = None, marked: tuple = (), boilerplate: frozenset = frozenset()) -> str:
    """Blocks of the content, in page order, joined by newlines."""
    held = list(blocks(html))
    slots = [b for b in held if _under(b.path, content) and not any(_under(b.path, m) for m in marked)] if content else []
    if not slots:
        held = [b for b in held if not b.marked]
        slots = [b for b in held if _ARTICLE.search(b.path)] or [b for b in held if _MAIN.search(b.path)] or held
    # a page that says nothing but what all pages say has that as its text
    return "\n".join(b.text for b in [b for b in slots if _hash(b.path, b.text) not in boilerplate] or slots)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    templates = deduce_templates(pages)
    templates = cut(templates)
    held = templates.agg(F.sum(F.length("host") + F.coalesce(F.length("content"), F.lit(0)) + F.length(F.array_join("marked", "")) + 64 * F.size("marked") + 8 * F.size("boilerplate") + 64)).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"
    if held <= BROADCAST_BYTES:
        known = {r["host"]: (r["content"], tuple(r["marked"]), r["boilerplate"]) for r in templates.toLocalIterator()}
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def by_broadcast(batches):
            sets = {h: (c, m, frozenset(b)) for h, (c, m, b) in shared.value.items()}
            for batch in batches:
                texts = [main_text(h, *sets.get(host(u), ())) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())]
                yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return map_batches(rows, by_broadcast, schema)

    host_of = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def by_join(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("html", "content", "marked", "boilerplate")]
            texts = [main_text(h, c, tuple(m or ()), frozenset(b or ())) for h, c, m, b in zip(*columns)]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_batches(rows.withColumn("host", host_of).join(templates, "host", "left"), by_join, schema)
