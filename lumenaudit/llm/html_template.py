"""Main text of web pages by equivalence-class template deduction over the pages of each host.

A page is read as tokens: elements by their path, and texts of blocks. Over a host's pages every token has an occurrence vector (how often on which page);
tokens of equal vectors form a class, and a class that is large and frequent enough is part of the host's template. The class of the
tokens that each page has once is the root; other classes nest in the element of the root that holds all their paths. What the template leaves
are slots: the slot with the article is the root element that holds most text outside links and template, where article and main break a tie; they also serve
pages without a slot. Texts that are themselves template tokens, inside the slot too, and elements that say that they are menus, adverts and the like, are no content. Inside the slot a paragraph or heading whose name may be that of
its subject (share, menu, login ..) is content; only the template drops it there.

Pages of equal sets of containers are a layout; a token that is frequent in a layout or in the whole host is template on all pages of the host. Occurrence vectors are
summed fingerprints, so hosts of any size aggregate in parts. Pages of equal texts count once. Defined results: null or empty html gives an empty string; a null
url is a host of its own; repeated rows are pages of their own; a host of one page uses its elements alone; broken or cut markup is read as far as it goes; a page or
text of any length is read whole; an empty table gives an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as _html
import marshal
import re
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Fixed values of HTML: elements without an end, elements that break a line of text, and elements whose text is never content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
_NEVER = frozenset("head nav footer aside form script style noscript template iframe object svg math canvas button select option textarea menu dialog audio video map".split())
#: Those of them that hold no text of a page at all.
_NO_TEXT = frozenset("head script style noscript template iframe object svg math canvas".split())
#: Elements that make a layout.
_CONTAINER = frozenset("body div section article main nav header footer aside form table ul".split())
_RAW = "script|style|textarea|title|noscript|iframe|template|xmp"
#: Whole names of class, id and role by which an element says that it is no content; a part of a hyphenated name says nothing.
_SAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side-bar menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc header masthead footer share sharing social related recommended "
    "comment comments respond replies reply disqus newsletter subscribe subscription signup login search searchbox widget toolbar tags copyright "
    "complementary contentinfo skip skip-link "
    "cookie-notice cookie-banner cookie-bar cookie-consent cookie-law-info-bar consent-banner site-header site-footer site-nav site-navigation main-nav main-menu main-navigation nav-bar nav-menu "
    "post-navigation nav-links share-box share-bar share-buttons share-links social-share social-links social-media related-posts related-articles related-links related-stories "
    "comment-list comment-form comments-area comments-section post-comments newsletter-signup search-form search-box ad-container ad-slot ad-banner ad-wrapper".split()
)
#: Those that inside the content may as well name a kind of text: there they do not count, and only the template tells.
_UNSURE = frozenset("notice notices alert header masthead banner search related recommended tags toc copyright".split())
#: Elements of running text, and the names that there are as unsure: controls are seldom paragraphs.
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt".split())
_UNSURE_THERE = _UNSURE | frozenset("share sharing social widget overlay subscribe subscription login menu pager".split())
#: Those that hold for an article element too.
_REMARKS = frozenset("comment comments respond replies reply disqus".split())
#: Levels of a name: content, no content unless inside the slot, no content.
_KEPT, _OUTSIDE, _OUT = 0, 1, 2
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[^a-z0-9-]+")
#: Start tags that end an open element of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _element(tag: str, attributes: str, in_article: bool, names: bool) -> tuple[str, int]:
    """(name with class and id, level at which it says that it is no content)"""
    name, no = tag, _OUT if tag in _NO_TEXT or names and (tag in _NEVER or tag == "header" and not in_article) else _KEPT
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                words = [w for w in _NAMES.split(value) if w]
                if key != "role":
                    name += "." + ".".join(words)
                if not names:
                    continue
                if tag in ("article", "main"):
                    no = max(no, _OUT * any(w in _REMARKS for w in words))
                elif tag not in ("body", "html"):
                    unsure = _UNSURE_THERE if tag in _PARAGRAPHS else _UNSURE
                    no = max([no, *((_OUTSIDE if w in unsure else _OUT) for w in words if w in _SAYS)])
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                no = _OUT
    return name, no


def read_page(page: str | None, names: bool = True) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """(paths of the elements in order, blocks of text as (path, text, characters in links, level of no content)). Without names no element says that it is no content."""
    elements: list[str] = []
    blocks: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, str, int]] = []  # tag, path of its block, level of no content
    parts: list[str] = []
    state = [0, _KEPT]  # characters in links, level of the open block
    links = [0]  # open links

    def cut(depth: int) -> None:
        links[0] -= sum(t == "a" for t, _, _ in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1][1] if stack else "", text, state[0], state[1]))
            parts.clear()
        state[0], state[1] = 0, _KEPT

    def text_of(raw: str) -> None:
        no = stack[-1][2] if stack else _KEPT
        if no == _OUT and stack[-1][0] in _INLINE and not _block_is_out(stack):
            return  # a flagged piece inside a line of content
        if not parts:
            state[1] = no
        parts.append(raw)
        if links[0]:
            state[0] += len(raw)

    def close_to(depth: int) -> None:
        flush()
        cut(depth)

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text_of(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue  # a comment, a declaration, or an element of raw text
        tag = m[3].lower()
        if m[2]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is None:
                if tag not in _INLINE:
                    flush()
            elif tag in _INLINE:
                cut(depth)
            else:
                close_to(depth)
            continue
        if tag == "br" or tag == "wbr":
            if parts and tag == "br":
                parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        outer = stack[-1] if stack else ("", "", _KEPT)
        if tag in _INLINE:
            name, no = _element(tag, m[4], True, names)
            stack.append((tag, outer[1], _OUT if no == _OUT else outer[2]))
            links[0] += tag == "a"
            continue
        flush()
        if tag in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[tag]:
                    cut(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        while stack and stack[-1][0] in _INLINE:
            cut(len(stack) - 1)
        outer = stack[-1] if stack else ("", "", _KEPT)
        name, no = _element(tag, m[4], any(t in ("article", "main") for t, _, _ in stack), names)
        stack.append((tag, f"{outer[1]}/{name}", max(outer[2], no)))
        elements.append(stack[-1][1])
    if at < len(page):
        rest = page[at:]
        cut = rest.rfind("<")
        text_of(rest if cut < 0 or not re.match(r"<[/!?a-zA-Z]", rest[cut:]) else rest[:cut])
    flush()
    return elements, blocks


def _block_is_out(stack) -> bool:
    return next((no == _OUT for tag, _, no in reversed(stack) if tag not in _INLINE), False)


def _host(url) -> str | None:
    if url is None:
        return None
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url)
    return (m[1].rpartition("@")[2] if m else url.partition("/")[0]).lower()


def text_key(path: str, text: str) -> bytes:
    """A block of text as a token: 128 bits of its path and text, however long it is."""
    return xxhash.xxh3_128_digest(f"{path}\n{text}")


def _root_shape(elements: list[str]) -> int:
    """Layout of a page: its set of containers down to two levels below the body, outside of the article; numbers in names do not tell layouts apart."""
    shape = set()
    for path in elements:
        steps = [x for x in path.split("/")[1:] if x != "html"]
        if 0 < len(steps) <= 3 and steps[-1].partition(".")[0] in _CONTAINER and not any(x.partition(".")[0] in ("article", "main") for x in steps[:-1]):
            shape.add(re.sub(r"[0-9]+", "0", "/".join(steps)))
    return xxhash.xxh3_64_intdigest("\n".join(sorted(shape))) >> 1 | 1  # 0 stands for the whole host


def _page_rows(it, names: bool):
    """(host, content, tokens): a page's tokens, packed, under a fingerprint of its texts, by which copies of a page are known."""
    for b in it:
        hosts, contents, packed = [], [], []
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            elements, blocks = read_page(page, names)
            mass: dict[str, int] = defaultdict(int)
            texts: dict[bytes, list] = {}
            for path, text, linked, no in blocks:
                if no != _OUT:
                    size = max(0, len(text) - 2 * linked)
                    mass[path] += size
                    row = texts.setdefault(text_key(path, text), [path, 0, 0])
                    row[1] += 1
                    row[2] += size
            counts: dict[str, int] = defaultdict(int)
            for path in elements:
                counts[path] += 1
            hosts.append(_host(url))
            contents.append(xxhash.xxh3_128_digest(b"".join(sorted(texts))))
            rows = [(path, n, mass.get(path, 0)) for path, n in counts.items()]
            packed.append(zlib.compress(marshal.dumps((_root_shape(elements), rows, [(k, *row) for k, row in texts.items()])), 1))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.binary()), pa.array(packed, pa.binary())], ["host", "content", "tokens"])


def _token_rows(it):
    """(host, layout, kind, token, path, pages, sum1, sum2, mass, once): a batch's share of each token's occurrence vector; mass is text outside links."""
    for b in it:
        found: dict[tuple, list] = {}
        for host, content, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            layout, elements, texts = marshal.loads(zlib.decompress(packed))
            for kind, token, path, n, size in (("n", b"", "", 1, 0), *(("e", path.encode(), path, n, m) for path, n, m in elements), *(("t", k, path, n, m) for k, path, n, m in texts)):
                h = xxhash.xxh3_64_intdigest(content + n.to_bytes(4))
                row = found.setdefault((host, layout, kind, token, path), [0, 0, 0, 0, True])
                row[0] += 1
                row[1] += h & 0xFFFFFFFF
                row[2] += h >> 32
                row[3] += size
                row[4] = row[4] and n == 1
        cols = list(zip(*((*k, *v) for k, v in found.items()), strict=True)) or [()] * 10
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "layout", "kind", "token", "path", *_SUMS, "once"])


_SUMS = ("pages", "sum1", "sum2", "mass")
_NAMED = re.compile(r"/(article|main)\b")


def _template(pdf: pd.DataFrame, names: bool = True) -> tuple[str | None, list[bytes]]:
    """(path of the root element that holds the content, texts of the template) of the pages of one layout or host from their frequent tokens."""
    classes = pdf.groupby(["sum1", "sum2"])["token"].transform("size")
    e = pdf[pdf["kind"] == "e"]
    # Valid: not alone, as chance occurrences are.
    t = pdf[(pdf["kind"] == "t") & (classes > 1)]
    root = e[e["once"] & (e["pages"] == e["pages"].max())]["path"].tolist()
    # Text that the template does not hold.
    own = e.set_index("path")["mass"].sub(t.groupby("path")["mass"].sum(), fill_value=0)
    under = lambda p: int(own[own.index.str.startswith(p + "/") | (own.index == p)].sum())
    mass = {p: under(p) for p in root}
    total = max(mass.values(), default=0)
    good = [p for p in root if total and mass[p] >= 0.6 * total]
    named = [p for p in good if names and _NAMED.search(p)]
    if named:  # the names break the tie among the elements that hold the text
        slot = min(named, key=lambda p: p.count("/"))
    elif names and total and own[own.index.str.contains(_NAMED.pattern.replace("(", "(?:"))].sum() >= 0.6 * total:
        slot = None  # several articles on a page
    else:
        slot = max(good, key=lambda p: p.count("/")) if good else None
    return slot, t["token"].tolist()


def deduce_templates(pages: DataFrame, least: int = 3, share: float = 0.5, names: bool = True) -> DataFrame:
    """t_host, slots, texts. Copies of a page count once, as what they share is no template. A token is the template's if it is on a share of the host's pages
    or of the pages of one layout, so that a group is as large as a few pages, however many it has."""
    rows = pages.select("url", "html").mapInArrow(lambda it: _page_rows(it, names), "host string, content binary, tokens binary").dropDuplicates(["host", "content"])
    rows = rows.mapInArrow(_token_rows, "host string, layout long, kind string, token binary, path string, pages long, sum1 long, sum2 long, mass long, once boolean")
    sums = [*(F.sum(c).alias(c) for c in _SUMS), F.min("once").alias("once")]
    vectors = rows.groupBy("host", "layout", "kind", "token", "path").agg(*sums)
    # A token with its layouts, so that texts that few pages have go before anything is written.
    vectors = vectors.groupBy("host", "kind", "token", "path").agg(*sums, F.collect_list(F.struct("layout", *_SUMS, "once")).alias("parts")).where((F.col("kind") != "t") | (F.col("pages") >= least))
    vectors = vectors.select("host", "kind", "token", "path", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("layout"), *_SUMS, "once")), "parts")).alias("part")).select("host", "kind", "token", "path", "part.*")
    vectors = materialize(vectors, "template-vectors")
    n = vectors.where("kind = 'n'").select(F.col("host").alias("n_host"), F.col("layout").alias("n_layout"), F.col("pages").alias("n"))
    frequent = vectors.where("kind != 'n'").join(n, F.col("host").eqNullSafe(F.col("n_host")) & (F.col("layout") == F.col("n_layout")))
    frequent = frequent.where((F.col("pages") >= share * F.col("n")) & ((F.col("kind") != "t") | (F.col("pages") >= least))).drop("n_host", "n_layout")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, texts = _template(pdf, names)
        return pd.DataFrame({"t_host": [pdf["host"].iloc[0]], "slot": [slot], "texts": [texts]})

    found = frequent.groupBy("host", "layout").applyInPandas(one, "t_host string, slot string, texts array<binary>")
    return found.groupBy("t_host").agg(F.sort_array(F.collect_set("slot")).alias("slots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("texts"))


def main_text(page: str | None, slots, texts: frozenset[bytes], names: bool = True) -> str:
    """The page's text in that of the slots which holds most of it, without the template's texts; by tag names, or whole, where it has no slot."""
    _, blocks = read_page(page, names)
    blocks = [(path, text, linked, no) for path, text, linked, no in blocks if no != _OUT and (not texts or text_key(path, text) not in texts)]
    mass = {s: sum(max(0, len(text) - 2 * linked) for path, text, linked, _ in blocks if path == s or path.startswith(s + "/")) for s in slots or ()}
    slot = max(mass, key=lambda s: (mass[s], s), default=None)
    if slot is not None and mass[slot]:
        inside = lambda path: path == slot or path.startswith(slot + "/")
    elif names and any(_NAMED.search(path) for path, _, _, _ in blocks):
        inside = _NAMED.search
    else:
        return " ".join(text for _, text, _, no in blocks if no == _KEPT)
    return " ".join(text for path, text, _, _ in blocks if inside(path))


def extract_main_text(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages. Without names the template alone decides: no class and no element says by its name that it is, or is not, content."""
    templates = materialize(deduce_templates(pages, names=names), "templates")

    def extract(it):
        known: dict[tuple, frozenset] = {}
        for b in it:
            out = []
            for page, slots, texts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                key = tuple(texts or ())
                if key not in known:
                    known = {} if len(known) > 256 else known
                    known[key] = frozenset(key)
                out.append(main_text(page, slots, known[key], names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    own = pages.select("page_id", "url", "html", F.lower(F.when(F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1)).otherwise(F.element_at(F.split("url", "/"), 1))).alias("host"))
    joined = own.join(templates, F.col("host").eqNullSafe(F.col("t_host")), "left").select("page_id", "url", "html", "slots", "texts")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op8_extract_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
