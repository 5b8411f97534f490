"""Main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens: its elements by their path of names, classes and ids, and its blocks
of text by path and content, articles included.  A token's occurrence vector says how often it stands in each
page of its host.  Tokens of a host with the same vector form an equivalence class.  A class is part of the template
if it is large and frequent (it has several tokens and stands in most pages of the host) and each of its tokens has
a single place in a page.  On a page it is valid if its tokens are all there in order and it nests with every larger
valid class: one lies within a single gap of the other.  What the template leaves between its tokens are slots.

The template decides on every page of its host.  Its element that holds most of the host's text, found from the
root down, is the slot that is extracted; text of the template itself is dropped.  In an article a line counts as
template text only if nearly all pages of the host have it, and not if such lines are most of the article, as on
hosts that serve one article many times.  What elements mean breaks ties: `article` and `main` weigh more in the choice,
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are never chosen
and are left out of the slot, and within it articles come before what stands beside them.

Vectors are never gathered: a vector is kept as the sum of a hash of each page and its count, so
classes come from two aggregations that combine before they shuffle, whatever a host's number of
pages.  The template of a host holds tokens of at least half of its pages, so it is as small as
a page, and pages are joined with it by host.

Reading takes time in proportion to the page, whatever is left open in it.

Defined results: a null or empty html gives an empty text; a host of fewer than three pages has no template, and its pages
are cut by the elements' meaning only; a null url is the host ''; repeated rows are separate pages.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Pages of a host, and share of them, in which a template's token must stand; in an article, the share for a text.
LEAST_PAGES, LEAST_SHARE, ARTICLE_SHARE = 3, 0.5, 0.95
#: Tokens of a template's class.
LEAST_TOKENS = 2
#: Share of a slot's text that the element to go on with must hold, and what an article's text counts.
MAIN_SHARE, ARTICLE_WEIGHT = 0.5, 4

#: Fixed by the HTML standard: elements without content, and elements whose content is raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
DROPPED = frozenset("head nav footer aside form script style noscript template svg math canvas button select option textarea title iframe object menu dialog noembed noframes xmp map audio video".split())
ARTICLES = frozenset(["article", "main"])
#: Elements that can hold a page's slots.
HOLDERS = frozenset("html body div section article main center table tbody tr td".split())
ROLES_DROPPED = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Whole class names and ids that say what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs masthead site-header page-header "
    "footer site-footer page-footer sidebar aside widget notice cookie cookies cookie-notice cookie-banner consent gdpr popup modal overlay newsletter subscribe signup login "
    "share sharing social comments comment-list comment reader-comments user-comments disqus_thread respond pagination pager toolbar".split()
)
NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
QUOTE = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Element:
    name: str
    path: int
    dropped: bool
    inside: bool  # of an article
    start: int  # number of its token


@dataclass
class Token:
    """An element's start (text None) or a block of text, with a number that is the same on all pages."""

    number: int
    text: str | None
    dropped: bool
    inside: bool
    name: str = ""
    parent: int = 0
    end: int = 0  # of an element, the number of the token behind its content


def _attributes(name: str, attributes: str) -> tuple[str, bool]:
    """What tells an element from others of its name, and whether it is never main text."""
    own, marked = [], name in DROPPED
    for kind, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        kind, words = kind.lower(), max(values, key=len).lower().split()
        if kind == "role":
            marked |= not ROLES_DROPPED.isdisjoint(words)
        else:
            marked |= not MARKS.isdisjoint(words)
            own.append(f"{kind}={' '.join(words)}")
    return " ".join([name, *own]), marked


def tags(page: str) -> Iterator[tuple[str, int, int, str, bool, str]]:
    """Text before a tag, where the tag begins and ends, its name ('' for comments and the end), if it closes, its attributes.

    A tag ends at the first > outside quotes; once no such > is left in the page, quotes no longer count."""
    at = text_from = 0
    quotes, last = True, page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            yield page[text_from:], len(page), len(page), "", False, ""
            return
        begin = at
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield page[text_from:begin], begin, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield page[text_from:begin], begin, end, "", False, ""
        else:
            m = NAME.match(page, at + 1)
            if not m:
                at += 1
                continue
            end = m.end()
            while quotes:
                q = QUOTE.search(page, end)
                if q is None:
                    quotes = False
                elif q[0] == ">":
                    end = q.start()
                    break
                else:
                    closed = page.find(q[0], q.end())
                    quotes, end = closed >= 0, closed + 1 if closed >= 0 else end
            if not quotes:
                end = page.find(">", m.end())
            end += 1
            resume = yield page[text_from:begin], begin, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
            if resume:  # behind the content of a raw element
                end = resume
                yield "", end, end, "", False, ""
        at = text_from = end


def parse(page: str) -> list[Token]:
    """Elements and blocks in page order.  Inline elements and unclosed paragraphs do not nest."""
    stack = [Element("", 0, False, False, -1)]
    opened: Counter = Counter()
    out: list[Token] = []
    pieces: list[str] = []

    def close_block() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                top = stack[-1]
                out.append(Token(zlib.crc32(text.encode("utf-8", "surrogatepass"), top.path) | 1 << 32, text, top.dropped, top.inside, parent=top.path))

    def pop() -> Element:
        top = stack.pop()
        opened[top.name] -= 1
        out[top.start].end = len(out)
        return top

    found = tags(page)
    resume = None
    while True:
        try:
            text, _, end, name, closing, attributes = found.send(resume)
        except StopIteration:
            break
        resume = None
        if text:
            pieces.append(text)
        if not name:
            continue
        own, marked = _attributes(name, attributes if not closing else "")
        if name in INLINE and not (marked and not closing):
            continue
        close_block()
        if closing:
            if opened[name]:
                while pop().name != name:
                    pass
            continue
        if name in ARTICLES:
            # an article inside a menu, header, footer or sidebar means that one was not closed
            while len(stack) > 1 and stack[-1].dropped and not stack[-1].inside:
                pop()
        top = stack[-1]
        path = zlib.crc32(own.encode("utf-8", "surrogatepass"), top.path)
        dropped = top.dropped or marked or (name == "header" and not top.inside)
        inside = top.inside or (name in ARTICLES and not dropped)
        out.append(Token(path, None, dropped, inside, name, top.path, len(out) + 1))
        if name in RAW:
            closed = re.compile(f"</{re.escape(name)}", re.I).search(page, end)
            resume = (page.find(">", closed.end()) + 1 or len(page)) if closed else len(page)
        elif name not in VOID and name != "p" and not attributes.endswith("/"):
            stack.append(Element(name, path, dropped, inside, len(out) - 1))
            opened[name] += 1
    close_block()
    while len(stack) > 1:
        pop()
    return out


TOKEN_COLUMNS = "host string, token long, page long, n long, place long, chars long, parent long, weight int, head int"


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, page, n, place, ...): how often, and first where, each token stands in a page; of an element also
    the characters of main text below it, its parent, what its text counts, and whether a first heading is below it."""

    def rows_of(page: str) -> dict[int, list[int]]:
        found = parse(page)
        chars, heads = [0], [0]
        for t in found:
            chars.append(chars[-1] + (len(t.text) if t.text is not None and not t.dropped else 0))
            heads.append(heads[-1] + (t.name == "h1" and not t.dropped))
        seen: dict[int, list[int]] = {}
        for place, t in enumerate(found):
            own = seen.get(t.number)
            if own is not None:
                own[0] += 1
            elif t.text is not None:
                seen[t.number] = [1, place, 0, t.parent, -1, 0]
            else:
                weight = 0 if t.dropped else ARTICLE_WEIGHT if t.name in ARTICLES else 1 if t.name in HOLDERS else -1
                seen[t.number] = [1, place, chars[t.end] - chars[place], t.parent, weight, int(heads[t.end] > heads[place])]
        return seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, url, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = (raw.as_py() or b"").decode("utf-8", "replace")
                mark = zlib.crc32(page.encode(), zlib.crc32((url or "").encode()))
                out += [(host, number, mark, *own) for number, own in rows_of(page).items()]
            kinds = [pa.string(), *[pa.int64()] * 6, pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["host", "token", "page", "n", "place", "chars", "parent", "weight", "head"])

    return map_batches(pages.select(_host_column().alias("host"), "url", F.col("html").cast("binary").alias("html")), run, TOKEN_COLUMNS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's classes in order, with their class and what the choice of slots needs."""
    tokens = page_tokens(pages)
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)"))  # one number for an occurrence vector
    per = tokens.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.avg("place").alias("place"), vector.alias("vector"),
        F.sum("chars").alias("chars"), F.max("parent").alias("parent"), F.max("weight").alias("weight"), F.max("head").alias("head"),
    )
    sizes = pages.select(_host_column().alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    # tokens of a single page are no template's, and most are
    frequent = per.where((F.col("pages") >= LEAST_PAGES) & (F.col("most") == 1)).join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("size"))
    frequent = frequent.withColumn("share", F.col("pages") / F.col("size"))
    member = F.struct("place", "token", "share", "chars", "parent", "weight", "head")
    classes = frequent.groupBy("host", "vector", "pages").agg(F.collect_list(member).alias("members")).where(F.size("members") >= LEAST_TOKENS)
    named = classes.select("host", F.xxhash64(F.col("vector").cast("string")).alias("class"), F.inline("members"))
    return named.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "token", "class", "share", "chars", "parent", "weight", "head"))).alias("template"))


def _host_column():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


@dataclass(frozen=True)
class Member:
    """A token of a host's template."""

    token: int
    kind: int  # its class
    share: float = 1.0  # of the host's pages
    chars: int = 0
    parent: int = 0
    weight: int = -1
    head: int = 0


def main_slot(template: list[Member]) -> int:
    """The path of the template's element that is extracted: from the root down, as long as one element holds most of
    the text and no first heading stands beside it.  0 is the whole page."""
    children: dict[int, list[Member]] = {}
    for m in template:
        if m.weight >= 0:
            children.setdefault(m.parent, []).append(m)
    at, whole, seen = 0, None, set()
    while at not in seen and (below := children.get(at)):
        seen.add(at)
        best = max(below, key=lambda m: (m.chars * m.weight, m.token))
        text = sum(m.chars * m.weight for m in below)
        loose = 0 if whole is None else max(0, whole - sum(m.chars for m in below))  # text beside these elements
        if not best.weight or best.chars * best.weight < MAIN_SHARE * (text + loose) or (best.weight < ARTICLE_WEIGHT and any(m.head for m in below if m is not best)):
            break
        at, whole = best.token, best.chars
        if best.weight == ARTICLE_WEIGHT:
            break
    return at


def _in_one_gap(inner: list[int], outer: list[int]) -> bool:
    """Of two lists of places in order, without a common one."""
    return bisect(outer, inner[0]) == bisect(outer, inner[-1])


def valid_classes(tokens: list[Token], template: list[Member]) -> list[list[Member]]:
    """The classes that hold on a page: all there, in order, and nested with every larger one that holds."""
    place: dict[int, int] = {}
    for k, token in enumerate(tokens):
        place.setdefault(token.number, k)
    classes: dict[int, list[Member]] = {}
    for m in template:
        classes.setdefault(m.kind, []).append(m)
    out, held = [], []
    for members in sorted(classes.values(), key=lambda c: (-len(c), [m.token for m in c])):
        at = [place.get(m.token, -1) for m in members]
        if min(at) >= 0 and at == sorted(at) and all(_in_one_gap(at, other) or _in_one_gap(other, at) for other in held):
            held.append(at)
            out.append(members)
    return out


def main_text(page: str, template: list[Member], slot: int | None = None) -> str:
    """The text of the slot that is kept; template in order of place, slot as main_slot(template) says."""
    tokens = parse(page)
    fixed = {m.token: m.share for members in valid_classes(tokens, template) for m in members}
    slot = main_slot(template) if slot is None else slot
    start = next((k for k, t in enumerate(tokens) if t.number == slot), -1) if slot in fixed else -1
    within = range(start + 1, tokens[start].end) if start >= 0 else range(len(tokens))
    kept = [tokens[k] for k in within if tokens[k].text is not None and not tokens[k].dropped]
    if not kept and start >= 0:  # a page of another kind than its host's others
        kept = [t for t in tokens if t.text is not None and not t.dropped]
    if any(t.inside for t in kept):
        kept = [t for t in kept if t.inside]
    article = [t for t in kept if t.inside and fixed.get(t.number, 0) >= ARTICLE_SHARE]
    if 2 * sum(len(t.text) for t in article) > sum(len(t.text) for t in kept):
        article = []
    gone = {t.number for t in article}
    return "\n".join(t.text for t in kept if t.number not in gone and (t.inside or t.number not in fixed))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    base = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    # written, so that its size is known: templates of few hosts are sent to the pages, which then need not move
    known = materialize(templates(pages), "templates").select(F.col("host").alias("__host"), "template")
    joined = base.withColumn("host", _host_column()).join(known, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, template, slot = None, [], 0
        for batch in batches:
            texts = []
            for k, (host, raw) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2), strict=True)):
                if host != last:
                    last = host
                    template = [Member(m["token"], m["class"], m["share"], m["chars"], m["parent"], m["weight"], m["head"]) for m in batch.column(4)[k].as_py() or []]
                    slot = main_slot(template)
                texts.append(main_text((raw.as_py() or b"").decode("utf-8", "replace"), template, slot))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
