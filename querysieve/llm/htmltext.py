"""The main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags.  The first pass decides on each block alone: what stands in a menu, page
header, footer, sidebar, form, notice, advert or comment section is boilerplate, as is a block that is mostly links or a
copyright line; a long block rich in stop words is content; long blocks poor in them, and all short ones, are open (of the
former only neighbours in the same container count).  In
the second pass open blocks take the label of their nearest decided neighbours, neighbours of the same container first;
on a page without decided content open blocks are content.
Where a page marks its article and that holds content, blocks beside the article are boilerplate, and open blocks in it
are content unless a neighbour in it says otherwise.

Everything is per page: one scan, no shuffle, memory of a task is that of its longest page.

Edge cases: a null or empty page and one without content have an empty text; null page_ids and urls pass through; rows
that repeat are extracted each; columns other than page_id, url and html aren't read; tags left open, closed twice or cut
off by the end of the page are taken as browsers do, what follows an unclosed comment, script or style belongs to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import slices

SHORT, LONG = 70, 200  # characters: below SHORT a block is open, from LONG on stop words alone decide
FEW_STOPS, MANY_STOPS = 0.12, 0.2  # share of stop words among words
LINKED = 0.33  # share of characters in links from which a block is boilerplate
ROWS = 64  # pages a worker holds at once

# Frequent words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an which you were they one all their has would
    der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou
    el los y del las por con para una su al lo como más o pero sus le ha me si sin sobre este ya entre
    """.split()
)
# Elements by their part in a page.
SKIPPED = frozenset("script style head noscript template svg math iframe object select textarea canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav aside footer form menu button fieldset legend label dialog search".split())
INLINE = frozenset("abbr b bdi big cite code del dfn em font i ins kbd mark q s small span strong sub sup time tt u var".split())
CLOSES_ALONE = frozenset("p li dt dd td th tr option".split())  # end where the next one, or their container, begins or ends
# Words of class, id and role that name boilerplate, and headings that open a comment section.
NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions nav navbar navigation menu menus submenu breadcrumb
    breadcrumbs pagination pager footer masthead banner sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus discussion toolbar
    contentinfo complementary search searchbox form skip hidden copyright disclaimer legal paywall trending popular
    """.split()
)
PAGE_HEADS = frozenset("header topbar".split())  # boilerplate only outside the article
COMMENT_HEADS = frozenset("comments comment kommentare commentaires comentarios responses reactions discussion replies".split())

TAG_END = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")  # a sign > in a quoted value doesn't end a tag
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)


@dataclass(slots=True)
class Block:
    text: str
    linked: float  # share of its characters in links
    bad: bool  # in a boilerplate container
    level: int  # 2 in an article, 1 in the main part, 0 elsewhere
    heading: bool
    scope: int  # which container holds it


@dataclass(slots=True)
class Open:
    """An element that hasn't ended."""

    name: str
    own: bool  # boilerplate by itself
    bad: bool  # by itself or by what it stands in
    level: int
    scope: int


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def named_so(name: str, source: str, level: int) -> bool:
    """Whether the element's name or attributes call it boilerplate."""
    if name in BOILERPLATE or (name == "header" and not level):
        return True
    if not source or source.isspace():
        return False
    own = attributes(source)
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    words = {w.lower() for key in ("class", "id", "role", "itemtype") for w in PARTS.findall(own.get(key, ""))}
    return bool(words & NAMES) or (not level and bool(words & PAGE_HEADS))


def blocks(html: str) -> Iterator[Block]:
    """The page's blocks in order, in one pass over its characters."""
    stack: list[Open] = [Open("", False, False, 0, 0)]
    counts: dict[str, int] = {}
    parts: list[str] = []  # pieces of the block so far, and how many of their characters are linked
    links = linked = scopes = 0
    heading = silent = False
    silent_from = linked_from = 0
    at, n = 0, len(html)

    def ended() -> Block | None:
        nonlocal linked, silent, silent_from
        text = " ".join(unescape("".join(parts)).split())
        share = min(1.0, linked / max(1, sum(len(p.strip()) for p in parts)))
        parts.clear()
        linked = 0
        if not text:
            return None
        top = stack[-1]
        if heading and not silent and " ".join(WORD.findall(text.lower())).removeprefix("reader ") in COMMENT_HEADS:
            silent, silent_from = True, len(stack) - 1  # until the container of the heading ends
        return Block(text, share, top.bad or silent, top.level, heading, top.scope)

    def pop() -> None:
        nonlocal silent, links
        counts[stack.pop().name] -= 1
        silent = silent and len(stack) >= silent_from
        links = links if len(stack) >= linked_from else 0  # a link left open ends with what holds it

    while at < n:
        tag = html.find("<", at)
        tag = n if tag < 0 else tag
        if tag > at:
            parts.append(html[at:tag])
            if links:
                linked += len(html[at:tag].strip())
        if tag == n:
            break
        after = html[tag + 1 : tag + 2]
        if html.startswith("<!--", tag):
            at = html.find("-->", tag + 4)
            at = n if at < 0 else at + 3
            continue
        if after in ("!", "?"):
            at = html.find(">", tag)
            at = n if at < 0 else at + 1
            continue
        closing = after == "/"
        found = NAME.match(html, tag + 1 + closing)
        if not found:  # a sign, not a tag
            parts.append("<")
            at = tag + 1
            continue
        name = found[0].lower()
        end = TAG_END.match(html, found.end())
        if not end:
            break  # cut off within a tag
        source, at = html[found.end() : end.end() - 1], end.end()
        if name in SKIPPED and not closing:
            if not source.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
            continue
        if name in BLOCKS:
            if block := ended():
                yield block
            heading = name in HEADINGS and not closing
        elif name == "br":
            parts.append(" ")
        if name == "a":
            links, linked_from = (0, 0) if closing else (1, len(stack))
        if name in VOID or name == "a":
            continue
        if closing:
            if counts.get(name, 0):
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if name in BLOCKS and counts.get("p", 0):  # only inline elements can be open above it
            while stack[-1].name != "p":
                pop()
            pop()
        if name in CLOSES_ALONE and name != "p":
            above = len(stack) - 1
            while stack[above].name in INLINE:
                above -= 1
            while stack[above].name == name and len(stack) > above + 1:
                pop()
            if stack[above].name == name:
                pop()
        if source.endswith("/") and name not in BLOCKS:
            continue
        top = stack[-1]
        level = max(top.level, {"article": 2, "main": 1}.get(name, 0), 1 if 'role="main"' in source else 0)
        own = named_so(name, source, level)
        # An article isn't part of a form or menu: that one was left open, or holds the whole page.
        freed = level > top.level and all(o.name in ("form", "header", "nav") for o in stack if o.own)
        scopes += 1
        stack.append(Open(name, own, own or (top.bad and not freed), level, top.scope if name in INLINE or name in HEADINGS or name == "p" else scopes))
        counts[name] = counts.get(name, 0) + 1
    if block := ended():
        yield block


def first_label(block: Block, by_stops: bool) -> bool | None:
    """True for content, False for boilerplate, None for open."""
    if block.bad or (block.linked > LINKED and not (block.heading and block.level)):
        return False
    if not block.level and RIGHTS.search(block.text):
        return False
    if block.heading or len(block.text) < SHORT:
        return None
    if not by_stops:  # no stop word on the whole page: another language
        return True if len(block.text) >= LONG else None
    stops = stop_share(block)
    return True if stops >= MANY_STOPS or (stops >= FEW_STOPS and len(block.text) >= LONG) else None


def stop_share(block: Block) -> float:
    words = WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def labels(found: list[Block]) -> list[bool]:
    """Both passes over a page's blocks."""
    by_stops = any(w in STOP_WORDS for b in found for w in WORD.findall(b.text.lower()))
    first = [first_label(b, by_stops) for b in found]
    level = max((b.level for b, said in zip(found, first) if said), default=0)
    if not level:  # an article of open blocks only is still one
        level = max((b.level for b, said in zip(found, first) if said is None), default=0) if not any(first) else 0
    for k, b in enumerate(found):
        if b.level < level:
            title = b.heading and first[k] is None and k + 1 < len(found) and found[k + 1].level == level
            first[k] = first[k] if title else False
    if not any(first):  # nothing is decided content: what nothing speaks against is
        return [said is None for said in first]
    before = nearest(found, first, range(len(found)))
    behind = nearest(found, first, range(len(found) - 1, -1, -1))
    out = []
    for k, (b, said) in enumerate(zip(found, first)):
        near = [before[k], behind[k]]
        if said is None and by_stops and not b.level and not b.heading and len(b.text) >= SHORT and stop_share(b) < FEW_STOPS:
            # Long and without stop words: content only among content of its own container.
            near = [x if x and x[0] < len(found) else None for x in near]
        out.append(said if said is not None else inherit(b, level, *near))
    return out


def nearest(found: list[Block], first: list[bool | None], order: range) -> list[tuple[int, bool] | None]:
    """By block the distance and label of the last decided one in that direction; one in another container is further."""
    out: list[tuple[int, bool] | None] = [None] * len(found)
    anywhere: int | None = None
    inside: dict[int, int] = {}
    for k in order:
        same = inside.get(found[k].scope)
        if same is not None:
            out[k] = (abs(k - same), bool(first[same]))
        elif anywhere is not None:
            out[k] = (abs(k - anywhere) + len(found), bool(first[anywhere]))
        if first[k] is not None:
            anywhere = inside[found[k].scope] = k
    return out


def inherit(block: Block, level: int, before: tuple[int, bool] | None, behind: tuple[int, bool] | None) -> bool:
    default = block.level == level > 0
    if before is None and behind is None:
        return default
    if block.heading and behind is not None:  # a heading goes with what follows
        return behind[1] or (default and behind[0] >= 2)
    if before is None or behind is None or before[1] == behind[1]:
        near = before or behind
        return near[1] or default
    if before[0] == behind[0]:
        return True if level else default
    return min(before, behind)[1] or default


def main_text(html: str) -> str:
    found = list(blocks(html))
    return "\n\n".join(b.text for b, content in zip(found, labels(found)) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS):
        texts = [main_text(html or "") for html in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
