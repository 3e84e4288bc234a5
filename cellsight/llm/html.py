"""Op 4: main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags; scripts, styles and comments
of the markup give none. The first pass adds up the evidence of every block:
density of common words, length, share of link text, whether it stands in the
page's article, and whether an element around it names itself as furniture of
the page (an element that holds most of the page's prose is not believed). A
block is good, bad, or left open; headings and short blocks without
evidence against them are always left open. The second pass gives an open block
the label of the nearest decided neighbour in the same part of the page (a
heading: of the next one), of the part itself if nothing in it is decided.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from cellsight.llm.common import map_arrow
from cellsight.llm.quality import COMMON_WORDS

#: Limits of the first pass: link text, code points of a short block, share of common words.
MAX_LINKS = 0.5
SHORT_CHARS = 70
GOOD_DENSITY, POOR_DENSITY = 0.15, 0.06
#: What the evidence weighs, and the sums from which a block is good or bad.
LONG, DENSE, POOR, LINKED, LINKED_LIST = 1.0, 1.0, -2.0, -1.5, -3.0
IN_MAIN, BESIDE_MAIN, HINTED, NAMED = 1.0, -1.0, -1.5, -4.0
GOOD_FROM, BAD_FROM = 1.5, -1.0
#: An article with less than this share of the page's text outside furniture is a teaser and no evidence.
MAIN_SHARE = 0.3
#: An element that names itself as furniture is not believed if it holds this share of the page's prose and what stands
#: outside such elements is at most this share of its own; one that holds the article needs the first share only.
HOLDS_SHARE, OUTSIDE_SHARE = 0.6, 0.1
#: Common words say nothing on a page with less than this share of its prose in blocks that have some: its language is not listed.
LISTED_SHARE = 0.2
#: Names of tags and roles of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea select iframe object canvas audio video title noframes noembed button datalist map annotation annotation-xml desc metadata".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Heuristic: words of classes and ids that name furniture, and words that only hint at it.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu menus "
    "modal nav navbar navigation navi newsletter notice notices notification pager pagination paywall popup promo promotion promoted related reply replies respond responses share sharing sidebar sidebars "
    "signup sitemap sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar".split()
)
#: What these name is never taken for the page's text, however long it is.
APART_TAGS = frozenset("nav footer dialog search".split())
APART_WORDS = frozenset("comment comments commentlist respond responses reply replies footer disqus copyright".split())
HINT_WORDS = frozenset("disclaimer header menus overlay skip social tags warning widget widgets".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LIST_TAGS = frozenset(("li", "ul", "ol", "dd", "dt", "td", "th"))
STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words.split())

NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
PLAIN = re.compile(r"[^>\"']*+")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW_TAGS}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACES = re.compile(r"\s+")
OPEN, GOOD, BAD = 0, 1, 2
NOTHING, HINT, FURNITURE = 0, 1, 2


class Block(NamedTuple):
    text: str
    #: Share of the solid characters that stand in links.
    links: float
    tag: str
    in_main: bool
    #: NOTHING, HINT or FURNITURE: what the elements around it say.
    zone: int
    #: Number of the part of the page: it changes where an article or a zone begins or ends.
    part: int
    #: The furniture around it was named by a class outside the article.
    outer: bool


class Zone(NamedTuple):
    """An element that names itself as furniture or hints at it; ``within`` is the number of the one around it, or -1."""

    kind: int
    within: int
    outer: bool
    #: It is of a kind that is never the page's text.
    apart: bool


def kind_of(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """What an element says of itself: furniture of the page, a hint at it, or nothing; and whether it is never the page's text."""
    if tag in FURNITURE_TAGS or tag == "header" and not in_main:
        return FURNITURE, tag in APART_TAGS or any(APART_WORDS & {w.lower() for w in NAME_PARTS.findall(m[0])} for m in ATTRIBUTE.finditer(attributes))
    if not attributes or tag in ("html", "body") or tag in MAIN_TAGS and "omment" not in attributes:
        return NOTHING, False
    found = NOTHING
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return FURNITURE, True
        if name == "role" and value.strip().lower() in FURNITURE_ROLES:
            return FURNITURE, value.strip().lower() != "form"
        if name in ("class", "id", "aria-label", "itemtype"):
            words = {w.lower() for w in NAME_PARTS.findall(value)}
            if words & FURNITURE_WORDS:
                return FURNITURE, bool(words & APART_WORDS)
            if words & HINT_WORDS:
                found = HINT
    return found, False


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``(begin, end, name, ending, attributes)`` of every tag, and with an empty name of every comment and declaration, in linear time.

    A quoted value may hold ``>``. Once a quote has no end, quotes mean nothing in the rest of the page.
    """
    last, quotes, at = html.rfind(">"), True, 0
    while True:
        at = html.find("<", at)
        if at < 0:
            return
        if html.startswith("<!--", at):
            end = COMMENT_END.search(html, at + 4)
            yield at, end.end() if end else len(html), "", False, ""
            if not end:
                return
            at = end.end()
            continue
        m = NAME.match(html, at + 1)
        if not m:
            if html[at + 1 : at + 2] in ("!", "?", "/") and at + 2 < len(html):
                end = html.find(">", at + 2) + 1 or len(html)
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        if at > last:
            return
        end = m.end()
        while quotes:
            end = PLAIN.match(html, end).end()
            if html[end : end + 1] == ">":
                break
            close = html.find(html[end], end + 1) if end < len(html) else -1
            quotes = close >= 0
            end = close + 1
        if not quotes:
            end = html.find(">", m.end())
            if end < 0:
                return
        yield at, end + 1, m[1].lower(), html[at + 1] == "/", html[m.end() : end]
        at = end + 1


def read(html: str) -> tuple[list[Block], list[Zone], set[int]]:
    """Every block of the page in order, ``zone`` being the number of the zone around it (-1 for none); the zones; those that hold an article.

    An inline element of furniture gives a block of its own, and the block that it interrupts goes on after it. Work is
    linear: a tag looks at the innermost open zone of its name only.
    """
    blocks: list[Block] = []
    zones: list[Zone] = []
    holding: set[int] = set()
    parts: list[str] = []
    linked = links = main = part = last_part = nesting = 0
    tag_of, at = "body", 0
    endless: set[str] = set()
    opened: dict[str, int] = {}
    #: Open zones: number, tag, how many of that tag are open with it, open articles, open blocks, and what it interrupts.
    stack: list[tuple] = []
    of_tag: dict[str, list[int]] = {}

    def text(chunk: str) -> None:
        nonlocal linked
        if chunk:
            chunk = references.unescape(chunk)
            parts.append(chunk)
            if links:
                linked += len(SPACES.sub("", chunk))

    def close() -> None:
        nonlocal linked
        whole = SPACES.sub(" ", "".join(parts)).strip()
        if whole:
            zone = stack[-1][0] if stack else -1
            blocks.append(Block(whole, linked / max(len(whole) - whole.count(" "), 1), tag_of, main > 0, zone, part, False))
        parts.clear()
        linked = 0

    def new_part() -> None:
        nonlocal part, last_part
        part = last_part = last_part + 1

    def begin_zone(tag: str, kind: int, apart: bool, block: bool) -> None:
        nonlocal parts, linked
        held = None
        if not block and parts:  # it interrupts a block
            held = parts, linked, tag_of, part
            parts, linked = [], 0
        else:
            close()
        of_tag.setdefault(tag, []).append(len(stack))
        zones.append(Zone(kind, stack[-1][0] if stack else -1, not main and tag not in FURNITURE_TAGS and tag != "header", apart))
        stack.append((len(zones) - 1, tag, opened.get(tag, 0), main, nesting, held, block))
        new_part()

    def end_zones(down_to: int) -> None:
        """Zones from place ``down_to`` of the stack on end; interrupted blocks go on."""
        nonlocal parts, linked, tag_of, part
        while len(stack) > down_to:
            close()
            _, tag, *_, held, _ = stack.pop()
            of_tag[tag].pop()
            new_part()
            if held:
                parts, linked, tag_of, part = held

    for begin, end, tag, ending, attributes in tags_of(html):
        if begin < at:  # inside a raw element
            continue
        text(html[at:begin])
        at = end
        if not tag:
            continue
        if tag in RAW_TAGS:
            if not ending and (not attributes.endswith("/") or tag in ("script", "style", "title")) and tag not in endless:
                found = RAW_END[tag].search(html, at)
                if found:
                    at = html.find(">", found.end() - 1) + 1 or len(html)
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    endless.add(tag)
            continue
        block = tag in BLOCK_TAGS
        empty = tag in VOID_TAGS or attributes.endswith("/") and not block
        if ending:
            opened[tag] = max(0, opened.get(tag, 0) - 1)
            if block:
                nesting = max(0, nesting - 1)
        if of_tag.get(tag):  # the innermost zone of this name ends with its element, or where another begins that can't stand in it
            place = of_tag[tag][-1]
            if ending and opened[tag] < stack[place][2] or not ending and tag in ("p", "li") and stack[place][2] == opened.get(tag, 0):
                end_zones(place)
                if not ending:
                    opened[tag] = max(0, opened[tag] - 1)
        if block and stack:
            top = stack[-1]
            if top[1] == "p" or top[1] == "li" and ending and tag in ("ul", "ol") or ending and not top[6] and nesting < top[4]:
                end_zones(len(stack) - 1)  # a paragraph or list item that another tag ends; an inline element whose block ends
        if block:
            if stack and stack[-1][5] and not ending and tag in ("p", "li", *HEADINGS):
                end_zones(len(stack) - 1)  # an inline element left open in a paragraph
            close()
            links, tag_of = 0, "body" if ending else tag
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if ending else 1
        if tag in MAIN_TAGS:
            main = max(0, main + (-1 if ending else 1))
            if ending and stack and stack[-1][3] > main:  # left open in an article that ends
                place = len(stack) - 1
                while place and stack[place - 1][3] > main:
                    place -= 1
                end_zones(place)
            elif not ending and stack:
                holding.add(stack[-1][0])
            new_part()
        if not ending and not empty:
            opened[tag] = opened.get(tag, 0) + 1
            nesting += block
            kind, apart = kind_of(tag, attributes, main > 0)
            if kind:
                begin_zone(tag, kind, apart, block)
    if at < len(html):
        text(html[at:])
    end_zones(0)
    close()
    for number in range(len(zones) - 1, -1, -1):  # what an inner zone holds, the outer one holds too
        if number in holding and zones[number].within >= 0:
            holding.add(zones[number].within)
    return blocks, zones, holding


def believed(blocks: list[Block], zones: list[Zone], holding: set[int]) -> list[int]:
    """The kind of every zone, that of the zones around it included: furniture only if it doesn't hold the page's text.

    From the outermost on, a zone that holds most of the prose is nothing special if almost none stands outside such zones
    or if it holds the article. Of what is then nothing special, the prose counts as outside.
    """
    own = [0] * (len(zones) + 1)  # the last is for what stands in no zone
    for b in blocks:
        if len(b.text) >= SHORT_CHARS and b.links <= MAX_LINKS:
            own[b.zone] += len(b.text)
    whole, total, outside = own[:], sum(own), own[-1]
    for number in range(len(zones) - 1, -1, -1):
        if zones[number].within >= 0:
            whole[zones[number].within] += whole[number]
    out: list[int] = []
    for number, zone in enumerate(zones):
        around = out[zone.within] if zone.within >= 0 else NOTHING
        kind = zone.kind
        most = whole[number] > 0 and whole[number] >= HOLDS_SHARE * total
        if kind == FURNITURE and around != FURNITURE and not zone.apart and most and (number in holding or outside <= OUTSIDE_SHARE * whole[number]):
            kind = NOTHING
        out.append(max(kind, around))
        if out[-1] != FURNITURE:
            outside += own[number]
    return out


def blocks_of(html: str) -> list[Block]:
    """Every block of the page in order, those of furniture too, with what its zones say of it."""
    blocks, zones, holding = read(html)
    kinds = believed(blocks, zones, holding)
    outer: list[bool] = []  # whether the outermost furniture around is named outside the article
    for number, zone in enumerate(zones):
        inherited = zone.within >= 0 and kinds[zone.within] == FURNITURE
        outer.append(outer[zone.within] if inherited else kinds[number] == FURNITURE and zone.outer)
    return [b._replace(zone=kinds[b.zone], outer=outer[b.zone]) if b.zone >= 0 else b._replace(zone=NOTHING) for b in blocks]


def density(text: str) -> float:
    """Share of common words among a text's words, without the marks around them."""
    words = [w.strip(".,;:!?\"'()[]*#$%&|<>").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def main_is_evidence(blocks: list[Block]) -> bool:
    """Whether the page has an article that holds a fair share of its text outside furniture and links."""
    free = [(len(b.text), b.in_main) for b in blocks if b.zone != FURNITURE and b.links <= MAX_LINKS]
    inside = sum(n for n, m in free if m)
    return inside > 0 and inside >= MAIN_SHARE * sum(n for n, _ in free)


def is_listed(blocks: list[Block], common: list[float]) -> bool:
    """Whether a fair share of the page's prose has common words of a listed language, so that they can decide."""
    prose = [(len(b.text), c) for b, c in zip(blocks, common) if b.zone != FURNITURE and b.links <= MAX_LINKS and len(b.text) >= SHORT_CHARS]
    return sum(n for n, c in prose if c >= GOOD_DENSITY) > LISTED_SHARE * sum(n for n, _ in prose)


def evidence(block: Block, common: float, has_main: bool, listed: bool) -> float:
    """The sum of what speaks for a block (above zero) and against it; ``common``: its density. In a language that is not listed, length and links decide."""
    score = 0.0
    if len(block.text) >= SHORT_CHARS:  # the words of a short block say little
        score += LONG + (DENSE if common >= GOOD_DENSITY or not listed else POOR if common < POOR_DENSITY else 0.0)
    if block.links > MAX_LINKS:
        score += LINKED_LIST if block.tag in LIST_TAGS else LINKED
    if has_main:
        score += IN_MAIN if block.in_main else BESIDE_MAIN
    return score + (0.0, HINTED, NAMED)[block.zone]


def first_pass(blocks: list[Block]) -> list[int]:
    """GOOD, BAD or OPEN by the sum of evidence; headings and short blocks are never good by themselves."""
    has_main = main_is_evidence(blocks)
    common = [density(b.text) for b in blocks]

    def label(b: Block, c: float, listed: bool) -> int:
        score = evidence(b, c, has_main, listed)
        if score <= BAD_FROM and not (b.tag in HEADINGS and b.zone == NOTHING):
            return BAD
        return GOOD if score >= GOOD_FROM and b.tag not in HEADINGS and len(b.text) >= SHORT_CHARS else OPEN

    listed = is_listed(blocks, common)
    out = [label(b, c, listed) for b, c in zip(blocks, common)]
    if GOOD not in out:  # common words left nothing: length and links decide
        out = [label(b, c, False) for b, c in zip(blocks, common)]
    return out


def neighbours(labels: list[int], parts: list[int]) -> tuple[list[int | None], list[int | None]]:
    """The nearest decided block before and after each, within the same part."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, part = None, None
        for i in order:
            if parts[i] != part:
                last, part = None, parts[i]
            found[i] = last
            if labels[i] != OPEN:
                last = i
    return before, after


def inherit(i: int, before: int | None, after: int | None, labels: list[int], heading: bool) -> int:
    """Label of an open block from its decided neighbours; OPEN if there is none. Two at the same distance that differ: good."""
    if before is None and after is None:
        return OPEN
    if before is None or after is None:
        return labels[after if before is None else before]
    if heading or labels[before] == labels[after]:
        return labels[after]
    if i - before == after - i:
        return GOOD
    return labels[before if i - before < after - i else after]


def second_pass(labels: list[int], blocks: list[Block]) -> list[bool]:
    """Open blocks inherit within their part of the page; a part without a decided block stands as its place says.

    Furniture is then bad, an article good, and where the page has no article the nearest decided block of the page decides;
    a page without any keeps all.
    """
    has_main = main_is_evidence(blocks)
    near = neighbours(labels, [b.part for b in blocks])
    far = neighbours(labels, [0] * len(blocks))
    out = []
    for i, (label, b) in enumerate(zip(labels, blocks)):
        heading = b.tag in HEADINGS
        if label == OPEN:
            label = inherit(i, near[0][i], near[1][i], labels, heading)
        if label == OPEN:
            label = BAD if b.zone == FURNITURE else (GOOD if b.in_main else BAD) if has_main else inherit(i, far[0][i], far[1][i], labels, heading)
        out.append(label != BAD)
    return out


def judged(html: str | None) -> tuple[list[Block], list[int], list[bool]]:
    """Blocks, labels of the first pass, and which blocks stay."""
    blocks = blocks_of(html or "")
    if any(b.in_main and b.outer for b in blocks) and not any(b.in_main and b.zone != FURNITURE for b in blocks):
        # the only article stands inside an element whose class sounds like furniture
        blocks = [b._replace(zone=NOTHING) if b.in_main and b.outer else b for b in blocks]
    labels = first_pass(blocks)
    return blocks, labels, second_pass(labels, blocks)


def extract(html: str | None) -> str:
    """The main text: kept blocks joined by an empty line; empty for null, empty or text-free pages."""
    blocks, _, keep = judged(html)
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. Repeated rows stay, null ids and urls stay null, other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [extract(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    frame = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), pages[html_column].cast("string").alias("html"))
    return map_arrow(frame, run, "page_id long, url string, text string, n_chars long", "html")
