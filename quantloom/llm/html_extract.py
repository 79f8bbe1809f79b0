"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: every start and end of a block breaks the line, so that empty lines show how far apart two
blocks stand. The text lengths of the lines, text of links not counted, are summed over a sliding window; where the sum
ahead of a line rises to the page's threshold the text surges, where the sum behind it falls below it dives, and the
text between is content. The threshold is half of the root mean square of the page's own sums. A stretch goes on
over lines one break apart, and across a gap that is not mostly links.

The sums decide on every page; names set what a line counts. Lines of containers named as no article (menus, headers,
footers, sidebars, notices, adverts, comments of readers) and of scripts, styles and forms count nothing and leave no
gap. Where a page names its article, lines outside it count nothing, and a line inside with text outside links counts as
much as the threshold at least; headings there count in full, so that only stretches of bare links dive. A class or id
names a container if it consists of such a name and words on place or shape ("site-footer", not "has-sidebar" or
"copyright-law"), and not if the container holds most of the page's text outside links, comments of readers excepted. An
article inside a dropped container goes with it, unless that container is never closed or the page has no other text.

Results for odd input: null or empty html and pages without text give an empty text and 0 characters;
unclosed and misnested tags never raise; an unclosed quote in a tag ends at the next '>'; pages of any
length are read whole; repeated rows are extracted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

# Element names and the words in class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object option select svg template canvas audio video math".split())
ARTICLE = frozenset("article main".split())
BOILER = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments commentlist "
    "discussion disqus replies nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended recommendations footer header masthead toolbar pagination pager "
    "copyright disclaimer widget complementary contentinfo search skip".split()
)
READER = frozenset("comment comments commentlist discussion disqus replies".split())
#: Inside a named article these words also name parts of the article itself.
OUTSIDE_ONLY = frozenset("header masthead search skip widget".split())
#: Words on place and shape that may stand beside these in a class or id; one with another word names something else.
BESIDE = frozenset(
    "area article bar blog block body bottom box button buttons center col column container content desktop entry fixed form global group horizontal icons "
    "inner item items layer left link links list main mobile module outer page panel parent post posts primary reply respond right row secondary section side "
    "site slot sticky story sub thread title top unit vertical view wrap wrapper".split()
)
DENIAL = frozenset("has hide is no not show with without".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
WINDOW = 3
THRESHOLD = 0.5  # of the root mean square of the page's window sums
#: Elements whose end tag may be left out: the end of their parent closes them.
OPTIONAL_END = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marks(attributes: str) -> frozenset:
    """Names of no article in class, id and role."""
    words: set[str] = set()
    for m in _MARK.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [x for x in _SPLIT.split(name) if x]
            telling = BOILER.intersection(parts)
            if telling and not DENIAL.intersection(parts) and all(x in BOILER or x in BESIDE or len(x) == 1 or any(c.isdigit() for c in x) for x in parts):
                words |= telling
    return frozenset(words)


def block_lines(html: str, ended: frozenset | None = frozenset(), content: frozenset = frozenset()) -> tuple[list[str], list[int], list[bool], bool, frozenset, dict[int, int]]:
    """Lines in page order, their characters outside links, whether each is in a named article, whether the page names
    one, the places of dropped containers that are never closed and hold an article, and the characters outside links of
    each container dropped for its class or id alone. An article ends the dropped containers it is in if all of them are
    in `ended` (or if that is None); else it is dropped with them. Containers at the places `content` are not dropped."""
    lines: list[str] = []
    plain: list[int] = []
    linked: list[str] = []
    inside: list[bool] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, drops its text, drops as readers' comments, is an article, place
    named, at = False, 0
    holding: set[int] = set()  # dropped containers that hold an article
    unclosed: set[int] = set()
    held: dict[int, int] = {}

    def left_open(entries: list) -> None:
        unclosed.update(x[4] for x in entries if x[4] in holding and x[0] not in OPTIONAL_END)

    def end_line() -> None:
        line = " ".join(unescape("".join(text)).split()) if text else ""
        links = " ".join(unescape("".join(linked)).split()) if linked else ""
        text.clear()
        linked.clear()
        lines.append(line)
        plain.append(max(0, len(line) - len(links)))
        inside.append(bool(line) and any(x[3] for x in stack))

    def add(part: str) -> None:
        drop = next((x for x in stack if x[1]), None)
        if drop is None:
            text.append(part)
            if any(x[0] == "a" for x in stack) and not (any(x[3] for x in stack) and any(x[0] in HEADING for x in stack)):
                linked.append(part)
        elif drop[4] in held and not any(x[0] == "a" or x[0] in DROPPED for x in stack):
            held[drop[4]] += len(part.strip())

    def no_gap() -> None:
        """What was dropped leaves neither text nor empty lines."""
        while lines and not lines[-1]:
            for x in (lines, plain, inside):
                x.pop()

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[1]:
            continue
        name = m[3] or m[6]
        if not name:
            continue
        name, attributes = name.lower(), m[4] or m[7] or ""
        if m[2] or m[5]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name not in INLINE:
                end_line()
            if place >= 0 and (name not in INLINE or place == len(stack) - 1 or all(x[0] in INLINE for x in stack[place:])):
                dropped = any(x[1] for x in stack[place:])
                left_open(stack[place + 1 :])
                del stack[place:]
                if dropped and not any(x[1] for x in stack):
                    no_gap()
            continue
        if name in INLINE and not attributes:
            if name not in VOID:
                stack.append((name, False, False, False, m.start()))
            continue
        if name not in INLINE:
            end_line()
            while stack and (stack[-1][0] in ("p", *INLINE) or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                if stack.pop()[1] and not any(x[1] for x in stack):
                    no_gap()
        if name in VOID:
            continue
        marks = _marks(attributes) if attributes else frozenset()
        readers = bool(marks & READER)
        if name in ARTICLE and not readers and not any(x[2] for x in stack):
            within = {x[4] for x in stack if x[1]}
            if within and ended is not None and not within <= ended:
                holding |= within
                stack.append((name, False, False, False, m.start()))
                continue
            named = True
            if within:  # a container left open before the article ends there
                del stack[next(i for i, x in enumerate(stack) if x[1]) :]
            stack.append((name, False, False, True, m.start()))
            continue
        if any(x[3] for x in stack):
            marks -= OUTSIDE_ONLY
        drops = name in DROPPED or name == "header" and not any(x[3] for x in stack) or bool(attributes and _HIDDEN.search(attributes))
        if marks and not drops and name not in ("html", "body") and m.start() not in content:
            drops = True
            if not readers and not any(x[1] for x in stack):
                held[m.start()] = 0
        stack.append((name, drops, readers, False, m.start()))
    if at < len(html):
        add(html[at:])
    end_line()
    left_open(stack)
    return lines, plain, inside, named, frozenset(unclosed), held


def surge_and_dive(lengths: list[int], plain: list[int], window: int = WINDOW, threshold: float = THRESHOLD, article: bool = False) -> list[tuple[int, int]]:
    """[surge, dive) stretches of a page. `lengths`: characters of each line, `plain`: those outside links. A page whose
    text is all links has none outside, so its lines count in full. article: all lines are in a named article, and each
    one that counts at all reaches the threshold."""
    if not any(lengths):
        return []
    sizes = np.array(plain if any(plain) else lengths, float)
    total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(window - 1), sizes, np.zeros(window - 1)]))])
    sums = total[window:] - total[:-window]  # sums[i]: lines i - window + 1 .. i; sums[i + window - 1]: lines i .. i + window - 1
    enough = sums >= threshold * np.sqrt((sums[sums > 0] ** 2).mean())
    full = np.array(lengths) > 0
    content = full & (enough[: len(sizes)] | enough[window - 1 :])
    if article:
        content |= sizes > 0
    at = np.flatnonzero(full)
    near = np.diff(at) <= 2  # at most one empty line between
    block = np.concatenate([[0], np.cumsum(~near)])
    kept = np.bincount(block, content[at]) > 0  # a stretch goes on over lines one break apart
    first, last = np.flatnonzero(kept)[[0, -1]]
    texts, outside = (np.bincount(block, np.array(x)[at]) for x in (lengths, plain))
    gap = first
    for b in range(first, last + 1):
        if not kept[b]:
            continue
        if b > gap + 1 and 2 * outside[gap + 1 : b].sum() >= texts[gap + 1 : b].sum():
            kept[gap + 1 : b] = True
        gap = b
    out: list[tuple[int, int]] = []
    for b in np.flatnonzero(kept).tolist():
        rows = at[block == b]
        out.append((int(rows[0]), int(rows[-1]) + 1))
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found = block_lines(html)
    if found[4]:
        found = block_lines(html, found[4])
    lines, plain, inside, named, unclosed, held = found
    if not named and held:
        place, most = max(held.items(), key=lambda x: x[1])
        if 2 * most > sum(plain) + sum(held.values()):
            found = block_lines(html, unclosed, frozenset([place]))
    if not any(found[0]):
        found = block_lines(html, None)
    lines, plain, inside, named, _, _ = found
    named = named and any(inside)
    if named:
        lines, plain = [x if y else "" for x, y in zip(lines, inside, strict=True)], [x if y else 0 for x, y in zip(plain, inside, strict=True)]
    stretches = surge_and_dive([len(x) for x in lines], plain, article=named)
    return " ".join(x for a, b in stretches for x in lines[a:b] if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: a narrow map over whole pages, no shuffle."""

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
