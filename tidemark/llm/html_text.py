"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of block elements above it.  Text length and
punctuation are summed per path and divided by the path's number of blocks; both ratios are smoothed
along the page and multiplied.  Tags, roles and names that speak of boilerplate scale a block's score
down, but never decide alone: the threshold comes from the spread of the ratios themselves, and the
blocks whose score exceeds it are the content nodes.  Blocks below it stay only beside content nodes:
paragraphs and headings of the same element, sentence-like lists, tables and captions among them.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, spare_name

#: Weights of the smoothing along the page, the centre in the middle.
KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)
#: The threshold: so many standard deviations of the fused ratio plus this share of the largest.
SPREAD, FLOOR = 0.8, 0.05
#: Characters from which a paragraph in front of the content nodes, outside of their element, belongs to them.
LEAD = 25
#: What a tag or role of boilerplate leaves of a score, and what a name leaves all of whose parts speak of it (of a
#: paragraph's or heading's score).
TAG_HINT, NAME_HINT, TEXT_HINT = 0.1, 0.2, 0.6

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td template tfoot th thead tr ul caption".split())
#: Their content is no markup, so it ends at their own end tag only.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in "script style title textarea iframe".split()}
#: Inline elements whose content isn't text; one that isn't closed ends with its parent.
_MUTE = frozenset("select svg object math canvas audio video button".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTED = frozenset("li dt dd td th caption figcaption blockquote pre summary legend address".split())
#: An opening tag closes an open one of these, up to the nearest element named second.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",))}
_OFF_TAGS = frozenset("nav aside footer form menu dialog head noscript template".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that speak of boilerplate.
_OFF_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login share sharing social related recommended recommendations popup modal overlay widget widgets toolbar pagination pager search copyright skip".split())
#: A name such as has-sidebar speaks of the page's layout, not of the element.
_LAYOUT_NAMES = frozenset("has with no without".split())
_MARKS = ".,;:!?"


class _Node:
    __slots__ = ("hint", "label", "mute", "parent", "tag")

    def __init__(self, tag: str, label: str, hint: float, mute: bool, parent: _Node | None):
        self.tag, self.label, self.hint, self.mute, self.parent = tag, label, hint, mute, parent


def _hint(tag: str, attributes: str) -> tuple[str, float]:
    """The class as part of the path label, and what the attributes leave of a score.  Names say less of a single
    paragraph or heading than of an element that holds others."""
    label, hint, least = "", 1.0, TEXT_HINT if tag == "p" or tag in _HEADING else NAME_HINT
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hint = 0.0
        elif name == "role" and value.lower() in _OFF_ROLES:
            hint = min(hint, TAG_HINT)
        elif name in ("class", "id"):
            for one in value.split():
                parts = [part.lower() for part in _NAME_PART.findall(one)]
                if parts and not _LAYOUT_NAMES & set(parts):
                    hint = min(hint, 1 - (1 - least) * sum(part in _OFF_NAMES for part in parts) / len(parts))
            if name == "class":
                label = "." + " ".join(sorted(value.split()))
    return label, hint


def blocks_of(page: str) -> list[tuple[_Node, str, int]]:
    """(innermost block element, text, characters inside links) of the page's non-empty blocks in order."""
    root = _Node("", "", 1.0, False, None)
    at, out, parts, links, link_chars = root, [], [], 0, 0
    position, n = 0, len(page)

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                block = at
                while block.mute:
                    block = block.parent
                out.append((block, text, link_chars))
            parts.clear()
        link_chars = 0

    def opened(tag: str) -> _Node | None:
        """The nearest open element of this tag."""
        up = at
        while up is not None and up.tag != tag:
            up = up.parent
        return up

    while position < n:
        found = _TAG.search(page, position)
        upto = found.start() if found else n
        if upto > position and not at.mute:
            parts.append(page[position:upto])
            link_chars += (upto - position) * links
        if found is None:
            break
        position = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (found[1] or found[4]) == "/", found[3] or found[6] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = _RAW[tag].search(page, position)
                position = end.end() if end else n
            continue
        if tag in _MUTE:
            if not closing and not attributes.endswith("/"):
                at = _Node(tag, at.label, at.hint, True, at)
            elif closing:
                at = up.parent if (up := opened(tag)) is not None else at
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        if tag not in _BLOCK or (at.mute and not closing):
            continue
        if closing:
            up = opened(tag)
            if up is None and at.mute:
                continue
            flush()
            at = up.parent if up is not None and up.parent is not None else at
            links = 0
            continue
        flush()
        while at.tag == "p":
            at = at.parent
        if tag in _CLOSES:
            closes, until = _CLOSES[tag]
            up, last = at, None
            while up.parent is not None and up.tag not in until:
                if up.tag in closes:
                    last = up
                up = up.parent
            at = last.parent if last is not None else at
        if tag in _VOID:
            continue
        if tag == "body":
            while at.parent is not None and at.tag != "html":
                at = at.parent
        label, hint = _hint(tag, attributes) if attributes else ("", 1.0)
        if tag in ("html", "body", "main"):
            hint = 1.0
        if tag in _OFF_TAGS or (tag == "header" and not re.search(r"/(article|main)\b", at.label)):
            hint = min(hint, TAG_HINT)
        at = _Node(tag, f"{at.label}/{tag}{label}", min(at.hint, hint), False, at)
    flush()
    return out


def fused_ratios(blocks: list[tuple[_Node, str, int]]) -> list[float]:
    """The smoothed text ratio of each block's path times its smoothed punctuation ratio."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text, _ in blocks:
        length[node.label] += len(text)
        marks[node.label] += sum(map(text.count, _MARKS))
        count[node.label] += 1
    half, n = len(KERNEL) // 2, len(blocks)

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0]] * half + values + [values[-1]] * half
        return [sum(w * padded[i + j] for j, w in enumerate(KERNEL)) for i in range(n)]

    text_ratio = smooth([length[b[0].label] / count[b[0].label] for b in blocks])
    mark_ratio = smooth([(marks[b[0].label] + 0.5) / count[b[0].label] for b in blocks])
    return [a * b for a, b in zip(text_ratio, mark_ratio, strict=True)]


def content_nodes(blocks: list[tuple[_Node, str, int]]) -> list[bool]:
    """Which blocks exceed the threshold; if names hide all of them, names count for nothing."""
    fused = fused_ratios(blocks)
    mean = sum(fused) / len(fused)
    threshold = SPREAD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)) + FLOOR * max(fused)
    over = [f * b[0].hint >= threshold for b, f in zip(blocks, fused, strict=True)]
    return over if any(over) else [f >= threshold and b[0].hint > TAG_HINT for b, f in zip(blocks, fused, strict=True)]


def _above(node: _Node) -> list[_Node]:
    """The elements above a block, the outermost first; text outside of all elements stands in the root alone."""
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out[::-1] or [node]


def _groups(blocks: list[tuple[_Node, str, int]]) -> list[tuple[int, int, _Node]]:
    """Runs (first, end, list) of listed blocks below one outermost list, table, figure or quote."""
    out: list[tuple[int, int, _Node]] = []
    for i, (node, _, _) in enumerate(blocks):
        top, up = None, node
        while up is not None:
            if up.tag in ("ul", "ol", "dl", "table", "figure", "dir") or (top is None and up.tag in _LISTED):
                top = up
            up = up.parent
        if top is None:
            continue
        if out and out[-1][2] is top and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1, top)
        else:
            out.append((i, i + 1, top))
    return out


def main_text(page: str | None) -> str:
    """The article of a page; empty for a null or empty page and for one without text.

    Beside the content nodes stay, below the lowest element that holds all of them and without a hint of boilerplate:
    paragraphs of an element that has a content node, lists, tables, captions and quotes that read like sentences or stand
    between content nodes and aren't mostly links, headings in front of something that stays, an `h1` before all of it, and
    paragraphs right before the first content node.
    """
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    keep = content_nodes(blocks)
    if not any(keep):
        return ""
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    common = _above(blocks[first][0])
    parents = set()
    for (node, _, _), content in zip(blocks, keep, strict=True):
        if content:
            above = _above(node)
            parents.add(id(above[-1]))
            k = 0
            while k < min(len(common), len(above)) and common[k] is above[k]:
                k += 1
            common = common[:k]
    place = common[-1]
    open_page = place.tag in ("", "html", "body")
    inside = [place in _above(node) for node, _, _ in blocks]
    marks = [sum(map(text.count, _MARKS)) for _, text, _ in blocks]
    groups = _groups(blocks)
    grouped = {i for low, high, _ in groups for i in range(low, high)}
    for i, (node, text, chars) in enumerate(blocks):
        if not keep[i] and inside[i] and i not in grouped and node.hint == 1 and node.tag not in _HEADING and id(node.parent) in parents:
            keep[i] = (node.tag == "p" or not open_page) and (marks[i] > 0 or chars <= 0.6 * len(text))
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    for low, high, _ in groups:
        rows = range(low, high)
        n, chars = high - low, sum(len(blocks[i][1]) for i in rows)
        linked = sum(blocks[i][2] for i in rows) > 0.5 * chars
        spoken = sum(marks[low:high]) >= 0.5 * n
        if all(inside[i] and blocks[i][0].hint == 1 for i in rows) and (spoken or (not linked and ((first < low and high <= last) or chars >= 40 * n))):
            for i in rows:
                keep[i] = True
    # Paragraphs right in front of the content nodes lead into them.
    for i in range(first - 1, -1, -1):
        node, text, _ = blocks[i]
        if node.hint == 1 and node.tag not in _HEADING and not (keep[i] or (node.tag == "p" and marks[i] > 0 and len(text) >= LEAD)):
            break
        if node.hint == 1 and node.tag == "p":
            keep[i] = inside[i] = True
    follows = False
    for i in range(len(blocks) - 1, -1, -1):
        node = blocks[i][0]
        if node.tag in _HEADING:
            keep[i] = node.hint == 1 and follows and (inside[i] or (i < first and node.tag == "h1"))
        elif keep[i] or node.hint == 1:
            follows = keep[i]
    if not any(keep[i] for i in range(first) if blocks[i][0].tag == "h1"):
        titles = [i for i in range(first) if blocks[i][0].tag == "h1" and blocks[i][0].hint == 1]
        for i in titles[-1:]:
            keep[i] = True
    return "\n".join(text for (_, text, _), kept in zip(blocks, keep, strict=True) if kept)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns, text and n_chars of every row; rows may repeat, any column may be null and others are ignored.
    An empty table gives an empty result."""
    bounded_batches(pages.sparkSession)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    source = F.col(html_column).cast("string").alias(spare_name(pages, "source"))
    return pages.select(*keep, source).mapInArrow(run, ", ".join([*kinds, "text string, n_chars long"]))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
