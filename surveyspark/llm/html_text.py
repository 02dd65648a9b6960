"""Main text of HTML pages by tag-path ratios.

Every block of text is a leaf with a root-to-leaf tag path. Text length and
punctuation are summed per path, divided by the path's leaves, smoothed over the leaves
in page order and fused into one value a path. Tags and names of elements are
evidence that scales the value: much for what is named as a comment, advert, menu or
notice, little for words that also stand for parts of an article. Only elements that HTML
itself sets apart (``DROPPED``) are left out whatever their text.

Paths above a threshold hold content. Of the element around a content leaf (the article or
main element, else its parent) the rest belongs to the text as well: headings, lists, short
paragraphs; in an article or main element any block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# HTML elements by kind.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var br wbr img label".split()
)
DROPPED = set(
    "head title script style noscript template nav footer aside form button select textarea "
    "iframe object svg canvas audio video dialog menu".split()
)
CONTENT = ("article", "main")
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "menu", "select")
TEXT_TAGS = set(
    "h1 h2 h3 h4 h5 h6 hgroup header p ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption".split()
)
# How much a path with such a word in a class, id or role counts.
STRONG, WEAK = 0.05, 0.5
_STRONG_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|menu|"
    r"nav\w*|breadcrumbs?|sidebar|comments?|comment\w+|repl(?:y|ies)|opinions?|discussion|talkback|disqus|"
    r"footer|subscribe|newsletter|login|signup)(?:$|[\s_-])", re.I,
)
_WEAK_NAME = re.compile(
    r"(?:^|[\s_-])(?:header|masthead|search|social|shar(?:e|ing)|widgets?|related|modal)(?:$|[\s_-])", re.I
)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟¿¡]")


def evidence(tag: str, named: str, inside: bool) -> float:
    """How much an element's text counts by its tag and names; ``inside``: of an article or main element."""
    if tag in DROPPED or (tag == "header" and not inside):
        return 0.0
    if tag in ("html", "body", *CONTENT) or not named:
        return 1.0
    if _STRONG_NAME.search(named):
        return STRONG
    return WEAK if _WEAK_NAME.search(named) else 1.0


class Leaves(HTMLParser):
    """Blocks of text in page order: (path, evidence, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, float]] = []  # tag, name on the path, evidence
        self.blocks: list[tuple[tuple[str, ...], float, str]] = []
        self.text: list[str] = []

    def above(self) -> float:
        return self.stack[-1][2] if self.stack else 1.0

    def end_block(self) -> None:
        if self.text:
            if found := " ".join("".join(self.text).split()):
                path = tuple(name for tag, name, _ in self.stack if tag not in INLINE)
                self.blocks.append((path, self.above(), found))
            self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.text.append(" ") if tag in INLINE else self.end_block()
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        if tag not in INLINE:
            self.end_block()
        if tag in CLOSES_P:
            self.leave("p", (*LISTS, "td", "th", "article", "body"))
        for sibling in SIBLINGS.get(tag, ()):
            self.leave(sibling, LISTS)
        own = evidence(tag, named, any(t in CONTENT for t, _, _ in self.stack))
        # An inline element of another kind (an advert link) is a block of its own.
        if tag in INLINE and own <= STRONG < self.above():
            self.end_block()
        words = named.split()
        self.stack.append((tag, f"{tag}.{words[0]}" if words else tag, min(own, self.above())))

    def leave(self, tag: str, within: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.end_block()
                del self.stack[k:]
                return
            if self.stack[k][0] in within:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                below = self.stack[k - 1][2] if k else 1.0
                if tag not in INLINE or self.above() <= STRONG < below:
                    self.end_block()
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.text.append(data)


def content_paths(leaves: list[tuple[tuple[str, ...], float, str]], share: float = 0.5) -> set[tuple[str, ...]]:
    """Paths whose smoothed and fused ratio reaches ``share`` of the mean over all text."""
    totals: dict[tuple[str, ...], np.ndarray] = {}
    for path, _, text in leaves:
        found = totals.setdefault(path, np.zeros(3))
        found += (len(text), len(_PUNCTUATION.findall(text)), 1)
    ratios = np.array([totals[p][:2] / totals[p][2] for p, _, _ in leaves])
    window = np.array([1.0, 2.0, 1.0])
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(ratios)] for k, w in enumerate(window)) / window.sum()
    fused = smooth[:, 0] * (1 + smooth[:, 1]) * np.array([e for _, e, _ in leaves])
    by_path: dict[tuple[str, ...], list[float]] = {}
    for (path, _, _), value in zip(leaves, fused):
        by_path.setdefault(path, []).append(value)
    limit = share * np.average(fused, weights=[len(t) for _, _, t in leaves])
    return {p for p, values in by_path.items() if np.mean(values) >= limit}


def _tag(name: str) -> str:
    return name.split(".", 1)[0]


def _around(path: tuple[str, ...]) -> tuple[str, ...]:
    """The outermost article or main element on the path, else the leaf's parent."""
    depth = next((k + 1 for k, name in enumerate(path) if _tag(name) in CONTENT), max(len(path) - 1, 0))
    return path[:depth]


def main_text(html: str, paths=content_paths) -> str:
    parser = Leaves()
    parser.feed(html)
    parser.close()
    parser.end_block()
    leaves = [block for block in parser.blocks if block[1] > 0]
    if not leaves:
        return ""
    chosen = paths(leaves)
    around = {_around(p) for p in chosen}
    marked = {own for own in around if own and _tag(own[-1]) in CONTENT}
    out = []
    for path, own_evidence, text in leaves:
        held = [own for own in marked or around if path[: len(own)] == own]
        # What is named as something else has to be content by itself.
        belongs = path in chosen if own_evidence <= STRONG else bool(
            marked or path in chosen or any(all(_tag(n) in TEXT_TAGS for n in path[len(own) :]) for own in held)
        )
        if held and belongs:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row; text is empty if there is none.

    Null or empty html gives the empty text. Broken markup is read as far as it can be;
    a tag left open at the end ends there. White space inside a block, no-break spaces
    included, becomes one space, and so does <br>. Repeated rows give repeated rows, an
    empty table gives none, other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = max(1, min(500, 16_000_000 * batch.num_rows // max(1, batch.column(2).nbytes)))
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = [main_text(h or "") for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
