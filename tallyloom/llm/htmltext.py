"""Main text of web pages by a linear-chain conditional random field over a page's leaf blocks.

A page is cut into blocks at the boundaries of block-level elements; comments, scripts, styles and other elements whose content isn't text give none. Each block has features of its ancestors (tags, and the words of their class, id and role) and of its text (length, share of links, punctuation, words of short blocks, place in the page); each pair of neighbours has features of whether they share a container and of where headings begin. The field is trained by its likelihood (forward and backward sums over all pages at once) on labelled pages, a bounded number of which comes from `labelledpages`, and labels are decoded by Viterbi. Tasks only get the weights, some thousands of numbers whatever the table. Pages are judged one by one, so nothing is shuffled.

Defined results: a null or empty page, or one without main text, has the empty text; a null id or address is passed on; repeated rows get the same text each; character references are decoded once, unknown ones stay as they are; `br` is white space inside a block; an end tag without a start is ignored and open elements end with the page, and an unclosed comment, script or style hides the rest of it; ties between two ways of labelling go to leaving blocks out; pages of any length are read whole, one page or 2 MB at a time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, slices, table
from tallyloom.llm.hashedtext import Adam
from tallyloom.llm.labelledpages import labelled_pages

#: Labelled pages that the query's model is fitted on, and steps of the fit.
PAGES, STEPS = 1000, 200
#: Open elements around a block that its features are of; pages rarely nest as deep.
NEAR = 48
#: Paths of ancestors whose scores a worker remembers.
REMEMBERED = 20_000

#: Elements of HTML by what they mean for blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea".split())
UNSEEN = frozenset("title svg math canvas object audio video select datalist".split())
HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same group, and where the search for it stops.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>""", re.S)
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple  # (tag, words of its names) of each ancestor near it, outermost first
    linked: float  # share of the text inside links
    bold: bool


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that name an element's part, each once."""
    out: dict[str, None] = {}
    for name, *values in NAMES.findall(attributes) if "=" in attributes or "hidden" in attributes.lower() else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out["hidden"] = None
        elif name not in ("style", "aria-hidden"):
            out |= dict.fromkeys(w.lower() for w in PARTS.findall(value))
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks of text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = bold = links = strong = unseen = 0

    def close() -> None:
        nonlocal pieces, linked, bold
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            out.append(Block(text, tuple(e for e in stack[-NEAR:] if e[0] not in INLINE), linked / len(text), bold > 0))
        pieces, linked, bold = [], 0, 0

    def pop(to: int) -> None:
        nonlocal links, strong, unseen
        for tag, _ in stack[to:]:
            links -= tag == "a"
            strong -= tag in ("b", "strong")
            unseen -= tag in UNSEEN or tag == "head"
        del stack[to:]

    def said(raw: str) -> None:
        nonlocal linked, bold
        if raw and not unseen:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            size = len(raw.strip())
            linked += size if links else 0
            bold += size if strong else 0

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        if token is None:
            break
        said(page[at : token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag in ("br", "hr", "img") and not token[1]:
            said(" ")
        if tag not in INLINE and tag != "br":
            close()
        if token[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if stack and stack[-1][0] == "head" and tag not in HEAD or tag == "body":
            pop(next((k for k, e in enumerate(stack) if e[0] == "head"), len(stack)))
        if tag not in INLINE and tag not in VOID:  # an open paragraph ends before a block
            k = len(stack)
            while k and stack[k - 1][0] in INLINE:
                k -= 1
            if k and (stack[k - 1][0] == "p" or stack[k - 1][0] in HEADINGS and tag in HEADINGS):
                pop(k - 1)
            if tag in SIBLINGS:
                fence = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in FENCES[tag]), -1)
                pop(next((k for k in range(fence + 1, len(stack)) if stack[k][0] in SIBLINGS[tag]), len(stack)))
        if tag not in VOID and not (token[3].endswith("/") and tag not in INLINE and "=" not in token[3]):
            links += tag == "a"
            strong += tag in ("b", "strong")
            unseen += tag in UNSEEN or tag == "head"
            stack.append((tag, names_of(token[3]) if token[3] else ()))
    said(page[at:])
    close()
    return out


WORD = re.compile(r"[^\W\d_]+")


def path_features(path: tuple) -> list[str]:
    own = [e for e in path if e[0] not in ("html", "body")]
    out = dict.fromkeys(f"in:{tag}" for tag, _ in own)
    out |= dict.fromkeys(f"name:{w}" for _, names in own for w in names)
    leaf, holder = (own[-1][0] if own else "body"), (own[-2][0] if len(own) > 1 else "body")
    return [*out, f"leaf:{leaf}", f"pair:{holder}>{leaf}", "named" if any(n for _, n in own) else "plain", f"deep:{min(len(own), 6)}"]


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    out = [f"chars:{min(n.bit_length(), 11)}", f"words:{min(words.bit_length(), 8)}", f"links:{0 if not b.linked else 1 + min(3, int(4 * b.linked))}", "stop" if b.text[-1] in ".!?:;\"'”»%" else "open"]
    if b.bold:
        out.append("bold")
    if "©" in b.text or "(c)" in b.text:
        out.append("copyright")
    if words <= 12:
        out += dict.fromkeys(f"word:{w.lower()}" for w in WORD.findall(b.text))
    return out


def place_features(k: int, n: int, headed: bool) -> list[str]:
    return [f"at:{4 * k // n}", "first" if k == 0 else "last" if k == n - 1 else "between", "headed" if headed else "before"]


def edge_of(a: Block, b: Block) -> int:
    """Which of four sets of weights a step from one block to the next has: same container or not, heading next or not."""
    heading = b.path[-1][0] in HEADINGS if b.path else False
    return 2 * (a.path[:-1] == b.path[:-1]) + heading


EDGES = 4


def headed_of(blocks: list[Block]) -> list[bool]:
    """For each block, whether a main heading stands at or before it."""
    out, seen = [], False
    for b in blocks:
        seen = seen or bool(b.path) and b.path[-1][0] == "h1"
        out.append(seen)
    return out


@dataclass
class Field:
    """Weights of features for a block being main text, and of each edge's labels (before, after)."""

    weights: dict[str, float]
    edges: np.ndarray
    paths: dict = field(default_factory=dict)

    def emissions(self, blocks: list[Block]) -> list[float]:
        get, n, out = self.weights.get, len(blocks), []
        if len(self.paths) > REMEMBERED:
            self.paths.clear()
        for k, (b, headed) in enumerate(zip(blocks, headed_of(blocks), strict=True)):
            own = self.paths.get(b.path)
            if own is None:
                own = self.paths[b.path] = sum(get(f, 0.0) for f in path_features(b.path))
            out.append(own + sum(get(f, 0.0) for f in text_features(b)) + sum(get(f, 0.0) for f in place_features(k, n, headed)))
        return out

    def labels(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the labels whose sum of weights is greatest."""
        if not blocks:
            return []
        edges = self.edges.tolist()
        scores = self.emissions(blocks)
        off, on, back = 0.0, scores[0], []
        for k in range(1, len(blocks)):
            e = edges[edge_of(blocks[k - 1], blocks[k])]
            to_off, to_on = (off + e[0][0], on + e[1][0]), (off + e[0][1], on + e[1][1])
            back.append((to_off[1] > to_off[0], to_on[1] > to_on[0]))
            off, on = max(to_off), max(to_on) + scores[k]
        out = [on > off]
        for was_off, was_on in reversed(back):
            out.append(was_on if out[-1] else was_off)
        return out[::-1]

    def main_text(self, page: str) -> str:
        blocks = blocks_of(page)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.labels(blocks), strict=True) if keep)


def gold_of(blocks: list[Block], main: str) -> list[bool]:
    """Labels of a labelled page: its blocks that are the main text's, in order."""
    left = main.split("\n\n") if main else []
    out, at = [], 0
    for b in blocks:
        hit = at < len(left) and b.text == left[at]
        out.append(hit)
        at += hit
    if at < len(left):
        raise ValueError(f"a labelled page has no block {left[at][:80]!r}")
    return out


def log_sums(score: np.ndarray, step: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded pages: log-likelihood normalisers, marginals of each block's labels and of each step's pair of labels. score: (pages, blocks, 2); step: (pages, blocks - 1, 2, 2)."""
    pages, most, _ = score.shape
    before, after = np.zeros_like(score), np.zeros_like(score)
    before[:, 0] = score[:, 0]
    for k in range(1, most):
        live = (k < sizes)[:, None]
        into = before[:, k - 1, :, None] + step[:, k - 1]
        before[:, k] = np.where(live, np.logaddexp(into[:, 0], into[:, 1]) + score[:, k], before[:, k - 1])
    for k in range(most - 2, -1, -1):
        live = (k + 1 < sizes)[:, None]
        out = step[:, k] + (score[:, k + 1] + after[:, k + 1])[:, None, :]
        after[:, k] = np.where(live, np.logaddexp(out[:, :, 0], out[:, :, 1]), 0.0)
    total = np.logaddexp(before[:, -1, 0], before[:, -1, 1])
    node = np.exp(before + after - total[:, None, None])
    pair = np.exp(before[:, :-1, :, None] + step + (score + after)[:, 1:, None, :] - total[:, None, None, None])
    alive = np.arange(most) < sizes[:, None]
    return total, node * alive[:, :, None], pair * alive[:, 1:, None, None]


def fit(labelled: list[tuple[str, str]], steps: int = STEPS, decay: float = 0.2) -> Field:
    """The field of greatest likelihood on labelled pages (page, main text), weights held small by `decay`. Features seen on one page only are left out."""
    read = [(b, gold_of(b, main)) for b, main in ((blocks_of(page), main) for page, main in labelled) if b]
    if not read:
        return Field({}, np.zeros((EDGES, 2, 2)))
    sizes = np.array([len(b) for b, _ in read])
    most = int(sizes.max())
    held: dict[str, set[int]] = {}
    rows = []
    for p, (blocks, _) in enumerate(read):
        for k, (b, headed) in enumerate(zip(blocks, headed_of(blocks), strict=True)):
            names = path_features(b.path) + text_features(b) + place_features(k, len(blocks), headed)
            rows.append((p * most + k, names))
            for f in names:
                held.setdefault(f, set()).add(p)
    index = {f: k for k, f in enumerate(sorted(f for f, pages in held.items() if len(pages) > 1))}
    at = np.concatenate([np.full(len([f for f in names if f in index]), spot) for spot, names in rows])
    of = np.array([index[f] for _, names in rows for f in names if f in index])
    gold, kind = np.zeros((len(read), most), int), np.zeros((len(read), max(most - 1, 0)), int)
    for p, (blocks, labels) in enumerate(read):
        gold[p, : len(labels)] = labels
        kind[p, : len(blocks) - 1] = [edge_of(a, b) for a, b in zip(blocks, blocks[1:], strict=False)]
    alive = np.arange(most) < sizes[:, None]
    wanted = np.bincount(of, (gold * alive).ravel()[at], len(index))
    wanted_edges = np.zeros((EDGES, 2, 2))
    np.add.at(wanted_edges, (kind, gold[:, :-1], gold[:, 1:]), alive[:, 1:])
    w, adam = np.zeros(len(index) + EDGES * 4), Adam(len(index) + EDGES * 4, 0.1)
    for _ in range(steps):
        edges = w[len(index) :].reshape(EDGES, 2, 2)
        score = np.zeros((len(read), most, 2))
        score[:, :, 1] = np.bincount(at, w[of], len(read) * most).reshape(len(read), most)
        _, node, pair = log_sums(score, edges[kind], sizes)
        found_edges = np.zeros((EDGES, 2, 2))
        np.add.at(found_edges, kind, pair)
        found = np.bincount(of, node[:, :, 1].ravel()[at], len(index))
        w -= adam.step((np.concatenate([found - wanted, (found_edges - wanted_edges).ravel()]) + decay * w) / len(read))
    return Field({f: float(w[k]) for f, k in index.items()}, w[len(index) :].reshape(EDGES, 2, 2))


def extract(pages: DataFrame, model: Field) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [model.main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op13_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit(labelled_pages(PAGES)))
