"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between two block-level tags. Its features are the tags and class words of its ancestors and
measures of its text; Viterbi finds the best sequence of `main` and `other` for a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of HTML: elements that break a line of text, have no content, or have no readable content.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
    tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select")
SILENT_SET = frozenset(SILENT)
#: Elements whose end tag may be left out, by the start tags that end them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

TAGS = """article main section nav header footer aside form fieldset dialog menu ul ol li dl table figure figcaption blockquote pre details
    summary address div p h1 h2 h3 h4 h5 h6 td th label button body""".split()
CLASS_WORDS = """ad ads advert advertisement adverts banner sponsor sponsored promo promotion promoted sidebar side widget menu nav navigation navbar
    breadcrumb breadcrumbs header head masthead logo footer foot copyright legal comment comments reply replies respond disqus discussion
    cookie cookies consent gdpr notice notices alert warning message modal popup overlay newsletter subscribe signup login search share sharing
    social related recommended popular trending tags tag meta pager pagination skip form hidden
    content article post entry main body story text page news blog prose""".split()
MEASURES = ["words 1", "words 2-4", "words 5-9", "words 10-19", "words 20-39", "words 40-", "links none", "links some", "links most", "links all",
            "sentence end", "copyright sign", "separators", "digits", "capitals", "first", "last", "after same parent", "bias"]
FEATURES = {name: i for i, name in enumerate([f"in {t}" for t in TAGS] + [f"own {t}" for t in TAGS] + [f"class {w}" for w in CLASS_WORDS] + MEASURES)}
MAIN = 1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SILENT_END = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in SILENT}
_CLASSES = frozenset(CLASS_WORDS)


class Block:
    __slots__ = ("text", "features", "parent", "linked")

    def __init__(self, text, features, parent, linked):
        self.text, self.features, self.parent, self.linked = text, features, parent, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, white space in each turned into single spaces."""
    found: list[Block] = []
    # per open element: tag, features of it and its ancestors, its own number
    stack: list[tuple[str, frozenset, int]] = [("", frozenset(), 0)]
    parts: list[str] = []
    linked, links, number, at = 0, 0, 0, 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                level = next(e for e in reversed(stack) if e[0] in BLOCKS or not e[0])
                own = FEATURES.get(f"own {level[0]}")
                # inline elements opened before the block and left open say nothing about it
                found.append(Block(text, level[1] | {own} if own is not None else level[1], level[2], linked / max(1, sum(map(len, parts)))))
            parts.clear()
        linked = 0

    size = len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        upto = token.start() if token else size
        if upto > at:
            parts.append(page[at:upto])
            if links:
                linked += upto - at
        if token is None:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCKS:
                close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
            links = sum(e[0] == "a" for e in stack)
            continue
        if tag in SILENT_SET:
            if not token[3].rstrip().endswith("/"):
                at = _SILENT_END[tag].search(page, at).end()
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            close()
            while stack[-1][0] and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p"):  # a block ends open inline elements and p
                stack.pop()
            if stack[-1][0] in ENDED_BY and tag in ENDED_BY[stack[-1][0]]:
                stack.pop()
                if tag == "tr" and stack[-1][0] == "tr":
                    stack.pop()
            links = sum(e[0] == "a" for e in stack)
        if tag in VOID:  # a slash before the end of other tags means nothing
            continue
        added = set()
        if f"in {tag}" in FEATURES:
            added.add(FEATURES[f"in {tag}"])
        for value in _ATTRIBUTE.findall(token[3]) if token[3] else ():
            added |= {FEATURES[f"class {w}"] for w in _CLASSES.intersection(_WORD.findall(value.lower()))}
        number += 1
        stack.append((tag, stack[-1][1] | added if added else stack[-1][1], number))
        links += tag == "a"
    close()
    return found


def active(page: list[Block]) -> list[list[int]]:
    """Numbers of the features of each block."""
    out, before = [], None
    for i, b in enumerate(page):
        words = b.text.split(" ")
        n = len(words)
        on = ["bias", "words 1" if n == 1 else "words 2-4" if n < 5 else "words 5-9" if n < 10 else "words 10-19" if n < 20 else "words 20-39" if n < 40 else "words 40-",
              "links none" if not b.linked else "links some" if b.linked < 0.4 else "links most" if b.linked < 0.9 else "links all"]
        if b.text[-1] in ".!?…\"”»":
            on.append("sentence end")
        if "©" in b.text or "(c)" in b.text.lower() or "copyright" in b.text.lower():
            on.append("copyright sign")
        if b.text.count("|") + b.text.count("·") + b.text.count("»") > 1:
            on.append("separators")
        if sum(map(str.isdigit, b.text)) * 4 > len(b.text):
            on.append("digits")
        if sum(w[:1].isupper() for w in words) * 3 > n * 2:
            on.append("capitals")
        if not i:
            on.append("first")
        if i == len(page) - 1:
            on.append("last")
        if before == b.parent:
            on.append("after same parent")
        before = b.parent
        out.append([*b.features, *(FEATURES[x] for x in on)])
    return out


def train(pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 200, rate: float = 0.1, decay: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (features, 2) and of label pairs (2, 2): Adam on the log likelihood, by forward and backward sums
    over all pages at once."""
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, len(FEATURES)), dtype=np.float32)
    y, mask = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for i, (page, label) in enumerate(zip(pages, labels)):
        for t, on in enumerate(page):
            x[i, t, on] = 1
        y[i, :len(label)], mask[i, :len(label)] = label, True
    flat = x.reshape(-1, len(FEATURES))
    w, pair = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    seen = flat.T @ (np.eye(2)[y.reshape(-1)] * mask.reshape(-1, 1))
    seen_pairs = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen_pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, rounds + 1):
        score = (flat @ w).reshape(*mask.shape, 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            reach = np.logaddexp.reduce(forward[:, t - 1, :, None] + pair, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], reach, forward[:, t - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            reach = np.logaddexp.reduce(pair + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], reach, 0)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        joint = np.exp(forward[:, :-1, :, None] + pair + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grads = [(flat.T @ single.reshape(-1, 2) - seen) / len(pages) + decay * w, (joint.sum(axis=(0, 1)) - seen_pairs) / len(pages) + decay * pair]
        for k, (value, grad) in enumerate(zip((w, pair), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w, pair


def viterbi(scores: np.ndarray, pair: np.ndarray) -> list[int]:
    """Best label sequence of one page."""
    (aa, ab), (ba, bb) = pair.tolist()
    a = b = 0.0
    back = []
    for t, (sa, sb) in enumerate(scores.tolist()):
        if t:
            to_a, to_b = b + ba > a + aa, b + bb > a + ab
            back.append((to_a, to_b))
            a, b = (b + ba if to_a else a + aa) + sa, (b + bb if to_b else a + ab) + sb
        else:
            a, b = sa, sb
    label = int(b > a)
    out = [label]
    for choice in reversed(back):
        label = int(choice[label])
        out.append(label)
    return out[::-1]


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """Trained on labelled pages made by rule, since no table labels blocks."""
    from allotment.llm.labelled_pages import labelled
    pages, labels = [], []
    for page, wanted in labelled(400):
        found = blocks(page)
        pages.append(active(found))
        labels.append([int(b.text in wanted) for b in found])
    return train(pages, labels)


def extract(page: str, weights: np.ndarray, pair: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    scores = np.array([weights[on].sum(axis=0) for on in active(found)])
    return "\n".join(b.text for b, label in zip(found, viterbi(scores, pair)) if label == MAIN)


def _extract(weights: np.ndarray, pair: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", weights, pair) for page in batch.column("html").to_pylist()]
            others = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(texts, pa.string())], [*others, "text"])
    return run


def main_texts(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """Columns `keep` of every page with `text`: its main blocks in page order, one a line.

    Character references are decoded and white space inside a block becomes one space. Scripts, styles and the like
    are no text. A null or empty page, and one without main blocks, has an empty text; broken markup is read as far as
    it goes (unclosed elements end with the next block). Repeated pages are each read; other columns are ignored.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in keep]
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_column).alias("html"))
    found = rows.mapInArrow(_extract(*model()), ", ".join([f"k{i} {kind}" for i, kind in enumerate(kinds)] + ["text string"]))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
