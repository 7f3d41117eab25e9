"""Extracting the main text of pages (operator 7).

A page is a chain of leaf blocks. A linear-chain conditional random field, with
features of a block's ancestors and text, is trained on labelled pages and labels
the blocks of a page by the most likely path (Viterbi).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table
from tallyloom.llm.html_blocks import TAGS, WORDS, Block, blocks_of

#: At most this many labelled pages of the data are learned from, of at most so
#: many characters each.
TRAINING_PAGES = 200
TRAINING_CHARS = 100_000
#: Example pages composed for training, and passes over all of them.
EXAMPLE_PAGES = 600
PASSES = 150
SEED = 7
SEPARATOR = "\n\n"

_HEADINGS = frozenset(("h1", "h2", "h3"))
_LENGTHS = (1, 2, 4, 8, 16, 32, 64)
_NAMES = [
    "always",
    *(f"in_{tag}" for tag in TAGS),
    *(f"is_{tag}" for tag in TAGS),
    *(f"word_{kind}" for kind in WORDS),
    *(f"length_{n}" for n in range(len(_LENGTHS) + 1)),
    *(f"links_{n}" for n in range(4)),
    "sentence", "copyright", "first", "last", "heading", "after_heading",
]
FEATURES = {name: number for number, name in enumerate(_NAMES)}


def features(blocks: Sequence[Block]) -> list[list[int]]:
    """Numbers of the features that each block of a page has."""
    found = []
    for at, block in enumerate(blocks):
        own = {"always"}
        own.update(f"in_{tag}" for tag in block.tags)
        own.add(f"is_{block.inner}")
        own.update(f"word_{kind}" for kind in block.kinds)
        words = block.text.count(" ") + 1
        own.add(f"length_{sum(words > limit for limit in _LENGTHS)}")
        density = block.link_chars / len(block.text)
        own.add(f"links_{(density > 0) + (density > 0.3) + (density > 0.7)}")
        if block.text[-1] in ".!?…\"”»":
            own.add("sentence")
        if "©" in block.text:
            own.add("copyright")
        if at == 0:
            own.add("first")
        if at == len(blocks) - 1:
            own.add("last")
        if block.tags & _HEADINGS:
            own.add("heading")
        if at and blocks[at - 1].tags & _HEADINGS:
            own.add("after_heading")
        found.append(sorted(FEATURES[name] for name in own if name in FEATURES))
    return found


@dataclass(frozen=True)
class Crf:
    """Weights: of each feature for content against the rest, and of each pair of labels."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, of_blocks: Sequence[list[int]]) -> list[int]:
        """The most likely labels: 1 for content."""
        if not of_blocks:
            return []
        weights, ((stay0, to1), (to0, stay1)) = self.weights, self.pairs.tolist()
        zero, one = 0.0, float(weights[of_blocks[0]].sum())
        back: list[tuple[int, int]] = []
        for own in of_blocks[1:]:
            gain = float(weights[own].sum())
            from0, from1 = (zero + stay0, one + to0), (zero + to1, one + stay1)
            back.append((int(from0[1] > from0[0]), int(from1[1] > from1[0])))
            zero, one = max(from0), max(from1) + gain
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: Sequence[tuple[list[list[int]], list[int]]], passes: int = PASSES) -> Crf:
    """Maximum likelihood with a small penalty, by gradient steps over all pages.

    Pages are stacked, so that one step forward or back is done for all at once.
    """
    pages = [page for page in pages if page[0]]
    longest = max(len(of_blocks) for of_blocks, _ in pages)
    number = len(pages)
    # Blocks of the same features are one row of ``table``.
    kinds = {tuple(own): None for of_blocks, _ in pages for own in of_blocks}
    index = {own: row for row, own in enumerate(kinds)}
    table = np.zeros((len(index), len(FEATURES)))
    for own, row in index.items():
        table[row, list(own)] = 1.0
    at = np.zeros((number, longest), np.int64)
    there = np.zeros((number, longest))
    truth = np.zeros((number, longest))
    for page, (of_blocks, labels) in enumerate(pages):
        size = len(of_blocks)
        at[page, :size] = [index[tuple(own)] for own in of_blocks]
        there[page, :size] = 1.0
        truth[page, :size] = labels
    true_pairs = np.zeros((2, 2))
    for _, labels in pages:
        np.add.at(true_pairs, (labels[:-1], labels[1:]), 1.0)
    theta = np.zeros(len(FEATURES) + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, passes + 1):
        weights, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        gains = (table @ weights)[at]
        content, expected = _marginals(gains, there, pairs)
        by_kind = np.bincount(
            at.ravel(), ((truth - content) * there).ravel(), minlength=len(index)
        )
        gradient = np.concatenate([table.T @ by_kind, (true_pairs - expected).ravel()])
        gradient = gradient / number - 1e-3 * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        theta = theta + rate * mean / (np.sqrt(square) + 1e-8)
    return Crf(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def _marginals(
    gains: np.ndarray, there: np.ndarray, pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content at each block, and expected number of each pair of labels."""
    number, longest = gains.shape
    scores = np.stack([np.zeros_like(gains), gains], axis=2)
    forward = np.zeros((longest, number, 2))
    backward = np.zeros((longest, number, 2))
    forward[0] = scores[:, 0]
    for t in range(1, longest):
        step = np.logaddexp.reduce(forward[t - 1][:, :, None] + pairs, axis=1) + scores[:, t]
        forward[t] = np.where(there[:, t, None] > 0, step, forward[t - 1])
    for t in range(longest - 2, -1, -1):
        step = np.logaddexp.reduce(
            pairs + (scores[:, t + 1] + backward[t + 1])[:, None, :], axis=2
        )
        backward[t] = np.where(there[:, t + 1, None] > 0, step, backward[t + 1])
    whole = np.logaddexp.reduce(forward[-1], axis=1)
    content = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole).T
    expected = np.zeros((2, 2))
    for t in range(1, longest):
        joint = forward[t - 1][:, :, None] + pairs + (scores[:, t] + backward[t])[:, None, :]
        expected += (np.exp(joint - whole[:, None, None]) * there[:, t, None, None]).sum(axis=0)
    return content, expected


# --- labelled pages -----------------------------------------------------------

_SYLLABLES = "ba ke lo mi nu ra se ti vo zu".split()
_MARK = "⁣"  # an invisible sign, put before content and taken away with the labels


def example_pages(number: int = EXAMPLE_PAGES, seed: int = SEED) -> list[str]:
    """Pages in common layouts; the texts of content begin with ``_MARK``."""
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        some = (
            "".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4)))
            for _ in range(draw.randint(low, high))
        )
        return " ".join(some)

    def sentences(low: int, high: int) -> str:
        return " ".join(words(4, 18).capitalize() + "." for _ in range(draw.randint(low, high)))

    def links(low: int, high: int) -> str:
        items = (f'<a href="/x">{words(1, 3)}</a>' for _ in range(draw.randint(low, high)))
        return "".join(f"<li>{item}</li>" for item in items)

    def linked(text: str) -> str:
        """The text, sometimes with a link or an emphasis somewhere inside."""
        parts = text.split(" ")
        if len(parts) > 8 and draw.random() < 0.25:
            at = draw.randrange(1, len(parts) - 3)
            stop = at + draw.randint(1, 3)
            inside = " ".join(parts[at:stop])
            tag = draw.choice(('<a href="/x">{}</a>', '<a href="/y">{}</a>', "<em>{}</em>"))
            parts[at:stop] = [tag.format(inside)]
        return " ".join(parts)

    def paragraphs(mark: str, low: int, high: int, tag: str = "p") -> str:
        return "".join(
            f"<{tag}>{mark}{linked(some) if mark else some}</{tag}>"
            for _ in range(draw.randint(low, high))
            for some in [
                sentences(1, draw.choice((1, 5, 20))) if draw.random() < 0.8 else words(1, 12)
            ]
        )

    def boilerplate(kind: str) -> str:
        name = draw.choice(WORDS[kind].split())
        key = draw.choice(("class", "id"))
        inner = draw.choice(
            (
                sentences(1, 2),
                f"<p>{sentences(1, 3)}</p>",
                f"<ul>{links(2, 6)}</ul>",
                words(1, 6),
            )
        )
        return f'<div {key}="{name}">{inner}</div>'

    def comments() -> str:
        body = "".join(
            f'<div class="comment"><b>{words(1, 2)}</b><p>{sentences(1, 3)}</p></div>'
            for _ in range(draw.randint(1, 5))
        )
        tag, key = draw.choice(("section", "div")), draw.choice(("class", "id"))
        name = draw.choice(("comments", "discussion", "replies"))
        return f'<{tag} {key}="{name}"><h3>{words(1, 2)}</h3>{body}</{tag}>'

    def before() -> str:
        parts = [
            f"<nav><ul>{links(2, 8)}</ul></nav>",
            f"<header><p>{words(1, 6)}</p><nav>{links(2, 5)}</nav></header>",
            f"<header><h2>{words(1, 4)}</h2>{words(2, 6)}</header>",
            boilerplate("menu"), boilerplate("head"), boilerplate("advert"), boilerplate("notice"),
            f"<aside>{paragraphs('', 1, 2)}</aside>", boilerplate("side"),
        ]
        return "".join(draw.sample(parts, draw.choice((0, 1, 2, 3, 4))))

    def after() -> str:
        parts = [
            f"<footer>© {words(1, 3)} · {sentences(1, 2)}</footer>",
            f"<footer><p>{sentences(1, 2)}</p><ul>{links(1, 5)}</ul></footer>",
            f"<aside><h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul></aside>",
            f"<form><label>{words(1, 3)}</label><p>{sentences(1, 1)}</p></form>",
            boilerplate("side"), boilerplate("foot"), boilerplate("share"), boilerplate("notice"),
            boilerplate("advert"), boilerplate("form"), comments(), comments(),
        ]
        return "".join(draw.sample(parts, draw.choice((0, 1, 2, 3, 4, 5))))

    def within() -> str:
        parts = [
            boilerplate("advert"), boilerplate("share"), boilerplate("notice"), boilerplate("side"),
            comments(), f"<aside>{sentences(1, 2)}</aside>",
            f"<form><p>{sentences(1, 1)}</p></form>", f"<nav>{links(2, 4)}</nav>",
        ]
        return draw.choice(parts) if draw.random() < 0.35 else ""

    def content() -> str:
        pieces = []
        if draw.random() < 0.1:
            return paragraphs(_MARK, 1, 1)
        tag = "div" if draw.random() < 0.2 else "p"
        for _ in range(draw.randint(1, 4)):
            kind = draw.random()
            if kind < 0.6:
                pieces.append(paragraphs(_MARK, 1, 5, tag))
            elif kind < 0.7:
                pieces.append(f"<h2>{_MARK}{words(1, 6)}</h2>{paragraphs(_MARK, 1, 2)}")
            elif kind < 0.8:
                items = (f"<li>{_MARK}{words(1, 14)}</li>" for _ in range(draw.randint(2, 5)))
                pieces.append(f"<ul>{''.join(items)}</ul>")
            elif kind < 0.85:
                pieces.append(f"<blockquote>{_MARK}{sentences(1, 2)}</blockquote>")
            elif kind < 0.9:
                pieces.append(f"<pre>{_MARK}{words(2, 12)}</pre>")
            else:
                cells = (f"<td>{_MARK}{words(1, 4)}</td>" for _ in range(2))
                pieces.append(f"<table><tr>{''.join(cells)}</tr></table>")
            pieces.append(within())
        return "".join(pieces)

    pages = []
    for _ in range(number):
        title = f"<h1>{_MARK}{words(1, 10)}</h1>" if draw.random() < 0.85 else ""
        if title and draw.random() < 0.15:
            title = f"<header>{title}</header>"
        left, right = draw.choice(
            (
                ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
                ('<div id="main"><div class="post">', "</div></div>"), ("<section>", "</section>"),
                ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("", ""),
            )
        )
        main = f"{left}{title}{content()}{right}"
        pages.append(f"<html><body>{before()}{main}{after()}</body></html>")
    return pages


def _labelled_example(page: str) -> tuple[list[list[int]], list[int]]:
    marked = blocks_of(page)
    labels = [int(_MARK in block.text) for block in marked]
    return features(blocks_of(page.replace(_MARK, ""))), labels


def labels_by_text(blocks: Iterable[Block], text: str) -> list[int]:
    """1 for blocks that are a line of the text, or the beginning of one in a heading."""
    lines = {" ".join(line.split()) for line in text.split("\n")}
    whole = " ".join(text.split())
    return [
        int(
            block.text in lines
            or bool({"h1", "h2"} & block.tags)
            and whole.startswith(block.text)
        )
        for block in blocks
    ]


def _labelled_page(page: str, text: str) -> tuple[list[list[int]], list[int]]:
    blocks = blocks_of(page)
    return features(blocks), labels_by_text(blocks, text)


def train_on_pages(labelled: DataFrame | None, pages: int = TRAINING_PAGES) -> Crf:
    """Train on composed examples and on ``html`` of ``labelled`` pages.

    ``labelled`` has the true text of its pages in ``text``. At most ``pages`` of
    them come to the driver, those whose hashes are smallest, of at most
    ``TRAINING_CHARS`` characters. Pages on which no block is content are left out.
    """
    known = [_labelled_example(page) for page in example_pages()]
    if labelled is not None:
        fits = (F.length("html") <= TRAINING_CHARS) & (F.length("text") <= TRAINING_CHARS)
        drawn = labelled.where(fits).select("html", "text", F.xxhash64("html").alias("_at"))
        for row in drawn.orderBy("_at", "html", "text").limit(pages).collect():
            page = _labelled_page(row.html, row.text)
            if any(page[1]):
                known.append(page)
    return train(known)


# --- the operator -------------------------------------------------------------


def main_blocks(page: str, crf: Crf) -> list[str]:
    blocks = blocks_of(page)
    return [
        block.text for block, label in zip(blocks, crf.decode(features(blocks))) if label
    ]


def _extractor(crf: Crf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                SEPARATOR.join(main_blocks(page.as_py() or "", crf)) for page in batch.column(2)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return extract


def extract_text(pages: DataFrame, crf: Crf) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Reads ``page_id``, ``url`` and ``html``; other columns are not read. ``text``
    joins the blocks of the article by an empty line, in page order; it is empty if
    there are none, or the page is NULL or empty. Whole pages are read. Repeated
    rows stay; an empty table gives no rows. Nothing is shuffled.
    """
    found = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        _extractor(crf), "page_id long, url string, text string"
    )
    return found.withColumn("n_chars", F.length("text").cast("long"))


def pages_of_documents(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``html`` of pages and ``text`` of the documents that their URLs name.

    The last number of the path names the document. The pages are bounded first,
    so that hardly more than those that are learned from are joined.
    """
    number = F.regexp_extract("url", r"/([0-9]{1,18})[^0-9/?#]*/?(?:[?#].*)?$", 1)
    named = pages.select("html", F.nullif(number, F.lit("")).cast("long").alias("doc_id"))
    drawn = named.where("doc_id IS NOT NULL AND html IS NOT NULL").orderBy(
        F.xxhash64("html"), "html", "doc_id"
    )
    some = drawn.limit(2 * TRAINING_PAGES)
    return some.join(docs.select("doc_id", "text"), "doc_id").where("text IS NOT NULL")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    crf = train_on_pages(pages_of_documents(pages, read_table(spark, sf_dir, "documents")))
    return extract_text(pages, crf)
