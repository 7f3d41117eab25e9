import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest

from conftest import SF_DIR
from tallyloom.llm.html_blocks import blocks_of
from tallyloom.llm.html_extract import (
    FEATURES,
    Crf,
    _marginals,
    example_pages,
    extract_text,
    main_blocks,
    op7_html_extract,
    train_on_pages,
)


@pytest.fixture(scope="module")
def crf():
    return train_on_pages(None)


def random_crf(seed):
    draw = np.random.default_rng(seed)
    return Crf(draw.normal(size=len(FEATURES)), draw.normal(size=(2, 2)))


def test_viterbi_and_marginals_equal_enumeration():
    draw = random.Random(11)
    for seed in range(20):
        model = random_crf(seed)
        page = [draw.sample(range(len(FEATURES)), 3) for _ in range(draw.randint(1, 7))]
        gains = np.array([model.weights[own].sum() for own in page])

        def score(labels):
            return float(gains @ np.array(labels)) + sum(
                model.pairs[a, b] for a, b in zip(labels, labels[1:])
            )

        paths = list(itertools.product((0, 1), repeat=len(page)))
        assert abs(score(model.decode(page)) - max(map(score, paths))) < 1e-9
        weights = np.exp([score(path) for path in paths])
        wanted = (np.array(paths) * weights[:, None]).sum(axis=0) / weights.sum()
        padded = np.zeros((1, 9))
        padded[0, : len(page)] = gains
        there = (np.arange(9) < len(page)).astype(float)[None]
        content, expected = _marginals(padded, there, model.pairs)
        assert np.allclose(content[0, : len(page)], wanted)
        assert abs(expected.sum() - (len(page) - 1)) < 1e-9
    assert random_crf(0).decode([]) == []


def test_blocks_of_broken_markup():
    texts = lambda page: [block.text for block in blocks_of(page)]
    assert texts("<p>a<p>b &amp; c&nbsp;d</div> <b>e\n\tf</b>") == ["a", "b & c d", "e f"]
    assert texts("<p><b>one<br>two<p>three") == ["one two", "three"]
    assert texts("x<script>var a='<p>no</p>';</script>y<style>z") == ["x", "y"]
    assert texts("a < b <3 <p title='>'>c</p><!-- <p>no</p> -->d<!-- open") == ["a < b <3", "c", "d"]
    assert texts("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert texts("<div hidden><p>no</p></div><div style='display: none'>no</div>yes") == ["yes"]
    assert texts("") == [] and texts("<<<>>>") == ["<<<>>>"] and texts("<p") == ["<p"]
    assert len(texts("<div>" * 3000 + "deep")) == 1
    assert texts("<a href=\"x>" + "y" * 50) != []
    assert texts("<p>one <img src=x> two <svg><text>no</text></svg> three<hr>four") == ["one two three", "four"]
    assert texts("<p>pick <select><optgroup><option>no<option>no</select> one</p>") == ["pick one"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data=x>shown</object>") == ["so x=2 and shown"]


def test_what_is_left_open_hides_no_page():
    texts = lambda page: [block.text for block in blocks_of(page)]
    assert texts("<html><head><title>t</title><body><p>Text</p></body></html>") == ["Text"]
    assert texts("<head><meta charset=x><link href=/a/><p>Text") == ["Text"]
    assert texts("<head><title>t</title> Text") == ["Text"] and texts("<title>open <p>Text") == ["open", "Text"]
    for tag in ("button", "select", "svg", "datalist"):
        assert texts(f"<div>a<{tag}>no</div><p>b</p>") == ["a", "b"]
        assert texts(f"<{tag}>no<p>Text</p><p>more") == ["Text", "more"]
    for tag in ("textarea", "noscript", "iframe", "xmp", "object", "video", "math"):
        assert texts(f"<p>a</p><{tag}><p>Text</p>") == ["a", "Text"]
    assert texts("<a href=/x/>one</a> <div/>two<p/>three") == ["one", "two", "three"]
    assert [b.link_chars for b in blocks_of("<p><a href=/x/>one</a> two")] == [3]
    assert texts("<svg><path d='x'/><g/></svg>yes") == ["yes"]


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 100_000, "<div class='post a1'>" * 100_000 + "x", "<a x=\"b\" y=\"c" * 50_000,
        "<a x=\"b\" y='c" * 50_000 + ">", "<a " * 100_000 + "\" >", "<b <i " * 50_000 + "'x' \"", "<" * 200_000,
        "<div>" * 50_000 + "<tr></tr><p>x</p></b></td>" * 50_000, "<title>" * 50_000 + "<textarea>" * 50_000,
        "<p>" * 100_000 + "</p>" * 100_000, "<a>" * 100_000 + "x", "<!--" * 100_000, "<x-y>" * 100_000, "&amp;" * 200_000,
        "<p " + "a " * 200_000 + ">x", "<p " + " " * 400_000 + "=>x", "<li>" * 100_000, "<svg><button>" * 50_000 + "<p>x",
    ],
    ids=range(18),
)
def test_time_is_in_proportion_to_the_page(page):
    begun = time.process_time()
    blocks_of(page)
    assert time.process_time() - begun < 6


def test_unseen_examples_are_labelled_well(crf):
    right = total = 0
    for page in example_pages(200, seed=99):
        marked = blocks_of(page)
        wanted = [block.text[1:] for block in marked if block.text.startswith("⁣")]
        found = main_blocks(page.replace("⁣", ""), crf)
        right += 2 * len(set(found) & set(wanted))
        total += len(set(found)) + len(set(wanted))
    assert right / total > 0.95


def test_boilerplate_goes_and_the_article_stays(crf):
    article = "<h1>Title of it</h1><p>First &quot;words&quot; are here, of some length.</p><p>Second paragraph, and it ends.</p>"
    page = f"""<html><head><title>no</title></head><body><nav><a href=/>Home</a></nav>
    <header><p>Site name</p></header><div class="cookie-notice">We use cookies. Accept them all.</div>
    <article>{article}<div class="ad">Buy this now.</div></article>
    <aside><h3>Related</h3><ul><li><a href=/a>One more</a></li></ul></aside>
    <section class="comments"><div class="comment"><p>I disagree with this text.</p></div></section>
    <form><label>Mail</label><input></form><footer>© Site. All rights.</footer></body></html>"""
    assert main_blocks(page, crf) == [
        "Title of it", 'First "words" are here, of some length.', "Second paragraph, and it ends.",
    ]


def test_articles_of_bare_divisions_and_with_links(crf):
    lines = [f"Sentence number {n} of the article, which says something of some length." for n in "one two three four five".split()]
    bare = "".join(f"<div>{line}</div>" for line in lines)
    page = f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div>{bare}</div><footer>© Site</footer></body></html>"
    assert main_blocks(page, crf) == lines
    linked = "".join(f"<p>{line.replace('article', '<a href=/a>article</a>')}</p>" for line in lines)
    assert main_blocks(page.replace(bare, linked), crf) == lines


def test_awkward_rows(spark, crf):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a>x</a></nav>"), (3, "u", "<nav><a>x</a></nav>")]
    rows += [(None, "u", "<article><p>" + "Long text. " * 20000 + "</p></article>")]
    frame = spark.createDataFrame([(*row, 9) for row in rows], "page_id long, url string, html string, n_chars int")
    found = extract_text(frame, crf).collect()
    assert sorted((row.page_id or 0, row.n_chars) for row in found) == [(0, 219999), (1, 0), (2, 0), (3, 0), (3, 0)]
    assert extract_text(frame.limit(0), crf).isEmpty()


def test_query_gives_the_text_of_the_documents(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    found = op7_html_extract(spark, SF_DIR).collect()
    assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{SF_DIR}/pages.parquet'").fetchall()[0][0]
    right = 0
    for row in found:
        number = int(re.search(r"/(\d+)[^0-9/?#]*/?(?:[?#].*)?$", row.url)[1])
        lines = [line for line in (" ".join(x.split()) for x in docs[number].split("\n")) if line]
        blocks = row.text.split("\n\n")
        right += blocks[1:] == lines and lines[0].startswith(blocks[0])
        assert row.n_chars == len(row.text)
    assert right >= 0.95 * len(found)
