import math
import random

import duckdb

from conftest import SF_DIR
from tallyloom.llm.url_filter import RULES, UrlModel, judge_urls, op6_url_filter, with_rules


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(mark) for mark in "/?#" if mark in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(mark) for mark in "?#" if mark in path] or [len(path)])]


def slow_rule(host, path):
    fits = []
    for rule, verdict in RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "https://ORG/x", "https://a.example.org/es/1", "x://example.org/es",
    "http://example.org/en/12#y", "http://b.example.org/en/2", "https://a.com/fr/?q=1&r=2", "http://com/de/",
    "http://notexample.org/es/", "ftp://xorg/", "http://a.org?x=/y", "http://a.org#f", "http://ÄB.Com/de/x",
    "a://b://c/d", "http://x.com/de", "http://h/" + "p" * 5000, "http://m\nn.org/\n",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    for row in with_rules(pages, RULES).collect():
        assert (row.host, row.path) == slow_parts(row.url)
        assert (row.rule, row.rule_verdict) == slow_rule(row.host, row.path)


def test_trees_judge_held_out_urls(spark):
    draw = random.Random(10)

    def url(bad):
        name = "".join(draw.choices("abcdefgh", k=6))
        number = draw.randint(1, 99)
        return (
            f"http://{name}-win{number}{number}.net/{number}/{number}?a={number}&b=2&c=3"
            if bad
            else f"https://www.{name}.net/{name}"
        )

    rows = [(n, url(n % 2), n % 2, "v") for n in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked int, verdict string")
    found = judge_urls(frame.where("page_id >= 200"), frame.where("page_id < 200"))
    right = [(row.verdict == "block") == bool(row.page_id % 2) for row in found.collect()]
    assert len(right) == 200 and sum(right) >= 195
    awkward = spark.createDataFrame([(n, u) for n, u in enumerate(URLS)] * 2, "page_id long, url string")
    judged = judge_urls(awkward, frame).collect()
    assert len(judged) == 2 * len(URLS)
    for row in judged:
        assert row.verdict in ("allow", "block")
        assert row.rule is None or row.verdict == dict(RULES)[row.rule]


def test_without_labels_and_without_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, blocked int")
    assert judge_urls(pages, none).first().verdict == "allow"
    assert judge_urls(pages.limit(0), none).isEmpty()


def test_query(spark):
    found = op6_url_filter(spark, SF_DIR).collect()
    pages = duckdb.sql(f"SELECT page_id, url FROM '{SF_DIR}/pages.parquet'").fetchall()
    assert sorted((row.page_id, row.url) for row in found) == sorted(pages)
    for row in found:
        rule, verdict = slow_rule(*slow_parts(row.url))
        assert row.rule == rule and (rule is None or row.verdict == verdict)


def test_statistics_take_all_labelled_rows_and_trees_different_urls(spark):
    parts = [(f"http://h{n % 40}.net/s{n % 7}/{n}", f"h{n % 40}.net", f"/s{n % 7}/{n}", n % 2) for n in range(400)]
    frame = spark.createDataFrame(parts, "url string, host string, path string, blocked int")
    first = frame.selectExpr("min_by(struct(*), xxhash64(url)) AS r").select("r.*")
    often = first.selectExpr("*", "explode(sequence(1, 600)) AS n").drop("n")
    model = UrlModel(frame.unionAll(often), training_urls=100)
    assert model.trees is not None
    by_host = {row.two_labels: row for row in model.suffixes["two_labels"].collect()}
    top = first.first()
    assert len(by_host) == 40
    for name, row in by_host.items():
        assert round(math.exp(row.two_labels_known)) == 11 + 600 * (name == top.host)
    assert model.share == (200 + 600 * top.blocked) / 1000
