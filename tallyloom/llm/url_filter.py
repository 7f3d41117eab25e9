"""Judging URLs by rules and by boosted trees (operator 6).

A URL that a rule fits has that rule's verdict. The others are judged by
gradient-boosted trees on lexical features, trained from labelled URLs.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import attach, let, read_table, stored

#: The trees are fitted on at most this many different labelled URLs, taken by the
#: hash of the URL. Suffixes are counted in all labelled rows.
TRAINING_URLS = 20_000
TREES = 12
DEPTH = 4
SEED = 6
#: Labelled URLs by which the share of a suffix is drawn towards the common one.
SMOOTHING = 20.0

# The rules of the query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Suffixes whose blocked share and frequency among labelled URLs are features.
_SUFFIXES = ("top_label", "two_labels", "section", "file_suffix")


def host_of(url: str) -> Column:
    """After the first ``://``, up to ``/``, ``?`` or ``#``; A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_case(rules: Sequence[tuple[str, str]], values: Sequence[str]) -> Column:
    """The value of the longest rule that fits ``host`` and ``path``, else NULL."""
    ordered = sorted(zip(rules, values), key=lambda pair: -len(pair[0][0]))
    found = F.lit(None).cast("string")
    for (rule, _), value in reversed(ordered):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        found = F.when(fits & F.col("path").startswith(slash + path), value).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``page_id`` and ``url`` with host, path, and the fitting rule and its verdict."""
    return (
        pages.select("page_id", "url")
        .withColumns({"host": host_of("url"), "path": path_of("url")})
        .withColumns(
            {
                "rule": _rule_case(rules, [rule for rule, _ in rules]),
                "rule_verdict": _rule_case(rules, [verdict for _, verdict in rules]),
            }
        )
    )


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def of_chars(chars: Column) -> Column:
        return F.aggregate(
            chars,
            F.lit(0.0),
            lambda total, char: total
            + let(
                (F.length(text) - F.length(F.replace(text, char))) / F.length(text),
                lambda share: F.when(share > 0, -share * F.log2(share)).otherwise(0.0),
            ),
        )

    return F.when(F.length(text) > 0, of_chars(F.array_distinct(F.split(text, "")))).otherwise(0.0)


def _features() -> dict[str, Column]:
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda part: part != "")),
        "labels": _count(host, ".") + 1,
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "host_digits": F.length(F.regexp_replace(host, r"[^0-9]", "")),
        "hyphens": _count(host, "-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https").cast("int"),
    }


def _suffix_columns() -> dict[str, Column]:
    host, path = F.col("host"), F.col("path")
    return {
        "top_label": F.substring_index(host, ".", -1),
        "two_labels": F.substring_index(host, ".", -2),
        "section": F.regexp_extract(path, r"^/([^/]*)/", 1),
        "file_suffix": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


class UrlModel:
    """The trees, and the suffix statistics of all labelled URLs."""

    def __init__(self, labelled: DataFrame, training_urls: int = TRAINING_URLS) -> None:
        """Learn from ``url``, ``host``, ``path`` and ``blocked`` (0 or 1).

        Without labelled URLs of both kinds there are no trees, and every URL has
        the only label known, or 0.
        """
        blocked = F.col("blocked").cast("double").alias("blocked")
        rows = labelled.where("blocked IS NOT NULL").select("url", "host", "path", blocked)
        counts = stored(
            rows.withColumns(_suffix_columns())
            .groupBy(*_SUFFIXES)
            .agg(F.sum("blocked").alias("blocked"), F.count("*").alias("rows"))
        )
        known = counts.agg(F.sum("blocked") / F.sum("rows")).first()
        self.share = known[0] or 0.0
        self.suffixes = {name: self._statistics(counts, name) for name in _SUFFIXES}
        # One row per URL, with its more frequent label.
        label = (F.avg("blocked") >= 0.5).cast("double").alias("blocked")
        drawn = rows.groupBy("url", "host", "path").agg(label)
        drawn = drawn.orderBy(F.xxhash64("url"), "url").limit(training_urls)
        sample = stored(drawn.withColumns(_suffix_columns()))
        kinds = sample.agg(F.min("blocked"), F.max("blocked")).first()
        of_suffixes = [f"{name}_{kind}" for name in _SUFFIXES for kind in ("share", "known")]
        self.assembler = VectorAssembler(
            inputCols=[*_features(), *of_suffixes], outputCol="features"
        )
        self.trees: GBTClassificationModel | None = None
        if tuple(kinds) == (0, 1):
            trainer = GBTClassifier(
                labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2
            )
            self.trees = trainer.fit(self._vectors(sample).select("features", "blocked"))

    def _statistics(self, counts: DataFrame, name: str) -> DataFrame:
        """One row per suffix of the labelled rows."""
        prior = self.share * SMOOTHING
        return stored(
            counts.groupBy(name).agg(
                ((F.sum("blocked") + prior) / (F.sum("rows") + SMOOTHING)).alias(f"{name}_share"),
                F.log1p(F.sum("rows")).alias(f"{name}_known"),
            )
        )

    def _vectors(self, urls: DataFrame) -> DataFrame:
        found = urls
        for name, statistics in self.suffixes.items():
            found = attach(found, statistics, name, F.xxhash64("url"))
        unseen = {f"{name}_share": self.share for name in _SUFFIXES}
        unseen |= {f"{name}_known": 0.0 for name in _SUFFIXES}
        return self.assembler.transform(found.fillna(unseen).withColumns(_features()))

    def judged(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with host and path) and ``blocked``, true or false."""
        columns = urls.columns
        if self.trees is None:
            return urls.withColumn("blocked", F.lit(self.share >= 0.5))
        found = self.trees.transform(self._vectors(urls.withColumns(_suffix_columns())))
        return found.select(*columns, (F.col("prediction") == 1).alias("blocked"))


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    Reads ``page_id`` and ``url`` of the pages, ``url`` and ``blocked`` of the
    labelled URLs. A rule (a short list) fits its host and the hosts below it, if
    the path begins with the rule's; the longest wins. The trees judge the rest.

    A NULL URL, or one without ``://``, has an empty host and path, fits no rule
    and is judged like any other. Repeated rows stay; an empty table gives no rows.
    Pages are shuffled only to meet the statistics of a suffix that has too many
    values to be broadcast, by suffix and salt.
    """
    columns = {"host": host_of("url"), "path": path_of("url")}
    model = UrlModel(labelled.select("url", "blocked").withColumns(columns))
    judged = model.judged(with_rules(pages, rules))
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs that a rule judges, and those of documents labelled poor or toxic.

    The last number of a path names the document that the page shows. A rule
    comes before a label.
    """
    ruled = with_rules(pages, RULES)
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1)
    by_rule = ruled.where("rule_verdict IS NOT NULL").select(
        "url", (F.col("rule_verdict") == "block").cast("int").alias("blocked")
    )
    open_urls = ruled.where("rule_verdict IS NULL").select(
        "url", F.nullif(number, F.lit("")).cast("long").alias("doc_id")
    )
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("blocked")
    by_label = open_urls.join(labels.select("doc_id", bad), "doc_id").select("url", "blocked")
    return by_rule.unionByName(by_label).where("blocked IS NOT NULL")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    labelled = labelled_urls(pages, read_table(spark, sf_dir, "labels"))
    return judge_urls(pages, labelled)
