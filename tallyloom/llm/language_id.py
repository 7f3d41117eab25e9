"""Language identification by fused evidence (operator 4).

Bayes: the posterior of a language is its prior at the host times the likelihoods
of the text, of the language the markup declares, and of the address suffix. The
prior of a host is drawn towards that of the domain above it, this one towards that
of its top label, and this one towards that of the whole table. All of these are
counts by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import attach, read_table, stored
from tallyloom.llm.url_filter import host_of

LANGUAGES = ("de", "en", "es", "fr")
#: The text model is trained on a random sample of about so many texts of a language.
TRAINING_TEXTS = 1_500
SEED = 4
#: Buckets of byte triples. The model has one number per bucket and language.
BUCKETS = 1 << 15
_PARTS = 1 << 30
#: A triple tells less than its likelihood says, since triples overlap; and the
#: words of a text are of one language together, so a text tells only so much.
TEXT_WEIGHT = 0.3
TEXT_LIMIT = 30.0
#: Share of pages whose markup or address names the language they are written in, before
#: any is seen: it counts as ``SMOOTHING`` pages, beside those counted.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
#: No declaration is taken to be right more often than this.
MOST_RIGHT = 0.99
#: Pages by which a host is drawn towards the level above.
SMOOTHING = 20.0
#: A document is rejected below this posterior, or if its letters are less likely in
#: every language than if all triples were equally common.
MIN_POSTERIOR = 0.5

# Address suffixes that stand for one of the languages.
SUFFIX_LANGUAGE = {
    "de": "de", "at": "de", "es": "es", "mx": "es", "fr": "fr", "uk": "en", "us": "en",
}


def _triples(data: bytes) -> np.ndarray:
    """Buckets of all byte triples of letters in a text in lower case.

    What is not a letter counts as a blank, and blanks in a row as one.
    """
    text = data.decode("utf-8", "replace").lower()
    raw = np.frombuffer(text.encode(), np.uint8)
    letters = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    kept = np.where(letters, raw, 32).astype(np.uint32)
    kept = np.concatenate([[32], kept, [32]]).astype(np.uint32)
    double = (kept[1:] == 32) & (kept[:-1] == 32)
    kept = kept[np.concatenate([[True], ~double])]
    if len(kept) < 3:
        return np.zeros(0, np.int64)
    mixed = (kept[:-2] * 961 + kept[1:-1] * 31 + kept[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Log likelihood of each bucket in each language, less that of any bucket."""

    languages: tuple[str, ...]
    gains: np.ndarray

    def evidence(self, text: bytes) -> tuple[list[float], bool]:
        """Bounded log likelihoods, and whether some language explains the text."""
        triples = _triples(text)
        if not len(triples):
            return [0.0] * len(self.languages), False
        sums = np.bincount(triples, minlength=BUCKETS) @ self.gains
        relative = np.maximum((sums - sums.max()) * TEXT_WEIGHT, -TEXT_LIMIT)
        return relative.tolist(), bool(sums.max() > 0)


def _counts(
    languages: tuple[str, ...],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Triples by bucket and language within a task: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for language, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                found[languages.index(language)] += np.bincount(
                    _triples(text.encode()), minlength=BUCKETS
                )
        at, bucket = np.nonzero(found)
        columns = (at.astype(np.int32), bucket.astype(np.int32), found[at, bucket])
        yield pa.RecordBatch.from_arrays(
            [pa.array(column) for column in columns], ["language", "bucket", "n"]
        )

    return count


def train_text_model(
    labelled: DataFrame,
    languages: Sequence[str] = LANGUAGES,
    training_texts: int = TRAINING_TEXTS,
) -> TextModel:
    """Learn from ``lang`` and ``text``; rows of other languages are left out.

    The sample has about ``training_texts`` of each language, at most; copies count once. Of a language with no
    sample every triple is equally likely. What comes to the driver has ``BUCKETS``
    rows per language.
    """
    names = tuple(languages)
    known = labelled.where(F.col("lang").isin(*names) & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("texts")).collect()
    texts = {row.lang: row.texts for row in sizes}
    share = F.lit(0.0)
    for name, number in texts.items():
        share = F.when(F.col("lang") == name, min(1.0, training_texts / number)).otherwise(share)
    # By their hash, so that the same texts are drawn however the rows are stored; of
    # copies one, so that a text that is a third of all rows is not a third of these.
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "lang", "text"), F.lit(_PARTS)) / _PARTS
    sample = known.where(drawn < share).dropDuplicates(["lang", "text"])
    rows = (
        sample.select("lang", "text")
        .mapInArrow(_counts(names), "language int, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.full((BUCKETS, len(names)), 0.5)
    for row in rows:
        counts[row.bucket, row.language] += row.n
    return TextModel(names, np.log(counts / counts.sum(axis=0)) + np.log(BUCKETS))


def _reader(
    model: TextModel,
    text: str,
    keep: Sequence[str] | None,
    to_text: Callable[[bytes], bytes] | None,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the evidence of the text in column ``row``; keeps some fields of it, or all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = row.field(text).cast(pa.large_binary())
            found = [
                model.evidence(to_text(raw) if to_text else raw)
                for raw in (x.as_py() or b"" for x in texts)
            ]
            if keep is not None:
                row = pa.StructArray.from_arrays([row.field(name) for name in keep], list(keep))
            of_text = pa.array([x[0] for x in found], pa.list_(pa.float64()))
            explained = pa.array([x[1] for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [row, *batch.columns[1:], of_text, explained], [*batch.schema.names, *_EVIDENCE]
            )

    return read


_EVIDENCE = ["_of_text", "_explained"]


def _first(values: Column, largest: Column, names: Sequence[str]) -> Column:
    """The first name whose value is the largest."""
    return F.get(F.array(*map(F.lit, names)), F.array_position(values, largest).cast("int") - 1)


def _right(hits: float | None, named: float | None, before: float) -> float:
    """How often a declaration is right, as counted, drawn towards what is expected."""
    found = ((hits or 0.0) + SMOOTHING * before) / ((named or 0.0) + SMOOTHING)
    return min(max(found, 0.01), MOST_RIGHT)


def _named(languages: Sequence[str], value: Column, right: float) -> Column:
    """Log likelihoods of a declaration; 0 each if it is none of the languages."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    logs = [
        F.when(value == name, float(np.log(right))).otherwise(float(np.log(wrong)))
        for name in languages
    ]
    return F.when(value.isin(*languages), F.array(*logs)).otherwise(
        F.array(*[F.lit(0.0)] * len(languages))
    )


def _counts_by_host(rows: DataFrame, languages: Sequence[str]) -> DataFrame:
    """How many rows of a host are written in each language, by their text alone.

    Also how many of them name a language, and how many the one they are written in.
    """
    sums = [
        F.sum((F.col("_by_text") == name).cast("double")).alias(f"_host_{name}")
        for name in languages
    ]
    for kind, value in (("declared", F.col("_declared")), ("suffix", _of_suffix())):
        sums.append(F.sum(value.isin(*languages).cast("double")).alias(f"_{kind}_named"))
        sums.append(F.sum((value == F.col("_by_text")).cast("double")).alias(f"_{kind}_right"))
    return rows.where(F.col("_by_text").isNotNull()).groupBy("_host").agg(*sums)


def _of_suffix() -> Column:
    """The language that the address suffix stands for; NULL if it is of none."""
    by_suffix = F.create_map(*(F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair))
    return by_suffix[F.col("_suffix")]


def host_priors(hosts: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``_host`` and ``_prior``, the smoothed share of each language there.

    ``hosts`` has one row per host: how many rows are written in each language. A
    domain is what follows the first dot of a host, or the host where it has none;
    the levels above are sums over the hosts.
    """
    own = [f"_host_{name}" for name in languages]
    parts = hosts.withColumn(
        "_domain",
        F.when(F.col("_host").contains("."), F.regexp_extract("_host", r"^[^.]*\.(.*)$", 1))
        .otherwise(F.col("_host")),
    ).withColumn("_top", F.substring_index("_domain", ".", -1))
    whole = parts.agg(*(F.sum(name).alias(name) for name in own)).first()
    counts = np.array([x or 0.0 for x in whole]) + 1.0
    prior = [F.lit(float(x)) for x in counts / counts.sum()]
    for level in ("_top", "_domain", "_host"):
        if level == "_host":
            found, columns = parts, own
        else:
            columns = [f"{level}_{name}" for name in languages]
            sums = parts.groupBy(level).agg(
                *(F.sum(a).alias(b) for a, b in zip(own, columns))
            )
            parts = found = attach(parts, stored(sums), level, F.col("_host"))
        total = sum((F.col(name) for name in columns), F.lit(0.0))
        prior = [
            (F.col(name) + SMOOTHING * above) / (total + SMOOTHING)
            for name, above in zip(columns, prior)
        ]
        if level != "_host":
            names = [f"_p{level}_{name}" for name in languages]
            parts = parts.withColumns(dict(zip(names, prior)))
            prior = [F.col(name) for name in names]
    return found.select("_host", F.array(*prior).alias("_prior"))


def identify(
    rows: DataFrame,
    model: TextModel,
    text: str,
    declared: Column,
    host: Column,
    suffix: Column,
    keep: Sequence[str] | None = None,
    to_text: Callable[[bytes], bytes] | None = None,
) -> DataFrame:
    """``row`` (the given row, or its ``keep`` columns), ``language``, ``posterior``, ``accepted``.

    ``text`` names the column of texts (or of markup, with ``to_text`` to turn it
    into text); ``declared``, ``host`` and ``suffix`` are the other evidence. One
    that is NULL, or names none of the model's languages, tells nothing. Of equally
    likely languages the first of the model's counts. How far a declaration or a suffix
    is believed is counted too: how often it is the language of the text, among the rows
    whose text tells one.

    A row is rejected, with ``accepted`` false, if its text has no letters (NULL and
    empty texts too), if no language explains it better than chance, or if the best
    posterior is below ``MIN_POSTERIOR``. Repeated rows stay; an empty table gives
    no rows. The columns of a row are a struct, so no name can clash.

    The evidence of rows cut down to ``keep`` is stored; of whole rows it is taken
    twice, for the priors and for the result. Counts by host are taken within each
    task before the shuffle, and priors come back by ``attach``, so a host may hold
    a third of all rows. Texts are not shuffled unless hosts are too many to be
    broadcast.
    """
    names = model.languages
    plain = rows.select(
        F.struct(*rows.columns).alias("row"),
        F.lower(F.substring_index(F.regexp_replace(declared, "_", "-"), "-", 1)).alias("_declared"),
        F.coalesce(host, F.lit("")).alias("_host"),
        F.lower(suffix).alias("_suffix"),
    )

    def evidence(fields: Sequence[str] | None) -> DataFrame:
        row = plain.schema["row"].dataType
        if fields is not None:
            row = T.StructType([row[name] for name in fields])
        schema = T.StructType([T.StructField("row", row), *plain.schema.fields[1:]])
        schema.add("_of_text", T.ArrayType(T.DoubleType())).add("_explained", T.BooleanType())
        return plain.mapInArrow(_reader(model, text, fields, to_text), schema)

    read = evidence(keep) if keep is None else stored(evidence(keep))
    best = F.array_max("_of_text")
    by_text = F.when(F.col("_explained"), _first(F.col("_of_text"), best, names))
    counted = read if keep is not None else evidence([text]).drop("row")
    hosts = stored(_counts_by_host(counted.withColumn("_by_text", by_text), names))
    priors = stored(host_priors(hosts, names))
    rated = attach(read, priors, "_host", F.xxhash64("_of_text", "_declared"))
    even = F.array(*[F.lit(1.0 / len(names))] * len(names))
    said = hosts.agg(
        *(F.sum(f"_{kind}_{what}") for kind in ("declared", "suffix") for what in ("right", "named"))
    ).first()
    declared_right = _right(said[0], said[1], DECLARED_RIGHT)
    suffix_right = _right(said[2], said[3], SUFFIX_RIGHT)
    logs = F.zip_with(
        F.zip_with(
            F.zip_with("_of_text", F.coalesce("_prior", even), lambda a, b: a + F.log(b)),
            _named(names, F.col("_declared"), declared_right),
            lambda a, b: a + b,
        ),
        _named(names, _of_suffix(), suffix_right),
        lambda a, b: a + b,
    )
    weights = rated.withColumn("_logs", logs)
    top = F.array_max("_logs")
    total = F.aggregate("_logs", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - top))
    return weights.select(
        "row",
        _first(F.col("_logs"), top, names).alias("language"),
        (1.0 / total).alias("posterior"),
        (F.col("_explained") & (1.0 / total >= MIN_POSTERIOR)).alias("accepted"),
    )


# --- queries ------------------------------------------------------------------


def _markup_text(markup: bytes) -> bytes:
    """The text between tags, without scripts and styles."""
    import re

    bare = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", b" ", markup)
    bare = re.sub(rb"(?s)<[^>]*>", b" ", bare)
    return re.sub(rb"&[#0-9A-Za-z]+;", b" ", bare)


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with the columns given.

    ``lang`` is what they declare, ``source`` their host; they have no address.
    """
    model = train_text_model(docs.select("lang", "text"))
    found = identify(
        docs, model, "text", F.col("lang"), F.col("source"), F.lit(None).cast("string")
    )
    return found.where("accepted").select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: text and ``lang`` of the markup, host and suffix of the address."""
    model = train_text_model(read_table(spark, sf_dir, "documents").select("lang", "text"))
    pages = read_table(spark, sf_dir, "pages")
    rows = pages.select("page_id", "html", host_of("url").alias("host"))
    declared = F.nullif(
        F.regexp_extract("html", r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z-]+)", 1), F.lit("")
    )
    found = identify(
        rows,
        model,
        "html",
        declared,
        F.col("host"),
        F.substring_index("host", ".", -1),
        ["page_id", "host"],
        to_text=_markup_text,
    )
    return found.select("row.*", "language", F.round("posterior", 9).alias("posterior"), "accepted")
