"""Finding benchmark passages, re-parameterised ones too (operator 5).

Words become a template: numbers, names and units give way to typed placeholders.
Windows of templates are hashed and joined with those of the benchmark. Where they
match, the words behind the placeholders are compared: what stands for a value of
the benchmark in most places must stand for it, and no other does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import doc_key, fresh, let, read_table, stored, text_hash

#: Words of a window, and how many of them must not be placeholders.
WIDTH = 8
LITERALS = 5
#: Words of a benchmark item that a document must hold to count as contaminated,
#: or else this share of the item.
MIN_WORDS = 13
MIN_SHARE = 0.8
#: A table is broadcast up to so many rows of a few numbers, and characters besides.
SMALL_WINDOWS = 200_000
SMALL_CHARS = 8_000_000

# Words that name a unit.
UNITS = (
    "cm", "days", "dollars", "euros", "feet", "grams", "hours", "inches", "kg", "km",
    "kwh", "liters", "litres", "meters", "metres", "mg", "miles", "minutes", "ml", "mm",
    "months", "mph", "percent", "pounds", "seconds", "weeks", "years",
)
NUMBER, UNIT, NAME = "0n", "0u", "0a"


def words_of(text: str | Column) -> Column:
    """Runs of letters, marks and digits, in order."""
    cut = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(cut, lambda word: word != "")


#: A number with its separators, a run of name words, or any other word. Repeated
#: groups give nothing back, so that a run of any length needs no stack.
_TOKEN = (
    r"\p{N}[\p{L}\p{M}\p{N}]*+(?:[.,]\p{N}[\p{L}\p{M}\p{N}]*+)*+"
    r"|\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*+(?:(?:\s++|[-'’])\p{Lu}\p{Ll}[\p{L}\p{M}\p{N}]*+)*+"
    r"|[\p{L}\p{M}\p{N}]+"
)


def tokens_of(text: str | Column) -> Column:
    """The words, where those of one number or one run of names are one token."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def template_word(word: Column) -> Column:
    """The lower-cased word, or the placeholder of its type.

    A number begins with a digit, a name with one capital and a small letter. No
    literal word begins with a digit, so none can be taken for a placeholder.
    """
    return (
        F.when(word.rlike(r"^\p{N}"), NUMBER)
        .when(F.lower(word).isin(*UNITS), UNIT)
        .when(word.rlike(r"^\p{Lu}\p{Ll}"), NAME)
        .otherwise(F.lower(word))
    )


def _is_slot(word: Column) -> Column:
    return word.startswith("0")


#: Ways to compare: words in lower case, and templates of tokens.
VERBATIM, BY_TOKENS = range(2)


def _templates(words: Column, tokens: Column) -> list[Column]:
    """What is compared in each way."""
    lowered = F.transform(words, lambda word: F.lower(word))
    return [lowered, F.transform(tokens, template_word)]


def _windows(template: Column, way: int) -> Column:
    """All windows of ``WIDTH`` as structs: a hash, which is of the way too, and the place."""

    def joined(hashes: Column) -> Column:
        number = F.greatest(F.size(hashes) - (WIDTH - 1), F.lit(0))
        return F.transform(
            F.slice(F.sequence(F.lit(0), F.size(hashes)), F.lit(1), number),
            lambda at: F.struct(
                F.xxhash64(F.lit(way), *(hashes[at + k] for k in range(WIDTH))).alias("window"),
                at.alias("pos"),
            ),
        )

    return let(F.transform(template, lambda word: F.xxhash64(word)), joined)


def _small(facts: DataFrame, chars: Column | None = None) -> DataFrame:
    """To be broadcast if it is measured to be small; else left to Spark.

    ``chars`` is the size of a row where it is not a few numbers.
    """
    rows, size = facts.agg(F.count("*"), F.sum(chars if chars is not None else F.lit(0))).first()
    return F.broadcast(facts) if rows <= SMALL_WINDOWS and (size or 0) <= SMALL_CHARS else facts


def _items(benchmark: DataFrame) -> DataFrame:
    """Different items: ``item_id``, ``item_text``, ``item_words`` and ``item_key``.

    The key tells items apart also where they have no item_id.
    """
    return stored(
        benchmark.groupBy(F.coalesce("text", F.lit("")).alias("item_text"))
        .agg(F.min("item_id").alias("item_id"))
        .withColumns({"item_words": F.size(words_of("item_text")), "item_key": F.xxhash64("item_text")})
    )


def _item_tokens(items: DataFrame) -> DataFrame:
    """A row for each way, item and token: where it is, its value, and its words' places."""
    cut = items.select("item_key", words_of("item_text").alias("w"), tokens_of("item_text").alias("t"))
    templates = _templates(F.col("w"), F.col("t"))
    parts = []
    for way, (value, template) in enumerate(zip(("w", "t"), templates)):
        zipped = cut.select("item_key", F.posexplode(F.arrays_zip(F.col(value).alias("v"), template.alias("k"))))
        parts.append(
            zipped.select(
                F.lit(way).alias("way"),
                "item_key",
                F.col("pos").alias("at"),
                F.lower("col.v").alias("ours"),
                (F.lit(way != VERBATIM) & _is_slot(F.col("col.k"))).alias("is_slot"),
                F.size(words_of("col.v")).alias("n_words"),
            )
        )
    before = W.partitionBy("way", "item_key").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return reduce(DataFrame.unionAll, parts).select(
        "*", F.coalesce(F.sum("n_words").over(before), F.lit(0)).cast("int").alias("first_word")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item: one row per document and item.

    Reads ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of the
    benchmark. Gives ``doc_id``, ``text_hash``, ``item_id``, ``matched_words`` (words
    of the item found), ``item_words``, and ``reparameterised`` (whether some of the
    words were found by a template only).

    A document holds an item if it has ``MIN_WORDS`` of its words, or ``MIN_SHARE`` of
    them, in windows of ``WIDTH`` that match in one of two ways: of words equal but for
    case; of tokens of equal templates, with at least ``LITERALS`` literal words, where
    a number with its separators and a run of names are one placeholder each.
    Windows at one distance between the place in the document and in the item are one
    alignment. There a value of the item stands for the value that most of its places
    have in the document, of equally frequent ones the smallest; placeholders with
    another are left out, and only they. Two values that become one do not contradict
    each other.

    NULL texts are empty. Items of fewer than ``WIDTH`` words can't be told from
    chance within a text: such an item is held by documents that say nothing else, in
    whatever case; one without words by none. Items with equal text are one, with the
    smallest item_id; rows with the same doc_id and text are one document. Empty
    tables give no rows. Document windows are joined, never grouped, before they have
    matched, so a frequent passage is only as many rows as it has windows.
    """
    items = _items(benchmark)
    tokens = stored(_item_tokens(items))
    keyed = docs.select(
        doc_key("doc_id").alias("_id"), text_hash("text").alias("text_hash"), "doc_id", "text"
    )
    keys = ["_id", "text_hash"]
    # A text is cut once for all ways, and its windows are joined once.
    cut = keyed.select(*keys, words_of("text").alias("w"), tokens_of("text").alias("t"))
    of_docs = cut.select(*keys, F.explode(_all_windows(F.col("w"), F.col("t"))).alias("at")).select(
        *keys, "at.window", "at.pos"
    )
    of_items = stored(_item_windows(items))
    spans = stored(
        of_docs.join(_small(of_items), "window")
        .groupBy(*keys, "item_key", "way", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.collect_set("item_pos").alias("starts"))
    )
    wanted = _small(stored(spans.select(*keys).distinct()))
    values = (
        keyed.join(wanted, keys, "left_semi")
        .dropDuplicates(keys)
        .select(*keys, "doc_id", words_of("text").alias("w"), tokens_of("text").alias("t"))
    )
    covered = F.array_distinct(
        F.flatten(F.transform("starts", lambda at: F.sequence(at, at + (WIDTH - 1))))
    )
    said = F.when(F.col("way") == BY_TOKENS, F.col("t")).otherwise(F.col("w"))
    aligned = (
        spans.withColumn("at", F.explode(covered))
        .join(_small(tokens, F.length("ours")), ["way", "item_key", "at"])
        .drop("starts")
    )
    place = [*keys, "doc_id", "item_key", "way", "shift"]
    compared = stored(
        aligned.join(values, keys).select(
            *place, "ours", F.lower(said[F.col("at") + F.col("shift")]).alias("theirs"),
            "is_slot", "first_word", "n_words",
        )
    )
    votes = compared.where("is_slot").groupBy(*place, "ours", "theirs").agg(
        F.count("*").alias("n"), F.collect_list(F.struct("first_word", "n_words")).alias("places")
    )
    by_vote = W.partitionBy(*place, "ours").orderBy(F.desc("n"), "theirs")
    elected = (
        votes.withColumn("place", F.row_number().over(by_vote))
        .where("place = 1")
        .select(*place, "ours", "theirs", F.explode("places").alias("one"))
        .select(*place, (F.col("ours") == F.col("theirs")).alias("equal"), "one.first_word", "one.n_words")
    )
    literal = compared.where("NOT is_slot").select(*place, F.lit(True).alias("equal"), "first_word", "n_words")
    found = elected.unionAll(literal).withColumn(
        "word", F.explode(F.expr("sequence(first_word, first_word + n_words - 1)"))
    )
    matched = (
        found.groupBy(*keys, "doc_id", "item_key", "word")
        .agg(F.max("equal").alias("equal"))
        .groupBy(*keys, "doc_id", "item_key")
        .agg(F.count("*").cast("int").alias("matched_words"), F.max(~F.col("equal")).alias("reparameterised"))
        .join(_small(items.select("item_key", "item_id", "item_words")), "item_key")
        .where(
            (F.col("matched_words") >= MIN_WORDS)
            | (F.col("matched_words") >= MIN_SHARE * F.col("item_words"))
        )
    )
    columns = ["doc_id", "text_hash", "item_id", "matched_words", "item_words", "reparameterised"]
    return matched.select(*columns).unionByName(_whole(keyed, items).select(*columns))


def _all_windows(words: Column, tokens: Column) -> Column:
    return F.concat(*(_windows(template, way) for way, template in enumerate(_templates(words, tokens))))


def _item_windows(items: DataFrame) -> DataFrame:
    """``way``, ``window``, ``item_key`` and ``item_pos``; templates with enough literals."""
    cut = items.select("item_key", words_of("item_text").alias("w"), tokens_of("item_text").alias("t"))
    parts = []
    for way, template in enumerate(_templates(F.col("w"), F.col("t"))):
        rows = cut.select("item_key", template.alias("k")).select(
            "item_key", "k", F.explode(_windows(F.col("k"), way)).alias("one")
        )
        if way != VERBATIM:
            inside = F.slice("k", F.col("one.pos") + 1, WIDTH)
            rows = rows.where(F.size(F.filter(inside, lambda word: ~_is_slot(word))) >= LITERALS)
        parts.append(
            rows.select(
                F.lit(way).alias("way"), "one.window", "item_key", F.col("one.pos").alias("item_pos")
            )
        )
    return reduce(DataFrame.unionAll, parts)


def _whole(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are an item of fewer than ``WIDTH`` words, and say nothing else."""

    def whole(text: str) -> Column:
        return F.array_join(F.transform(words_of(text), lambda word: F.lower(word)), " ")

    short = stored(
        items.where(F.col("item_words").between(1, WIDTH - 1))
        .select(whole("item_text").alias("whole"), "item_id", "item_words")
        .groupBy("whole", "item_words")
        .agg(F.min("item_id").alias("item_id"))
    )
    if short.isEmpty():
        return keyed.limit(0).select(
            "doc_id", "text_hash", F.lit(None).cast("long").alias("item_id"),
            F.lit(0).alias("matched_words"), F.lit(0).alias("item_words"), F.lit(False).alias("reparameterised"),
        )
    found = keyed.dropDuplicates(["_id", "text_hash"]).withColumn("whole", whole("text"))
    return found.join(_small(short, F.length("whole")), "whole").select(
        "doc_id", "text_hash", "item_id", F.col("item_words").alias("matched_words"), "item_words",
        F.lit(False).alias("reparameterised"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns given."""
    found = contamination(docs, benchmark).select(doc_key("doc_id").alias("_id"), "text_hash")
    return _without(docs, found)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    key, mark = fresh(docs, "_id", "_hash")
    found = stored(rows.toDF(key, mark).distinct())
    keyed = docs.withColumns({key: doc_key("doc_id"), mark: text_hash("text")})
    return keyed.join(_small(found), [key, mark], "left_anti").select(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.drop("text_hash")


def _sql_words(text: str) -> str:
    return rf"""list_filter(regexp_split_to_array({text}, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"""


def _sql_template(words: str) -> str:
    units = ", ".join(f"'{unit}'" for unit in UNITS)
    return rf"""list_transform({words}, lambda x: CASE
    WHEN regexp_matches(x, '^\p{{N}}') THEN '{NUMBER}'
    WHEN list_contains([{units}], lower(x)) THEN '{UNIT}'
    WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') THEN '{NAME}' ELSE lower(x) END)"""


def _sql_ways(key: str, rows: str) -> str:
    """Tokens and templates of texts in both ways."""
    token = _TOKEN.replace("*+", "*").replace("++", "+").replace("'", "''")
    return f"""
  SELECT {key}, unnest([
    {{'way': 0, 'tokens': words, 'template': list_transform(words, lambda x: lower(x))}},
    {{'way': 1, 'tokens': tokens, 'template': {_sql_template("tokens")}}}], recursive := true)
  FROM (SELECT {key}, {_sql_words("text")} AS words,
               regexp_extract_all(text, '{token}') AS tokens FROM {rows})"""


OP5_SQL = f"""
WITH items AS (
  SELECT min(item_id) AS item_id, coalesce(text, '') AS text FROM benchmark GROUP BY 2
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), of_items AS ({_sql_ways("item_id", "items")}
), of_docs AS ({_sql_ways("doc_id", "docs")}
), item_windows AS (
  SELECT * FROM (
    SELECT way, item_id, item_pos, template[item_pos + 1 : item_pos + {WIDTH}] AS likeness
    FROM (SELECT *, unnest(range(len(template) - {WIDTH - 1})) AS item_pos FROM of_items))
  WHERE way = 0 OR len(list_filter(likeness, lambda x: NOT starts_with(x, '0'))) >= {LITERALS}
), doc_windows AS (
  SELECT way, doc_id, pos, template[pos + 1 : pos + {WIDTH}] AS likeness
  FROM (SELECT *, unnest(range(len(template) - {WIDTH - 1})) AS pos FROM of_docs)
), covered AS (
  SELECT DISTINCT doc_id, item_id, way, pos - item_pos AS shift,
         unnest(range(item_pos, item_pos + {WIDTH})) AS spot
  FROM doc_windows JOIN item_windows USING (way, likeness)
), said AS (
  SELECT c.*, lower(i.tokens[spot + 1]) AS ours, lower(d.tokens[spot + shift + 1]) AS theirs,
         way <> 0 AND starts_with(i.template[spot + 1], '0') AS slot
  FROM covered c JOIN of_items i USING (item_id, way) JOIN of_docs d USING (doc_id, way)
), votes AS (
  SELECT doc_id, item_id, way, shift, ours, theirs,
         row_number() OVER (PARTITION BY doc_id, item_id, way, shift, ours
                            ORDER BY count(*) DESC, theirs) AS place
  FROM said WHERE slot GROUP BY doc_id, item_id, way, shift, ours, theirs
), tokens AS (
  SELECT item_id, way, spot, n, coalesce(sum(n) OVER (
           PARTITION BY item_id, way ORDER BY spot
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
  FROM (SELECT item_id, way, spot, len({_sql_words("tokens[spot + 1]")}) AS n
        FROM (SELECT *, unnest(range(len(tokens))) AS spot FROM of_items))
), words AS (
  SELECT doc_id, item_id, first_word + unnest(range(n)) AS word, ours = theirs AS equal
  FROM (SELECT said.* FROM said LEFT JOIN votes USING (doc_id, item_id, way, shift, ours, theirs)
        WHERE NOT slot OR place = 1) JOIN tokens USING (item_id, way, spot)
), matched AS (
  SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS matched_words,
         bool_or(NOT equal) AS reparameterised
  FROM (SELECT doc_id, item_id, word, bool_or(equal) AS equal FROM words GROUP BY ALL)
  GROUP BY doc_id, item_id
), sizes AS (
  SELECT item_id, CAST(len(tokens) AS INTEGER) AS item_words, array_to_string(template, ' ') AS whole
  FROM of_items WHERE way = 0
)
SELECT doc_id, item_id, matched_words, item_words, reparameterised
FROM matched JOIN sizes USING (item_id)
WHERE matched_words >= {MIN_WORDS} OR matched_words >= {MIN_SHARE} * item_words
UNION ALL
SELECT doc_id, min(item_id), item_words, item_words, false
FROM of_docs JOIN sizes ON array_to_string(template, ' ') = whole AND item_words < {WIDTH}
WHERE way = 0 AND item_words > 0
GROUP BY doc_id, item_words"""
