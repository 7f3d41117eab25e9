"""SimHash near-duplicates by deletion-variant signatures (operator 10).

A fingerprint of 64 bits is cut into two segments of 32. Of two fingerprints that
differ in at most two bits, one segment differs in at most one. Every segment is
indexed 32 times, each time with another of its bits as a wildcard, so such a pair
meets under an equal signature and is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import (
    SMALL_ROWS,
    attach,
    doc_key,
    fresh,
    read_table,
    stored,
    text_hash,
)
from tallyloom.llm.components import components

SEED = 42
WORDS = 3
MAX_DISTANCE = 2
#: Members of a signature up to which all its pairs are compared.
CROWD = 64
#: Shingles whose bits are counted at once.
_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles of ``words`` words of a UTF-8 text, in order."""
    import xxhash

    found = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(joined)]
    width = min(words, len(found))
    spans = zip(begins[: len(found) - width + 1], ends[width - 1 :])
    digest = xxhash.xxh64_intdigest
    total = len(found) - width + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", total)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text over shingles of ``words`` words, repeats included."""
    hashes = shingle_hashes(text, words)
    total = len(hashes)
    if not total:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _AT_ONCE):
        some = hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        found = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
            ["doc_id", "text_hash", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text, and the fingerprint ``fp`` as a long."""
    return docs.select(
        F.col("doc_id").cast("long"), text_hash("text").alias("text_hash"), "text"
    ).mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _signatures(prints: DataFrame) -> DataFrame:
    """64 rows per fingerprint: which segment and wildcard, and the other 31 bits."""
    signature = """explode(transform(sequence(0, 63), which ->
        shiftleft(bigint(which), 32) + (
            if(which < 32, fp & 4294967295, shiftrightunsigned(fp, 32))
            & ~shiftleft(1L, which % 32))))"""
    return prints.select("fp", F.expr(signature).alias("signature"))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_DISTANCE


def _links_by_flips(prints: DataFrame) -> DataFrame:
    """Links among fingerprints that crowd under one signature.

    Two fingerprints differ in at most two bits just if flipping at most one bit
    of each gives the same value. At most 65 fingerprints can give one value, and
    all of them are linked, so each is tied to the smallest of them.
    """
    flipped = "concat(array(fp), transform(sequence(0, 63), bit -> fp ^ shiftleft(1L, bit)))"
    values = prints.select("fp", F.explode(F.expr(flipped)).alias("value"))
    first = F.min("fp").over(W.partitionBy("value"))
    return values.select(first.alias("a"), F.col("fp").alias("b")).where("a < b")


def link_fingerprints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp``.

    Every two fingerprints that differ in one or two bits are connected, directly
    or by way of others that do; no other link is given. Signatures are counted
    first. Two members of a signature are compared at once, up to ``crowd`` of
    them in pairs; the members of larger ones are linked by flipped bits, which
    needs 65 rows for each, however many there are.
    """
    # Each fingerprint becomes 64 rows: small partitions must not be merged before.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signatures = _signatures(prints.repartition(tasks, "fp"))
    shared = stored(
        signatures.groupBy("signature")
        .agg(F.count("*").alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("members > 1")
    )
    twos = shared.where("members = 2").select("a", "b").where(_near("a", "b"))
    more = shared.where("members > 2").select("signature", "members")
    if more.isEmpty():
        return twos.distinct()
    if more.count() <= SMALL_ROWS:
        more = F.broadcast(more)
    met = stored(signatures.join(more, "signature"))
    few = met.where(F.col("members") <= crowd)
    pairs = (
        few.select("signature", F.col("fp").alias("a"))
        .join(few.select("signature", F.col("fp").alias("b")), "signature")
        .where((F.col("a") < F.col("b")) & _near("a", "b"))
        .select("a", "b")
    )
    crowded = met.where(F.col("members") > crowd).select("fp").distinct()
    return twos.unionAll(pairs).unionAll(_links_by_flips(crowded)).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``fp``, ``root``, ``component_id``.

    Reads ``doc_id`` and ``text``; other columns are not read. Documents are in
    one component if their fingerprints are equal or linked, at any remove.
    ``root`` names the component by its smallest fingerprint; ``component_id`` is
    its smallest doc_id.

    A NULL text counts as an empty one: fingerprint zero, linked like any other.
    Rows with NULL doc_id have components like other rows; one with no other
    doc_id has ``component_id`` NULL. Repeated rows stay. An empty table gives no
    rows. Copies share one fingerprint, so any number of them is one row in all
    joins but the last, which Spark splits where a fingerprint is frequent.
    """
    rows = stored(fingerprints(docs))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    links = stored(link_fingerprints(prints.select("fp")))
    roots = components(links)
    linked = stored(prints.join(roots.withColumnRenamed("node", "fp"), "fp"))
    firsts = stored(linked.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    of_linked = attach(linked, firsts, "root", F.col("fp")).select("fp", "root", "component_id")
    alone = prints.join(roots, prints.fp == roots.node, "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("first_doc").alias("component_id")
    )
    found = stored(of_linked.unionAll(alone))
    return rows.join(found, "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays.

    It is the one with the smallest doc_id, then the smallest hash of its text;
    of rows that agree in both, one. Columns are those given.
    """
    # Copies meet in their root: the minimum is taken in each task first.
    chosen = stored(
        near_duplicates(docs)
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    ).select(doc_key("first.doc_id"), "first.text_hash").distinct()
    key, mark = fresh(docs, "_id", "_hash")
    keyed = docs.withColumns({key: doc_key("doc_id"), mark: text_hash("text")})
    kept = keyed.join(chosen.toDF(key, mark), [key, mark], "left_semi")
    return kept.dropDuplicates([key, mark]).select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
