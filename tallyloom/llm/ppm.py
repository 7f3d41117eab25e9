"""Scoring texts by prediction by partial matching (operator 8).

The model is a trie of byte contexts with the counts of the bytes that followed.
The probability of a byte is taken from its longest context that knows it; each
longer one that does not gives an escape, whose share is estimated by the number
of different bytes seen there (method D: half of it, over the bytes counted), and
the bytes it has seen are excluded below.

The trie is a table, one row per context, built level by level by Spark. Texts are
dealt to blocks of bounded size. A block asks only for the byte sequences that
occur in it, so no task holds the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import doc_key, read_table, stored, text_hash

#: Bytes of context.
ORDER = 5
#: Expected characters of text in a block.
BLOCK_CHARS = 16_000_000
#: Bytes whose sequences and words are counted at once.
_AT_ONCE = 4_000_000
#: Bytes that a text counts for besides its own: those put between texts.
_BETWEEN = 8
_END = b"\n"


# --- within a block -----------------------------------------------------------


def _body(text: bytes) -> bytes:
    """Words between ASCII blanks, A-Z in lower case, one blank between them, and an end."""
    return b" ".join(text.lower().split()) + _END


def _grams(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ``order`` bytes before it, and where each body begins.

    A text begins as if after an end of text, so it does not matter what it follows.
    """
    pad = _END * order
    stream = np.frombuffer(_END * (7 - order) + pad + pad.join(bodies), np.uint8)
    pairs = stream[:-1].astype(np.uint16) << 8 | stream[1:]
    fours = pairs[:-2].astype(np.uint32) << 16 | pairs[2:]
    eights = fours[:-4].astype(np.int64) << 32 | fours[4:]
    lengths = np.array([len(body) for body in bodies], np.int64)
    begins = np.cumsum(lengths) - lengths
    inside = np.ones(len(eights), bool)
    pads = begins[1:, None] + order * np.arange(len(bodies) - 1)[:, None] + np.arange(order)
    inside[pads] = False
    return eights[inside] & ((1 << (8 * (order + 1))) - 1), begins


def _tokens(bodies: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Every word and end as its place among the different ones; these; where each body begins."""
    stream = np.frombuffer(b"".join(bodies), np.uint8)
    blank, end = stream == ord(" "), stream == ord(_END)
    first = end.copy()
    first[0] = True
    first[1:] |= blank[:-1] | end[:-1]
    begins = np.flatnonzero(first[~blank])
    places = np.append(begins, len(stream) - np.count_nonzero(blank))
    buffers = [None, pa.py_buffer(places), pa.py_buffer(stream[~blank])]
    tokens = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
    _, places, texts = tokens.dictionary.buffers()
    places = np.frombuffer(places, np.int64, len(tokens.dictionary) + 1).tolist()
    texts = texts.to_pybytes()
    different = [texts[begin:stop] for begin, stop in zip(places, places[1:])]
    after = np.flatnonzero(end[first]) + 1
    return tokens.indices.to_numpy(), different, np.append(0, after[:-1])


def _batches(bodies: Iterable[bytes]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for body in bodies:
        some.append(body)
        size += len(body) + _BETWEEN
        if size >= _AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(counts, begins)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes as compressed planes of bytes, sorted ones as differences."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), 1)


def _restored(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def _keys_blob(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.int64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_restored(blob))


@dataclass(frozen=True)
class _Extract:
    """What a block contains, for each shard of the keys, and how often in training."""

    order: int
    shards: int

    def __call__(self, docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        bodies: dict[bool, list[bytes]] = {False: [], True: []}
        for held_out, text in zip(docs.column("held_out").to_pylist(), docs.column("body")):
            bodies[held_out].append(_body(text.as_py()))
        columns = [range(self.shards), [block] * self.shards]
        for keys, counts in self._counted(bodies):
            shards = _shard_of(keys, self.shards)
            order = np.argsort(shards, kind="stable")
            begins = np.searchsorted(shards[order], np.arange(1, self.shards))
            columns.append(map(_keys_blob, np.split(keys[order], begins)))
            columns.append(map(_squeezed, np.split(counts[order], begins)))
        return pa.Table.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, _KEY_TYPES)], _KEY_NAMES
        )

    def _counted(self, bodies: dict[bool, list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Byte sequences and hashes of words, each with their counts in training."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams, of_words = [nothing], [nothing]
        for held_out, own in bodies.items():
            for some in _batches(own):
                found, times = np.unique(_grams(some, self.order)[0], return_counts=True)
                grams.append((found, np.zeros_like(times) if held_out else times))
                at, words, _ = _tokens(some)
                times = np.bincount(at)
                of_words.append((_word_hashes(words), np.zeros_like(times) if held_out else times))
        return [_summed(*map(np.concatenate, zip(*found))) for found in (grams, of_words)]


_KEY_NAMES = ["shard", "block", "grams", "gram_counts", "words", "word_counts"]
_KEY_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_KEY_SCHEMA = (
    "shard long, block long, grams binary, gram_counts binary, words binary, word_counts binary"
)


# --- within a shard of the keys -----------------------------------------------


def _over_blocks(keys: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    found = [_keys(blob) for blob in keys.column(f"{name}s").to_pylist()]
    counts = [_restored(blob) for blob in keys.column(f"{name}_counts").to_pylist()]
    return _summed(np.concatenate(found), np.concatenate(counts))


def _merge(keys: pa.Table) -> pa.Table:
    """Counts of the byte sequences over all blocks; last, the words of the shard.

    The words are one row: how many different ones training has, and how many in all.
    """
    grams, times = _over_blocks(keys, "gram")
    _, of_words = _over_blocks(keys, "word")
    shard = keys.column("shard")[0].as_py()
    ends = [int((of_words > 0).sum())], [int(of_words.sum())]
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(grams) + 1, shard)),
            pa.array(np.append(np.zeros(len(grams), bool), True)),
            pa.array(np.append(grams, ends[0])),
            pa.array(np.append(times, ends[1])),
        ],
        ["shard", "is_words", "gram", "n"],
    )


def _answer(keys: pa.Table, costs: pa.Table) -> pa.Table:
    """To each block, the costs of its byte sequences and the counts of its words."""
    order = np.argsort(costs.column("gram").to_numpy())
    grams = costs.column("gram").to_numpy()[order]
    cost = costs.column("cost").to_numpy()[order]
    words, times = _over_blocks(keys, "word")
    rows = []
    for block, own_grams, own_words in zip(
        keys.column("block").to_pylist(),
        keys.column("grams").to_pylist(),
        keys.column("words").to_pylist(),
    ):
        costs_of = cost[np.searchsorted(grams, _keys(own_grams))].astype(np.float32)
        counts_of = times[np.searchsorted(words, _keys(own_words))]
        rows.append((block, own_grams, costs_of.tobytes(), own_words, _squeezed(counts_of)))
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), *[pa.binary()] * 4])],
        ["block", "grams", "costs", "words", "counts"],
    )


_ANSWER_SCHEMA = "block long, grams binary, costs binary, words binary, counts binary"


# --- scores -------------------------------------------------------------------


class _Lookup:
    """Values by key, for many keys at once: a table of hashes with open addresses."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, values.dtype)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[left[free]]
            done = self.keys[slots] == keys[left]
            self.values[slots[done]] = values[left[done]]
            left, slots = left[~done], (slots[~done] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be known."""
        slots = self._slots(keys)
        out = self.values[slots]
        left = np.flatnonzero(self.keys[slots] != keys)
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slots] == keys[left]
            out[left[hit]] = self.values[slots[hit]]
            left, slots = left[~hit], slots[~hit]
        return out


@dataclass(frozen=True)
class _Score:
    order: int
    train_tokens: int
    train_words: int

    def __call__(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        cost_of = _Lookup(
            np.concatenate([_keys(blob) for blob in answers.column("grams").to_pylist()]),
            np.concatenate(
                [np.frombuffer(blob, np.float32) for blob in answers.column("costs").to_pylist()]
            ),
        )
        hashes = np.concatenate([_keys(blob) for blob in answers.column("words").to_pylist()])
        times = np.concatenate([_restored(blob) for blob in answers.column("counts").to_pylist()])
        order = np.argsort(hashes)
        hashes, times = hashes[order], times[order]
        whole = self.train_tokens + 0.5 * (self.train_words + 1)
        logs = np.log10((times + 0.5) / whole)
        found = [[np.zeros(0, kind) for kind in (np.int64, np.int64, np.float64, np.float64)]]
        for some in _batches(_body(text.as_py()) for text in docs.column("body")):
            grams, begins = _grams(some, self.order)
            score = np.add.reduceat(cost_of(grams).astype(np.float64), begins)
            at, words, begins = _tokens(some)
            of_words = np.searchsorted(hashes, _word_hashes(words))
            base = np.add.reduceat(logs[of_words][at], begins)
            known = np.add.reduceat((times[of_words] > 0).astype(np.int64)[at], begins)
            found.append([np.diff(begins, append=len(at)), known, base, score])
        tokens, known, base, score = map(np.concatenate, zip(*found))
        return pa.Table.from_arrays(
            [
                docs.column("doc_id").combine_chunks(),
                docs.column("held_out").combine_chunks(),
                pa.array(tokens),
                pa.array(known),
                pa.array(np.full(len(score), self.train_tokens, np.int64)),
                pa.array(base),
                pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


_SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


# --- the trie -----------------------------------------------------------------


def _last_bytes(context: str, level: int) -> Column:
    return F.col(context).bitwiseAND((1 << (8 * level)) - 1)


def _nodes(bytes_seen: DataFrame) -> DataFrame:
    """One row per context: its bytes with their counts, their sum, their number."""
    return bytes_seen.groupBy("context").agg(
        F.map_from_entries(F.collect_list(F.struct("byte", "n"))).alias("seen"),
        F.sum("n").alias("total"),
        F.count("*").alias("kinds"),
    )


def _trie(counts: DataFrame, order: int) -> list[DataFrame]:
    """The contexts of each length, 0 to ``order``, as stored tables.

    The longest have the counts of the corpus. A shorter one counts in how many
    contexts one byte longer each byte was seen, since these are the places where
    it would have been asked. ``rest`` is what the next shorter context has counted
    of other bytes than those seen here, and ``rest_kinds`` the number of these.
    """
    level = counts.where("n > 0").select(
        F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("byte"), "n"
    )
    nodes = [stored(_nodes(level))]
    for length in range(order - 1, -1, -1):
        longer = nodes[-1].select("context", F.explode("seen").alias("byte", "_"))
        level = longer.groupBy(_last_bytes("context", length).alias("context"), "byte").agg(
            F.count("*").alias("n")
        )
        nodes.append(stored(_nodes(level)))
    nodes.reverse()
    nothing = F.lit(None).cast("long")
    linked = [nodes[0].withColumns({"rest": nothing, "rest_kinds": nothing})]
    for length in range(1, order + 1):
        shorter = nodes[length - 1].select(
            F.col("context").alias("suffix"),
            F.col("seen").alias("below"),
            F.col("total").alias("below_total"),
            F.col("kinds").alias("below_kinds"),
        )
        own = nodes[length].withColumn("suffix", _last_bytes("context", length - 1))
        excluded = F.aggregate(
            F.map_keys("seen"),
            F.lit(0).cast("long"),
            lambda so_far, byte: so_far + F.col("below")[byte],
        )
        kinds = F.col("below_kinds") - F.col("kinds")
        linked.append(
            stored(
                _joined(own, shorter, "suffix", length - 1).select(
                    "context",
                    "seen",
                    "total",
                    "kinds",
                    (F.col("below_total") - excluded).alias("rest"),
                    kinds.alias("rest_kinds"),
                )
            )
        )
    return linked


def _joined(rows: DataFrame, nodes: DataFrame, key: str, length: int) -> DataFrame:
    """Left join with the contexts of a length; those of 0 and 1 are 257 at most."""
    return rows.join(F.broadcast(nodes) if length <= 1 else nodes, key, "left")


def _cost(n: Column, total: Column) -> Column:
    return F.log10((2 * n - 1) / F.nullif(2 * total, F.lit(0)))


def _costs(counts: DataFrame, order: int) -> DataFrame:
    """``gram`` and ``cost``, the log10 probability of its last byte after the others."""
    trie = _trie(counts, order)
    known = trie[order].select("context", "total", F.explode("seen").alias("byte", "n")).select(
        (F.shiftleft("context", 8) + F.col("byte")).alias("gram"),
        _cost(F.col("n"), F.col("total")).alias("cost"),
    )
    asked = counts.where("n = 0").select(
        "gram",
        F.col("gram").bitwiseAND(255).alias("byte"),
        F.lit(None).cast("double").alias("cost"),
        F.lit(0.0).alias("so_far"),
        F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("long").alias("left_kinds"),
    )
    for length in range(order, -1, -1):
        asked = asked.withColumn("context", _last_bytes_of_gram(length))
        asked = _joined(asked, trie[length], "context", length)
        total = F.coalesce("left", "total")
        kinds = F.coalesce("left_kinds", "kinds")
        found = F.col("so_far") + _cost(F.col("seen")[F.col("byte")], total)
        escape = F.when(kinds > 0, F.log10(kinds / F.nullif(2 * total, F.lit(0))))
        asked = asked.select(
            "gram",
            "byte",
            F.coalesce("cost", found).alias("cost"),
            (F.col("so_far") + F.coalesce(escape, F.lit(0.0))).alias("so_far"),
            F.col("rest").alias("left"),
            F.col("rest_kinds").alias("left_kinds"),
            F.col("kinds").alias("known"),
        )
    any_byte = F.log10(F.lit(1.0) / (256 - F.coalesce("known", F.lit(0))))
    unknown = asked.select("gram", F.coalesce("cost", F.col("so_far") + any_byte).alias("cost"))
    return known.unionAll(unknown)


def _last_bytes_of_gram(length: int) -> Column:
    return F.shiftright("gram", 8).bitwiseAND((1 << (8 * length)) - 1)


# --- the operator -------------------------------------------------------------


def ppm_scores(
    docs: DataFrame, held_out: Column, order: int = ORDER, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Scores of all texts by a model of those that are not ``held_out``.

    Reads ``doc_id`` and ``text``; other columns are not read, except by
    ``held_out``. One row per document: ``doc_id``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score``, both log10.
    The model sees words, A-Z in lower case, with one blank between them, and an
    end; ``order`` (1 to 6) is its longest context in bytes.

    A NULL text is an empty one: just the end. Every row is scored, repeated ones
    too; an empty table gives no rows. Without any training text, all bytes are
    equally likely. Words are told apart by a hash of 64 bits.

    Two shuffles move the texts, to blocks whose number follows the input; all
    others move what is different within a block.
    """
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    blocked = docs.select(
        F.pmod(F.xxhash64(doc_key("doc_id"), text_hash("text")), F.lit(blocks)).alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"),
    )
    keys = stored(
        blocked.groupBy("block").applyInArrow(_extract(order, blocks), _KEY_SCHEMA)
    )
    merged = stored(
        keys.groupBy("shard").applyInArrow(
            _merge, "shard long, is_words boolean, gram long, n long"
        )
    )
    words = merged.where("is_words").agg(F.sum("gram"), F.sum("n")).first()
    counts = merged.where("NOT is_words")
    costs = _costs(counts, order).join(counts.select("gram", "shard"), "gram")
    answers = (
        keys.groupBy("shard").cogroup(costs.groupBy("shard")).applyInArrow(_answer, _ANSWER_SCHEMA)
    )
    score = _Score(order, int(words[1] or 0), int(words[0] or 0))

    def scored(texts: pa.Table, answered: pa.Table) -> pa.Table:
        return score(texts, answered)

    return (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(scored, _SCORE_SCHEMA)
    )


def _extract(order: int, shards: int):
    extract = _Extract(order, shards)

    def of_block(docs: pa.Table) -> pa.Table:
        return extract(docs)

    return of_block


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return ppm_scores(docs, fold == 1)
