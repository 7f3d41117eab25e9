import random
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import Ppm, words
from tallyloom.llm import ppm
from tallyloom.llm.ppm import ppm_scores

SCHEMA = "doc_id long, text string, held boolean, score string, block int"


def block_of(texts):
    ids = range(len(texts))
    return pa.table(
        {
            "block": pa.array([0] * len(texts), pa.int64()),
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array([n % 5 == 1 for n in ids]),
            "body": pa.array(texts, pa.binary()),
        }
    )


def cpu_seconds(call):
    """The least of five runs, and the result."""
    took = []
    for _ in range(5):
        begin = time.process_time()
        found = call()
        took.append(time.process_time() - begin)
    return min(took), found


def test_equals_brute_force(spark):
    draw = random.Random(12)
    some = "the cat Sat on a mat été über ß x\x0by 12 the the".split(" ")
    rows = [(n, " ".join(draw.choices(some, k=draw.randint(0, 30))), n % 4 == 1) for n in range(60)]
    rows += [(60, None, True), (61, "", False), (62, "new wörds zzz", True), (62, "new wörds zzz", True)]
    rows += [(None, "no id", False), (63, "word " * 4000, None)]
    docs = spark.createDataFrame([(*row, "s", 1) for row in rows], SCHEMA)
    train = [text for _, text, held in rows if not held]
    counts = Counter(word for text in train for word in [*words(text), "\n"])
    whole, kinds = sum(counts.values()), len(counts)
    for order, block_chars in ((2, 500), (5, 10**9)):
        model = Ppm(train, order)
        found = ppm_scores(docs, F.col("held"), order, block_chars).collect()
        assert len(found) == len(rows)
        texts = {n: (text, bool(held)) for n, text, held in rows}
        for row in found:
            text, held = texts[row.doc_id]
            tokens = [*words(text), "\n"]
            base = sum(log10((counts[t] + 0.5) / (whole + 0.5 * (kinds + 1))) for t in tokens)
            assert (row.held_out, row.n_tokens, row.train_tokens) == (held, len(tokens), whole)
            assert row.n_known == sum(t in counts for t in tokens)
            assert abs(row.base_score - base) < 1e-6 * max(1, -base)
            assert abs(row.score - model.score(text)) < 1e-4 * max(1, -row.score)


def test_probabilities_of_all_bytes_add_up():
    model = Ppm(["a b", "b a a", "abc"], 3)
    for context in (b"\n\n\n", b"\nab", b"zzz", b" a "):
        assert abs(sum(10 ** model.cost(context, byte) for byte in range(256)) - 1) < 1e-9


def test_without_training_or_documents(spark):
    docs = spark.createDataFrame([(1, "ab", True, "", 0)], SCHEMA)
    row = ppm_scores(docs, F.col("held"), 2).first()
    assert abs(row.score - 3 * log10(1 / 256)) < 1e-6 and row.n_known == 0
    assert ppm_scores(docs.limit(0), F.col("held")).isEmpty()


def test_folds():
    assert zlib.crc32(b"") % 5 == 0  # a document without id is learned from


def test_sequences_and_words_of_odd_texts():
    texts = [b"", b" a\x1cB  \x0b\x00 ", b"\n", "É é\t".encode(), b"a a", b"x" * 40, b""]
    bodies = [ppm._body(text) for text in texts]
    at, different, begins = ppm._tokens(bodies)
    assert len(different) == len(set(different))
    found = [[different[n] for n in own] for own in np.split(at, begins[1:])]
    assert found == [[*text.lower().split(), b"\n"] for text in texts]
    for order in range(1, 7):
        grams, begins = ppm._grams(bodies, order)
        padded = [b"\n" * order + body for body in bodies]
        assert [gram.item().to_bytes(order + 1, "big") for gram in grams] == [
            body[n : n + order + 1] for body in padded for n in range(len(body) - order)
        ]
        assert begins.tolist() == np.cumsum([0, *map(len, bodies)])[:-1].tolist()


def test_a_batch_of_empty_texts_is_bounded():
    sizes = [len(ppm._grams(some, 5)[0]) for some in ppm._batches([b"\n"] * 1_000_000)]
    assert sum(sizes) == 1_000_000 and max(sizes) < 500_000


def test_scoring_a_block_takes_little_more_than_looking_up_its_words():
    draw = random.Random(5)
    listed = ["".join(draw.choices("etaoinshrdlu", k=draw.randint(3, 10))) for _ in range(20_000)]
    often = [1 / n for n in range(1, len(listed) + 1)]
    texts = [" ".join(draw.choices(listed, often, k=500)).encode() for _ in range(1000)]
    docs = block_of(texts)
    keys = ppm._Extract(5, 1)(docs).to_pylist()[0]
    counts = Counter(word for text in texts[:1] for word in text.split())
    whole = 10**6 + 0.5 * 10**5
    sequences, hashes = ppm._keys(keys["grams"]), ppm._keys(keys["words"])
    times = dict(zip(ppm._word_hashes(list(counts)).tolist(), counts.values()))
    answer = {
        "block": [0],
        "grams": [keys["grams"]],
        "costs": [np.full(len(sequences), -1, np.float32).tobytes()],
        "words": [keys["words"]],
        "counts": [ppm._squeezed(np.array([times.get(n, 0) for n in hashes.tolist()]))],
    }
    score = ppm._Score(5, 10**6, 10**5 - 1)
    took, found = cpu_seconds(lambda: score(docs, pa.table(answer)))

    def one_by_one():
        different = {b"\n"}.union(*(text.lower().split() for text in texts))
        cost = {word: log10((counts[word] + 0.5) / whole) for word in different}
        seen = {word: word in counts for word in different}
        rows = []
        for text in texts:
            own = [*text.lower().split(), b"\n"]
            base, known = (sum(map(of.__getitem__, own)) for of in (cost, seen))
            rows.append((len(own), known, base, -len(text) - 1))
        return rows

    plainly, expected = cpu_seconds(one_by_one)
    columns = ("n_tokens", "n_known", "base_score", "score")
    rows = zip(*(found.column(name).to_pylist() for name in columns))
    for row, plain in zip(rows, expected, strict=True):
        assert row[:2] == plain[:2] and np.allclose(row[2:], plain[2:], rtol=1e-12)
    assert took < 2.8 * plainly


def test_a_block_is_dealt_to_many_shards_at_little_cost():
    draw = random.Random(6)
    docs = block_of([bytes(draw.choices(b"abcdefghijklmnopqrstuvwxyz  ", k=1500)) for _ in range(1000)])
    one, whole = cpu_seconds(lambda: ppm._Extract(5, 1)(docs))
    many, parts = cpu_seconds(lambda: ppm._Extract(5, 1000)(docs))
    for name in ("gram", "word"):
        assert ppm._over_blocks(whole, name)[0].tolist() == ppm._over_blocks(parts, name)[0].tolist()
        assert ppm._over_blocks(whole, name)[1].tolist() == ppm._over_blocks(parts, name)[1].tolist()
    assert many < 3 * one
