"""The pipeline against plain Python, stage by stage."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brute import dedup_lines, fingerprint, roots
from conftest import SF_DIR


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, from a table that has all kinds of documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    more = spark.createDataFrame(
        [(900001, None, "en", "s", 0), (900002, "?! 12", "en", None, 5), (900003, "", None, "s", None)],
        docs.schema,
    )
    found = [docs.unionAll(more)]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(number))
        stage(spark, found[-1], SF_DIR).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def texts(frame):
    return {row.doc_id: row.text for row in frame.collect()}


def test_columns_stay(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_language_drops_what_has_no_letters(stages):
    assert set(texts(stages[0])) - set(texts(stages[1])) == {900001, 900002, 900003}


def test_lines(stages):
    before = texts(stages[1])
    wanted = {}
    for doc_id, lines in dedup_lines(before).items():
        text = "\n".join(lines)
        if text.strip(" ") or text == before[doc_id]:
            wanted[doc_id] = text
    assert texts(stages[2]) == wanted
    assert all(row.n_chars == len(row.text) for row in stages[2].collect())


def test_one_of_each_group_stays(stages):
    prints = {doc_id: fingerprint(text) for doc_id, text in texts(stages[2]).items()}
    groups = roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert set(texts(stages[3])) == set(groups.values())


def test_benchmark_passages_go(spark, stages):
    plain = lambda text: " ".join(text.lower().split())
    items = [plain(row.text) for row in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = texts(stages[3]), set(texts(stages[4]))
    holding = {n for n, text in before.items() if any(item in plain(text) for item in items)}
    assert holding and after == set(before) - holding


def test_all_that_is_left_is_packed(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = {}
    for row in stages[5].collect():
        packed[row.doc_id] = packed.get(row.doc_id, 0) + row.length
    wanted = {
        n: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        for n, text in texts(stages[4]).items()
    }
    assert packed == wanted


def test_run_applies_all_stages(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(found.columns)
    assert found.count() > 0
