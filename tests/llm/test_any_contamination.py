"""Edited copies of items: case, numbers, names, and values that contradict each other."""

import random

import corpus_pipeline
from tallyloom.llm.decontamination import contamination, without_benchmark
from test_decontamination import ITEM, filler

TRAIN = ITEM.replace("Paris", "Rome").replace("Lyon", "Pisa").replace("9", "7").replace("120", "300")
SHOP = "the shop of Anna sells 980 apples at 3 dollars and later 4 pears, so how much money does it get for all of them by the evening"


def found(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(row.doc_id, row.item_id) for row in contamination(docs, bench).collect()}


def test_case_and_numbers_and_names_of_several_words(spark):
    draw = random.Random(21)
    texts = [
        (1, ITEM.upper()), (2, f"{filler(draw, 9)} {ITEM.lower()}"), (3, filler(draw, 200)), (4, None),
        (5, SHOP.replace("980", "1,250.5").replace("Anna", "Anna Maria Jones")),
        (6, f"{filler(draw, 9)} {SHOP.upper()} {filler(draw, 9)}"), (7, TRAIN),
    ]
    wanted = {(1, 1), (2, 1), (5, 2), (6, 2), (7, 1)}
    assert found(spark, texts, [(1, ITEM), (2, SHOP), (3, None), (4, "short")]) == wanted
    assert found(spark, texts, []) == set() and found(spark, [], [(1, ITEM)]) == set()


def test_long_runs_of_names_and_numbers(spark):
    texts = [(1, "Anna Maria " * 100_000), (2, "1.234," * 100_000), (3, "Anna " * 50_000 + f"says {SHOP}")]
    assert found(spark, texts, [(1, SHOP)]) == {(3, 1)}


def test_one_edited_value_does_not_hide_the_rest(spark):
    item = "The baker makes bread for 40 people each day. The miller brings him flour from a mill near the old river"
    texts = [
        (1, item.replace("The miller", "She")), (2, item.replace("The miller", "She then")),
        (3, TRAIN.replace("if Rome", "if Milan")),  # one name becomes two
        (4, SHOP.replace(" 3 ", " 5 ").replace(" 4 ", " 5 ")),  # two values become one
        (5, "The baker makes tea. The miller brings him nothing at all from the old river"),
    ]
    assert found(spark, texts, [(1, item), (2, ITEM), (3, SHOP)]) == {(1, 1), (2, 1), (3, 2), (4, 3)}
    docs = spark.createDataFrame([(*row, "x") for row in texts], "doc_id long, text string, _id string")
    bench = spark.createDataFrame([(1, item), (2, ITEM), (3, SHOP)], "item_id long, text string")
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns and [row.doc_id for row in kept.collect()] == [5]


def test_short_items_are_found_as_whole_documents(spark):
    texts = [(1, "Short  ITEM!"), (2, "a short item here"), (3, ""), (4, None), (5, "0 apples"), (5, "0 apples"), (5, "Other")]
    items = [(7, "short item"), (8, "Short, item"), (9, ""), (10, None), (11, "0 apples")]
    assert found(spark, texts, items) == {(1, 7), (5, 11)}


def test_extra_columns_and_nulls(spark):
    docs = spark.createDataFrame(
        [(None, ITEM, 1, "a"), (None, ITEM, 2, "b"), (4, None, 3, "c")],
        "doc_id long, text string, item_id int, way string",
    )
    bench = spark.createDataFrame([(None, ITEM, 1), (3, None, 2)], "item_id long, text string, doc_id int")
    rows = contamination(docs, bench).collect()
    assert [(row.doc_id, row.item_id, row.matched_words == row.item_words, row.reparameterised) for row in rows] == [(None, None, True, False)]
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns and [row.doc_id for row in kept.collect()] == [4]


def test_the_stage_uses_it(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, ITEM.upper()), (2, "fine")], "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert [row.doc_id for row in kept.collect()] == [2]
