import random

from tallyloom.llm.decontamination import contamination, without_benchmark

ITEM = "A train leaves Paris at 9 and drives 120 km towards Lyon, how long does the journey take if Paris waits for it"
WORDS = "sun moon star sky tree leaf root stone river lake cloud rain wind snow fire ash".split()


def found(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in contamination(docs, bench).collect()}


def filler(draw, size):
    return " ".join(draw.choices(WORDS, k=size))


def test_passages_also_with_other_values(spark):
    draw = random.Random(7)
    other = ITEM.replace("Paris", "Rome").replace("Lyon", "Pisa").replace("9", "7").replace("120", "300")
    mixed = other.replace("if Rome", "if Milan")  # one name of the item becomes two
    texts = [
        (1, f"{filler(draw, 30)}. {ITEM}. {filler(draw, 30)}"),
        (2, f"{filler(draw, 9)} {other} {filler(draw, 9)}"),
        (3, f"{filler(draw, 9)} {mixed} {filler(draw, 9)}"),
        (4, filler(draw, 200)),
        (5, None), (6, ""), (7, ITEM.upper()), (7, "short"), (None, ITEM),
        (8, " ".join(ITEM.split()[:7])),
    ]
    rows = found(spark, texts, [(1, ITEM), (2, ITEM), (3, None), (4, "too short"), (5, "")])
    # In another case too, and where one of the names has become two.
    assert {key for key in rows} == {(1, 1), (2, 1), (3, 1), (7, 1), (None, 1)}
    assert not rows[1, 1].reparameterised and rows[2, 1].reparameterised
    assert rows[1, 1].matched_words == rows[1, 1].item_words == len(ITEM.replace(",", "").split())
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, texts, []) == {}


def test_items_of_hardly_any_literal_words_are_compared_verbatim(spark):
    names = "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lisa Max Nina"
    swapped = " ".join(reversed(names.split()))
    rows = found(spark, [(1, f"so {names} went"), (2, f"so {swapped} went")], [(9, names)])
    assert set(rows) == {(1, 9)}


def test_equals_brute_force_and_keeps_the_rest(spark):
    draw = random.Random(8)
    items = {n: filler(draw, draw.randint(14, 30)) for n in range(20)}
    texts = {n: filler(draw, draw.randint(0, 60)) for n in range(100)}
    for n in range(0, 100, 3):
        texts[n] += f" {items[n % 20]} {filler(draw, 5)}"
    rows = found(spark, list(texts.items()), list(items.items()))
    wanted = {(n, i) for n, t in texts.items() for i, item in items.items() if item in t}
    assert set(rows) == wanted
    docs = spark.createDataFrame(
        [(n, t, "x", n) for n, t in texts.items()] + [(1, texts[1], "y", 1)],
        "doc_id long, text string, _id string, text_hash long",
    )
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    kept = without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    clean = sorted({*texts} - {n for n, _ in wanted})
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*clean, *([1] if 1 in clean else [])])
