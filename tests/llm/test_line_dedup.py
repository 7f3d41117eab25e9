import random

from brute import dedup_lines as slow_dedup
from tallyloom.llm.line_dedup import dedup_lines


def test_equals_brute_force(spark):
    draw = random.Random(6)
    texts = {
        n: "\n".join(draw.choices(["a", "b", " b ", "", "c"], k=draw.randint(0, 12)))
        for n in range(60)
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = slow_dedup(texts)
    for row in dedup_lines(docs).collect():
        assert row.text == "\n".join(wanted[row.doc_id])
        assert row.n_lines == texts[row.doc_id].count("\n") + 1
        assert row.n_removed == row.n_lines - len(wanted[row.doc_id])


def test_awkward_rows(spark):
    same = "x\ny\nz"
    rows = [(1, same), (1, same), (2, same), (None, "p\nq\nr"), (3, "p\nq\nr"), (4, None), (5, ""), (6, "p\nq")]
    docs = spark.createDataFrame(
        [(*row, "k", 1, 2) for row in rows], "doc_id long, text string, _id string, n_lines int, pos int"
    )
    found = dedup_lines(docs)
    assert set(found.columns) == {*docs.columns, "n_removed"}
    by_id = sorted((str(r.doc_id), r.text, r.n_removed, r._id, r.n_lines) for r in found.collect())
    assert by_id == sorted(
        [
            ("1", same, 0, "k", 3), ("1", same, 0, "k", 3), ("2", "", 3, "k", 3),
            ("None", "p\nq\nr", 0, "k", 3), ("3", "", 3, "k", 3), ("4", None, 0, "k", 0),
            ("5", "", 0, "k", 1), ("6", "p\nq", 0, "k", 2),
        ]
    )
    assert dedup_lines(docs.limit(0)).isEmpty()
