import random

from brute import fingerprint as slow_fingerprint
from brute import roots
from tallyloom.llm.components import components
from tallyloom.llm.simhash import fingerprint, keep_one, link_fingerprints, near_duplicates


def near(a, b):
    return (a ^ b).bit_count() <= 2


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprint_is_that_of_the_definition():
    draw = random.Random(3)
    texts = ["", "one", "One two", "ÀB c d", "a\x0bb\tc\rd", "x " * 9]
    texts += [" ".join(draw.choices("ab cd ef gh ÄÖ".split(), k=draw.randint(0, 300))) for _ in range(40)]
    for text in texts:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_components_of_any_shape(spark):
    draw = random.Random(4)
    path = [(n, n + 1) for n in range(0, 300)]
    star = [(1000, 1000 + n) for n in range(1, 200)]
    loose = [(draw.randint(2000, 2400), draw.randint(2000, 2400)) for _ in range(150)]
    links = [*path, *star, *loose, (5, 5), (1, 0), (1, 0)]
    draw.shuffle(links)
    pairs = set(links) | {(b, a) for a, b in links}
    wanted = roots({n for pair in links for n in pair}, lambda a, b: (a, b) in pairs)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {row.node: row.root for row in found} == wanted and len(found) == len(wanted)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_links_reach_just_what_is_near_also_in_crowds(spark):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(60)}
    centre = draw.getrandbits(64)
    for _ in range(300):  # many share most of their bits
        value = centre
        for _ in range(draw.randint(0, 5)):
            value ^= 1 << draw.randint(0, 63)
        values.add(value)
    values |= {0, 1, 3, (1 << 64) - 1, (1 << 63), signed(0)}
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for crowd in (2, 64):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in link_fingerprints(prints, crowd).collect()]
        pairs = set(links) | {(b, a) for a, b in links}
        assert roots(values, near) == roots(values, lambda a, b: (a, b) in pairs)
        # Flipped bits tie two to a third that lies between, or to each other.
        assert all(near(a, b) for a, b in links)


def test_near_duplicates_of_awkward_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again " * 20
    rows = [
        (3, text), (2, text), (7, text), (7, text), (9, None), (8, ""), (4, " \n"),
        (5, "something else entirely, of a few words"), (None, text), (6, text + "end"),
    ]
    docs = spark.createDataFrame([(*row, 0, "x") for row in rows], "doc_id long, text string, fp int, _hash string")
    found = near_duplicates(docs).collect()
    prints = {doc: slow_fingerprint(t) for doc, t in rows}
    linked = lambda a, b: near(prints[a], prints[b])
    wanted = roots([doc for doc in prints if doc is not None], linked)
    assert len(found) == len(rows)
    for row in found:
        assert row.component_id == wanted[row.doc_id or 2]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (doc is None, doc or 0) for doc in {None, *set(wanted.values())} - {2}
    )
    assert near_duplicates(docs.limit(0)).isEmpty() and keep_one(docs.limit(0)).isEmpty()
