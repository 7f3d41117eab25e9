"""The trie against plain Python."""

import hashlib
import random
import zlib

import numpy as np

from brute import words
from conftest import SF_DIR
from tallyloom.llm.prefix_trie import (
    Parentheses,
    op11_prefix_trie,
    prefix_trie,
    turn_paths,
    with_shared_turns,
)

SCHEMA = "conv_id long, turn long, role string, text string, node string, shard int"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
    "saved_tokens", "ends_sha256",
)


def slow_paths(rows, shared=True):
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [turn[2:] for turn in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    if not shared:
        return own
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return found


def slow_trie(paths):
    members = {}
    for c, turns in paths.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(c)
    found = []
    for node, convs in members.items():
        below = [other for other in members if other[: len(node)] == node]
        saved = sum((len(members[o]) - 1) * len(words(o[-1][1])) for o in below if o)
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        found.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(len(o) == len(node) + 1 for o in below),
            sum(all(p[:-1] != o for p in below if p) for o in below),
            saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(repr, found))


def listed(frame):
    return sorted(repr(tuple(row[name] for name in COLUMNS)) for row in frame.collect())


def test_findclose():
    draw = random.Random(1)
    for size in (1, 2, 63, 64, 65, 4000):
        signs, depth = [1], 1
        for left in range(2 * size - 2, 0, -1):
            up = depth == 1 and left > 1 or depth < left and draw.random() < 0.52
            signs.append(1 if up else -1)
            depth += signs[-1]
        signs.append(-1)
        trie, waiting, wanted = Parentheses(np.array(signs, np.int8)), [], {}
        for at, sign in enumerate(signs):
            if sign == 1:
                waiting.append(at)
            else:
                wanted[waiting.pop()] = at
        assert trie.findclose(trie.opens).tolist() == [wanted[at] for at in trie.opens]


def random_rows(draw):
    rows = []
    for c in range(140):
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9])):
            text = draw.choice(["a b", "b", "", None, "c\x0bd \x85e", "f  g"])
            rows.append((c, draw.choice([turn, turn, None]) if turn == 0 else turn, draw.choice(["u", None]), text))
    rows += [(c, turn, "u", "same text") for c in range(200, 260) for turn in range(3)]
    rows += [(400, turn, "u", "long " * turn) for turn in range(120)]
    rows += [(401, turn, "u", "long " * turn) for turn in range(119)]
    rows += [(None, 1, "u", "nobody's"), (407, 0, "u", "all of its turns are others'"), (-7, 0, "u", "x")]
    return [(*row, "n", 1) for row in rows]


def test_equals_the_definition_in_shards_of_any_size(spark):
    rows = random_rows(random.Random(2))
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = turn_paths(frame)
    # -7 % 20 is of the sign of -7 in SQL: its family is that of 0.
    positive = [row for row in rows if row[0] != -7]
    built = with_shared_turns(plain.where("conv_id >= 0"))
    wanted_plain, wanted = slow_trie(slow_paths(rows, False)), slow_trie(slow_paths(positive))
    for size in (3, 40, 100_000):
        assert listed(prefix_trie(plain, size)) == wanted_plain
        assert listed(prefix_trie(built, size)) == wanted


def test_tied_turns_turnless_and_empty_tables(spark):
    rows = [(20, 1, "u", "b"), (20, 1, "u", "a"), (20, 1, "u", "a"), (47, 3, "u", "x")]
    frame = spark.createDataFrame([(*row, "n", 1) for row in rows], SCHEMA)
    nodes = prefix_trie(turn_paths(frame)).collect()
    assert sorted(row.depth for row in nodes) == [0, 1, 1, 2, 3]
    assert prefix_trie(turn_paths(frame.limit(0))).isEmpty()
    # 47 has three turns of conversation 40, which is not there, and none of its own.
    assert zlib.crc32(b"47") % 4 >= 1
    root = prefix_trie(with_shared_turns(turn_paths(frame.where("conv_id = 47")))).collect()
    assert [(row.conv_id, row.depth, row.n_convs, row.n_leaves) for row in root] == [(47, 0, 1, 1)]
    assert root[0].ends_sha256 == hashlib.sha256(b"47").hexdigest()


def test_query(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()]
    assert listed(op11_prefix_trie(spark, SF_DIR)) == slow_trie(slow_paths(rows))
