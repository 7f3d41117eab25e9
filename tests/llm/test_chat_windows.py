"""Windows of chats against the definition: round trips, budgets, targets once."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_DIR
from tallyloom.llm import chat_windows as chat

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string, part string, piece int"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/", "s>", "INST]", " ", "ok", "<\\/s>", "[\\\\INST]"]
TEXTS = st.lists(st.sampled_from(PARTS)).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(TEXTS, TEXTS)))
def test_escapes_are_reversible_and_leave_no_control_string(turns):
    for _, text in turns:
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(control in chat.escaped(text) for control in PARTS[:4])
    window = "".join(chat.written(role, text)[0] for role, text in turns)
    assert list(chat.read_turns(window)) == turns


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(rows):
    found = {}
    for conv_id, turn, role, text, *_ in rows:
        found.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [turn[2:] for turn in sorted(turns)] for c, turns in found.items()}


def wanted_digests(rows):
    found = {}
    for conv_id, turns in conversations(rows).items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        found[conv_id] = (len(turns), digest(whole), len(learnt), digest(learnt))
    return found


def checked(frame, rows, budget, **settings):
    windows = chat.chat_windows(frame, PATH, budget, **settings)
    found = {r.conv_id: r for r in chat.read_back(windows).collect()}
    wanted = wanted_digests(rows)
    assert set(found) == set(wanted)
    for conv_id, row in found.items():
        assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == wanted[conv_id]
    encoding = chat._encoding(PATH)
    chars, turns = {}, conversations(rows)
    for row in sorted(windows.collect(), key=lambda r: (r.conv_id or 0, r.part, r.window)):
        chars[row.conv_id] = chars.get(row.conv_id, 0) + len(row.text)
        read = list(chat.read_turns(row.text))
        pieces = [chat.written(*turn)[0] for turn in read]
        assert len(read) == row.n_turns and "".join(pieces) == row.text
        sizes = [len(encoding.encode_ordinary(piece)) for piece in pieces]
        assert sum(sizes) == row.n_tokens
        first = turns[row.conv_id][0]
        starts = row.n_repeated == 0
        if first[0] == "system" and not starts:
            assert read[0] == first
        has_system = first[0] == "system"
        if row.n_tokens > budget:  # one turn that is too long, with the system turn at most
            assert row.n_turns - row.n_repeated == 1 or starts and row.n_turns == 2
            assert row.n_repeated <= has_system
        history = row.n_repeated - has_system
        assert history <= settings.get("history_turns", chat.HISTORY_TURNS)
    assert chars == {c: row.formatted_chars for c, row in found.items()}
    return windows


def test_windows_keep_every_turn_once(spark):
    draw = random.Random(8)
    rows = []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", "You <s> help. " * draw.randint(1, 4)))
        for turn in range(1, draw.choice([1, 2, 9, 60])):
            text = " ".join(draw.choices(["ab", "</s>", "[INST] x", "é日", "\\", "\n"], k=draw.randint(0, 30)))
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice([text, text, text, None])))
    rows += [(50, 1, "assistant", "long " * 3000), (50, 2, "user", "b"), (50, 0, "system", "s")]
    rows += [(51, None, "user", "first"), (51, 1, "user", "tie"), (51, 1, "assistant", "tie"), (51, 1, "user", "tie")]
    rows += [(None, 3, None, None), (None, 4, "assistant", "nobody's"), (53, 0, "system", "alone")]
    rows += [(54, turn, "assistant", f"turn {turn}") for turn in range(-5, 30)]
    rows = [(*row, "x", 1) for row in rows]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    checked(frame, rows, 200)
    checked(frame, rows, 60, history_turns=2, history_tokens=20)
    windows = checked(frame, rows, 120, part_turns=4, history_turns=3)
    later = windows.where("conv_id = 54 AND window = 0").orderBy("part").collect()
    assert [row.n_repeated > 0 for row in later] == [False] + [True] * (len(later) - 1)
    checked(frame, rows, 100, part_turns=2, history_turns=0)
    assert chat.chat_windows(frame.limit(0), PATH).isEmpty()


def test_greedy_windows():
    tokens = [5, 5, 5, 30, 5, 5]
    found = list(chat.token_windows(tokens, 0, 4, 19, 1, 8))
    # The long turn stands alone; after it no history of 8 tokens can be had.
    assert found == [(0, 0, 3), (3, 3, 4), (4, 4, 6)]
    assert list(chat.token_windows([4] * 6, 2, 0, 12, 2, 100)) == [(0, 2, 3), (1, 3, 4), (2, 4, 5), (3, 5, 6)]


def test_query(spark):
    rows = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    found = chat.op13_chat_format(spark, SF_DIR).collect()
    wanted = wanted_digests(rows)
    assert {r.conv_id: tuple(r)[1:5] for r in found} == wanted and len(found) == len(wanted)
    assert all(row.formatted_chars >= row.loss_chars for row in found)
