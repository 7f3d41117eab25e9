"""Chats as training texts of bounded length (operator 13).

Prefix sums of the tokens of turns tell how many turns fit in a window. A window
begins with the conversation's system turn and a few of the turns before it, both
repeated, and goes on with turns of its own, whole ones only. Targets are the
assistant's turns; where a window repeats one, it is masked, so that each is learnt
once.

A turn is written ``<s>[INST] role [/INST]text</s>``. A control string inside a role
or a text gets a backslash after its first character, and one that has backslashes
there gets one more, so that it can't be taken for the template's and is found again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table, stored

BUDGET = 2048
#: What a window repeats of the turns before it, at most.
HISTORY_TURNS = 4
HISTORY_TOKENS = 512
#: Turns are taken together if their numbers agree when divided by this.
PART_TURNS = 1024
SYSTEM, TARGET = "system", "assistant"
BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"/?s>|/?INST\]"
_TO_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_FIRST_PART = -(2**63)

#: Kinds of rows of a part: a system turn and the turns before, of other parts, and own.
KEPT, BEFORE, OWN = 0, 1, 2
#: Characters of windows that a task holds before it hands them on.
BATCH_CHARS = 1 << 22

_TURN = (
    "conv_id long, part long, turn long, role string, piece string, begin int, tokens long"
)
_WINDOW = (
    "conv_id long, part long, window int, text string, n_turns int, n_repeated int, "
    "n_tokens long, loss array<struct<begin: long, end: long>>"
)
_WINDOW_NAMES = ["conv_id", "part", "window", "text", "n_turns", "n_repeated", "n_tokens", "loss"]
_WINDOW_TYPES = [
    pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(),
    pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
]
_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escaped(text: str) -> str:
    """The text without control strings."""
    return _TO_ESCAPE.sub(r"\1\2\\\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def written(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text begins."""
    begin = f"{BEGIN}{escaped(role)}{MIDDLE}"
    return f"{begin}{escaped(text)}{END}", len(begin)


def read_turns(window: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a window's turns, as they were."""
    at = 0
    while at < len(window):
        if not window.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        middle = window.index(MIDDLE, at)
        begin = middle + len(MIDDLE)
        end = window.index(END, begin)
        yield unescaped(window[at + len(BEGIN) : middle]), unescaped(window[begin:end])
        at = end + len(END)


def token_windows(
    tokens: np.ndarray, first: int, kept: int, budget: int, history_turns: int, history_tokens: int
) -> Iterator[tuple[int, int, int]]:
    """Windows as (begin of what is repeated, begin, end) of turns.

    Turns before ``first`` are there to be repeated only. ``kept`` tokens of each
    window are taken by the system turn. Less history is repeated where the next
    turn would not fit else; a turn that fits in no window has one of its own.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    begin, room = first, budget - kept
    while begin < len(tokens):
        oldest = max(0, begin - history_turns, int(np.searchsorted(sums, sums[begin] - history_tokens)))
        needed = int(np.searchsorted(sums, sums[begin + 1] - room))
        oldest = min(max(oldest, needed), begin)
        end = int(np.searchsorted(sums, sums[oldest] + room, side="right")) - 1
        end = max(end, begin + 1)
        yield oldest, begin, end
        begin = end


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _turn_rows(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each turn as it is written, and its tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                roles, texts = (some.column(name).to_pylist() for name in ("role", "text"))
                pieces = [written(role, text) for role, text in zip(roles, texts)]
                ids = encoding.encode_ordinary_batch([piece for piece, _ in pieces], num_threads=1)
                columns = [
                    some.column("conv_id"),
                    some.column("part"),
                    some.column("turn"),
                    some.column("role"),
                    pa.array([piece for piece, _ in pieces], pa.string()),
                    pa.array([begin for _, begin in pieces], pa.int32()),
                    pa.array(map(len, ids), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["conv_id", "part", "turn", "role", "piece", "begin", "tokens"]
                )

    return rows


def _runs(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows in a row that agree in the named columns."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[name] for name in names)
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


def _windows_of(
    run: list[dict], budget: int, history_turns: int, history_tokens: int, system_role: str, target_role: str
) -> Iterator[tuple]:
    """Windows of a part of a conversation, whose rows come in the order of ``kind``."""
    is_first = run[0]["kind"] == OWN
    has_system = run[0]["role"] == system_role and (is_first or run[0]["kind"] == KEPT)
    system, turns = (run[:1], run[1:]) if has_system else ([], run)
    tokens = np.array([row["tokens"] for row in turns], np.int64)
    first = sum(row["kind"] == BEFORE for row in turns)
    kept = sum(row["tokens"] for row in system)
    plan = token_windows(tokens, first, kept, budget, history_turns, history_tokens)
    if is_first and not turns:
        plan = iter([(0, 0, 0)])  # nothing but a system turn
    for number, (oldest, begin, end) in enumerate(plan):
        rows = system + turns[oldest:end]
        n_repeated = len(rows) - (end - begin)
        if is_first and number == 0:
            n_repeated = 0
        loss, at = [], 0
        for place, row in enumerate(rows):
            if place >= n_repeated and row["role"] == target_role:
                loss.append({"begin": at + row["begin"], "end": at + len(row["piece"]) - len(END)})
            at += len(row["piece"])
        text = "".join(row["piece"] for row in rows)
        total = sum(row["tokens"] for row in rows)
        yield run[0]["conv_id"], run[0]["part"], number, text, len(rows), n_repeated, total, loss


def _window_rows(*settings: int | str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), _WINDOW_TYPES)]
        return pa.RecordBatch.from_arrays(arrays, _WINDOW_NAMES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for run in _runs(batches, ("conv_id", "part")):
            for window in _windows_of(run, *settings):
                held.append(window)
                size += len(window[3])
                if size > BATCH_CHARS:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return rows


def _from_other_parts(turns: DataFrame, history_turns: int, system_role: str) -> DataFrame:
    """What parts of a conversation but its first may repeat of others, as their rows.

    These are the last turns of the part before, and the conversation's system turn.
    """
    parts = stored(turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    in_order = W.partitionBy("conv_id").orderBy("part")
    links = stored(
        parts.select(
            F.col("conv_id").alias("conv"),
            F.col("part").alias("of"),
            F.lead("part").over(in_order).alias("next"),
            F.row_number().over(in_order).alias("number"),
        ).where("next IS NOT NULL OR number > 1")
    )
    if links.isEmpty():  # every conversation is one part
        return turns.limit(0).withColumn("kind", F.lit(KEPT))
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    within = W.partitionBy("conv_id", "part")
    order = [F.col(name) for name in ("turn", "role", "piece")]
    last = (
        turns.join(links.where("next IS NOT NULL"), same & (F.col("part") == F.col("of")))
        .withColumn("place", F.row_number().over(within.orderBy(*(c.desc_nulls_last() for c in order))))
        .where(F.col("place") <= max(1, history_turns))
        .withColumns({"part": F.col("next"), "kind": F.lit(BEFORE)})
    )
    systems = (
        turns.join(links.where("number = 1"), same & (F.col("part") == F.col("of")))
        .withColumn("place", F.row_number().over(within.orderBy(*(c.asc_nulls_first() for c in order))))
        .where((F.col("place") == 1) & (F.col("role") == system_role))
        .select(*turns.columns)
        .join(links.where("number > 1"), same)
        .withColumns({"part": F.col("of"), "kind": F.lit(KEPT)})
    )
    columns = [*turns.columns, "kind"]
    return last.select(*columns).unionAll(systems.select(*columns))


def chat_windows(
    conversations: DataFrame,
    tokenizer_path: str,
    budget: int = BUDGET,
    history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
    system_role: str = SYSTEM,
    target_role: str = TARGET,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Training texts of at most ``budget`` tokens each.

    Columns: conv_id, part and window (the order within a conversation), text,
    n_turns, n_repeated (turns at its beginning that were in a window before),
    n_tokens (of its turns, each by itself), and loss, the spans of ``text`` (code
    points) to be learnt: the escaped text of each target that is not repeated.

    Reads conv_id, turn, role and text. Turns are ordered by ``turn``, NULL first,
    then by role and text as written; NULL roles and texts are empty ones, and a
    NULL conv_id is a conversation like others. The first turn is the system turn if
    its role says so. A turn that is longer than the budget has a window of its own
    (with the system turn), which is then longer too: texts are never cut. Repeated
    rows are turns. An empty table gives no window. ``tokenizer_path`` is a file of
    ranks as tiktoken reads it.

    Windows end where the number of the turn, divided by ``part_turns``, changes.
    So a conversation of any length is spread over many tasks, and each holds so
    many turns of it at a time; only turns without a number, or all of one number,
    stay together.
    """
    part = F.floor(F.col("turn").cast("long") / F.lit(part_turns)).cast("long")
    turns = stored(
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.coalesce(part, F.lit(_FIRST_PART)).alias("part"),
            F.col("turn").cast("long").alias("turn"),
            *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
        ).mapInArrow(_turn_rows(tokenizer_path), _TURN)
    )
    others = _from_other_parts(turns, history_turns, system_role)
    order = ["conv_id", "part", "kind", "turn", "role", "piece"]
    return (
        turns.withColumn("kind", F.lit(OWN))
        .unionAll(others)
        .repartition("conv_id", "part")
        .sortWithinPartitions(*map(F.asc_nulls_first, order))
        .mapInArrow(
            _window_rows(budget, history_turns, history_tokens, system_role, target_role), _WINDOW
        )
    )


class _Digest:
    """What is read back from the windows of one conversation, in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, n_repeated: int, loss: list[dict]) -> None:
        self.formatted_chars += len(text)
        for place, (role, said) in enumerate(read_turns(text)):
            if place >= n_repeated:
                self.n_turns += 1
                self.turns.update(f"{role}\n{said}\n".encode())
        for span in loss:
            learnt = unescaped(text[span["begin"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
            self.loss.hexdigest(), self.formatted_chars,
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv_id, text, n_repeated, loss in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(text, n_repeated, loss)
        yield _digest_batch(done)
    if now is not None:
        yield _digest_batch([now.row()])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [part.split() for part in _DIGEST.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields)],
        [name for name, _ in fields],
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation: its turns and what is learnt of them, from the texts alone.

    A digest needs its texts in order: one task reads a conversation's windows, one
    at a time, and keeps none of them.
    """
    return (
        windows.select("conv_id", "part", "window", "text", "n_repeated", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "window")
        .select("conv_id", "text", "n_repeated", "loss")
        .mapInArrow(_digests, _DIGEST)
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, TARGET, said)],
        "conv_id long, turn long, role string, text string",
    )
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return read_back(chat_windows(table.unionAll(own), path))
