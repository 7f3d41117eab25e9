"""Packing documents into training sequences (operator 1).

First-fit decreasing: the longest piece first, each into the first sequence with
room for it. A tournament tree over the room left in each sequence finds that
sequence in a logarithmic number of steps. Every randomised group of documents is
packed by itself, so groups run side by side and none grows with the corpus.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import read_table, stored

MAX_TOKENS = 4096
END_ID = 2
#: Expected tokens per group: about a thousand sequences.
GROUP_TOKENS = 4_000_000
#: Characters of text tokenised at once; longer texts are taken in parts.
PART_CHARS = 1_000_000
#: Words a worker remembers, some 200 bytes each; when full, only those stay that were
#: met again, in another part, since the last time.
REMEMBERED_WORDS = 300_000
#: Rows that a worker is given at a time; their texts lie in the JVM and in the worker.
BATCH_ROWS = 2_000
_BATCH_OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch whose texts are Python strings at one time.
_ROWS = 256

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_MARK = "\x01"
#: Letters whose lower case is one letter, the same anywhere in a word.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LETTERS = _CAPITALS.lower() + "ßÿ"
#: Marks of which one may end a word.
_MARKS = ".,;:!?"
_PARTED = rf"\A[{_LETTERS}{_CAPITALS}]+[{_MARKS}]?\z"
_SMALL_LETTERS = rf"\A[{_LETTERS}]+\z"


class WordIds:
    """Token ids of words between blanks, asked of the tokenizer once per word.

    For tokenizers that drop white space and never look across it: the ids of a
    text are then those of its words in a row. Most words are letters, perhaps
    with one mark after them. Where the tokenizer parts such marks from letters
    and ignores case, the two are remembered apart, letters in lower case: they
    are far fewer than words, and go to the tokenizer's model at once. All other
    words are sent to the tokenizer together, with a mark between them whose id no
    other word can give.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode(_MARK)
        if len(self.mark) != 1:
            raise ValueError("the tokenizer must give the mark one id")
        self.model = self.tokenizer.model
        read = self.tokenizer.pre_tokenizer
        self.spelling = {ord(c): read.pre_tokenize_str(c)[0][0] for c in _LETTERS if read}
        self.parted = all(
            self._encode(word + mark) == self._of_letters(word.lower()) + self._encode(mark)
            for word in (*_LETTERS, *_CAPITALS, f"The{_LETTERS}")
            for mark in ("", *_MARKS)
        )
        self._forget(np.zeros(0, bool))

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _of_letters(self, word: str) -> list[int]:
        """Ids of a word that is nothing but lower-case letters."""
        spelt = word if word.isascii() else word.translate(self.spelling)
        return [token.id for token in self.model.tokenize(spelt)]

    def _forget(self, kept: np.ndarray) -> None:
        """Forgets all words but those marked; the first is the empty one, of no ids."""
        if not kept.any():
            self.known: dict[str, int] = {"": 0}
            self.begins = np.zeros(2, np.int64)
            self.ids = np.zeros(0, np.uint32)
        else:
            kept[0] = True
            # In place: two such tables at a time are too much for a worker.
            at = 0
            for word, stays in zip([*self.known], kept.tolist()):
                if stays:
                    self.known[word] = at
                    at += 1
                else:
                    del self.known[word]
            counts = np.diff(self.begins)
            self.ids = self.ids[np.repeat(kept, counts)]
            self.begins = np.concatenate([[0], np.cumsum(counts[kept])])
        self.met = np.zeros(len(self.known), bool)

    def _learn(self, words: pa.Array) -> None:
        is_quick = pc.match_substring_regex(words, _SMALL_LETTERS if self.parted else r"\A\z")
        quick = words.filter(is_quick).to_pylist()
        whole = words.filter(pc.invert(is_quick)).to_pylist()
        plain = [word for word in whole if _MARK not in word]
        marked = [word for word in whole if _MARK in word]
        found = [self._of_letters(word) for word in quick]
        counts = [*map(len, found)]
        ids = np.array(self._encode(f" {_MARK} ".join([*plain, ""])), np.uint32)
        ends = np.flatnonzero(ids == self.mark[0])
        counts.extend((np.diff(ends, prepend=-1) - 1).tolist())
        rest = [self._encode(word) for word in marked]
        counts.extend(map(len, rest))
        for word in chain(quick, plain, marked):
            self.known[word] = len(self.known)
        flat = [np.fromiter(chain.from_iterable(some), np.uint32) for some in (found, rest)]
        self.ids = np.concatenate([self.ids, flat[0], ids[ids != self.mark[0]], flat[1]])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts)])
        self.met = np.concatenate([self.met, np.zeros(len(words), bool)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the different words is remembered."""
        names = words.to_pylist()
        if len(self.known) + len(names) > REMEMBERED_WORDS:
            # Words met again since the last time stay, unless they are too many.
            self._forget(self.met & (2 * self.met.sum() < REMEMBERED_WORDS))
        is_new = [name not in self.known for name in names]
        if any(is_new):
            self._learn(words.filter(pa.array(is_new)))
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.met[at[~np.array(is_new, bool)]] = True
        return at

    def _units(self, words: pa.Array) -> np.ndarray:
        """For each of the different words: places of its letters and of its mark.

        A word of another kind is one unit, the other is the empty one.
        """
        is_parted = pc.match_substring_regex(words, _PARTED if self.parted else r"\A\z")
        letters = pc.utf8_lower(pc.utf8_rtrim(words, _MARKS))
        bare = pc.if_else(is_parted, letters, words).dictionary_encode()
        is_marked = pc.and_(is_parted, pc.match_substring_regex(words, f"[{_MARKS}]$"))
        marks = pc.if_else(is_marked, pc.utf8_slice_codeunits(words, -1), "").dictionary_encode()
        # Looked up together, so that nothing is forgotten between the two.
        both = pa.concat_arrays([bare.dictionary, marks.dictionary]).dictionary_encode()
        at = self._places(both.dictionary)[both.indices.to_numpy()]
        of_bare, of_marks = np.split(at, [len(bare.dictionary)])
        return np.stack(
            [of_bare[bare.indices.to_numpy()], of_marks[marks.indices.to_numpy()]], axis=1
        )

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends among them."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        parts = pc.split_pattern(texts, " ")
        words = parts.flatten().dictionary_encode()
        of_words = self._units(words.dictionary)
        at = of_words[words.indices.to_numpy(zero_copy_only=False)].ravel()
        begins = self.begins[at]
        counts = self.begins[at + 1] - begins
        after = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(begins - after[:-1], counts) + np.arange(after[-1])]
        word_ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        return ids, after[2 * word_ends]


_WORKER_WORDS: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One per worker process and tokenizer."""
    if path not in _WORKER_WORDS:
        _WORKER_WORDS[path] = WordIds(path)
    return _WORKER_WORDS[path]


def _parts(text: str) -> Iterator[str]:
    """The text in parts of bounded length, divided at blanks."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = text.rfind(" ", at + 1, at + PART_CHARS)
        line = text.rfind("\n", at + 1, at + PART_CHARS)
        cut = max(cut, line)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _texts(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), _ROWS):
        yield from column.slice(at, _ROWS).to_pylist()


def token_ids(texts: Iterable[str | None], encode: WordIds) -> Iterator[np.ndarray]:
    """Ids of each text, some million characters at a time."""
    waiting: list[str] = []
    lasts: list[bool] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ids, ends = encode(pa.array(waiting, pa.large_string()))
        begin = 0
        for end, last in zip(ends, lasts):
            held.append(ids[begin:end])
            begin = end
            if last:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held.clear()

    for text in texts:
        parts = list(_parts(text or ""))
        for number, part in enumerate(parts):
            waiting.append(part)
            lasts.append(number == len(parts) - 1)
            size += len(part)
            if size >= PART_CHARS:
                yield from flush()
                waiting, lasts, size = [], [], 0
    if waiting:
        yield from flush()


def _cutter(
    path: str, max_tokens: int, end_id: int, with_ids: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc_id, ids in zip(doc_ids, token_ids(_texts(batch.column(1)), encode)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), max_tokens):
                    piece = ids[start : start + max_tokens]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids)))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(column, pa.int64()) for column in columns]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return cut


class Tournament:
    """Bins in a row; finds the first with enough room.

    Leaves hold the room of the bins, each inner node the larger of its two
    children. Bins that were not begun hold the full room, so there always is one.
    """

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Bin, and the room it had."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < length:
                node += 1
        room = best[node]
        best[node] = room - length
        found = node - self.leaves
        while node > 1:
            node //= 2
            larger = max(best[2 * node], best[2 * node + 1])
            if best[node] == larger:
                break
            best[node] = larger
        return found, room


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given."""
    tree = Tournament(len(lengths), room)
    places = [tree.place(length) for length in lengths]
    return [found for found, _ in places], [room - left for _, left in places]


def _packer(max_tokens: int) -> Callable[[pa.Table], pa.Table]:
    def pack_group(pieces: pa.Table) -> pa.Table:
        group = pieces.column("group_id")[0].as_py()
        pieces = pieces.drop_columns(["group_id"]).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        )
        bins, offsets = first_fit(pieces.column("length").to_pylist(), max_tokens)
        sequence = np.array(bins, np.int64) + (group << 32)
        return pieces.append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offsets, pa.int64())
        )

    return pack_group


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Workers get ``BATCH_ROWS`` rows at a time, unless the session gives them fewer."""
    before = spark.conf.get(_BATCH_OPTION, None)
    if 0 < int(before or 0) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(_BATCH_OPTION, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_OPTION) if before is None else spark.conf.set(_BATCH_OPTION, before)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
    seed: int = 17,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents with their place in sequences of ``max_tokens``.

    Reads ``doc_id`` and ``text``. A document is its ids and ``end_id``; one
    longer than a sequence is cut into full sequences and a rest. Pieces keep the
    columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``with_ids``, their ids as an array.

    NULL and empty texts are the end id alone. Every row is a document, repeated
    rows and NULL doc_ids too. Other columns are not read. An empty table gives no
    rows. Texts of any length are taken in parts divided at blanks.

    The pieces are stored before they are dealt to groups: the number of groups
    follows from the tokens counted, and a lost executor cannot deal them anew.
    """
    ids = ", ids array<int>" if with_ids else ""
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _cutter(tokenizer_path, max_tokens, end_id, with_ids), _PIECE + ids
    )
    with _small_batches(docs.sparkSession):
        pieces = stored(cut)
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // group_tokens))
    dealt = pieces.withColumn("group_id", F.floor(F.rand(seed) * groups))
    return dealt.groupBy("group_id").applyInArrow(_packer(max_tokens), _piece_order(ids))


def _piece_order(ids: str) -> str:
    return f"{_PIECE}{ids}, sequence_id long, offset long"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(read_table(spark, sf_dir, "documents"), path)
