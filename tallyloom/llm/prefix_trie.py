"""Trie of the conversations' common beginnings (operator 11).

A conversation is its path: 16 bytes for each turn, in order. Sorted by path and
cut into shards, conversations with a common beginning are neighbours. The trie of
a shard is a sequence of balanced parentheses; ``findclose``, over blocks with the
least excess in each, delimits the subtree of every node at once, ranks of leaf
pairs count its leaves, and cumulative arrays give all that is summed in it.

Only nodes on the first or last path of a shard can go on in another one. What a
shard says of them adds up: a node's own words are counted where it first occurs,
it is a leaf where it last occurs. So those spines are merged by sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import attach, read_table, stored

#: Bytes of a turn in a path: the first half of its SHA-256.
STEP = 16
#: Turns and conversations in a shard, as expected.
SHARD_SIZE = 20_000
#: Parentheses in a block of the lowest level, and blocks in one of the next.
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Families of conversations, and the first turns that a family may share.
FAMILY = 20
SHARED_TURNS = 4

_NODE = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long"
)
_FOUND = f"shard int, {_NODE}, ends_sha256 string, ends string"
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` and ``words`` (of each turn's text) per conversation.

    Turns are ordered by ``turn``, NULL first, then by their bytes in the path. A
    NULL role or text is an empty one. Rows without conv_id belong to none and are
    left out.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # With the length of the role before it, no two turns give the same bytes.
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * STEP)).alias("step"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("one"),
    )
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return ordered.select("conv_id", "turns.step", "turns.words")


def with_shared_turns(paths: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first one of their family.

    Conversation c has the first h turns of conversation c - c % 20, then its own
    after its first h; h is the remainder by 4 of the CRC-32 of c in decimal.
    """
    c = F.col("conv_id")
    heads = paths.select(
        c.alias("head"),
        F.slice("step", 1, SHARED_TURNS - 1).alias("head_step"),
        F.slice("words", 1, SHARED_TURNS - 1).alias("head_words"),
    ).where(F.col("head") % FAMILY == 0)
    shared = F.crc32(c.cast("string")) % SHARED_TURNS
    joined = paths.withColumns(
        {"head": c - c % FAMILY, "shared": shared.cast("int")}
    ).join(heads, "head", "left")

    def rebuilt(name: str) -> str:
        return f"""concat(
            coalesce(slice(head_{name}, 1, shared), slice({name}, 1, 0)),
            slice({name}, shared + 1, greatest(size({name}) - shared, 0)))"""

    return joined.select("conv_id", *(F.expr(rebuilt(n)).alias(n) for n in ("step", "words")))


class Parentheses:
    """Balanced parentheses (+1 and -1) with the least excess of blocks of blocks."""

    def __init__(self, signs: np.ndarray) -> None:
        self.signs = signs
        self.excess = np.cumsum(signs, dtype=np.int64)
        self.opens = np.flatnonzero(signs == 1)
        self.levels = [self.excess]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            blocks = np.full(-(-len(below) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
            blocks[: len(below)] = below
            self.levels.append(blocks.reshape(-1, BLOCK).min(axis=1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at these places are closed."""
        wanted = self.excess[at] - 1
        place, level = at + 1, np.zeros(len(at), np.int64)
        found = np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            # Each looks at one cell of its level: too high, so it goes on to the next
            # cell, or up where a block ends; low enough, so it goes down into it.
            cell, height = place[todo], level[todo]
            least = np.empty(len(todo), np.int64)
            for one in np.unique(height):
                here = height == one
                least[here] = self.levels[one][cell[here]]
            low = least <= wanted[todo]
            done = low & (height == 0)
            found[todo[done]] = cell[done]
            down = todo[low & ~done]
            place[down] *= BLOCK
            level[down] -= 1
            on = todo[~low]
            place[on] += 1
            ends = on[place[on] % BLOCK == 0]
            place[ends] //= BLOCK
            level[ends] += 1
            todo = todo[~done]
        return found


def common_steps(one: bytes, other: bytes) -> int:
    """Number of steps in which two paths agree from the first."""
    size = min(len(one), len(other))
    differing = int.from_bytes(one[:size]) ^ int.from_bytes(other[:size])
    return (8 * size - differing.bit_length()) // (8 * STEP)


def _spine(path: bytes, depth: int) -> list[bytes]:
    """Names of the nodes of a path down to a depth, from the root."""
    names, so_far = [], hashlib.sha256()
    for at in range(depth + 1):
        if at:
            so_far.update(path[(at - 1) * STEP : at * STEP])
        names.append(so_far.digest()[:STEP])
    return names


def shard_nodes(
    paths: list[bytes], words: list[np.ndarray], conv_ids: list[int], before: int, after: int
) -> dict[str, list]:
    """Nodes of a shard of sorted paths, in columns.

    ``before`` and ``after`` are the steps that the first path has in common with
    the last one of the shard before, and the last one with the first of the next;
    -1 if there is no such shard. Nodes so shared are named in ``node``, and so are
    shared parents in ``parent``; their sums are the shard's part.
    """
    depths = np.array([len(path) // STEP for path in paths])
    common = np.array([-1, *map(common_steps, paths, paths[1:])])
    opened = depths - common
    closed = np.append((depths[:-1] - common[1:]), depths[-1] + 1)
    signs = np.repeat(np.tile(np.array([1, -1], np.int8), len(paths)), np.stack([opened, closed], 1).ravel())
    trie = Parentheses(signs)
    close = trie.findclose(trie.opens)
    n = len(trie.opens)
    # Nodes in order of their opening: the subtree of one is itself and those up to last.
    first, last = np.arange(n), np.arange(n) + (close - trie.opens + 1) // 2
    depth = trie.excess[trie.opens] - 1
    end_node = np.cumsum(opened) - 1
    on_path = np.zeros(depths.max() + 1, np.int64)
    node_words = np.zeros(n, np.int64)
    parent = np.full(n, -1, np.int64)
    begin = 0
    fresh_ends: list[int] = []
    for path_depth, shared, counts, end in zip(depths, common, words, end_node):
        if shared == path_depth:  # a copy of the path before
            fresh_ends.append(on_path[path_depth])
            continue
        new = np.arange(begin, end + 1)
        levels = np.arange(shared + 1, path_depth + 1)
        node_words[new[levels > 0]] = counts[levels[levels > 0] - 1]
        parent[new[1:]] = new[:-1]
        if shared >= 0:
            parent[new[0]] = on_path[shared]
        on_path[levels] = new
        begin = end + 1
        fresh_ends.append(end)
    ends_at = np.array(fresh_ends)

    def in_subtree(own: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(own)])
        return sums[last] - sums[first]

    left, right = np.zeros(n, bool), np.zeros(n, bool)  # go on before and after
    left[: before + 1] = True  # the first path is the first nodes,
    right[on_path[: after + 1]] = True  # and the last one is what on_path still holds
    n_convs = in_subtree(np.bincount(ends_at, minlength=n))
    is_leaf = (signs[trie.opens + 1] == -1) & ~right
    saved = in_subtree(n_convs * node_words - np.where(left, 0, node_words))
    children = np.bincount(parent[1:][~left[1:]], minlength=n)
    ids = np.array(conv_ids, np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, ends_at, ids)
    for one in range(n - 1, 0, -1):
        if least[one] < least[parent[one]]:
            least[parent[one]] = least[one]
    shared_node = left | right
    names: list[bytes | None] = [None] * n
    for path, reach, nodes in ((paths[0], before, first), (paths[-1], after, on_path)):
        for node, name in zip(nodes, _spine(path, reach)):
            names[node] = name
    texts = [""] * n
    runs = np.flatnonzero(np.diff(ends_at, prepend=-1, append=n + 1))
    for begin, stop in zip(runs, runs[1:]):  # conversations with one end are in a row
        texts[ends_at[begin]] = ",".join(map(str, conv_ids[begin:stop]))
    parents = parent.tolist()
    inside = ~shared_node
    return {
        "node": names,
        "parent": [names[up] if up >= 0 else None for up in parents],
        "depth": depth.tolist(),
        "conv_id": least.tolist(),
        "parent_conv_id": [
            int(least[up]) if up >= 0 and inside[up] else None for up in parents
        ],
        "n_convs": n_convs.tolist(),
        "n_children": children.tolist(),
        "n_leaves": in_subtree(is_leaf.astype(np.int64)).tolist(),
        "saved_tokens": saved.tolist(),
        "ends_sha256": [
            (hashlib.sha256(text.encode()).hexdigest() if text else _NO_ENDS) if whole else None
            for text, whole in zip(texts, inside)
        ],
        "ends": [text if text and not whole else None for text, whole in zip(texts, inside)],
    }


def _nodes(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is a shard, in order; Spark may hand it over in several batches.
        paths: list[bytes] = []
        words: list[np.ndarray] = []
        conv_ids: list[int] = []
        facts = None
        for batch in batches:
            paths.extend(batch.column("path").to_pylist())
            words.extend(np.asarray(one.values) for one in batch.column("words"))
            conv_ids.extend(batch.column("conv_id").to_pylist())
            if batch.num_rows:
                facts = [batch.column(name)[0].as_py() for name in ("shard", "before", "after")]
                if batch.column("shard")[-1].as_py() != facts[0]:
                    raise ValueError("a partition must be one shard")
        if facts is None:
            return
        shard, before, after = facts
        columns = shard_nodes(paths, words, conv_ids, before, after)
        table = pa.table({"shard": [shard] * len(columns["depth"]), **columns}, schema)
        yield from table.to_batches(max_chunksize=8192)

    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's members, whose parts come in a row and in order."""
    now, so_far, parts = None, hashlib.sha256(), 0
    for batch in batches:
        names, found = [], []
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(2)):
            if node != now:
                if parts:
                    names.append(now)
                    found.append(so_far.hexdigest())
                now, so_far, parts = node, hashlib.sha256(), 0
            so_far.update((b"," if parts else b"") + ends.as_py().encode())
            parts += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"]
        )
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([now], pa.binary()), pa.array([so_far.hexdigest()])], ["node", "ends_sha256"]
        )


def _common(one: str, other: str) -> Column:
    """``common_steps`` of two columns."""

    def steps(path: str) -> str:
        return f"""transform(sequence(0, greatest(0, length({path}) div {STEP} - 1)),
            at -> substring({path}, 1 + {STEP} * at, {STEP}))"""

    same = f"zip_with({steps(one)}, {steps(other)}, (a, b) -> coalesce(length(a) > 0 AND a = b, false))"
    return F.expr(
        f"""aggregate({same}, named_struct('n', 0, 'on', true), (so_far, same) -> named_struct(
            'n', so_far.n + int(so_far.on AND same), 'on', so_far.on AND same),
            so_far -> so_far.n)"""
    )


def _cut_in_shards(paths: DataFrame, shard_size: int) -> DataFrame:
    """``paths`` in order of path and conv_id, stored, with shard and shared steps."""
    spark = paths.sparkSession
    rows = stored(
        paths.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("step", F.hex), "")).alias("path"),
            "words",
        )
    )
    turns = rows.agg(F.sum(F.size("words")) + F.count("*")).first()[0] or 0
    shards = max(1, -(-turns // shard_size))
    ordered = stored(
        rows.repartitionByRange(shards, "path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .withColumn("shard", F.spark_partition_id())
    )
    sides = stored(
        ordered.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    )
    # One number per shard: some may be empty, so each is told the next that is not.
    numbers = sorted(row.shard for row in sides.select("shard").collect())
    follows = spark.createDataFrame(
        list(zip(numbers, numbers[1:])) or [(None, None)], "shard int, next int"
    )
    joints = stored(
        sides.join(F.broadcast(follows), "shard")
        .join(sides.select(F.col("shard").alias("next"), F.col("first").alias("next_first")), "next")
        .select("shard", "next", _common("last", "next_first").alias("steps"))
    )
    known = (
        sides.select("shard")
        .join(joints.select("shard", F.col("steps").alias("after")), "shard", "left")
        .join(joints.select(F.col("next").alias("shard"), F.col("steps").alias("before")), "shard", "left")
        .na.fill(-1, ["before", "after"])
    )
    # A row of three numbers per shard, and shards are far fewer than partitions can be.
    return ordered.join(F.broadcast(known), "shard")


def prefix_trie(paths: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per node of the trie of ``paths`` (``conv_id``, ``step``, ``words``).

    Columns: conv_id (smallest member), depth, parent_conv_id (NULL for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256, of the conv_ids of
    members that end there, in ascending order and joined by commas.

    Conversations without turns are members of the root. conv_ids are expected to
    be different. No conversation, no node. The path of one conversation, 16 bytes
    a turn, must fit in memory; everything else is split: copies of a conversation
    go to as many shards as they need. Only the SHA-256 of a node's members can't be
    split: one task reads their text, a part per shard, and keeps none of it.
    """
    spark = paths.sparkSession
    empty = spark.createDataFrame([], _FOUND)
    schema = pa.schema(
        [(f.name, _ARROW[f.dataType.simpleString()]) for f in empty.schema]
    )
    found = stored(_cut_in_shards(paths, shard_size).mapInArrow(_nodes(schema), _FOUND))
    parts = found.where("node IS NOT NULL")
    ends = (
        parts.where("ends IS NOT NULL")
        .select("node", "shard", "ends")
        .repartition("node")
        .sortWithinPartitions("node", "shard")
        .mapInArrow(_digests, "node binary, ends_sha256 string")
    )
    spines = stored(
        parts.groupBy("node")
        .agg(
            F.max("parent").alias("parent"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(name).alias(name) for name in _SUMS),
        )
        .join(ends, "node", "left")
        .na.fill(_NO_ENDS, ["ends_sha256"])
    )
    columns = ["conv_id", "depth", "parent", "parent_conv_id", *_SUMS, "ends_sha256"]
    inside = found.where("node IS NULL").select(*columns)
    shared = spines.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    ups = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    joined = attach(inside.unionAll(shared), ups, "parent", F.col("conv_id"))
    return joined.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "up").alias("parent_conv_id"),
        *_SUMS,
        "ends_sha256",
    )


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(),
}


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = turn_paths(read_table(spark, sf_dir, "conversations"))
    return prefix_trie(with_shared_turns(paths))


#: Nodes are the lists of their turns; the remainder of a CRC-32 is worked out bit by bit.
OP11_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, x: xor(xor(crc, x) >> 1, (xor(crc, x) & 1) * 3988292384)), 4294967295) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1 : c.h], []), c.turns[c.h + 1 :]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, depth, turns[1 : depth] AS node, len(turns) = depth AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         list(conv_id ORDER BY conv_id) FILTER (ends) AS ending
  FROM members GROUP BY node, depth
), parents AS (
  SELECT node[1 : depth - 1] AS node, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * len(list_filter(
           regexp_split_to_array(n.node[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))
         ELSE 0 END AS saved
  FROM nodes n LEFT JOIN parents USING (node)
), subtrees AS (
  SELECT node[1 : up] AS node, count(*) FILTER (n_children = 0) AS n_leaves,
         CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       n_leaves, saved_tokens,
       sha256(coalesce(array_to_string(c.ending, ','), '')) AS ends_sha256
FROM counted c JOIN subtrees USING (node)
LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1 : c.depth - 1]"""
