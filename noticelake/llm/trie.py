"""The prefix trie of rebuilt conversations, as a table of its nodes.

A conversation becomes one row: its number, the ids of its turns (16 bytes each, the
MD5 of role and text) as one binary and the code points of each turn. These rows are
range-partitioned by (ids, number), so copies of one conversation may fill several
shards. A shard works on chunks of a bounded padded matrix of turn ids: numpy's lexsort
orders it, column changes accumulated by OR along a row mark where a node starts at
each depth, and reduceat aggregates the members of every node.

Only nodes on the first and the last row of a chunk can have members elsewhere. Each
such node is written as a boundary row with what its chunk knows and the 16-byte digest of its path, and
boundary rows recombine in Spark: one aggregate per path adds up members and closed
subtrees, a running sum from the deep end of each boundary path carries sums to the nodes
above, and nodes whose parent is on a boundary look up its number. Lists of members are
hashed in their chunk, or as an ordered stream of the chunks' lists.

Rows with a null conversation number belong to none and are left out; null roles and
texts are empty; a null turn comes first; rows of one turn are ordered by the MD5 of
role and text, and equal rows are turns of their own. Remainders of negative numbers
are negative, as in SQL. Further columns are not read. A table without conversations
has no node. The turns of one conversation, about 40 bytes each whatever their texts,
are one row of one task; nothing else is gathered by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from noticelake.llm.common import stored

#: Cells of a padded matrix; a conversation of more turns has one of its own.
CELLS = 2_000_000
CLOSED, PENDING, OPEN = 0, 1, 2
NOBODY = np.iinfo(np.int64).max


def turn_id(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: [(id as hex, code points)]) in the order of the turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("known"),
        F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), turn_id(role, text).alias("id"),
        F.length(text).alias("size"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "id", "size"))).alias("l"))
    return listed.select("conv_id", F.transform("l", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(seqs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The first h turns of the conversation that opens the block of ``every`` numbers,
    then a conversation's own turns after its first h."""
    first = seqs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = seqs.select("*", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                       (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.join(first, "base", "left").select(
        "conv_id", F.when(F.size("turns") > 0, F.concat(head, own)).otherwise(head).alias("turns"))


def _padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ragged rows as a matrix, zero where a row has ended."""
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def trie(convs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple:
    """Nodes of a chunk by depth, and its rows in order.

    ``ids`` (16 bytes) and ``chars`` hold the turns of all rows, ``sizes`` how many
    belong to each. Per depth: first member, members, members that end here, children,
    childless nodes and saved code points below (the node included), parent's place,
    and the range of ``order`` that ends here. Of nodes on the first or the last row the
    sums leave out the node itself and children that are on those rows too."""
    _, ranks = np.unique(ids, return_inverse=True)
    matrix, lengths = _padded(ranks.reshape(-1).astype(np.int32) + 1, sizes), _padded(chars, sizes)
    order = np.lexsort((convs, *matrix.T[::-1]))
    matrix, lengths, sizes, convs = matrix[order], lengths[order], sizes[order], convs[order]
    change = np.ones(matrix.shape, bool)
    np.not_equal(matrix[1:], matrix[:-1], out=change[1:])
    np.logical_or.accumulate(change, axis=1, out=change)
    node = np.zeros(len(convs), np.int64)  # each row's node at the depth above
    levels = []
    for depth in range(matrix.shape[1] + 1):
        rows = np.flatnonzero(sizes >= depth)
        starts = np.flatnonzero(change[rows, depth - 1]) if depth else np.zeros(1, np.int64)
        parent = node[rows[starts]]
        place = np.zeros(len(rows), np.int64)
        place[starts[1:]] = 1
        node[rows] = np.cumsum(place)
        ends = (sizes[rows] == depth).astype(np.int64)
        n = np.diff(np.append(starts, len(rows)))
        levels.append({
            "conv": np.minimum.reduceat(convs[rows], starts), "n": n, "ends": np.add.reduceat(ends, starts),
            "parent": parent, "from": rows[starts], "chars": lengths[rows[starts], depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64)})
    return levels, order, matrix, sizes, convs


def sums(levels: list[dict], first: int, last: int) -> None:
    """Adds children, childless nodes, saved code points and which nodes are open, from
    the deepest level up; ``first`` and ``last`` are the depths of those rows."""
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        k = len(here["n"])
        here["open"] = np.zeros(k, bool)
        if depth <= first:
            here["open"][0] = True
        if depth <= last:
            here["open"][-1] = True
        children, leaves, saved = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        if below is not None:
            closed = ~below["open"]
            for into, values in ((children, np.ones(len(closed), np.int64)), (leaves, below["leaves"]), (saved, below["saved"])):
                np.add.at(into, below["parent"][closed], values[closed])
        own = ~here["open"]
        leaves += own & (children == 0)
        saved += np.where(own, (here["n"] - 1) * here["chars"], 0)
        here |= {"children": children, "leaves": leaves, "saved": saved}
        below = here


FIELDS = [("kind", pa.int8()), ("chunk", pa.int64()), ("side", pa.int8()), ("conv_id", pa.int64()), ("depth", pa.int64()),
          ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
          ("saved_tokens", pa.int64()), ("ends", pa.string()), ("chars", pa.int64()), ("path", pa.binary()), ("above", pa.binary())]
SCHEMA = ("kind byte, chunk long, side byte, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends string, chars long, path binary, above binary")


def _digests(path: np.ndarray) -> list[bytes]:
    """The digest of every prefix of a path of ids."""
    state = hashlib.md5()
    out = [state.digest()]
    for turn in path.tolist():
        state.update(turn)
        out.append(state.copy().digest())
    return out


def chunk_rows(convs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, chars: np.ndarray, chunk: int) -> Iterator[pa.RecordBatch]:
    """Nodes and boundary rows of a chunk of conversations, as ``SCHEMA``.

    A node with members in this chunk only is closed, or pending when its parent is on
    a boundary: then ``side`` says on which (0: of the first row, 1: of the last).
    Boundary rows hold both paths whole; a node on both counts on the first."""
    levels, order, _, ranked, members = trie(convs, sizes, ids, chars)
    sums(levels, int(ranked[0]), int(ranked[-1]))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    nothing = hashlib.sha256(b"").hexdigest()

    def listed(low: int, n: int) -> str:
        return ",".join(map(str, members[low:low + n].tolist()))

    schema = pa.schema(FIELDS)
    for depth, here in enumerate(levels):
        closed = np.flatnonzero(~here["open"])
        if not len(closed):
            continue
        above = levels[depth - 1]  # the root is open, so depth > 0
        parent = here["parent"][closed]
        pending = above["open"][parent]
        shas = [hashlib.sha256(listed(low, n).encode()).hexdigest() if n else nothing
                for low, n in zip(here["from"][closed].tolist(), here["ends"][closed].tolist())]
        k = len(closed)
        side = (parent > 0) | (depth - 1 > ranked[0])
        columns = [
            pending.astype(np.int8), np.full(k, chunk), side.astype(np.int8), here["conv"][closed], np.full(k, depth),
            np.where(pending, NOBODY, above["conv"][parent]), here["n"][closed], here["children"][closed],
            here["leaves"][closed], here["saved"][closed], shas]
        filled = [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)]
        yield pa.RecordBatch.from_arrays(filled + [pa.nulls(k, t) for _, t in FIELDS[len(filled):]], schema=schema)
    for side, row in ((0, 0), (1, len(order) - 1)):
        at, size = order[row], int(ranked[row])
        digests = _digests(ids[starts[at]:starts[at] + size])
        out = []
        for depth in range(size + 1):
            here = levels[depth]
            place = 0 if side == 0 else len(here["n"]) - 1
            mine = side == 0 or place > 0 or depth > ranked[0]
            ends = listed(int(here["from"][place]), int(here["ends"][place])) if mine and here["ends"][place] else None
            values = [here[c][place] for c in ("conv", "n", "children", "leaves", "saved")] if mine else [NOBODY, 0, 0, 0, 0]
            out.append((OPEN, chunk, side, values[0], depth, None, *values[1:], ends, here["chars"][place],
                        digests[depth], digests[depth - 1] if depth else None))
        for low in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(zip(*out[low:low + 10_000]), FIELDS)], schema=schema)


def shards(convs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes and boundary rows of all chunks of range-partitioned conversations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        longest = 0

        def done() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(w[2]) for w in waiting], np.int64)
            yield from chunk_rows(np.array([w[0] for w in waiting], np.int64), sizes,
                                  np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting]), chunk)

        for b in batches:
            numbers, paths, chars = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            offsets, flat = chars.offsets.to_numpy(), chars.values.to_numpy(zero_copy_only=False)
            for i, (conv, path) in enumerate(zip(numbers, paths)):
                size = len(path) // 16
                if waiting and (len(waiting) + 1) * (max(longest, size) + 1) > cells:
                    yield from done()
                    waiting, longest, chunk = [], 0, chunk + 1
                # an id may end in zero bytes, which numpy's bytes would drop
                waiting.append((conv, np.frombuffer(path, "V16"), flat[offsets[i]:offsets[i + 1]]))
                longest = max(longest, size)
        if waiting:
            yield from done()

    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("chars"))
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return rows.mapInArrow(run, SCHEMA)


def _streamed_digests(lists: DataFrame) -> DataFrame:
    """(path, ends_sha256) of member lists in order of their chunks, hashed as a stream:
    SHA-256 has no parallel form, and no list is ever whole in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for path, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = path, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["path", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["path", "sha"])

    ordered = lists.repartition("path").sortWithinPartitions("path", "chunk", "side")
    return ordered.select("path", "ends").mapInArrow(run, "path binary, sha string")


def recombined(boundary: DataFrame) -> DataFrame:
    """One row per boundary node and chunk side, with the node's full result. Grows with
    chunks times depth; all joins and aggregates are by path, the sums by chunk side."""
    nodes = boundary.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"),
        F.max("chars").alias("size"), F.max("above").alias("above"), F.min(F.struct("chunk", "side")).alias("shown"))
    children = nodes.where("above is not null").groupBy(F.col("above").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(children, "path", "left").withColumn("n_children", F.col("children") + F.coalesce("more", F.lit(0)))
    parents = nodes.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, "above", "left").select(
        "path", "conv_id", "parent_conv_id", "n_convs", "n_children", "shown", ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    rows = boundary.select("path", "chunk", "side", "depth", "n_leaves", "saved_tokens").join(nodes, "path")
    mine = F.col("shown") == F.struct("chunk", "side")  # a node's own share goes up one path only
    deep = Window.partitionBy("chunk", "side").orderBy(F.desc("depth"))
    rows = rows.withColumns({
        "leaves": F.sum(F.col("n_leaves") + F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).over(deep),
        "saved": F.sum(F.col("saved_tokens") + F.when(mine, F.col("own")).otherwise(0)).over(deep)})
    total = rows.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return rows.select("path", "chunk", "side", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                       mine.alias("shown")).join(total, "path")


def nodes(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    # Three ways on from here, so the conversations are written once.
    made = stored(shards(rebuilt(stored(sequences(turns))), cells), "kind")
    boundary = made.where(F.col("kind") == OPEN)
    top = stored(recombined(boundary))
    shas = _streamed_digests(boundary.where("ends is not null").select("path", "ends", "chunk", "side"))
    open_ = top.where("shown").join(shas, "path", "left").withColumn(
        "ends_sha256", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())))
    over = top.select("chunk", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over"))
    pending = made.where(F.col("kind") == PENDING).drop("parent_conv_id").join(over, ["chunk", "side", "depth"])
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return made.where(F.col("kind") == CLOSED).withColumnRenamed("ends", "ends_sha256").select(fields).unionByName(
        pending.withColumnsRenamed({"over": "parent_conv_id", "ends": "ends_sha256"}).select(fields)).unionByName(open_.select(fields))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
i AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || text) AS id FROM t),
s AS (SELECT conv_id, list({'id': id, 'n': length(text)} ORDER BY turn NULLS FIRST, id) AS l FROM i GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, list_reduce([xor(a, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT)))), 4294967295::BIGINT) % 6 AS h FROM s),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM h a LEFT JOIN s b ON b.conv_id = a.base),
p AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS d, l FROM r),
q AS (SELECT conv_id, d, len(l) = d AS at_end, CASE WHEN d > 0 THEN l[d].n ELSE 0 END AS n,
    array_to_string(list_transform(l[1:d], lambda x: x.id), '') AS path FROM p),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '') AS ends FROM q GROUP BY path, d),
k AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT left(path, 32 * a) AS path, sum(saved)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens,
  sha256(m.ends) AS ends_sha256
FROM m JOIN u USING (path) LEFT JOIN n o ON m.d > 0 AND o.path = left(m.path, 32 * (m.d - 1))"""
