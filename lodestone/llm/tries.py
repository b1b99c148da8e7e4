"""Prefix trie of conversations: which beginnings are shared, by whom, and how many words sharing saves.

Every conversation c is rebuilt: it begins with the first h turns of conversation c - c % PERIOD (h = crc32 of c in
decimal, modulo HEADS) and goes on with its own turns after its first h. Each distinct sequence of first d
rebuilt turns is a node of depth d; the conversations that start with it are its members, those that
end there its ends. A node is named by its smallest member.

Method: turns are reduced to a digest and a number of words before they are shuffled, by c - c % PERIOD, so that a
conversation meets the one it borrows from. A task reads its conversations in order and chains the digests: a node's key is the
hash of its parent's key and its last turn. Each task then emits a partial trie, the locally combined table of its nodes
with members summed and lists of ends. Partial tries are merged by key, first FAN ways apart and then together. Lists of ends are
merged as runs that are sorted by (node, id) over the whole cluster, joined to texts of up to RUN ids and hashed in order.

Rollup: a node's smallest member owns it, and what a conversation owns is the end of its path. Below a node, a
conversation saves the words of the turns on its path that it doesn't own, since somebody else's copy stays; it counts as
a leaf if it owns a node without children. So each path is walked once from its end up, its sums are
combined in the task and added by key: no round for each level, however long a conversation is.

Scale: no text, list of members or list of ends meets in one task. A conversation's turns are hashed one after the other in
one task, as a chain must be, but as 40 bytes a turn, sorted with spilling and read as a stream. The same holds for the list
of ends of one node, whose SHA-256 can only be computed in order: it is read as a stream of runs. Paths are stored in pieces of
PIECE turns.

Edge cases: null turns come first; turns of equal number are ordered by the SHA-256 of their length of role in bytes, a colon, role
and text. Null role or text is empty. Rows without a conv_id take no part. Repeated rows are turns of their own. A conversation that is
rebuilt to nothing is a member of the root only and ends there. For negative ids c % PERIOD has the sign of c. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import stored

PERIOD, HEADS = 20, 4
PIECE = 256  # turns of a stored piece of a path
FAN = 64  # partial tries are merged in so many groups first
COMBINE = 200_000  # nodes that a task combines at a time
RUN = 8192  # ids of a run of ends
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()

PATHS = "conv_id long, start int, before long, last boolean, above binary, keys binary, words binary"
NODES = "key binary, parent binary, depth long, before long, n_convs long, conv_id long, ends array<long>, part int"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, base, borrowed, turn, digest, n_words) of every row that has a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    return conversations.where("conv_id IS NOT NULL").select(
        conv.alias("conv_id"), (conv - conv % PERIOD).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("borrowed"),
        "turn", digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
    )


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of turns(), those of one base together, the base's own first, each conversation's in order, to rows of PATHS:
    pieces with the keys of their nodes (the first piece has the root's) and the words of their last turns."""
    out: list[tuple] = []
    base = conv = None
    head: list[tuple[bytes, int]] = []
    keys, words, start, before, above, key, skip = [], [], 0, 0, None, ROOT, 0

    def piece(last: bool) -> None:
        nonlocal keys, words, start, before, above
        out.append((conv, start, before, last, above, b"".join(keys), np.array(words, np.int64).tobytes()))
        start, before, above = start + len(keys), before + sum(words), key
        keys, words = [], []

    def add(digest: bytes, n: int) -> None:
        nonlocal key
        if len(keys) == PIECE:
            piece(False)
        key = hashlib.blake2b(key + digest, digest_size=16).digest()
        keys.append(key)
        words.append(n)

    schema = pa.schema([("conv_id", pa.int64()), ("start", pa.int32()), ("before", pa.int64()), ("last", pa.bool_()), ("above", pa.binary()), ("keys", pa.binary()), ("words", pa.binary())])
    rows = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    for batch in batches:
        for c, b, h, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "base", "borrowed", "digest", "n_words"))):
            if c != conv or b != base:
                if conv is not None:
                    piece(True)
                if b != base:
                    base, head = b, []
                conv, keys, words, start, before, above, key, skip = c, [ROOT], [0], 0, 0, None, ROOT, 0
                if c != b:
                    skip = h
                    for d, k in head[:h]:
                        add(d, k)
            if c == b and len(head) < HEADS - 1:
                head.append((digest, n))
            if skip:
                skip -= 1
            else:
                add(digest, n)
        if len(out) >= 5000:
            yield rows()
            out.clear()
    if conv is not None:
        piece(True)
        yield rows()


def paths(conversations: DataFrame) -> DataFrame:
    """The rebuilt conversations as rows of PATHS."""
    dealt = turns(conversations).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return dealt.select("conv_id", "base", "borrowed", "digest", "n_words").mapInArrow(rebuilt, PATHS)


def _ints(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, key as two numbers, words before the node's own) of every node on the batch's pieces."""
    words = _ints(batch.column("words"), np.int64)
    keys = _ints(batch.column("keys"), ">u8").reshape(-1, 2)
    sizes = np.array([len(x) // 16 for x in batch.column("keys").to_pylist()], np.int64)
    first = np.cumsum(sizes) - sizes
    ran = np.cumsum(words) - words
    before = ran - np.repeat(ran[first], sizes) + np.repeat(batch.column("before").to_numpy(), sizes)
    return np.repeat(np.arange(len(sizes)), sizes), keys, before


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each row in that order, first row of each group) of equal keys."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _binary(keys: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    data = np.ascontiguousarray(keys, ">u8").tobytes()
    at = (np.arange(len(keys) + 1) * 16).astype(np.int32)
    valid = None if none is None else pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [valid, pa.py_buffer(at), pa.py_buffer(data)])


def partial_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PATHS to rows of NODES, each node once for COMBINE nodes read."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % FAN

    def combined(held: list[tuple]) -> pa.RecordBatch:
        keys, parents, depth, before, conv, last = (np.concatenate(x) for x in zip(*held))
        order, group, first = _groups(keys)
        one = order[first]
        ends = np.lexsort((conv[order], group))
        ends = ends[last[order][ends]]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(group[ends], np.arange(len(first) + 1)).astype(np.int32)), pa.array(conv[order][ends]))
        return pa.record_batch(
            [_binary(keys[one]), _binary(parents[one], depth[one] == 0), pa.array(depth[one]), pa.array(before[one]), pa.array(np.bincount(group).astype(np.int64)),
             pa.array(np.minimum.reduceat(conv[order], first)), lists, pa.array(np.full(len(first), part, np.int32))],
            names=["key", "parent", "depth", "before", "n_convs", "conv_id", "ends", "part"],
        )

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, keys, before = _opened(batch)
        new = np.ones(len(piece), bool)
        new[1:] = piece[1:] != piece[:-1]
        parents = np.roll(keys, 1, axis=0)
        parents[new] = _ints(pa.array([x or ROOT for x in batch.column("above").to_pylist()]), ">u8").reshape(-1, 2)
        at = np.flatnonzero(new)
        depth = batch.column("start").to_numpy().astype(np.int64)[piece] + np.arange(len(piece)) - at[piece]
        last = np.zeros(len(piece), bool)
        last[np.append(at[1:], len(piece)) - 1] = batch.column("last").to_numpy(zero_copy_only=False)
        held.append((keys, parents, depth, before, batch.column("conv_id").to_numpy()[piece], last))
        n += len(piece)
        if n >= COMBINE:
            yield combined(held)
            held, n = [], 0
    if held:
        yield combined(held)


def merged(tries: DataFrame) -> DataFrame:
    """(key, parent, depth, before, n_convs, conv_id) of the partial tries together, merged FAN ways apart, then all."""
    same = [F.any_value(c).alias(c) for c in ("parent", "depth", "before")]
    sums = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    return tries.groupBy("key", "part").agg(*same, *sums).groupBy("key").agg(*same, *sums)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) to (key, first, ids): up to RUN ids of a node, joined by commas."""
    key, ids, out = None, [], []
    rows = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or len(ids) == RUN:
                if ids:
                    out.append((key, ids[0], ",".join(map(str, ids))))
                key, ids = k, []
            ids.append(c)
            if len(out) >= 5000:
                yield rows()
                out.clear()
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
    if out:
        yield rows()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, first, ids) to (key, ends_sha256)."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def end_hashes(tries: DataFrame) -> DataFrame:
    """(key, ends_sha256) of each node at which a conversation ends."""
    ends = tries.select("key", F.explode("ends").alias("conv_id")).repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = ends.mapInArrow(_runs, "key binary, first long, ids string")
    return runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with what their conversation owns from (``owned``, words before it) and whether it is a leaf, to sums by node."""
    held, n = [], 0

    def combined() -> pa.RecordBatch:
        keys, saved, leaves = (np.concatenate(x) for x in zip(*held))
        order, _, first = _groups(keys)
        return pa.record_batch([_binary(keys[order[first]]), pa.array(np.add.reduceat(saved[order], first)), pa.array(np.add.reduceat(leaves[order], first))], names=["key", "saved", "leaves"])

    for batch in batches:
        if not batch.num_rows:
            continue
        piece, keys, before = _opened(batch)
        owned, leaf = (batch.column(c).to_numpy() for c in ("owned", "leaf"))
        held.append((keys, np.maximum(owned[piece] - before, 0), leaf[piece]))
        n += len(piece)
        if n >= COMBINE:
            yield combined()
            held, n = [], 0
    if held:
        yield combined()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    walked = stored(paths(conversations), "trie-paths")
    tries = stored(walked.mapInArrow(partial_trie, NODES), "trie-parts")
    nodes = stored(merged(tries), "trie-nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").select("key", "parent", "depth", "before", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")), "trie-children")

    own = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before"))["before"].alias("from"), F.max(F.struct("depth", "n_children"))["n_children"].alias("below"))
    total = walked.where("last").select("conv_id", "before", "words").mapInArrow(_total, "conv_id long, total long")
    convs = total.join(own, "conv_id", "left").select("conv_id", F.coalesce("from", "total").alias("owned"), F.coalesce((F.col("below") == 0).cast("long"), F.lit(0).cast("long")).alias("leaf"))
    sums = walked.select("conv_id", "before", "keys", "words").join(convs, "conv_id").mapInArrow(_rolled, "key binary, saved long, leaves long")
    sums = sums.groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "key").join(end_hashes(tries), "key", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last pieces to all words of their conversations."""
    for batch in batches:
        more = [int(np.frombuffer(w, np.int64).sum()) for w in batch.column("words").to_pylist()]
        yield pa.record_batch([batch.column("conv_id"), pa.array(batch.column("before").to_numpy() + np.array(more, np.int64), pa.int64())], names=["conv_id", "total"])
