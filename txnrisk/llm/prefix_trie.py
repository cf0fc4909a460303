"""Conversation prefix trie: every distinct run of first turns is a node, with subtree totals.

A conversation is a sequence of (role, text) turns. A depth-d node is a distinct sequence of first
d turns; the textless root has depth 0. Node identity is a 128-bit sequence hash: four 32-bit
lanes, each the sum modulo 2**32 of a hash of (position, role, text) over the first d turns, so a
prefix's key is a running sum, computed in blocks of ``BLOCK`` turns: a conversation with a third of
all turns is spread over many tasks; joins of turns with what is known per conversation go by
(conversation, block) for the same reason.

Subtree totals are passed upwards by time-forward processing. Nodes are cut into shards, subtrees
whose weight (rows of member conversations at or below the node, at least the subtree's size) is
at most ``SHARD_WEIGHT``; a shard's nodes are sorted in reverse level order and each node, when its
turn comes, takes the totals its children queued for it and queues its own for its parent in a
priority queue keyed by the parent's place in that order. Nodes above the shards ("top" nodes)
are handled the same way in the next round, with the totals of the shard roots below them as
input, until none is left. A shard never holds more than ``SHARD_WEIGHT`` nodes, so its queue
stays in memory; the sort that orders it spills like any Spark sort.

Defined results: rows with a null conv_id belong to no conversation and are left out; a null role
or text is the empty text; turns are ordered by turn (nulls first), then role and text, so
repeated rows count as repeated turns. A conversation with no turns after rebuilding is a member of
the root only. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from txnrisk.llm.ordering import numbered
from txnrisk.sources.workspace import settled

# Fixed values of the contract: the borrowed head comes from conversation c - c % GROUP,
# crc32 of the decimal id modulo HEAD_MOD turns long.
GROUP = 100
HEAD_MOD = 6
LANES = 4
BLOCK = 4096  # turns of one conversation summed in one task
SHARD_WEIGHT = 200_000  # most rows below a shard's root, so most nodes a shard holds
BROADCAST_TOPS = 1_000_000  # most top nodes sent whole to every task (16 bytes each)
MASK = (1 << 32) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _blocks(first: Column, last: Column) -> Column:
    """Block numbers (``BLOCK`` places each) from place ``first`` to place ``last``."""
    low = F.floor(first / BLOCK).cast("long")
    return F.explode(F.sequence(low, F.greatest(F.floor(last / BLOCK).cast("long"), low)))


def _spread(per_c: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per conversation, repeated for each block its places span: joined on (c, block), the
    rows of a conversation with a third of all turns meet it in as many tasks as it has blocks."""
    return per_c.withColumn("block", _blocks(first, last))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, role, text, n_turns): positions from 0 within each conversation."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = numbered(turns, "row_no", F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    first = placed.groupBy("c").agg(F.min("row_no").alias("first_no"), F.count("*").alias("n_turns"))
    first = _spread(first, F.col("first_no"), F.col("first_no") + F.col("n_turns") - 1)
    placed = placed.withColumn("block", F.floor(F.col("row_no") / BLOCK).cast("long"))
    return placed.join(first, ["c", "block"]).select(
        "c", (F.col("row_no") - F.col("first_no")).alias("pos"), "role", "text", "n_turns"
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, pos, role, text, length) and conversations (c, length).

    Conversation c takes the first h turns of conversation c - c % 100 (all if fewer, none if
    absent), then its own turns after its first h; h = crc32(decimal c) % 6.
    """
    own = settled(ordered_turns(conversations))
    convs = own.select("c", "n_turns").dropDuplicates(["c"]).select(
        "c",
        "n_turns",
        (F.crc32(F.col("c").cast("string").cast("binary")) % HEAD_MOD).alias("h"),
        (F.col("c") - F.col("c") % GROUP).alias("base"),
    )
    heads = own.filter(F.col("pos") < HEAD_MOD).select(F.col("c").alias("base"), "pos", "role", "text")
    borrowed = convs.join(heads, "base").filter(F.col("pos") < F.col("h")).select("c", "pos", "role", "text")
    taken = borrowed.groupBy("c").agg(F.count("*").alias("m"))
    sized = convs.join(taken, "c", "left").select(
        "c", "h", "n_turns", F.coalesce("m", F.lit(0)).alias("m"),
        (F.coalesce("m", F.lit(0)) + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("length"),
    )
    sized = settled(sized)
    shifts = _spread(sized.select("c", "h", "m", "n_turns"), F.lit(0), F.col("n_turns") - 1)
    at = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    kept = own.select("*", at).join(shifts, ["c", "block"]).filter(F.col("pos") >= F.col("h"))
    kept = kept.select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "role", "text")
    lengths = sized.select("c", "length")
    spread = _spread(lengths, F.lit(0), F.col("length") - 1)
    turns = borrowed.unionByName(kept).select("*", at).join(spread, ["c", "block"]).drop("block")
    return settled(turns), lengths


def _lane(k: int) -> Column:
    return F.xxhash64(F.lit(k), F.col("pos"), F.col("role"), F.col("text")).bitwiseAND(F.lit(MASK))


def _key(lanes: list[Column]) -> tuple[Column, Column]:
    hi = F.shiftleft(lanes[0], 32).bitwiseOR(lanes[1])
    lo = F.shiftleft(lanes[2], 32).bitwiseOR(lanes[3])
    return hi, lo


def path_rows(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..length: (c, d, length, k1, k2, p1, p2, last_len).

    (k1, k2) is the node's key, (p1, p2) its parent's (null at the root), last_len the code points
    of its last text. Running sums go block by block, so no task sums more than ``BLOCK`` turns
    of one conversation besides one row per block.
    """
    lanes = {f"l{k}": _lane(k) for k in range(LANES)}
    hashed = turns.withColumns(lanes).withColumn("block", F.floor(F.col("pos") / BLOCK))
    names = list(lanes)
    blocks = hashed.groupBy("c", "block").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("c", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b{n}") for n in names])
    inside = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select(
        "c", "block", "pos", "length", F.length("text").cast("long").alias("last_len"), *names,
        *[F.sum(n).over(inside).alias(f"s{n}") for n in names],
    ).join(before, ["c", "block"])
    node = [(F.col(f"s{n}") + F.col(f"b{n}")).bitwiseAND(F.lit(MASK)) for n in names]
    parent = [(F.col(f"s{n}") + F.col(f"b{n}") - F.col(n)).bitwiseAND(F.lit(MASK)) for n in names]
    k1, k2 = _key(node)
    p1, p2 = _key(parent)
    deep = summed.select(
        "c", (F.col("pos") + 1).alias("d"), "length", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"),
        p2.alias("p2"), "last_len",
    )
    none = F.lit(None).cast("long")
    roots = lengths.select(
        "c", F.lit(0).cast("long").alias("d"), "length", F.lit(0).cast("long").alias("k1"),
        F.lit(0).cast("long").alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("last_len"),
    )
    return deep.unionByName(roots)


def _pass_up(group: pd.DataFrame) -> pd.DataFrame:
    """Time-forward processing of one shard: reverse level order, totals queued for parents."""
    group = group.sort_values(["depth", "k1", "k2"], ascending=False, kind="stable").reset_index(drop=True)
    # parent keys come without nulls (the root's is 0 with has_parent false): pandas would make a
    # nullable long column a float one and lose bits of the keys
    rank = {key: at for at, key in enumerate(zip(group["k1"].tolist(), group["k2"].tolist()))}
    has_parent = group["has_parent"].tolist()
    parents = [rank.get(key) for key in zip(group["p1"].tolist(), group["p2"].tolist())]
    leaves_own, saved_own = group["own_leaves"].tolist(), group["own_saved"].tolist()
    queue: list[tuple[int, int, int]] = []
    leaves, saved, root = [], [], []
    for at in range(len(group)):
        got_leaves, got_saved = leaves_own[at], saved_own[at]
        while queue and queue[0][0] == at:
            _, sent_leaves, sent_saved = heapq.heappop(queue)
            got_leaves += sent_leaves
            got_saved += sent_saved
        leaves.append(got_leaves)
        saved.append(got_saved)
        root.append(parents[at] is None and has_parent[at])
        if parents[at] is not None:
            heapq.heappush(queue, (parents[at], got_leaves, got_saved))
    return pd.DataFrame({
        "k1": group["k1"], "k2": group["k2"], "p1": group["p1"], "p2": group["p2"],
        "n_leaves": leaves, "saved_tokens": saved, "shard_root": root,
    })


TOTALS = "k1 long, k2 long, p1 long, p2 long, n_leaves long, saved_tokens long, shard_root boolean"


def subtree_totals(rows: DataFrame, nodes: DataFrame, weight: int = SHARD_WEIGHT) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) of every node, from path rows and nodes with their own
    values (own_leaves, own_saved), shard by shard, then across shard roots round by round."""
    current = rows.select("c", "d", F.col("length").alias("limit"), "k1", "k2")
    sent: list[DataFrame] = []  # totals of shard roots, for parents in later rounds
    done: list[DataFrame] = []
    while True:
        weights = current.groupBy("k1", "k2").agg((F.sum(F.col("limit") - F.col("d")) + 1).alias("weight"))
        # few nodes are top (at most rows / weight on a level), so only they travel, and no row of
        # the root or of a common first turn is shuffled to one task for a join by node
        tops = settled(weights.filter(F.col("weight") > weight).select("k1", "k2", F.lit(True).alias("top")))
        few = tops.count() <= BROADCAST_TOPS
        marked = current.join(F.broadcast(tops) if few else tops, ["k1", "k2"], "left")
        marked = settled(marked.withColumn("top", F.coalesce("top", F.lit(False))))
        at = F.floor(F.col("d") / BLOCK).cast("long").alias("block")
        stars = marked.groupBy("c").agg(
            F.sum(F.col("top").cast("long")).alias("d_star"), F.max("limit").alias("_last")
        )
        stars = _spread(stars, F.lit(0), F.col("_last")).drop("_last")
        marked = settled(marked.select("*", at).join(stars, ["c", "block"]).drop("block"))
        roots = marked.filter(F.col("d") == F.col("d_star")).select(
            "c", "d_star", "limit", F.col("k1").alias("r1"), F.col("k2").alias("r2")
        )
        roots = _spread(roots, F.col("d_star"), F.col("limit")).drop("d_star", "limit")
        placed = (
            marked.filter(F.col("d") >= F.col("d_star"))
            .select("*", at)
            .join(roots, ["c", "block"])
            .select("k1", "k2", "r1", "r2")
            .dropDuplicates(["k1", "k2"])
        )
        parent_of = [F.coalesce(F.col(p), F.lit(0)).alias(p) for p in ("p1", "p2")]
        work = placed.join(
            nodes.select("k1", "k2", *parent_of, F.col("p1").isNotNull().alias("has_parent"), "depth", "own_leaves",
                         "own_saved"),
            ["k1", "k2"],
        )
        if sent:
            inbox = sent[0]
            for more in sent[1:]:
                inbox = inbox.unionByName(more)
            inbox = inbox.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
                F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
            )
            work = work.join(inbox, ["k1", "k2"], "left").select(
                "k1", "k2", "r1", "r2", "p1", "p2", "has_parent", "depth",
                (F.col("own_leaves") + F.coalesce("n_leaves", F.lit(0))).alias("own_leaves"),
                (F.col("own_saved") + F.coalesce("saved_tokens", F.lit(0))).alias("own_saved"),
            )
        totals = settled(work.groupBy("r1", "r2").applyInPandas(_pass_up, TOTALS))
        done.append(totals.select("k1", "k2", "n_leaves", "saved_tokens"))
        current = marked.filter(F.col("d") < F.col("d_star")).select(
            "c", "d", (F.col("d_star") - 1).alias("limit"), "k1", "k2"
        )
        current = settled(current)
        if current.isEmpty():
            break
        sent.append(totals.filter("shard_root").select("p1", "p2", "n_leaves", "saved_tokens"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _sha_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (k1, k2, c) sorted by key then c; one SHA-256 per key over its comma-joined ids."""
    out_k1, out_k2, out_sha = [], [], []
    current, digest, first = None, None, True
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        for k1, k2, c in zip(*(col.to_pylist() for col in batch.columns)):
            if (k1, k2) != current:
                if current is not None:
                    out_k1.append(current[0]), out_k2.append(current[1]), out_sha.append(digest.hexdigest())
                current, digest, first = (k1, k2), hashlib.sha256(), True
            digest.update((b"" if first else b",") + str(c).encode())
            first = False
        if len(out_k1) >= 4096:
            yield pa.RecordBatch.from_pydict({"k1": out_k1, "k2": out_k2, "ends_sha256": out_sha}, schema=schema)
            out_k1, out_k2, out_sha = [], [], []
    if current is not None:
        out_k1.append(current[0]), out_k2.append(current[1]), out_sha.append(digest.hexdigest())
    yield pa.RecordBatch.from_pydict({"k1": out_k1, "k2": out_k2, "ends_sha256": out_sha}, schema=schema)


def prefix_trie(conversations: DataFrame, weight: int = SHARD_WEIGHT) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256):
    conv_id is the least member, members are the conversations that start with the node;
    n_leaves counts childless nodes of its subtree (itself included), saved_tokens sums
    (n_convs - 1) * code points of the last text over the subtree; ends_sha256 hashes the
    ascending, comma-joined ids of the members that end there (none: the empty text's hash).
    The ends of one node are hashed in one task, streamed in id order with constant memory.
    """
    turns, lengths = rebuilt_turns(conversations)
    rows = settled(path_rows(turns, lengths))
    grouped = rows.groupBy("k1", "k2").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("d").alias("depth"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("last_len").alias("last_len"),
    )
    children = grouped.filter(F.col("p1").isNotNull()).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children")
    )
    nodes = grouped.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settled(nodes.withColumns({
        "own_leaves": (F.col("n_children") == 0).cast("long"),
        "own_saved": (F.col("n_convs") - 1) * F.col("last_len"),
    }))
    totals = subtree_totals(rows, nodes, weight)
    ends = (
        rows.filter(F.col("d") == F.col("length"))
        .select("k1", "k2", "c")
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "c")
        .mapInArrow(_sha_of_ends, "k1 long, k2 long, ends_sha256 string")
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(totals, ["k1", "k2"])
        .join(ends, ["k1", "k2"], "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
