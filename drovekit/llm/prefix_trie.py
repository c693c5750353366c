"""Prefix trie of conversations by heavy-path decomposition.

Conversations that begin with the same turns share nodes. A node is named by its depth and a 128-bit sum over its turns'
SHA-256 and places, so that all prefixes of a conversation, however long, come from running sums over bounded
blocks. Each node's heavy child is the one with most members; following heavy children makes paths, each of which
ends in a leaf and lies within the conversation that the leaf stands for: its path is that conversation's part below its
last light step. A light child has at most half its parent's members, so the number of light steps above a path is at most
the logarithm of the number of conversations; that many rounds, from the deepest paths up, sum each path from its end and
attach its total to the node above its head.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.placement import placed, running
from .common import cut

#: Bits of the ids that one text holds.
BITS = 12
LIMBS = ["l0", "l1", "l2", "l3"]
NODE = ["depth", "a", "b"]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, chars, place) of each turn, its place from 0 on. Turns with equal numbers are in the order of the
    SHA-256 of their role and text; repeated rows are turns of their own; rows without a conv_id are left out."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).filter("conv_id is not null")
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256))
    turns = turns.select("conv_id", "turn", digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    return placed(turns, [F.asc_nulls_first("turn"), "digest"], within=["conv_id"], name="place").drop("turn")


def rebuilt(turns: DataFrame, *, share: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, chars) of conversations whose first turns are those of the first of each ``share``
    conversations, and members (conv_id, n), turnless ones with n = 0.

    A conversation c takes the first h turns of c - c % share (all if there are fewer, none if it is absent), then its own after
    its first h; h = crc32(decimal c) % most. The remainder has the sign of c.
    """
    counts = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n_own")), "counts")
    convs = counts.select("*", (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    front = F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left").select("conv_id", "base", "h", front.alias("front"), (front + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))
    convs = cut(convs, "members")
    own = turns.join(convs.select("conv_id", "h", "front"), "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("front") + 1).alias("depth"), "digest", "chars")
    heads = turns.filter(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = convs.filter("front > 0").join(heads, "base").filter("place < front").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    return own.unionByName(taken), convs.select("conv_id", "n")


def chains(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars, n): the node of each prefix of each conversation, and that of the prefix before it."""
    low, unsigned = F.lit(0xFFFFFFFF), lambda c, k: F.shiftrightunsigned(c, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    hashes = [F.xxhash64(F.lit(s), "depth", "digest") for s in (1, 2)]
    limbs = {LIMBS[2 * i + k]: unsigned(h, k) for i, h in enumerate(hashes) for k in (0, 1)}
    rows = running(turns.select("conv_id", "depth", (F.col("depth") - 1).alias("_at"), "chars", *(c.alias(n) for n, c in limbs.items())), "conv_id", "_at", LIMBS, 1 << 32)
    pair = lambda x, y: F.shiftleft(y.bitwiseAND(low), 32).bitwiseOR(x.bitwiseAND(low))
    now, before = (lambda k: F.col(f"s_{LIMBS[k]}")), (lambda k: F.col(f"s_{LIMBS[k]}") - F.col(LIMBS[k]) + F.lit(1 << 32))
    names = [pair(now(0), now(1)).alias("a"), pair(now(2), now(3)).alias("b"), pair(before(0), before(1)).alias("pa"), pair(before(2), before(3)).alias("pb")]
    return rows.select("conv_id", "depth", *names, "chars").join(members, "conv_id")


def same(df: DataFrame, other: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (df[a] == other[b] for a, b in pairs))


def _linked(chain: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes: depth, a, b, pa, pb, conv_id, n_convs, chars, n_children, parent_conv_id, light (not its parent's heavy child)."""
    nodes = chain.groupBy(*NODE).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"), "conv_id", "n_convs", zero.alias("chars"))
    nodes = cut(nodes.unionByName(root), "nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    below = cut(below.agg(F.count("*").alias("n_children"), F.max_by(F.struct("a", "b"), F.struct("n_convs", F.bitwise_not("conv_id"))).alias("heavy")), "children")
    full = cut(nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    up = full.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    light = (F.col("depth") > 0) & ((F.col("a") != F.col("chosen.a")) | (F.col("b") != F.col("chosen.b")))
    out = full.join(up, ["depth", "pa", "pb"], "left").select(*NODE, "pa", "pb", "conv_id", "n_convs", "chars", "n_children", "parent_conv_id", F.coalesce(light, F.lit(False)).alias("light"))
    return cut(out, "linked")


def _elements(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each node once, on its path: path (the conversation of its leaf), depth, a, b, pa, pb, at (0 for the leaf), head, level (the
    light steps above it), and what it adds to the sums over its subtree: n_leaves, saved_tokens."""
    ends = nodes.filter("n_children = 0").select(F.col("conv_id").alias("path"))
    own = nodes.select(*NODE, "light", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    # a leaf's conversation ends there: all its nodes are the leaf's way from the root
    way = cut(chain.join(ends, F.col("conv_id") == F.col("path"), "left_semi").withColumnRenamed("conv_id", "path").drop("chars").join(own, NODE), "ways")
    paths = cut(way.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("head"), F.sum(F.col("light").cast("long")).alias("level"), F.first("n").alias("n")), "paths")
    names = ["path", *NODE, "pa", "pb", "at", "head", "level", "n_leaves", "saved_tokens"]
    rows = way.drop("n").join(paths, "path").filter("depth >= head").withColumn("at", F.col("n") - F.col("depth"))
    # the root lies on the path that no light step leads to; where no conversation has a turn it is a leaf, and a path
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = nodes.filter("depth = 0").select(null.alias("path"), null.alias("n"), "conv_id", "n_children")  # one row here, and one at most there
    top = top.unionByName(paths.filter("head = 0").select("path", "n", null.alias("conv_id"), null.alias("n_children"))).agg(*(F.max(c).alias(c) for c in ("path", "n", "conv_id", "n_children"))).filter("conv_id is not null")
    top = top.select(F.coalesce("path", "conv_id").alias("path"), zero.alias("depth"), zero.alias("a"), zero.alias("b"), null.alias("pa"), null.alias("pb"), F.coalesce("n", zero).alias("at"), zero.alias("head"), zero.alias("level"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    return cut(rows.select(*names).unionByName(top.select(*names)), "elements")


def _summed(elements: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens) over each node's subtree: paths summed from their ends, the deepest level first."""
    heads = elements.filter("head > 0 and depth = head").select(F.col("path").alias("of"), (F.col("head") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    links = cut(heads.join(elements.select("path", *NODE), NODE).select("of", F.col("path").alias("up"), F.col("depth").alias("up_depth")), "links")
    sums, done, add = ["n_leaves", "saved_tokens"], [], None
    for level in range(elements.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = elements.filter(F.col("level") == level)
        if add is not None:
            rows = rows.join(add, ["path", "depth"], "left").select(*(c for c in elements.columns if c not in sums), *((F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in sums))
        got = cut(running(rows, "path", "at", sums).select("path", "head", *NODE, *(F.col(f"s_{c}").alias(c) for c in sums)), "level")
        done.append(got.select(*NODE, *sums))
        if level:
            tops = got.filter("depth = head").join(links, F.col("path") == F.col("of"))
            add = cut(tops.groupBy(F.col("up").alias("path"), F.col("up_depth").alias("depth")).agg(*(F.sum(c).alias(f"add_{c}") for c in sums)), "attached")
    return reduce(DataFrame.unionByName, done)


def ends(chain: DataFrame, members: DataFrame, bits: int = BITS) -> DataFrame:
    """(depth, a, b, part, ids): the conv_ids that end at a node, ascending, as comma-joined texts of at most 2**bits ids."""
    zero = F.lit(0).cast("long")
    last = chain.filter("depth = n").select(*NODE, "conv_id").unionByName(members.filter("n = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    parts = last.groupBy(*NODE, F.shiftright("conv_id", bits).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return parts.select(*NODE, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def ends_sha256(parts: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of a table of ``ends``. Nodes with several texts are read in order and hashed as they come."""
    parts = cut(parts, "ends")
    whole = parts.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    long_ones = cut(whole.filter("n > 1").select(*NODE), "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        found: list[tuple] = []
        for b in batches:
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node != now:
                    if now is not None:
                        found.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if now is not None:
            found.append((*now, sha.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=[*NODE, "ends_sha256"])

    streamed = parts.join(long_ones, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")
    return whole.filter("n = 1").select(*NODE, F.sha2(F.encode("ids", "utf-8"), 256).alias("ends_sha256")).unionByName(streamed)


def trie(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the conversations that end at them (``ends``), of turns (conv_id, depth, digest, chars) at depths 1, 2, ...,
    and members (conv_id, n), the number of their turns.

    A node has depth, a, b (its name), conv_id (its smallest member), parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens. Of children with as many members the one with the smallest conv_id is heavy.
    """
    chain = cut(chains(turns, members), "chains")
    nodes = _linked(chain, members)
    sums = _summed(_elements(chain, nodes))
    return nodes.join(sums, NODE).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends(chain, members)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn comes first; see ``ordered`` for ties and repeated rows and ``rebuilt`` for
    how conversations are rebuilt. Texts leave the first stage as their digests and lengths, so they may be of any length, and
    a conversation may have any number of turns. Other columns don't matter. Without conversations there is no node.
    SHA-256 reads its input in order, so the ids that end at one node pass one task, as a stream of texts of 2**BITS ids at most.
    """
    turns, members = rebuilt(ordered(conversations))
    nodes, last = trie(turns, members)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends_sha256(last), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
