"""N-gram Jaccard join: linked documents and their components, by PartEnum signatures.

Documents with one shingle set are one node. Nodes that share a signature form a group: equal
signatures are found in a sorted stream, and groups with the same members count once. Odd sketches
bound the difference of two sets from below; what they leave of the groups is joined into clusters,
in one of which each node is. An exact check inside each cluster then finds all links. Both steps
work in blocks of bounded size and return spanning stars, so that no pairs are ever listed.
Components are computed by distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import components, cut, drop, small, tidied
from .flat import slices, spans
from .shingles import PartEnum, bounds, folded, odd_sketches, set_keys, shingle_sets

#: A block of an oversized group: members, and bytes of their sketches or sets.
BLOCK_ROWS, SKETCH_BYTES, SET_BYTES = 1024, 1 << 20, 16 << 20
#: Text bytes that are turned into arrays at a time.
PIECE = 1 << 20
#: Nodes or groups that a task remembers, and rows of a group that it holds.
SEEN, HELD_ROWS = 1 << 18, 1 << 16


def _pieces(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[tuple]:
    """(batch, first row, last row, set values, set counts) of pieces of about PIECE bytes."""
    for batch in batches:
        data, offsets = spans(batch.column("text"))
        for i, j in slices(offsets, PIECE):
            yield batch, i, j, *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, seed)


def node_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, node, check, sketch): node and check are two keys of the set; null if it is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for batch, i, j, values, counts in _pieces(batches, width, seed):
            a, b = set_keys(values, counts)
            none = counts == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(counts), pa.array(a, mask=none), pa.array(b, mask=none), pa.array(odd_sketches(values, counts), pa.binary(), mask=none)], schema=schema)

    return docs.mapInArrow(tidied(run), "doc_id long, n_shingles long, node long, check long, sketch binary")


def signature_rows(docs: DataFrame, width: int, seed: int, scheme: PartEnum) -> DataFrame:
    """(sig, node) of every document; copies in one task sign once (of its last SEEN nodes)."""
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64())])

    def run(batches):
        seen = np.empty(0, np.int64)
        for _, _, _, values, counts in _pieces(batches, width, seed):
            nodes = set_keys(values, counts)[0]
            once = np.zeros(len(nodes), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            once &= ~np.isin(nodes, seen)
            seen = np.concatenate((seen, nodes[once]))[-SEEN:]
            keep = np.repeat(once & (counts > 0), counts)
            sig, row = scheme.signatures(values[keep], counts[once & (counts > 0)])
            nodes = nodes[once & (counts > 0)][row]
            for k in range(0, len(sig), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + (1 << 18)]), pa.array(nodes[k : k + (1 << 18)])], schema=schema)

    return docs.mapInArrow(tidied(run), "sig long, node long")


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, node) sorted by both: rows of the groups of several nodes that share a signature, under their group's name.

    A group is named by a key of its members, so that of groups with the same members one is left when rows are made
    distinct; a task returns each once (of its last SEEN, known by two keys). Groups whose names clash are checked as one.
    A group of more than HELD_ROWS isn't held: its name is its signature.
    """
    sig = node = np.empty(0, np.int64)  # the group that isn't complete yet, and whether some of its rows went out
    flowing, seen = False, {}

    def complete(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal sig, node, flowing
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        end = len(sig) if last else starts[-1]
        edges = np.append(starts[starts < end], end)
        counts = np.diff(edges)
        if end:
            name, check = set_keys(node[:end].view(np.uint64), counts)
            keep = counts > 1
            if flowing:
                name[0], keep[0] = sig[0], True
            for k in np.flatnonzero(keep)[int(flowing) :].tolist():
                if len(seen) >= SEEN:
                    seen.clear()
                keep[k] = seen.get(key := int(name[k])) != (other := int(check[k]))
                seen[key] = other
            rows = np.repeat(keep, counts)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, counts)[rows]), pa.array(node[:end][rows])], names=["sig", "node"])
            sig, node, flowing = sig[end:], node[end:], False
        if len(sig) > HELD_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(sig[:-1]), pa.array(node[:-1])], names=["sig", "node"])
            sig, node, flowing = sig[-1:], node[-1:], True

    for batch in batches:
        if batch.num_rows:
            sig = np.concatenate((sig, batch.column("sig").to_numpy(zero_copy_only=False)))
            node = np.concatenate((node, batch.column("node").to_numpy(zero_copy_only=False)))
            yield from complete(False)
    if len(sig):
        yield from complete(True)


def set_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, bytes): the shingle sets themselves, as little-endian 64-bit integers."""
    schema = pa.schema([("node", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for _, _, _, values, counts in _pieces(batches, width, seed):
            nodes, edges = set_keys(values, counts)[0], bounds(counts)
            rows = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows]), pa.array([values[edges[r] : edges[r + 1]].tobytes() for r in rows], pa.binary())], schema=schema)

    return docs.mapInArrow(tidied(run), "node long, bytes binary")


def connected(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row that links connect it to."""
    np.fill_diagonal(near, True)
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def possible(sizes: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set, the first of those that links could connect it to, by sizes and sketches."""
    width = min(map(len, sketches))
    x = np.stack([folded(s, width) for s in sketches])
    bits = np.unpackbits(x, axis=1).astype(np.float32)
    ones = bits.sum(axis=1)
    differ = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
    both = sizes[:, None] + sizes[None, :]
    ratio = num * np.maximum(sizes[:, None], sizes[None, :]) <= den * np.minimum(sizes[:, None], sizes[None, :])
    return connected(ratio & ((den - num) * both >= (den + num) * differ))


def linked(_: np.ndarray, sets: list[bytes], num: int, den: int) -> np.ndarray:
    """For each set, the first of those that links connect it to: exact, in dense column blocks."""
    sets = [np.frombuffer(s, np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        inter = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([0, 0 if den * inter >= num * (n.sum() - inter) else 1])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[code] > 1
    row, col = row[shared], rank[code[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    columns = int((count > 1).sum())
    step = min(max(256, (8 << 20) // len(sets)), max(columns, 1))
    for lo in range(0, columns, step):
        a, b = np.searchsorted(col, (lo, lo + step))
        block = np.zeros((len(sets), step), np.float32)
        block[row[a:b], col[a:b] - lo] = 1
        inter += block @ block.T
    inter = np.rint(inter).astype(np.int64)
    return connected(den * inter >= num * (n[:, None] + n[None, :] - inter))


def in_groups(check: Callable, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (sig, i, j, node, size, bytes) sorted by sig, i, j: the parts that ``check`` finds in
    each group, as links (a, b) of a part's first node with each other."""

    def group(parts: list[pa.RecordBatch]) -> list[np.ndarray]:
        nodes = np.concatenate([p.column("node").to_numpy(zero_copy_only=False) for p in parts])
        if len(nodes) < 2:
            return []
        sizes = np.concatenate([p.column("size").to_numpy(zero_copy_only=False) for p in parts])
        label = check(sizes, [x.as_py() for p in parts for x in p.column("bytes")], num, den)
        rest = np.flatnonzero(label != np.arange(len(label)))
        return [np.stack((nodes[label[rest]], nodes[rest]))]

    def batch_of(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        if both.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in both], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(k[:, a])
                if now != key and held:
                    out += group(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
            yield from batch_of(out)
        yield from batch_of(group(held) if held else [])

    return run


def in_blocks(groups: DataFrame, payload: DataFrame, most_bytes: int) -> DataFrame:
    """Rows (sig, i, j, node, size, bytes), sorted: each group's members, dealt out by pairs of bounded blocks."""
    sized = groups.join(payload.select("node", F.length("bytes").alias("length")), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("length") / most_bytes)).cast("int").alias("blocks")
    blocks = cut(sized.groupBy("sig").agg(blocks).filter("blocks > 1"), "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    dealt = groups.join(small(blocks), "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.select("sig", "node", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    return dealt.join(payload, "node").select("sig", "i", "j", "node", "size", "bytes").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "node")


def jaccard_components(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, scheme: PartEnum | None = None, seed: int = 0) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Texts link when the Jaccard similarity of their sets of word shingles is at least num/den;
    component_id is the smallest doc_id that links reach. Null, empty and wordless texts have no
    shingles and link with nothing, their component is their own doc_id. A row with a null doc_id
    takes part and gets the component's smallest doc_id, or null if that has none. Rows that
    repeat a doc_id are reported each. Other columns don't matter; an empty table gives an empty
    result. If two different sets ever share a 64-bit node key, all is redone with other hashes.
    """
    return _labelled(docs, width, num, den, scheme, seed)[0].drop("node")


def _labelled(docs: DataFrame, width: int, num: int, den: int, scheme: PartEnum | None, seed: int) -> tuple[DataFrame, int]:
    """(doc_id, n_shingles, node, component_id) of each row, node the key of its set, and the seed of the keys."""
    scheme = scheme or (PartEnum(num, den) if num * 100 >= den * 86 else PartEnum(num, den, subs=1, margin=1.3, least=2))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = cut(node_rows(docs, width, seed), "nodes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("owner")
    one = [F.first(c).alias(c) for c in ("n_shingles", "sketch")]
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(first, F.count("*").alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), *one), "nodes")
    if not nodes.filter("lo != hi").isEmpty():
        return _labelled(docs, width, num, den, scheme, seed + 1)

    sorted_rows = signature_rows(docs, width, seed, scheme).repartition("sig").sortWithinPartitions("sig", "node")
    groups = cut(sorted_rows.mapInArrow(tidied(shared_runs), "sig long, node long").distinct(), "groups")
    sketches = nodes.select("node", F.col("n_shingles").alias("size"), F.col("sketch").alias("bytes"))
    clusters = cut(components(in_blocks(groups, sketches, SKETCH_BYTES).mapInArrow(tidied(in_groups(possible, num, den)), "a long, b long")).select(F.col("component").alias("sig"), "node"), "clusters")
    drop(groups)
    wanted = cut(nodes.select("node", "owner", F.col("n_shingles").alias("size")).join(clusters.select("node"), "node"), "wanted")
    owners = small(wanted.select(F.col("owner").alias("o")).distinct(), wanted.count())
    sets = set_rows(docs.join(owners, F.col("doc_id").eqNullSafe(F.col("o")), "left_semi"), width, seed).dropDuplicates(["node"])
    sets = cut(sets.join(wanted.select("node", "size"), "node"), "sets")
    edges = in_blocks(clusters, sets, SET_BYTES).mapInArrow(tidied(in_groups(linked, num, den)), "a long, b long")

    found = components(edges)
    for done in (clusters, wanted, sets):
        drop(done)
    label = F.coalesce("component", "node")
    merged = cut(nodes.join(found, "node", "left").withColumn("label", label).filter("copies > 1 or component is not null").select("node", "owner", "label"), "labels")
    drop(nodes)
    least = cut(merged.groupBy("label").agg(F.min("owner").alias("component_id")), "least")
    named = small(merged.join(least, "label").select("node", "component_id"))
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id")), seed


def keep_one(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; other columns as they are.

    Rows without a doc_id stay. Dropped rows are named by doc_id; where rows share a doc_id and only
    some of them are to go, by the set of their text too. Rows that repeat the doc_id that stays, all stay.
    """
    near, seed = _labelled(docs, width, num, den, None, 0)
    near = cut(near, "near")
    lost = cut(near.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_set")).distinct(), "lost")
    n = lost.count()
    ids = lost.select("_gone").distinct()
    # ids that some rows keep while others with another text lose them
    split = cut(near.filter("doc_id = component_id").join(small(ids, n), F.col("doc_id") == F.col("_gone"), "left_semi").select(F.col("doc_id").alias("_split")).distinct(), "split")
    drop(near)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    shared = split.count()
    if not shared:
        return rows.drop("text").join(small(ids, n), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
    whole = small(ids.join(small(split, shared), F.col("_gone") == F.col("_split"), "left_anti"), n)
    rows = rows.join(whole, F.col("_id") == F.col("_gone"), "left_anti")
    split = small(split, shared)
    plain = rows.join(split, F.col("_id") == F.col("_split"), "left_anti").select("_row")
    unlike = with_node(rows.join(split, F.col("_id") == F.col("_split"), "left_semi"), width, seed)
    unlike = unlike.join(small(lost, n), (F.col("_id") == F.col("_gone")) & (F.col("_node") == F.col("_set")), "left_anti").select("_row")
    return plain.unionByName(unlike).select("_row.*")


def with_node(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """rows (_row, _id, text) as (_row, _id, _node), the key of the text's set; null if it is empty."""
    row = rows.select("_row").schema[0].dataType

    def run(batches):
        for batch, i, j, values, counts in _pieces(batches, width, seed):
            node = pa.array(set_keys(values, counts)[0], mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, j - i), batch.column("_id").slice(i, j - i), node], names=["_row", "_id", "_node"])

    rows = rows.withColumn("_id", F.col("_id").cast("long"))
    return rows.mapInArrow(tidied(run), StructType().add("_row", row).add("_id", "long").add("_node", "long"))
