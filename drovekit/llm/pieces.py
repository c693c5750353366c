"""SentencePiece encoding and decoding in numpy batches.

Words of one length advance together over a lattice: at each end position the substrings of each
length are looked up by hash among the sorted piece keys, and vectorised maxima choose the piece
that ends there and store its length as backpointer.

* Unigram models: Viterbi. The best sum of piece scores wins, the longer piece on a tie.
* BPE models: summed scores don't give what merges give, so the lattice has the merges' own rule
  instead. The last piece of a prefix's encoding is the one whose seam with the last piece before
  it stays unmerged; that is decided from the two pieces by undoing their merges, the latest first.
  Exactly one piece passes, and the path of backpointers is the encoding that merging gives.

Text is cut into units before the lattice: no piece goes beyond the start of a run of spaces or
over a control character that no piece holds. Each distinct unit is encoded once a batch and kept in
a bounded table. Runs of spaces, and units of a BPE model that are longer than LONG, are few of a length
and go through the merges themselves, in n log n steps.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .shingles import mix

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_B = np.uint64(0x9E3779B97F4A7C15)
#: Units kept from batch to batch, and characters of text in a batch.
KEPT, PIECE = 1 << 18, 2 << 20
#: A BPE unit of more characters is merged alone.
LONG = 256


class Keys:
    """Sorted 64-bit keys, and a table of the slots that their hashes take, with a key's place in each: what falls on a free slot
    isn't a key, and only where a slot is another key's too is the rest searched for among the sorted keys."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys.astype(np.uint64), np.uint64(64 - bits)
        slots = self._slots(self.keys)
        self.place = np.full(1 << bits, -1, np.int32)
        self.place[slots] = np.arange(len(keys))
        self.shared = np.bincount(slots.astype(np.int64), minlength=1 << bits) > 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _B) >> self.shift

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Each key's place, -1 for what isn't a key."""
        slots = self._slots(wanted)
        out = self.place[slots]
        other = np.flatnonzero((out >= 0).ravel())
        some = wanted.ravel()[other]
        wrong = self.keys[out.ravel()[other]] != some
        other, some = other[wrong], some[wrong]
        flat = out.reshape(-1)
        flat[other] = -1
        again = self.shared[slots.ravel()[other]]
        other, some = other[again], some[again]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        flat[other] = np.where(self.keys[at] == some, at, -1)
        return out


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        if b[i] < 128:
            return x, i + 1
        i, shift = i + 1, shift + 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ((8 if kind == 1 else 4), i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Model:
    """Pieces and rules of a SentencePiece file. Only the identity normaliser is supported, as nothing
    else is needed for the public vocabularies; others raise."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        scores, kinds, trainer, normalizer = [], [], {}, {}
        for number, value in _fields(proto):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.dummy_prefix, self.strip = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or self.strip or not normalizer.get(5, 1):
            raise ValueError("only unigram and BPE models without normalisation rules are supported")
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.scores, self.kinds = np.array(scores), np.array(kinds)
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, kinds, strict=True) if k == 1):
            raise ValueError("pieces over a space aren't supported")
        self.unk = kinds.index(2)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        normal = [i for i, k in enumerate(kinds) if k == 1]
        self.ids = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.ids), default=1)
        keys = np.array([self._key(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.by_key = Keys(self.keys, 20)
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in self.ids))
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        if self.kind == BPE:
            self._merges()

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_B) + ord(c) + 1) & (1 << 64) - 1
        return int(mix(np.array([h], np.uint64))[0])

    def _merges(self) -> None:
        """Ranks, the last merge of each piece, and which pairs merge to which piece. Ids from
        len(pieces) on stand for characters that are no piece; they never merge."""
        n = len(self.pieces)
        long_ones = [(p, i) for p, i in self.ids.items() if len(p) > 1]
        order = sorted({-self.scores[i] for _, i in long_ones})
        of_score = {s: k for k, s in enumerate(order)}
        self.rank = np.full(n + 1, -1)
        pairs = {}
        for p, i in long_ones:
            self.rank[i] = of_score[-self.scores[i]]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.by_pair = Keys(self.pair_keys, 21)
        self.pairs, self.ranks = pairs, self.rank.tolist()
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        self.reached = np.ones(n + 1, bool)
        for p, i in long_ones:
            steps = self.merge(p)
            self.reached[i] = steps[-1][2] == i if steps and len(steps) == len(p) - 1 else False
            if self.reached[i]:
                self.left[i], self.right[i] = steps[-1][:2]

    def merge(self, text: str) -> list[tuple[int, int, int]]:
        """The merges (left, right, merged) of a text in order: the best score first, the leftmost on a tie.

        A heap of the pairs that can merge, each with what stood there when it was found: n log n steps."""
        now = [self.ids.get(c, len(self.pieces)) for c in text]
        after, before, out = list(range(1, len(now) + 1)), list(range(-1, len(now) - 1)), []

        def found(k: int) -> None:
            if 0 <= k and after[k] < len(now) and (m := self.pairs.get(now[k] << 20 | now[after[k]])) is not None:
                heappush(heap, (self.ranks[m], k, now[k], now[after[k]], m))

        heap: list[tuple[int, int, int, int, int]] = []
        for k in range(len(now) - 1):
            found(k)
        while heap:
            _, k, a, b, m = heappop(heap)
            j = after[k]
            if now[k] != a or j >= len(now) or now[j] != b:
                continue
            out.append((a, b, m))
            now[k], now[j], after[k] = m, -1, after[j]
            if after[k] < len(now):
                before[after[k]] = k
            found(before[k])
            found(k)
        self.merged = [x for x in now if x >= 0]
        return out

    def seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b, side by side, stay two pieces under the merges."""
        out, limit = np.ones(len(a), bool), np.full(len(a), np.iinfo(np.int64).max)
        todo = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(todo):
            at = self.by_pair.find((a[todo] << 20 | b[todo]).astype(np.uint64))
            crossed = (at >= 0) & (self.rank[self.pair_ids[at]] < limit[todo])
            out[todo[crossed]] = False
            r1, r2 = self.rank[a[todo]], self.rank[b[todo]]
            go = ~crossed & (np.maximum(r1, r2) >= 0)
            todo, r1, r2 = todo[go], r1[go], r2[go]
            first = r1 > r2
            x, y = todo[first], todo[~first]
            limit[x], a[x] = r1[first], self.right[a[x]]
            limit[y], b[y] = r2[~first] + 1, self.left[b[y]]
        return out

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of words of one length, piece lengths by end position, and those pieces' ids
        (len(pieces) for a character that is none); codes are (words, length) code points."""
        words, length = codes.shape
        none = len(self.pieces)
        prefix, power = np.zeros((length + 1, words), np.uint64), [np.uint64(1)]
        for i in range(length):
            prefix[i + 1] = prefix[i] * _B + codes[:, i].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            for _ in range(min(length, self.longest)):
                power.append(power[-1] * _B)
        back = np.zeros((length + 1, words), np.int32)
        chosen = np.full((length + 1, words), none)
        best = np.zeros((length + 1, words))
        for i in range(1, length + 1):
            spans = range(min(i, self.longest), 0, -1)
            wanted = mix(np.stack([prefix[i] - prefix[i - k] * power[k] for k in spans]))
            at = self.by_key.find(wanted)
            ids = np.where(at >= 0, self.key_ids[at], -1)
            if self.kind == UNIGRAM:
                value = np.where(ids >= 0, self.scores[ids], -np.inf)
                value[-1] = np.where(ids[-1] >= 0, value[-1], self.scores[self.kinds == 1].min() - 10)
                value += np.stack([best[i - k] for k in spans])
                top = value.argmax(axis=0)  # the first of equal maxima: the longest piece
                best[i] = value[top, np.arange(words)]
                back[i] = i - (i - np.array(list(spans)))[top]
                chosen[i] = np.where(ids[top, np.arange(words)] >= 0, ids[top, np.arange(words)], none)
                continue
            ids[-1] = np.where(ids[-1] >= 0, ids[-1], none)
            open_ = np.arange(words)
            for row, k in enumerate(spans):
                x = open_[ids[row, open_] >= 0]
                x = x[self.reached[ids[row, x]]]
                if len(x) and i > k:
                    x = x[self.seams(chosen[i - k, x], ids[row, x])]
                if len(x):
                    back[i, x], chosen[i, x] = k, ids[row, x]
                    open_ = open_[back[i, open_] == 0]
                    if not len(open_):
                        break
            if len(open_):
                raise RuntimeError("no piece fits: the model's merges contradict each other")
        return back, chosen

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        cores = units
        if self.kind == BPE:  # runs of spaces merge after all else, as their scores are the least
            cores = [u if len(u) < 2 or u[1] != SPACE else u.lstrip(SPACE) and SPACE + u.lstrip(SPACE) for u in units]
        sizes = np.array([len(c) for c in cores])
        out: list[bytes] = [b""] * len(units)
        for length in np.unique(sizes):
            rows = np.flatnonzero(sizes == length)
            if self.kind == BPE and length > LONG:  # few of a length: a lattice of one word is slower than its merges
                for r in rows.tolist():
                    self.merge(units[r])
                    ids = [x for m, part in zip(self.merged, self._parts(units[r]), strict=True) for x in ([m] if m < len(self.pieces) else self._ids([part]))]
                    out[r] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            if not length:
                for r in rows:
                    out[r] = self.spaces(len(units[r])).astype("<u4").tobytes()
                continue
            for lo in range(0, len(rows), step := max(1, (1 << 19) // int(length))):
                part = rows[lo : lo + step]
                codes = np.frombuffer("".join(cores[r] for r in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                back, chosen = self.lattice(codes)
                ends = np.zeros((len(part), length + 1), bool)
                at = np.full(len(part), length)
                while (live := np.flatnonzero(at)).size:
                    ends[live, at[live]] = True
                    at[live] -= back[at[live], live]
                flat = chosen.T[ends].astype("<u4")
                edges = np.concatenate(([0], np.cumsum(ends.sum(axis=1)))) * 4
                odd = (chosen.T == len(self.pieces)) & ends
                odd = odd.any(axis=1) | np.array([len(units[r]) != length for r in part])
                raw, edges = flat.tobytes(), edges.tolist()
                for j, r in enumerate(part.tolist()):
                    out[r] = raw[edges[j] : edges[j + 1]]
                for j in np.flatnonzero(odd).tolist():
                    r, core, to = part[j], cores[part[j]], np.flatnonzero(ends[j]).tolist()
                    ids = self._ids([core[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)])
                    extra = len(units[r]) - len(core)
                    if extra:
                        alone = ids[0] == self.ids.get(SPACE)
                        ids = [*self.spaces(extra + alone).tolist(), *ids[alone:]]
                    out[r] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def spaces(self, n: int) -> np.ndarray:
        """Ids of n spaces alone."""
        if self.kind != BPE:
            return np.full(n, self.ids[SPACE], np.int64)
        self.merge(SPACE * n)
        return np.array(self.merged, np.int64)

    def _parts(self, text: str) -> Iterator[str]:
        """The characters of each of the pieces that were merged last."""
        at = 0
        for m in self.merged:
            n = len(self.pieces[m]) if m < len(self.pieces) else 1
            yield text[at : at + n]
            at += n

    def _ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[x] for x in p.encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unk or self.kind == BPE:
                out.append(self.unk)
        return out

    def cut(self, text: str) -> list[str]:
        """The units of a text."""
        text = text.replace(" ", SPACE)
        return self.units.findall(SPACE + text if self.dummy_prefix and text else text)

    @cached_property
    def surfaces(self) -> list[bytes]:
        shown = {1: lambda p: p.replace(SPACE, " ").encode(), 2: lambda p: " ⁇ ".encode(), 3: lambda p: b"", 6: lambda p: bytes([int(p[1:-1], 16)])}
        return [shown[k](p) for p, k in zip(self.pieces, self.kinds.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surfaces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Codec:
    """A model with a bounded table of the units that were met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        units = [self.model.cut(t) if t else [] for t in texts]
        new = list({u for us in units for u in us if u not in self.known})
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = list({u for us in units for u in us})
        self.known.update(zip(new, self.model.encode_units(new), strict=True))
        return [b"".join(map(self.known.__getitem__, us)) for us in units]


def _codec(shared) -> Codec:
    """One codec for each worker process and model."""
    model = shared.value
    if getattr(model, "codec", None) is None:
        model.codec = Codec(model)
    return model.codec


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    held, start, size = [], 0, 0
    for k, t in enumerate(batch.column("text")):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= PIECE or k + 1 == batch.num_rows:
            yield start, held
            held, start, size = [], k + 1, 0


def load(path: str) -> Model:
    """Read the model file on the driver; tasks get it by broadcast."""
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_tokens, ids (array<int>), and text_sha256 of the ids decoded again.

    A null text is empty and has no ids. Null and repeated doc_ids are rows like others; other
    columns aren't read. An empty table gives an empty result. text_sha256 differs from the text's
    own where the ids don't say all: for the space mark itself, and for characters without a
    piece in models without byte fallback.
    """
    return _encoded(docs, model, True)


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """As ``encode``, with ids_crc32 (unsigned, ids as little-endian 32-bit integers) in place of the ids."""
    return _encoded(docs, model, False)


def _encoded(docs: DataFrame, model: Model, whole: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    last = ("ids", pa.list_(pa.int32())) if whole else ("ids_crc32", pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("text_sha256", pa.string()), last])

    def run(batches):
        for batch in batches:
            for start, texts in _groups(batch):
                codec = _codec(shared)
                once = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # repeats of a text are encoded once
                at = np.array([once[t] for t in texts])
                ids = codec.encode(list(once))
                again = [codec.model.decode(np.frombuffer(x, "<u4")) for x in ids]
                counts = np.array([len(x) // 4 for x in ids], np.int64)[at]
                if whole:
                    flat = np.frombuffer(b"".join(map(ids.__getitem__, at.tolist())), "<i4")
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int32()))
                else:
                    value = pa.array([zlib.crc32(x) for x in ids], pa.int64()).take(pa.array(at))
                sha = pa.array([hashlib.sha256(a.encode("utf-8", "surrogatepass")).hexdigest() for a in again]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(counts), sha, value], schema=schema)

    ddl = "doc_id long, n_tokens long, text_sha256 string, " + ("ids array<int>" if whole else "ids_crc32 long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), ddl)
