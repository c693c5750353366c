"""Documents operators on small fixtures: odd rows, empty tables, and brute-force versions."""

import hashlib
import re
import warnings
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from drovekit.llm import exact_dedup, flat, media, mixing, ngram_join, pieces, shingles, token_store, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _row string, sig long, label string"
WORDS = [f"w{i}" for i in range(400)]


def near(seed, edits):
    rng = np.random.default_rng(seed)
    words = [WORDS[i] for i in np.random.default_rng(1).integers(0, 400, 200)]
    for k in rng.choice(200, edits, replace=False):
        words[k] = f"x{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \t\n", "one", "One", "one two", "a  b\tc", "a b c", "a b c", "ünï cödé 日本", "x" * 300_000, "long " * 60_000, *(near(s, s % 8) for s in range(30))]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c"), (7, "a b c"), (None, None), (3, "one")]
    return spark.createDataFrame([(i, t, "en", "s", 0, 5, "r", 6, "l") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"chunk": 7, "huge": 100}, {"primes": (3, 3), "chunk": 5}])
def test_exact_groups(docs, how):
    got = exact_dedup.exact_groups(docs, **how).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append(r.doc_id)
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for sha, ids in by_sha.items():
        mine = [r for r in got if r.text_sha256 == sha]
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {r.group_size for r in mine} == {len(ids)} and sum(r.kept for r in mine) == 1
        assert {r.keep_id for r in mine} == {min((i for i in ids if i is not None), default=None)}


def test_fingerprints_compose():
    data = np.frombuffer(b"some bytes to hash" * 9, np.uint8)
    assert len({exact_dedup.fingerprint(data, c) for c in (1, 5, 64, 1 << 20)}) == 1


def test_keep_first(docs):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in kept.filter("doc_id is not null").collect()]
    assert len(texts) == len(set(texts))


def brute(rows, width, num):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= num * (len(a) + len(sets[j]) - n):
                group = [group[i] if g == group[j] else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [q.doc_id for q, g in zip(rows, group, strict=True) if g == group[i] and q.doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, width, num):
    assert rows(ngram_join.jaccard_components(docs, width=width, num=num)) == brute(docs.collect(), width, num)


def test_jaccard_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    assert rows(ngram_join.jaccard_components(docs, width=3, num=90)) == brute(docs.collect(), 3, 90)


def runs(found, size):
    data = sorted(found)
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in data[k : k + size]], pa.int64()), pa.array([y for _, y in data[k : k + size]], pa.int64())], names=["sig", "node"]) for k in range(0, len(data), size)]
    out = {}
    for b in ngram_join.shared_runs(iter(batches)):
        for name, node in zip(b.column("sig").to_pylist(), b.column("node").to_pylist(), strict=True):
            out.setdefault(name, []).append(node)
    return out


@pytest.mark.parametrize("held", [1 << 16, 3])
def test_groups_with_the_same_members_come_once(monkeypatch, held):
    monkeypatch.setattr(ngram_join, "HELD_ROWS", held)
    rng = np.random.default_rng(5)
    members = {int(s): sorted({int(n) for n in rng.integers(0, 9, int(rng.integers(1, 8)))}) for s in rng.integers(-(1 << 62), 1 << 62, 300)}
    found = [(s, n) for s, m in members.items() for n in m for _ in range(2)]  # each row twice
    want = {tuple(m) for m in members.values() if len(m) > 1}
    for size in (1, 4, 1000):
        got = runs(found, size)
        assert {tuple(m) for m in got.values()} == want
        if held > 9:
            assert len(got) == len(want)


def test_groups_of_signatures_are_shuffled_once(docs, monkeypatch):
    plans, deal = [], ngram_join.in_blocks
    monkeypatch.setattr(ngram_join, "in_blocks", lambda groups, *x: plans.append(groups._jdf.queryExecution().executedPlan().toString()) or deal(groups, *x))
    ngram_join.jaccard_components(docs, width=5, num=80).collect()
    assert plans and not any("Exchange" in p for p in plans)


def test_keep_one_of_shared_ids_with_unlike_texts(spark):
    a, near_a, other = near(1, 0), near(2, 1), "quite another text " + near(3, 120)
    rows_ = [(3, a), (7, near_a), (7, other), (9, near_a), (11, other), (11, "alone"), (None, a), (12, None), (12, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 0, 5, "r", 6, "l") for i, t in rows_], SCHEMA)
    got = ngram_join.keep_one(d)
    assert got.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, a), (7, other), (11, "alone"), (None, a), (12, None), (12, "")]))


@pytest.mark.parametrize("scheme", [shingles.PartEnum(90, 100), shingles.PartEnum(80, 100, subs=1, margin=1.3, least=2)])
def test_linked_sets_share_a_signature(scheme):
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 10, 11, 40, 300):
        for _ in range(20):
            a = rng.choice(1 << 40, size, replace=False).astype(np.uint64)
            drop = int(rng.integers(0, size // 5 + 1))
            b = np.concatenate((a[drop:], rng.choice(1 << 40, int(rng.integers(0, size // 5 + 1)), replace=False).astype(np.uint64)))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if not len(b) or scheme.den * inter < scheme.num * union:
                continue
            sig, row = scheme.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)]))
            assert set(sig[row == 0]) & set(sig[row == 1])
            x, y = (np.frombuffer(s, np.uint8) for s in shingles.odd_sketches(np.concatenate((a, b)), np.array([len(a), len(b)])))
            n = min(len(x), len(y))
            differ = np.unpackbits(shingles.folded(x.tobytes(), n) ^ shingles.folded(y.tobytes(), n)).sum()
            assert differ <= union - inter


def test_words_are_split_at_ascii_white_space():
    texts = ["A b C\td", None, "", " x ", "É e"]
    _, counts = flat.word_hashes(*flat.spans(pa.array(texts)))
    assert counts.tolist() == [3, 0, 0, 1, 2]


def test_token_store(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_store.token_ids(docs, path).collect()
    want = sorted((str(r.doc_id), zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_units_encode_like_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), token_store.Encoder(path)
    texts = ["it's  a\n\ntest, don't\t<|endoftext|> x", " lead", "trail ", "a b", "x\x00y", "Éa ²3 ´s ... !?\nz", None, "", " ", "\n", "\n \n", "a\n", "\na", "x \x1cy z\x1c", "a\u00a0 b c", "日本 語\u3000x y", "a\r\nb \n c", "don 't we 'll", " \n"]
    rng = np.random.default_rng(0)
    parts = ["a", "word", "'s", " ", "  ", "\n", "\t", ".", ",", "é", "日", "12", "\u2003", "_", "<|endoftext|>"]
    texts += ["".join(rng.choice(parts, rng.integers(1, 40), p=[0.14, 0.14, 0.05, 0.3, 0.05, 0.1, 0.03, 0.05, 0.05, 0.03, 0.03, 0.01, 0.005, 0.01, 0.005])) for _ in range(2000)]
    for kept in (1 << 20, 200):  # the table holds all, or forgets at once
        monkeypatch.setattr(e, "KEPT", kept)
        for k in range(0, len(texts), 300):
            part = texts[k : k + 300]
            ids, counts = e.encode(pa.array(part))
            for text, to, n in zip(part, np.cumsum(counts), counts, strict=True):
                assert ids[to - n : to].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_damaged_frame_is_found(tmp_path):
    w = token_store.FrameWriter(frame_ids=4)
    raw = bytearray(b"".join([*w.add(None, b"none"), *w.add(5, b"abcd" * 3), *w.add(9, b"efgh" * 8), *w.finish()]))
    (tmp_path / "a").write_bytes(raw)
    assert token_store.fetch(str(tmp_path / "a"), [9])[9].tobytes() == b"efgh" * 8
    raw[6] ^= 255
    (tmp_path / "b").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_store.fetch(str(tmp_path / "b"), [5])


def test_media_columns(docs):
    got = media.media_columns(docs).collect()
    want = []
    for r in docs.collect():
        p = media.padded((r.text or "").encode())
        want.append((str(r.doc_id), len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), hashlib.sha256(media.wave(p)).hexdigest(), media.feature_of(p)))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.feature) for r in got) == sorted(want)


def test_media_of_shared_ids_with_unlike_texts(spark):
    passage = " ".join(near(1, 9) for _ in range(40))
    rows_ = [(None, "unique"), (None, "copy"), (3, "copy"), (5, passage), (9, passage + "an end"), (9, "a start" + passage), (9, "own"), (None, passage), (9, "own"), (4, None), (9, " ")]
    got = media.media_columns(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).collect()
    want = [(str(i), hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t in rows_]
    assert sorted((str(r.doc_id), r.payload_sha256) for r in got) == sorted(want)


def test_chunks_are_content_defined():
    rng = np.random.default_rng(5)
    tail = rng.integers(0, 256, 200_000, np.uint8).tobytes()
    a, b = tail, rng.integers(0, 256, 777, np.uint8).tobytes() + tail
    cut = lambda d: {hashlib.sha256(d[i:j]).digest() for i, j in zip([0, *media.chunk_ends(d)[:-1]], media.chunk_ends(d), strict=True)}
    assert len(cut(a) & cut(b)) > 0.9 * len(cut(a))
    sizes = np.diff([0, *media.chunk_ends(a)])
    assert sizes.sum() == len(a) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load(path)
    got = pieces.encode(docs, model).collect()
    want = [(r.doc_id, lib.encode(r.text or "", num_threads=1)) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), x) for i, x in want)
    codec = pieces.Codec(model)
    texts = ["   x", " ", "a  b   c", "-----=====", "é𝕏\n\ttab", "aaaa" * 40, " " * 33, "don't stop", " " * 100_001, "x" * 70_000, "abc𝕏é" * 900 + "   y", " " * 5000 + "interna" * 50]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [lib.encode(t) for t in texts]


def test_unigram_viterbi_is_the_best_path():
    raw = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    at = raw.index(b"tok_v0") + 6
    m = pieces.Model(raw[:at] + b"\x18\x01" + raw[at + 2 :])  # the same pieces and scores as a unigram model

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for i in range(1, len(word) + 1):
            for k in range(1, min(i, m.longest) + 1):
                if (p := m.ids.get(word[i - k : i])) is not None:
                    top[i] = max(top[i], top[i - k] + m.scores[p])
        return top[-1]

    for unit, ids in zip(us := ["▁the", "▁international", "▁thonner", "ing", "▁Haanth"], m.encode_units(us), strict=True):
        assert sum(m.scores[i] for i in np.frombuffer(ids, "<u4")) == pytest.approx(best(unit))


def test_toxicity(spark, docs):
    rng = np.random.default_rng(0)
    rows_, labels = [], []
    for k in range(600):
        words = [WORDS[i] for i in rng.integers(0, 400, 40)]
        y = int(k % 4 == 0)
        if y:
            words[5] = words[20] = "nasty" + "abcdef"[rng.integers(6)]
        rows_.append((k, " ".join(w.replace("w", "v") + "qrstuvwxyz"[int(w[1:]) % 10] for w in words) if not y else " ".join(w if w.startswith("nasty") else w.replace("w", "v") + "qrstuvwxyz"[int(w[1:]) % 10] for w in words)))
        labels.append((k, y, 1))
    labels += [(None, 1, 1), (1, None, 0), (0, 0, 0)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    held = [k for k in got if got[k].held_out]
    assert held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[k].predicted == (k % 4 == 0) for k in held]) > 0.9
    model = toxicity.train(d, y)
    assert toxicity.score_documents(docs, model).count() == docs.count()
    assert toxicity.reject(d, model).count() == sum(1 - r.predicted for r in got.values())


def brute_ratio(rows, word):
    """Kneser-Ney over all n-grams of rows (text, toxic), from its definition."""
    n, d, start = toxicity.ORDER, toxicity.DISCOUNT, chr(2)
    cut = lambda w: [(start * (n - 1) + w + chr(3))[i : i + n] for i in range(len(w) + 1)]
    counts = [defaultdict(int), defaultdict(int)]
    for text, y in rows:
        for g in (g for w in toxicity.words(text) for g in cut(w)):
            counts[y][g] += 1
    seen = set(counts[0]) | set(counts[1])
    parts = {k: {g[n - k :] for g in seen} for k in range(1, n + 1)}

    def backoff(part):
        if not part:
            return 1 / len(parts[1])
        ext = [x for x in parts[len(part) + 1] if x[1:-1] == part[:-1]]
        own, kinds = sum(x[1:] == part for x in ext), len({x[1:] for x in ext})
        return max(own - d, 0) / len(ext) + d * kinds / len(ext) * backoff(part[1:])

    out = 0
    for g in cut(word):
        if not any(x[:-1] == g[:-1] for x in seen):
            continue
        p = []
        for c in counts:
            inside = [v for x, v in c.items() if x[:-1] == g[:-1]]
            left = max(1 - sum(max(v - d, 0) for v in inside) / sum(inside), 1e-6) if inside else 1.0
            p.append((max(c.get(g, 0) - d, 0) / sum(inside) if inside else 0, left))
        (o, lo), (t, lt) = p
        shared = backoff(g[1:]) if g in seen else 1.0
        out += np.log(t + lt * shared) - np.log(o + lo * shared) if g in seen else np.log(lt) - np.log(lo)
    return np.log1p(toxicity.SHARE * np.expm1(min(out, 50)))


def test_toxicity_keeps_every_gram(spark, monkeypatch):
    common = "river water " * 30_000  # above 2^18 characters, where a share of the total would be more than one occurrence
    texts = [(common, 0), ("a rare zebra sits", 0), ("a rare quagga sits nearby", 1), ("", 0)]
    ids = [k for k in range(200) if 0 < zlib.crc32(str(k).encode()) % 5 < 4][: len(texts)]
    d = spark.createDataFrame([(k, t) for k, (t, _) in zip(ids, texts, strict=True)], "doc_id long, text string")
    y = spark.createDataFrame([(k, y) for k, (_, y) in zip(ids, texts, strict=True)], "doc_id long, toxic int")
    words = ["zebra", "quagga", "river", "qzz", "sits", "zebu"]
    want = [brute_ratio(texts, w) for w in words]
    model = toxicity.train(d, y)
    assert np.allclose(model.ratios(words), want)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    joined = toxicity.train(d, y)
    got = {r.word: r.ratio for r in joined.ratios(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert np.allclose([got[w] for w in words], want)


def test_toxicity_by_joins_is_the_same(spark, docs, monkeypatch):
    d = spark.createDataFrame([(k, f"some ordinary words {'nasty' if k % 4 == 0 else 'kind'} {WORDS[k]} end") for k in range(300)], "doc_id long, text string")
    y = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    both = d.unionByName(docs.select("doc_id", "text"))
    want, kept = toxicity.toxicity(both, y).collect(), toxicity.reject(docs, toxicity.train(d, y)).collect()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    got, joined = toxicity.toxicity(both, y).collect(), toxicity.reject(docs, toxicity.train(d, y))
    key = lambda r: (str(r.doc_id), round(r.score, 6))
    assert [(*key(r), r.predicted) for r in sorted(got, key=key)] == [(*key(r), r.predicted) for r in sorted(want, key=key)]
    assert joined.columns == docs.columns and sorted(map(str, joined.collect())) == sorted(map(str, kept))


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    rows_ = [(k, " ".join(["12345" if k % 3 == 0 else "word"] * int(rng.integers(5, 60)))) for k in range(300)] + [(None, None), (5000, "")]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    y = spark.createDataFrame([(k, "low" if k % 3 == 0 else "high") for k in range(100)] + [(None, "low")], "doc_id long, domain string")
    m, _ = mixing.fit(mixing.features_of(d), y, {"high": 0.9, "low": 0.1})
    assert np.allclose(m.totals, m.targets, rtol=1e-5)
    out = mixing.mixed(d, y, {"high": 0.9, "low": 0.1}).collect()
    expected = [sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in out) for x in ("high", "low")]
    assert np.allclose(expected, m.targets, rtol=1e-3) and all(r.rate >= 0 for r in out)
    more = mixing.resampled(d, y, {"high": 0.9, "low": 0.1}, least=1.0)
    assert more.columns == d.columns and more.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_mixing_counts_words(spark, docs):
    texts = [r.text for r in docs.collect()] + ["a  b", "a\n\n\nb", "   ", "a\x0bb\x0cc", " a "]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r._tokens for r in mixing.with_features(d).select("doc_id", "_tokens").collect()}
    assert got == {k: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for k, t in enumerate(texts)}


def test_mixing_shifts_and_reports(spark):
    import corpus_pipeline
    from drovekit.llm import queries

    assert queries.MIX == corpus_pipeline.MIX == {"high": 0.9, "low": 0.1}
    rng = np.random.default_rng(3)
    texts = [" ".join(["12345" if rng.random() < (0.6 if k % 3 == 0 else 0.3) else "word" for _ in range(int(rng.integers(5, 60)))]) for k in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    y = spark.createDataFrame([(k, "low" if k % 3 == 0 else "high") for k in range(300)], "doc_id long, domain string")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        m, _ = mixing.fit(mixing.features_of(d), y, {"high": 0.8, "low": 0.2})
        up, _ = mixing.fit(mixing.features_of(d), y, {"high": 0.7, "low": 0.3}, least=1.0)
    assert up.met and sum(up.targets) > sum(m.targets)
    assert np.abs(np.subtract(m.totals, m.targets)).max() <= 1e-6 * sum(m.targets)
    with pytest.warns(UserWarning, match="misses its targets after 2 rounds"):
        assert not mixing.fit(mixing.features_of(d), y, {"high": 0.01, "low": 0.99}, least=1.0, rounds=2)[0].met


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (0.8, 0.1, 0.1), (0.05, 0.15, 0.8), (0.34, 0.33, 0.33)])
def test_rates_are_the_least_squares(spark, weights):
    """Against all choices of rates at the bound: the feasible rates nearest to 1 that meet the targets."""
    from itertools import product

    rng = np.random.default_rng(9)
    p, t = rng.dirichlet([0.4] * 3, 9), rng.integers(1, 50, 9).astype(float)
    vectors = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(t, p)], "_tokens double, _p0 double, _p1 double, _p2 double")
    m = mixing.Mixer(["a", "b", "c"], np.zeros((3, 1)))
    mixing.match(m, vectors, dict(zip("abc", weights)))
    got = np.maximum(1 - p @ np.array(m.multipliers), 0)
    goal, a, best = t.sum() * np.array(weights), (p * t[:, None]).T, None
    for free in product((False, True), repeat=len(t)):
        f = np.flatnonzero(free)
        if len(f) < 3:
            continue
        gram = (a[:, f] / t[f]) @ a[:, f].T
        if np.linalg.cond(gram) > 1e10:
            continue
        r = np.zeros(len(t))
        r[f] = 1 - p[f] @ np.linalg.solve(gram, a[:, f].sum(axis=1) - goal)
        if r.min() >= -1e-9 and (best is None or t @ (r - 1) ** 2 < best[0]):
            best = t @ (r - 1) ** 2, r
    assert m.met and np.allclose(got, best[1], atol=1e-4)


def test_domains_of_unseen_rows(spark):
    """Held-out log-loss of the posteriors, against that of the domains' shares (0.38)."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    y = mixing.of_quality(labels).withColumn("out", toxicity.fold() == 0)
    features = mixing.features_of(d)
    m = mixing.Mixer(["high", "low"], mixing.train(features, y.filter("not out").select("doc_id", "domain"), ["high", "low"]))
    got = m.posteriors(features).join(y.filter("out"), "doc_id").select("_p0", "_p1", "domain").collect()
    assert len(got) > 500
    assert np.mean([-np.log(max(r._p0 if r.domain == "high" else r._p1, 1e-9)) for r in got]) < 0.12


def test_empty_tables(spark, none):
    y = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.keep_first(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert media.media_columns(none).count() == 0
    assert token_store.token_ids(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert toxicity.toxicity(none, y).count() == 0
    assert pieces.encode(none, pieces.load(public_tokenizers.path("piece_bpe_32k.model"))).count() == 0
    assert mixing.mixed(none, mixing.of_quality(y), {"high": 1.0, "low": 1.0}).count() == 0
    assert mixing.resampled(none, mixing.of_quality(y), {"high": 1.0, "low": 1.0}).count() == 0
