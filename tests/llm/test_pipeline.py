"""The pipeline on a small folder: each stage's rows against a brute-force version, then the whole run."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from drovekit.llm import mixing, toxicity  # noqa: E402
from drovekit.llm.common import cut, table  # noqa: E402

from test_text_operators import SCHEMA, brute, brute_ratio  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = np.random.default_rng(5), str(tmp_path_factory.mktemp("tables"))
    words = ["".join("bcdfglmnprst"[c] + "aeiou"[v] for c, v in zip(rng.integers(0, 12, 3), rng.integers(0, 5, 3), strict=True)) for _ in range(60)]
    texts, labels = [], []
    for k in range(240):
        text = [words[i] for i in rng.integers(0, 60, 30)]
        if k % 4 == 1:
            text[::3] = [f"{x}" for x in rng.integers(100, 999, 10)]
        if k % 6 == 0:
            text[4] = text[17] = text[25] = "zzyqx"
        texts.append(" ".join(text))
        labels.append((k, int(k % 4 != 1), int(k % 6 == 0)))
    clean = [t for k, t in enumerate(texts) if k % 6]
    texts += [t.replace(" ", "\n ", 3) for t in clean[:20]] * 2  # equal but for white space
    texts += [f"{t} {x}" for t in clean[20:40] for x in ("more", "more or", "less")]  # near copies
    texts += [None, "", " \t", "word", "x" * 30_000, "ünï 日本 𝕏"]
    rows = list(enumerate(texts)) + [(None, clean[0]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 5, "r", 6, "l") for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def counted(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def toxicity_left(spark, docs, folder):
    """Rows whose score, by Kneser-Ney from its definition and the fitted curve, is below a half."""
    y = {r.doc_id: r.toxic for r in table(spark, folder, "labels").filter("doc_id is not null and toxic is not null").collect()}
    rows = docs.collect()
    seen = [(r.text, y[r.doc_id]) for r in rows if r.text and r.doc_id in y and zlib.crc32(str(r.doc_id).encode()) % 5 in (1, 2, 3)]
    curve, ratio = toxicity.train(docs, table(spark, folder, "labels")).curve, {}
    left = Counter()
    for r in rows:
        found = toxicity.words(r.text or "")
        for w in found:
            if w not in ratio:
                ratio[w] = brute_ratio(seen, w) if len(w) < 1000 else 0.0
        if any(len(w) >= 1000 for w in found):
            continue
        d = sum(ratio[w] for w in found) / max(len(found), 1)
        left[r.doc_id, r.text] += int(toxicity.on_curve(curve, np.array([d]), np.array([len(found)]))[0] < 0.5)
    return +left, y


def test_toxic_documents_go(spark, folder):
    docs = table(spark, folder, "documents")
    out = STAGES["toxicity"](spark, docs, folder)
    want, y = toxicity_left(spark, docs, folder)
    got = Counter({k: n for k, n in counted(out.collect()).items() if len(k[1] or "") < 1000})
    assert out.columns == docs.columns and got == want
    assert {i for i, _ in want if y.get(i) == 0} == {i for i, v in y.items() if v == 0}  # clean ones stay
    assert not any(y.get(i) for i, _ in want)


def test_copies_go(spark, folder):
    docs = table(spark, folder, "documents")
    out = STAGES["exact_dedup"](spark, docs, folder)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append((r.doc_id, r.text))
    want = Counter()
    for members in groups.values():
        want.update([m for m in members if m[0] is None] + [min((m for m in members if m[0] is not None), key=lambda m: m[0])])
    assert out.columns == docs.columns and counted(out.collect()) == want and sum(want.values()) < docs.count()


def test_near_copies_go(spark, folder):
    docs = table(spark, folder, "documents")
    out = STAGES["near_dedup"](spark, docs, folder)
    keep = {i for i, _, c in brute(docs.collect(), 5, 80) if i == c}
    want = Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id in keep)
    assert out.columns == docs.columns and counted(out.collect()) == want and sum(want.values()) < docs.count()


def test_the_mix_has_its_weights(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = STAGES["mixing"](spark, docs, folder)
    rates = mixing.mixed(docs, mixing.of_quality(labels), corpus_pipeline.MIX, least=corpus_pipeline.LEAST_RATE).collect()
    expected = [sum(r.rate * r.n_tokens * r[f"p_{x}"] for r in rates) for x in corpus_pipeline.MIX]
    assert np.allclose(np.array(expected) / sum(expected), list(corpus_pipeline.MIX.values()), atol=1e-4)
    got, had = counted(out.collect()), counted(docs.collect())
    assert out.columns == docs.columns and set(got) == set(had) and sum(got.values()) > sum(had.values())
    rate = {r.doc_id: r.rate for r in rates if r.doc_id is not None}
    assert all(np.floor(rate[k[0]] + 1e-9) <= n <= np.ceil(rate[k[0]] - 1e-9) for k, n in got.items() if k[0] is not None)


def test_the_run_is_its_stages(spark, folder):
    import sentencepiece

    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, folder), f"test-{name}")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r.doc_id, tuple(lib.encode(r.text or "", num_threads=1))) for r in before.collect())
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want and all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_nothing(spark, folder, name, tmp_path):
    docs = table(spark, folder, "documents").limit(0)
    assert STAGES[name](spark, docs, folder).count() == 0
