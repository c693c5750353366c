"""Toxicity by class-conditional Kneser-Ney models.

A word is a sequence of characters between start marks and an end mark. Each class (toxic,
ordinary) has a model of the next character after the last ``ORDER - 1``: its own discounted
counts, interpolated with one backoff model that both classes share and that Kneser-Ney
continuation counts over both make up. An expression that is rare in a class thus gets nearly the
shared probability, and the classes' ratio is near one. A toxic text is mostly ordinary: each of
its words is taken from the toxic model with probability SHARE, else from the ordinary one. A
document's two log-likelihoods are divided by its number of words and compared; a logistic curve
over that difference and the length, fitted on labelled rows which the counts haven't seen, gives
the score.

Counts cover every labelled row of the training folds, and every n-gram, context and continuation
that they hold is in the model: written tables, which grow with the input. Tables that were counted
and have at most MODEL_ROWS rows are sent to all executors; larger ones are joined with the n-grams
of the distinct words. Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, tidied
from .shingles import mix

ORDER = 6
DISCOUNT = 0.75
#: Share of the toxic model's own words in a toxic text.
SHARE = 0.03
#: A model of at most this many n-grams and contexts (16 bytes each) is sent to the executors.
MODEL_ROWS = 1 << 20
#: Texts that are turned into arrays at a time, in characters.
PIECE = 1 << 19
_WORD = regex.compile(r"[^\W\d_]+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x2545F4914F6CDD1D)]
_START, _END = 2, 3


def fold() -> Column:
    """0 to 4; labels of fold 0 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def words(text: str | None) -> list[str]:
    """Runs of letters of the whole text in lower case."""
    return _WORD.findall(text.lower()) if text else []


def distinct(docs: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """Each word's place among the distinct words of texts, and these."""
    coded = pa.array([w for d in docs for w in d], pa.string()).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def grams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word): ORDER code points up to each character of each word, the end mark included."""
    pad = chr(_START) * (ORDER - 1)
    flat = np.frombuffer("".join(f"{pad}{w}{chr(_END)}" for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) for w in vocabulary], np.int64)
    ends = np.cumsum(lengths + ORDER)
    word = np.repeat(np.arange(len(vocabulary)), lengths + 1)
    at = np.arange(len(word)) + (word + 1) * (ORDER - 1)
    assert not len(ends) or at[-1] == ends[-1] - 1
    return np.stack([flat[at - ORDER + 1 + j] for j in range(ORDER)]), word


def keys(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of columns of code points; the number of rows is part of the key."""
    out = np.full(codes.shape[1], len(codes), np.uint64)
    for row in codes:
        out = mix(out * _M[0] + row.astype(np.uint64) + _M[1])
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[str]]]]:
    texts, start, size, held = batch.column("text"), 0, 0, []
    for k in range(len(texts)):
        held.append(words(texts[k].as_py()))
        size += sum(map(len, held[-1])) + 1
        if size >= PIECE:
            yield start, k + 1, held
            start, size, held = k + 1, 0, []
    if held:
        yield start, len(texts), held


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) sums from rows (text, toxic): gram is a string of ORDER characters."""
    schema = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("ordinary", pa.int64())])

    def run(batches):
        for batch in batches:
            for i, j, docs in _pieces(batch):
                y = np.repeat(batch.column("toxic").slice(i, j - i).to_numpy(zero_copy_only=False), [len(d) for d in docs])
                if not len(y):
                    continue
                code, vocabulary = distinct(docs)
                per = [np.bincount(code[y == v], minlength=len(vocabulary)) for v in (1, 0)]
                codes, word = grams(vocabulary)
                _, at, inverse = np.unique(keys(codes), return_index=True, return_inverse=True)
                text = codes[:, at].T.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                sums = [np.bincount(inverse, p[word], len(at)).astype(np.int64) for p in per]
                yield pa.RecordBatch.from_arrays([pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)]), *map(pa.array, sums)], schema=schema)

    found = rows.select("text", "toxic").mapInArrow(tidied(run), "gram string, toxic long, ordinary long")
    return found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def tables(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts) with the log-ratio of the classes, from the counts of all n-grams, (gram, toxic, ordinary).

    A context's value is the ratio of what its classes leave to the backoff, which is that of all
    n-grams in it that no class has seen.
    """
    # each distinct suffix, and how many distinct extensions to the left it has
    suffixes = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("size"), F.substring("gram", 1 + ORDER - k, k).alias("part")) for k in range(2, ORDER + 1)))).alias("x")).select("x.*").distinct()
    kinds = suffixes.groupBy((F.col("size") - 1).alias("size"), F.expr("substring(part, 2)").alias("part")).agg(F.count("*").alias("n"))
    kinds = cut(kinds.withColumn("before", F.expr("substring(part, 1, size - 1)")), "continuations")
    before = kinds.groupBy("size", "before").agg(F.sum("n").alias("total"), F.count("*").alias("after"))
    own, rest = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total"), F.lit(DISCOUNT) * F.col("after") / F.col("total")
    levels = cut(kinds.join(before, ["size", "before"]).select("size", "part", own.alias("own"), rest.alias("rest"), "after"), "levels")
    level = lambda k: levels.filter(F.col("size") == k)
    shared = level(1).select("part", (F.col("own") + F.col("rest") / F.col("after")).alias("p"))
    for k in range(2, ORDER):
        shorter = shared.select(F.col("part").alias("end"), "p")
        shared = level(k).join(shorter, F.expr("substring(part, 2)") == F.col("end")).select("part", (F.col("own") + F.col("rest") * F.col("p")).alias("p"))
    taken = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    contexts = sums.groupBy(F.substring("gram", 1, ORDER - 1).alias("context")).agg(*(f(x).alias(f"{a}_{c}") for c in ("toxic", "ordinary") for a, f, x in (("total", F.sum, c), ("taken", F.sum, taken(c)))))
    left = lambda c: F.when(F.col(f"total_{c}") > 0, F.greatest(1 - F.col(f"taken_{c}") / F.col(f"total_{c}"), F.lit(1e-6))).otherwise(1.0)
    contexts = cut(contexts.select("context", *(x for c in ("toxic", "ordinary") for x in (F.col(f"total_{c}"), left(c).alias(f"left_{c}")))), "contexts")
    seen = lambda c: F.when(F.col(f"total_{c}") > 0, taken(c) / F.col(f"total_{c}")).otherwise(0.0) + F.col(f"left_{c}") * F.col("p")
    grams = sums.join(contexts, F.substring("gram", 1, ORDER - 1) == F.col("context")).join(shared, F.substring("gram", 2, ORDER - 1) == F.col("part"))
    grams = cut(grams.select("gram", (F.log(seen("toxic")) - F.log(seen("ordinary"))).alias("value")), "gram-values")
    return grams, contexts.select("context", (F.log("left_toxic") - F.log("left_ordinary")).alias("value"))


def in_toxic_texts(total: np.ndarray) -> np.ndarray:
    """A word's log-likelihood in a toxic text less that in an ordinary one, from that of the two models."""
    return np.log1p(SHARE * np.expm1(np.minimum(total, 50)))


class Model:
    """Log-ratios of the classes: by n-gram, else by context, else 0; held in arrays."""

    def __init__(self, gram: tuple[np.ndarray, np.ndarray], context: tuple[np.ndarray, np.ndarray], curve: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0)):
        self.gram, self.context, self.curve = gram, context, curve

    @classmethod
    def of_tables(cls, grams: DataFrame, contexts: DataFrame) -> Model:
        def keyed(size: int):
            def run(batches):
                for batch in batches:
                    text = "".join(batch.column(0).to_pylist())
                    key = keys(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).T)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), batch.column(1)], names=["key", "value"])

            return run

        held = []
        for df, size in ((grams, ORDER), (contexts, ORDER - 1)):
            rows = df.mapInArrow(keyed(size), "key long, value double").toArrow()  # 16 bytes a row
            key = rows.column("key").to_numpy().view(np.uint64)
            order = np.argsort(key)
            held.append((key[order], rows.column("value").to_numpy()[order]))
        return cls(*held)

    def ratios(self, vocabulary: list[str]) -> np.ndarray:
        """Each word's log-likelihood in a toxic text less that in an ordinary one."""
        codes, word = grams(vocabulary)
        if not len(word) or not len(self.gram[0]):
            return np.zeros(len(vocabulary))
        out = np.zeros(len(word))
        for (known, value), wanted in ((self.context, keys(codes[:-1])), (self.gram, keys(codes))):
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at] == wanted
            out[hit] = value[at[hit]]
        return in_toxic_texts(np.bincount(word, out, len(vocabulary)))

    def differences(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(difference of the length-normalised log-likelihoods, words) of each text; 0 and 0 if it has no words."""
        n = np.array([len(d) for d in docs])
        if not n.sum():
            return np.zeros(len(docs)), n
        code, vocabulary = distinct(docs)
        total = np.bincount(np.repeat(np.arange(len(docs)), n), self.ratios(vocabulary)[code], len(docs))
        return total / np.maximum(n, 1), n

    def score(self, difference: np.ndarray, n: np.ndarray) -> np.ndarray:
        return on_curve(self.curve, difference, n)


class Joined:
    """The same model, left in its tables: whatever it is asked goes through joins."""

    def __init__(self, grams: DataFrame, contexts: DataFrame):
        self.grams, self.contexts, self.curve = grams, contexts, (0.0, 1.0, 0.0, 0.0, 0.0)

    def ratios(self, found: DataFrame) -> DataFrame:
        """(word, ratio) of distinct words: each is cut into its n-grams, and each of these joined with the tables."""
        schema = pa.schema([("id", pa.int64()), ("gram", pa.string())])

        def run(batches):
            for batch in batches:
                vocabulary, ids, start, size = batch.column("word").to_pylist(), batch.column("id").to_numpy(), 0, 0
                for k, w in enumerate(vocabulary, 1):
                    size += len(w) + 1
                    if size >= PIECE // ORDER or k == len(vocabulary):
                        codes, word = grams(vocabulary[start:k])
                        text = codes.T.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                        yield pa.RecordBatch.from_arrays([pa.array(ids[start:k][word]), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())], schema=schema)
                        start, size = k, 0

        found = cut(found.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
        parts = found.mapInArrow(tidied(run), "id long, gram string")
        parts = parts.join(self.grams, "gram", "left").withColumn("context", F.substring("gram", 1, ORDER - 1))
        parts = parts.join(self.contexts.withColumnRenamed("value", "other"), "context", "left")
        total = F.sum(F.coalesce("value", "other", F.lit(0.0)))
        sums = parts.groupBy("id").agg(F.log1p(SHARE * F.expm1(F.least(total, F.lit(50.0)))).alias("ratio"))
        return found.join(sums, "id").select("word", "ratio")

    def measured(self, docs: DataFrame) -> DataFrame:
        """(digest, difference, n) of each distinct text; of texts without words none."""
        schema = pa.schema([("digest", pa.binary()), ("word", pa.string()), ("count", pa.int64()), ("n", pa.int64())])

        def run(batches):
            for batch in batches:
                for i, j, texts in _pieces(batch):
                    n = np.array([len(d) for d in texts])
                    if not n.sum():
                        continue
                    code, vocabulary = distinct(texts)
                    pair, count = np.unique(np.repeat(np.arange(len(texts)), n) * len(vocabulary) + code, return_counts=True)
                    row = pair // len(vocabulary)
                    yield pa.RecordBatch.from_arrays([batch.column("digest").slice(i, j - i).take(pa.array(row)), pa.array(vocabulary, pa.string()).take(pa.array(pair % len(vocabulary))), pa.array(count), pa.array(n[row])], schema=schema)

        pairs = cut(docs.filter("text is not null").select(digest("text").alias("digest"), "text").mapInArrow(tidied(run), "digest binary, word string, count long, n long"), "words")
        ratios = self.ratios(pairs.select("word").distinct())
        # rows of one text weigh alike in both sums
        return pairs.join(ratios, "word").groupBy("digest").agg((F.sum(F.col("count") * F.col("ratio")) / F.sum("count")).alias("difference"), F.max("n").alias("n"))

    def scores(self, docs: DataFrame) -> DataFrame:
        """(digest, score) of each distinct text with words."""
        curve = self.curve

        def run(batches):
            for batch in batches:
                d, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("difference", "n"))
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(on_curve(curve, d, n))], names=["digest", "score"])

        return self.measured(docs).mapInArrow(run, "digest binary, score double")

    def without_words(self) -> float:
        return float(on_curve(self.curve, np.zeros(1), np.zeros(1))[0])


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def features(difference: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve sees: a constant, the difference, it at two other scales, and the length's logarithm."""
    difference = np.clip(difference, -0.1, 1)
    total = np.maximum(difference * n, 0)
    return np.stack([np.ones(len(n)), difference * 10, np.sqrt(np.maximum(difference, 0)) * 10, np.log1p(total), np.log1p(n) / 10], axis=1)


def on_curve(curve: tuple[float, ...], difference: np.ndarray, n: np.ndarray) -> np.ndarray:
    z = features(difference, n) @ np.array(curve)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.05 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (0.05 + 1e-9) * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, b))


def held(checked: DataFrame, model: Model) -> DataFrame:
    """(d, n, y): the rounded difference and logarithm of the length of each row of (text, toxic)."""
    shared = checked.sparkSession.sparkContext.broadcast(model)

    def binned(batches):
        for batch in batches:
            for i, j, texts in _pieces(batch):
                d, n = shared.value.differences(texts)
                y = batch.column("toxic").slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(d, 4)), pa.array(np.round(np.log1p(n), 1)), pa.array(y.astype(np.int64))], names=["d", "n", "y"])

    return checked.mapInArrow(tidied(binned), "d double, n double, y long")


def train(docs: DataFrame, labels: DataFrame) -> Model | Joined:
    """Fit on all rows of labels but those of fold 0: counts on folds 1 to 3, the curve on fold 4.

    A doc_id that has several labels is toxic if one says so; null labels and ids don't count.
    """
    y = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.withColumn("fold", fold()).filter("fold != 0")
    y = y.select(F.col("doc_id").alias("_id"), "toxic", "fold")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string")).filter("text is not null").join(small(y), F.col("doc_id") == F.col("_id")).select("text", "toxic", "fold")
    grams, contexts = tables(cut(gram_counts(texts.filter("fold < 4")), "grams"))
    model = Model.of_tables(grams, contexts) if grams.count() + contexts.count() <= MODEL_ROWS else Joined(grams, contexts)
    checked = texts.filter("fold = 4").select("text", "toxic")
    if isinstance(model, Joined):
        checked = checked.withColumn("digest", digest("text"))
        d, n = (F.coalesce(c, F.lit(0.0)) for c in ("difference", "n"))
        seen = checked.select("digest", F.col("toxic").cast("long").alias("y")).join(model.measured(checked), "digest", "left").select(F.round(d, 4).alias("d"), F.round(F.log1p(n), 1).alias("n"), "y")
    else:
        seen = held(checked, model)

    # rounded: at most some thousand distinct rows reach the driver
    seen = seen.select(F.greatest(F.lit(-0.1), F.least(F.lit(1.0), "d")).alias("d"), "n", "y").groupBy("d", "n", "y").count().collect()
    d, n, y, count = np.array(seen, float).reshape(-1, 4).T
    if len(set(y)) == 2:
        model.curve = fit_curve(features(d, np.expm1(n)), y, count)
    else:
        model.curve = (-2.0, 1.0, 0.0, 0.0, 0.0)
    return model


def joined_scores(docs: DataFrame, model: Joined) -> DataFrame:
    """docs (_row, text) with score: a text's words are counted once, however many rows have it."""
    rows = docs.withColumn("_digest", digest("text"))
    scores = model.scores(docs.select("text")).select(F.col("digest").alias("_digest"), "score")
    return rows.join(scores, "_digest", "left").select("_row", F.coalesce("score", F.lit(model.without_words())).alias("score"))


def score_documents(docs: DataFrame, model: Model | Joined) -> DataFrame:
    """docs (doc_id, text) with score (0 to 1) and predicted (1 from 0.5 on); the text alone counts.

    Null, empty and wordless texts have no difference and get the curve's value for it. A null
    doc_id or repeated rows are scored like any others; other columns aren't read.
    """
    if isinstance(model, Joined):
        scored = joined_scores(docs.select(F.col("doc_id").cast("long").alias("_row"), F.col("text").cast("string")), model)
        return scored.select(F.col("_row").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, texts in _pieces(batch):
                s = shared.value.score(*shared.value.differences(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Empty tables give empty results."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model | Joined) -> DataFrame:
    """docs without those that the model predicts toxic, columns as they are; judged by its own text."""
    if isinstance(model, Joined):
        return joined_scores(docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text")), model).filter("score < 0.5").select("_row.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, texts in _pieces(batch):
                keep = shared.value.score(*shared.value.differences(texts)) < 0.5
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
