"""Prefix trie, filter audit and licence scan against brute-force versions, on small fixtures and their SQL."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from drovekit.functions import placement  # noqa: E402
from drovekit.llm import filter_audit, licences, prefix_trie, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth int, a string, place long, path string"
DOCS = "doc_id long, text string, lang string, part string, mask int, n long, sha string"


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), digest, role, text))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        built[c] = convs.get(base, [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))

    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        sums[node] = (sum(sums[k][0] for k in kids[node]) or 1, own + sum(sums[k][1] for k in kids[node]))
        ids = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids[node]), *sums[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*TRIE).collect()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS).repartition(3)


def random_turns(seed, convs, most, words):
    rng = np.random.default_rng(seed)
    rows = []
    for c in convs:
        for k in range(int(rng.integers(1, most))):
            rows.append((int(c), None if rng.random() < 0.1 else int(rng.integers(0, most)), None if rng.random() < 0.1 else "u", None if rng.random() < 0.1 else str(rng.choice(words))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_brute_force(spark, seed):
    # ties of turns, null turns, roles and texts, repeated rows, negative ids, absent bases
    rows = random_turns(seed, [*range(0, 12), *range(100, 130), *range(203, 240), -5, -100, -101, 9_007_199_254_740_993], 9, ["a", "ü日", "", "b c"])
    rows += [(None, 1, "u", "lost"), (100, 0, "u", "a"), (100, 0, "u", "a")]
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_long_conversations_and_hot_nodes(spark):
    # one conversation of more turns than a block of blocks, and many that are equal, in small blocks
    long_ones = [(c, k, "u", "t" if c < 2 or k < 40 else f"{k}") for c in range(3) for k in range(120)]
    rows = long_ones + [(c, k, "u", "same") for c in range(300, 700) for k in range(3)]
    turns, members = prefix_trie.rebuilt(prefix_trie.ordered(conversations(spark, rows)))
    was = placement.BLOCK
    try:
        prefix_trie.running.__defaults__ = (None, 4)
        nodes, _ = prefix_trie.trie(turns, members)
        chain = prefix_trie.chains(turns, members)
        shas = prefix_trie.ends_sha256(prefix_trie.ends(chain, members, bits=3))
        empty = hashlib.sha256(b"").hexdigest()
        got = nodes.join(shas, prefix_trie.NODE, "left").na.fill(empty, ["ends_sha256"])
        assert trie_rows(got) == brute_trie(rows)
    finally:
        prefix_trie.running.__defaults__ = (None, was)


def test_trie_of_few_rows(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []
    alone = [(c, 0, "u", "x") for c in (301, 302, 303, 304, 305)]  # no base: some have no turn left
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, alone))) == brute_trie(alone)
    bare = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 >= 1)
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, [(bare, 0, "u", "x" * 300_000)]))) == brute_trie([(bare, 0, "u", "x")])


def brute_audit(docs, labels):
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1 and d is not None} for k in (0, 1))
    masks = []
    for d, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)}
        masks.append((d, lang or "", {f for f, x in fails.items() if x}))
    out = []
    for part in {p for _, p, _ in masks}:
        mine = [(d, m) for d, p, m in masks if p == part]
        rows, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                removed = [(d, m) for d, m in left if f in m]
                left = [(d, m) for d, m in left if f not in m]
                shapley[f] += len(removed)
                redundant = sum(f in m for _, m in mine) - len(removed)
                rows.append((part, "".join(order), k + 1, len(left), len(removed), redundant, sum(m == {f} for _, m in mine), sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_is_brute_force(spark):
    rng = np.random.default_rng(2)
    long_one = " ".join(f"w{i}" for i in range(250))
    pool = [None, "", " \t\n", "ABC abc", "x # y", long_one, long_one + " $", "same " * 300, ("same " * 300).strip(), "Ä " * 220, "A" * 300_000, "\x1c\x1d word", "a\x0bb\x85c"]
    docs = [(int(i), pool[int(rng.integers(0, len(pool)))], [None, "en", "", "fr"][int(rng.integers(0, 4))]) for i in rng.integers(0, 90, 120)]
    docs += [(None, long_one, "en"), (None, long_one, "en"), (3, long_one, "en"), (3, long_one, "en")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 90, 60)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    got = filter_audit.audit(spark.createDataFrame([(*d, "p", 7, 8, "s") for d in docs], DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
    bare = filter_audit.audit(spark.createDataFrame([(*d, "p", 7, 8, "s") for d in docs], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in bare.collect()) == brute_audit(docs, [])


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_filter_audit"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want.select(*cols).fetchall()))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_scan(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    hits = [(i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), sorted({x for _, x in hits}), words


def brute_quotes(words, weight, share=0.8, slack=2):
    """Every template at every alignment."""
    out = {}
    for label, text, must in licences.TEMPLATES:
        run = text.split()
        total = sum(weight[w] for w in run)
        for s in range(-len(run) - slack, len(words) + slack):
            near = lambda p: words[max(0, s + p - slack) : max(0, s + p + slack + 1)]  # noqa: E731, B023
            score = sum(weight[w] for p, w in enumerate(run) if w in near(p)) / total
            part = words[max(0, s - slack) : max(0, s + len(run) + slack)]
            whole = all(any(part[i : i + len(m.split())] == m.split() for i in range(len(part))) for m in must)
            if score >= share - 1e-12 and whole:
                out[label] = max(out.get(label, 0), score)
    return out


def test_licences_are_brute_force(spark):
    rng = np.random.default_rng(3)
    names = sorted({w for _, t, _ in licences.TEMPLATES for w in t.split()} | {"filler", "日本", "x2"})
    texts = [None, "", " .,;", "MIT License", "mit-license", "mıt license", "MIT\nLicense MIT license", "mit licenses", "The Apache License, Version 2.0", "GNU General\x00Public License", "lIcensed under CC BY-NC 4.0.", "é" * 200_000, "word " * 50_000 + "General Public License"]
    for _, t, _ in licences.TEMPLATES:
        run = t.split()
        for edits in (0, 1, 3):
            words = list(run)
            for k in rng.choice(len(words), min(edits, len(words)), replace=False):
                words[k] = str(rng.choice(names))
            if edits == 3:
                words.insert(int(rng.integers(0, len(words))), "odd")
            texts.append(f"some text. {' '.join(words).upper()}; more")
    texts += [" ".join(rng.choice(names, 60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "MIT License"), (3, "MIT License"), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "p", 1, 2, "s") for i, t in rows], DOCS).repartition(3)
    got = sorted(map(str, (tuple(r) for r in df.transform(licences.scan).collect())))
    known = {w for p in licences.BASE for w in p.split()} | {w for _, t, must in licences.TEMPLATES for x in (t, *must) for w in x.split()}
    found = [(i, brute_scan(t)) for i, t in rows]
    weight = {w: np.log((2.0 + len(rows)) / (1.0 + sum(w in f[5] for _, f in found))) for w in known}
    want = []
    for i, (n, places, first, last, own, words) in found:
        quotes = brute_quotes(words, weight) if n < 1000 or "general" in words else {}
        score = float(max([0.5 if own else 0.0, *(min(1.0, s) for s in quotes.values())]))
        want.append((i, n, places, first, last, ",".join(own), ",".join(sorted({*own, *quotes})), score))
    strip = lambda r: re.sub(r"[0-9.]+\)$", lambda m: f"{float(m[0][:-1]):.9f})", r)
    assert [strip(r) for r in got] == sorted(strip(str(r)) for r in want)
    assert any("gpl-3.0" in r for r in got) and any("cc-by-nc-4.0" in r for r in got)
    assert licences.scan(spark.createDataFrame([], DOCS)).collect() == []


def test_broadcasts_are_measured(spark, monkeypatch):
    from drovekit.llm import common

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    rows = spark.createDataFrame([(1, "x" * 100, [1, 2]), (2, None, None)], "a int, b string, c array<int>")
    assert hinted(common.measured(rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 50)
    assert not hinted(common.measured(rows)) and hinted(common.measured(rows.select("a")))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert not hinted(common.measured(rows.select("a")))
