"""Defined results of the training-data operators, against brute force."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from starweft.llm import bpe, components, encode, leak, mixture, neighbours, split

VOCAB = encode.VOCABULARY
has_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files")


@pytest.fixture(scope="module")
def v():
    return bpe.loaded(encode.vocabulary_bytes(VOCAB))


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = [None, "", "   ", " \n\t ", "plain words, here.", "it's we'll 'sx ''re", "<|endoftext|> x", "é́ 日本語。テスト", " 　 x", "a" * 9000, "12345" * 900, " " * 5000 + "b", "🙂🙃" * 300, "x\r\n\r\ny", "ﬁ½Ⅷ", "A" * 700 + "  " + "!?" * 600, "\x00\x01 z"]


@has_vocab
def test_encoding_equals_the_library(v):
    lib = library()
    for t in TEXTS:
        assert encode.encode_text(v, t) == (lib(t) if t else [])
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choice(["word ", "é", "日本", "  ", "\n", "9", "aaaa", "'re", "!?", "\t", "Zq"]) for _ in range(r.randint(0, 400)))
        want, e, out, at = lib(t), bpe.StreamingEncoder(v), [], 0
        while at < len(t):
            n = r.choice([1, 2, 7, 300])
            out += e.feed(t[at : at + n])
            at += n
        assert out + e.finish() == want == v.run(t)
        d = bpe.Decoder(v)
        assert "".join(d.feed([i]) for i in want) + d.finish() == t


@has_vocab
def test_very_long_texts_take_the_same_path(v):
    """Above a million characters: mixed text, one unbroken run, blanks; equal to the library and to small pieces."""
    lib, r = library(), random.Random(6)
    mixed = " ".join(r.choice(["word", "naïve", "日本語。", "x\n\ny", "12", "!?", "  ", "\t", "'re", "\x1c", "\u3000"]) for _ in range(300_000))
    for t in (mixed, "ab" * 600_000, "x" + " " * 3000 + "y " * 520_000):
        assert len(t) > 1_000_000
        assert encode.encode_text(v, t) == lib(t)


@has_vocab
def test_lookahead_comes_from_the_merges(v):
    assert v.lookahead == max(len(v.token[r]) for r in v.built) - 1
    tiny = bpe.Vocabulary(b"\n".join(__import__("base64").b64encode(t) + b" %d" % i for i, t in enumerate([b"a", b"b", b"c", b"ab", b"abcabc"])))
    assert tiny.lookahead == 1 and 4 not in tiny.built  # nothing merges into the longest token


@has_vocab
def test_neighbouring_tokens_against_plain_merging(v):
    r = random.Random(8)
    built = list(v.built)
    common = [v.run(w)[0] for w in "a b aa ab the then ing in n ' ! !! 0 00 000 é 日".split()]
    for _ in range(20_000):
        a, b = (r.choice(common if r.random() < 0.3 else built[: r.choice([300, 3000, 50_000])]) for _ in range(2))
        assert v.may_follow(a, b) == (v.merged(v.token[a] + v.token[b]) == [a, b])


@has_vocab
def test_constant_memory_in_an_unbroken_run(v):
    e, most, n = bpe.StreamingEncoder(v), 0, 0
    for k in range(300):
        n += len(e.feed("abcdefghij"[k % 7 :] * 40))
        most = max(most, len(e.held) + (len(e.open[0].tail) if e.open else 0))
    assert most < 8000 and n > 1000


@has_vocab
def test_encode_and_decode_tables(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (4, "repeated", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode.encode(df)
    assert out.count() == len(rows) and out.filter("ids is null").count() == 0
    back = {(r["doc_id"], r["text"]) for r in encode.decode(out).collect()}
    assert back == {(a, b or "") for a, b, _ in rows}
    assert encode.encode(df.limit(0)).count() == 0


@has_vocab
def test_pieces(spark, v):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["alpha", "beta.", "gamma\n", "delta"]) for _ in range(3000)), "x" * 20000, "。".join(["日本語のテキスト"] * 400)]
    df = spark.createDataFrame([(i % 10, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = split.pieces(df, limit=64, overlap=8).collect()
    want = []
    for t in texts:
        if not t:
            continue
        _, ids, places, kinds = split.cut_points(v, t, 56)
        cuts = [8] if len(ids) > 64 else [len(ids)]
        starts = [] if len(ids) > 64 else [(0, len(ids))]
        while len(ids) > 64 and cuts[-1] < len(ids):
            e = cuts[-1]
            near = [(k, p) for p, k in zip(places, kinds) if e < p <= e + 56]
            cuts.append(max(p for k, p in near if k == max(x for x, _ in near)) if near else min(e + 56, len(ids)))
            starts.append((e - 8, cuts[-1]))
        want += [tuple(ids[a:b]) for a, b in starts]
    assert sorted(tuple(x["ids"]) for x in got) == sorted(want)
    assert all(x["stop"] - x["start"] <= 64 for x in got)
    assert split.pieces(df.limit(0)).count() == 0


def test_leaks(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 8, 15, 40]))), " ".join(r.choice(words) for _ in range(r.choice([2, 20])))) for i in range(25)] + [(90, None, None), (91, "", "..."), (None, "w1 w2", "w3")]
    docs = []
    for d in range(150):
        w = [r.choice(words) for _ in range(30)]
        i = r.choice(items[:25])
        src = (i[1] if r.random() < 0.6 else i[2]).split()
        a = r.randint(0, max(0, len(src) - 3))
        w[10:10] = src[a : a + r.choice([5, 11, 12, 13, 50])]
        docs.append((d, r.choice([" ", "  ", ", ", "\n"]).join(w).upper()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, " ".join(["w1"] * 5000))]
    want = set()
    for d, t in docs:
        w = leak.words_of(t)
        for i, p, a in items:
            for part, s in enumerate((p, a)):
                s = leak.words_of(s)
                n = 12 if len(s) >= 12 else len(s) if part == 0 else 0
                grams = {tuple(s[k : k + n]) for k in range(len(s) - n + 1)} if n else set()
                if d is not None and i is not None and any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                    want.add((d, i))
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, prompt string, answer string")
    for size, chars in ((50, 10**7), (100_000, 10**7), (100_000, 700)):
        found = leak.leaks(D, I, shard_words=size, block_chars=chars)
        assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want
    texts = {d: leak.words_of(t) for d, t in docs}
    by_item = {i: [leak.words_of(p), leak.words_of(a)] for i, p, a in items}
    for x in found.collect():
        grams = {tuple(texts[x["doc_id"]][k : k + x["matched_words"]]) for k in range(len(texts[x["doc_id"]]))}
        longer = {tuple(texts[x["doc_id"]][k : k + x["matched_words"] + 1]) for k in range(len(texts[x["doc_id"]]))}
        parts = [(s, k) for s in by_item[x["item_id"]] for k in range(len(s))]
        assert any(tuple(s[k : k + x["matched_words"]]) in grams for s, k in parts)
        assert not any(tuple(s[k : k + x["matched_words"] + 1]) in longer for s, k in parts if k + x["matched_words"] < len(s) and len(s) >= 12)
    named = leak.leaks(D.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), I)
    assert {(x["doc_id"], x["item_id"]) for x in named.collect()} == {(f"d{d}", i) for d, i in want}
    assert leak.leaks(D.limit(0), I).count() == leak.leaks(D, I.limit(0)).count() == 0
    # the one without an id leaks its own item too
    assert leak.without_leaks(D, I).count() == len(docs) - len({d for d, _ in want}) - 1


def test_components(spark):
    r = random.Random(3)
    links = [(f"n{r.randint(0, 400)}", f"n{r.randint(0, 400)}") for _ in range(260)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(120)] + [("hub", f"s{k}") for k in range(300)]
    links += links[:20] + [(b, a) for a, b in links[:20]] + [("self", "self"), (None, "x"), ("y", None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            parent[root(a)] = root(b)
    by = {}
    for x in list(parent):
        by.setdefault(root(x), []).append(x)
    want = {(min(g), x) for g in by.values() for x in g}
    got = [tuple(x) for x in components.groups(spark.createDataFrame(links, "a string, b string")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert components.groups(spark.createDataFrame([(None, "a"), ("b", "b")], "a string, b string")).count() == 0


@pytest.mark.parametrize("lookups", [neighbours.PROBE_ROWS, 0])
def test_neighbours(spark, monkeypatch, lookups):
    monkeypatch.setattr(neighbours, "PROBE_ROWS", lookups)  # by tasks, by joins
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(600, 3)), 0.001 * rng.normal(size=(600, 3)) + 1, np.repeat(rng.normal(size=(1, 3)), 60, axis=0)])
    rows = [(i, *map(float, p), 1) for i, p in enumerate(x)] + [(5000, None, 0.0, 0.0, 1), (5001, float("nan"), 0.0, 0.0, 1), (None, 0.0, 0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "vid long, a double, b double, c double, id int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:5]
        want[i] = order
    got = {}
    for r in neighbours.most_similar(df, "vid", ["a", "b", "c"], 5).collect():
        got.setdefault(r["probe_id"], []).append((r["distance"], r["id"]))
    assert {k: [j for _, j in sorted(g)] for k, g in got.items()} == want
    few = df.filter("vid < 3")
    asked = spark.createDataFrame([(7, 1), (8, 999), (None, 1)], "probe_id long, id long")
    assert sorted((r["probe_id"], r["id"]) for r in neighbours.most_similar(few, "vid", ["a", "b", "c"], 5, asked).collect()) == [(7, 0), (7, 2)]
    twice = asked.filter("probe_id = 7").unionByName(asked.filter("probe_id = 7")).unionByName(spark.createDataFrame([(7, 2)], "probe_id long, id long"))
    assert sorted(r["id"] for r in neighbours.most_similar(few, "vid", ["a", "b", "c"], 5, twice).collect()) == [0, 0, 0, 1, 2, 2]
    assert neighbours.most_similar(df.limit(0), "vid", ["a", "b", "c"], 5, asked).count() == 0
    assert neighbours.most_similar(df, "vid", ["a", "b", "c"], 5, asked.limit(0)).count() == 0


def test_approximate_neighbours_have_high_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2)) @ rng.normal(size=(2, 16)) + 0.02 * rng.normal(size=(1500, 16))
    cols = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    asked = df.filter("id % 50 = 0").select(F.col("id").alias("probe_id"), "id")
    got = {(r["probe_id"], r["id"]) for r in neighbours.most_similar(df, "id", cols, 10, asked, axes=4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {(i, j) for i in range(0, 1500, 50) for j in np.argsort(d[i])[1:11].tolist()}
    assert len(got & want) / len(want) >= 0.9


def test_mixture_groups(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows, want, n = [], set(), 0
    for g in range(60):
        c = r.normal(size=3)
        c /= np.linalg.norm(c)
        if g < 30:  # many in one small region
            c = np.array([1.0, 0, 0]) + 0.003 * r.normal(size=3)
            c /= np.linalg.norm(c)
        size = int(r.integers(2, 30))
        ids = list(range(n, n + size))
        n += size
        for i in ids:
            p = c + r.uniform(-1, 1, size=3) * 3.4e-5 / 4
            rows.append(("s", i, *map(float, p)))
        if size >= 4:
            want |= {("s", ids[0], i) for i in ids}
    p = rows[-1]
    rows += [("t", 10_000 + k, *p[2:]) for k in range(40)] + [("t", None, 0.0, 0.0, 1.0), ("t", -4, 0.0, 0.0, 1.0), (None, 1, 0.0, 0.0, 1.0), ("t", 5, None, 0.0, 1.0)]
    want |= {("t", 10_000, 10_000 + k) for k in range(40)}
    df = spark.createDataFrame([(*x, 0) for x in rows], "scope string, id long, x double, y double, z double, rank int")
    for full in (mixture.FULL_BLOCK, 50):
        monkeypatch.setattr(mixture, "FULL_BLOCK", full)
        got = mixture.similarity_groups(df, 3.4e-5)
        assert {(x["scope"], x["group_id"], x["id"]) for x in got.collect()} == want
    about = mixture.described(got).filter("scope = 't'").first()
    assert about["size"] == 40 and len(about["typical"]) == 3
    assert mixture.similarity_groups(df.limit(0), 3.4e-5).count() == 0


def test_information_criterion_separates_two_blobs():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=(60, 2)) * 0.05 - 1, r.normal(size=(60, 2)) * 0.05 + 1])
    comp, dens = mixture.fit_mixtures(np.zeros(120, np.int64), x, np.ones(120))
    assert len(set(comp[:60])) == len(set(comp[60:])) == 1 and comp[0] != comp[-1] and np.isfinite(dens).all()


def test_components_are_checked_without_a_graph_of_pairs(monkeypatch):
    """Groups in touching cells come from the mixture's components; pairs are listed only where components settle nothing."""
    r = np.random.default_rng(5)
    centres = np.array([[1.0, 0.0, 0.0]]) + np.array([[0, a, b] for a in range(4) for b in range(3)]) * 1.6
    p = np.concatenate([c + r.uniform(-0.12, 0.12, size=(12, 3)) for c in centres])
    n = len(p)
    args = np.zeros(n, np.int64), np.floor(p).astype(np.int64) + 5, p, np.arange(n), np.ones(n), np.ones(n, bool), 1.0, 4
    want = {(k // 12 * 12, k) for k in range(n)}

    def listed(*_):
        raise AssertionError("points were compared one by one")

    cut = mixture.cut_sets
    monkeypatch.setattr(mixture, "cut_sets", listed)
    found, _ = mixture.find_groups(*args)
    assert set(zip(found["group_id"], found["row"])) == want
    # where the information criterion finds one component only, the check has it fitted again
    fit, calls = mixture.fit_mixtures, []

    def one_at_first(seg, x, w, fewest=1):
        calls.append(fewest)
        comp, dens = fit(seg, x, w, fewest)
        return (comp, dens) if fewest > 1 else (np.zeros(len(seg), np.int64), dens)

    monkeypatch.setattr(mixture, "fit_mixtures", one_at_first)
    found, _ = mixture.find_groups(*args)
    assert set(zip(found["group_id"], found["row"])) == want and 2 in calls
    monkeypatch.setattr(mixture, "cut_sets", cut)


def test_a_dense_spot_is_cut_into_groups_that_hold():
    """50,000 distinct points in a spot of 30 radii: every group is mutually similar, no point is in two, none is left that
    could make another."""
    r = np.random.default_rng(11)
    p = r.normal(size=(50_000, 3)) * [8, 8, 1e-3]
    started = time.time()
    found = mixture.cut_neighbourhood(p, np.arange(len(p)), np.ones(len(p)), 1.0, 4)
    assert found["row"].is_unique and len(found) > 40_000 and time.time() - started < 300
    for _, g in found.groupby("group_id"):
        q = p[g["row"].to_numpy()]
        assert np.linalg.norm(q[:, None] - q[None], axis=2).max() <= 1.0


def test_a_long_chain_is_cut_alike_whatever_the_blocks(spark, monkeypatch):
    """Chains across block faces: equal groups at both block sizes and as one piece, no point in two groups."""
    radius = 3.4e-5
    rows, r = [], np.random.default_rng(8)
    for c, (y, z) in enumerate([(0.0, 0.0), (40.5, 3.1), (100.2, 63.9)]):
        for k in range(67):  # from -10 to 10 radii across a face at 0, and one along a face
            at = (-10 + 0.3 * k + 0.02 * r.normal(), y + 0.02 * r.normal(), z + 0.02 * r.normal())
            rows.append(("s", 100 * c + (k * 29) % 67, *(float(v * radius) for v in (at if c < 2 else (at[1], at[0], at[2])))))
    df = spark.createDataFrame(rows, "scope string, id long, x double, y double, z double")
    want = set()
    for c in range(3):
        one = [x for x in rows if x[1] // 100 == c]
        p, ids = np.array([x[2:] for x in one]), np.array([x[1] for x in one])
        found = mixture.cut_neighbourhood(p, ids, np.ones(len(ids)), radius, 4)
        want |= {(g, int(ids[k]), rank) for k, g, rank in zip(found["row"], found["group_id"], found["rank"])}
    for full in (mixture.FULL_BLOCK, 20):
        monkeypatch.setattr(mixture, "FULL_BLOCK", full)
        got = mixture.similarity_groups(df, radius).collect()
        assert len({x["id"] for x in got}) == len(got) > 100
        assert {(x["group_id"], x["id"], x["rank"]) for x in got} == want
