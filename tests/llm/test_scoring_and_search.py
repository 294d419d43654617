"""Language-model scores, hard negatives and spelling variants against brute force, with nulls, repeats, ties and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import attention, negatives, spans, variants
from quillstream.llm.shared import raw_texts

RANKS = P.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, word string, score double, uid long, n long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def grammar(rng, n):
    """Text with an order: each word follows from the one before."""
    after = {"sun": ["rises", "sets"], "rises": ["over"], "sets": ["over"], "over": ["hills", "seas"], "hills": ["and"], "seas": ["and"], "and": ["sun"]}
    out = [rng.choice(list(after))]
    while len(out) < n:
        out.append(rng.choice(after[out[-1]]))
    return " ".join(out)


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "x", 1.0, 2, 3) for k, t in texts], DOCS).repartition(3)


# --- language-model scores -------------------------------------------------------------------------------------------


def test_attention_scores(spark, monkeypatch):
    monkeypatch.setattr(attention, "HEAD", 4)  # other words take the join
    rng = random.Random(3)
    texts = [(k, grammar(rng, rng.randint(60, 140))) for k in range(120)]
    texts += [(200, None), (201, ""), (202, " \n\t"), (203, "Sun RISES Äpfel"), (203, "Sun RISES Äpfel"), (None, "sun rises"), (204, "long " * 5000), (205, "x" * 4000), (206, "hills sun and over sets rises seas over sun"), (207, "sun rises over hills and sun sets over seas")]
    got = attention.score_documents(documents(spark, texts), RANKS).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in texts:
        if not held(d):
            counts.update([*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in texts:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        want.append((-1 if d is None else d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    score = {r.doc_id: r.score for r in got}
    assert all(s < 0 and math.isfinite(s) for s in score.values())
    assert score[206] < 2 * score[207]  # the same words in an order that never occurs
    fresh = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert fresh and sum(r.score for r in fresh) > 0.6 * sum(r.base_score for r in fresh)  # the order of words is learnt


def test_attention_without_training_texts(spark):
    got = attention.score_documents(documents(spark, [(None, "one two"), (None, None)]), RANKS).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in got)
    assert attention.score_documents(documents(spark, [(1, "x")]).limit(0), RANKS).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(1)
    share = rng.random(attention.CLASSES)
    model = attention.Attention(attention.Attention.fresh(share / share.sum()))
    model.w = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in model.w.items()}
    inputs = rng.integers(0, attention.CLASSES, (2, attention.WINDOW))
    inputs[0, :10], inputs[0, 10] = attention.CLASSES + 1, attention.CLASSES
    targets, counted = rng.integers(0, attention.CLASSES, (2, attention.SCORED)), np.ones((2, attention.SCORED), bool)
    counted[1, 40:] = False

    def loss():
        m = (model._forward(inputs)[-1] ** 2 + attention.FLOOR) ** 4
        p = m[np.arange(len(m)), targets.ravel()] / m.sum(1)
        return -(np.log(p) * counted.ravel()).sum() / counted.sum()

    for name, g in model.gradients(inputs, targets, counted).items():
        flat = model.w[name].reshape(-1)
        for i in rng.choice(len(flat), 6, replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.ravel()[i]) < 2e-4, name


def test_attention_scores_each_token_once_and_sums_to_one():
    rng = np.random.default_rng(2)
    share = rng.random(attention.CLASSES)
    model = attention.Attention(attention.Attention.fresh(share / share.sum()))
    model.w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in model.w.items()}
    net, end = model.scorer(), attention.CLASSES - 1
    rows = [rng.integers(0, end, n).tolist() + [end] for n in (0, 1, 47, 48, 200)]
    ends = np.cumsum([0, *map(len, rows)])
    row, inputs, targets, counted = attention.windows(np.concatenate(rows).astype(np.int64), ends)
    assert [targets[row == k][counted[row == k]].tolist() for k in range(len(rows))] == rows
    each = net.log_probabilities(inputs, targets)
    # a token alone: its window is what stands before it, from the place that its batch gives it
    plain = np.log((model._forward(inputs)[-1] ** 2 + attention.FLOOR) ** 4)
    plain = plain - np.log(np.exp(plain).sum(1, keepdims=True))
    assert np.allclose(each.ravel(), plain[np.arange(len(plain)), targets.ravel()], atol=1e-3)
    whole = sum(np.exp(net.log_probabilities(inputs[:1], np.full((1, attention.SCORED), c))[0, 0]) for c in range(attention.CLASSES))
    assert abs(whole - 1) < 1e-4
    # later tokens change nothing before them
    other = inputs.copy()
    other[-1, -1] = 5
    assert np.allclose(net.log_probabilities(other, targets)[-1, :-1], each[-1, :-1], atol=1e-5)


def coded(spark, texts):
    docs = documents(spark, texts)
    counts = attention.saved(attention.word_counts(docs), "words")
    coder, share = attention.coder_of(docs, counts, RANKS)
    return attention.saved(attention._coded(docs, coder), "classes"), share


def test_attention_takes_a_common_word_as_one_unit(spark):
    text = "unaccountably interdenominational counterrevolutionaries"
    texts = [(k, text) for k in range(40)] + [(90, text + " hypersensitivenesses"), (91, ""), (92, None)]
    rows = {r.doc_id: r for r in coded(spark, texts)[0].collect()}
    assert all(len(rows[k].classes) == 4 and not rows[k].rare for k in range(40))  # three words and the end
    assert len(rows[90].classes) > 5 and [tuple(x) for x in rows[90].rare] == [("hypersensitivenesses", 1)]
    assert len(rows[91].classes) == len(rows[92].classes) == 1


def test_attention_finds_common_words_that_share_a_slot():
    names = np.sort(np.array([5, 6, 7, 1 << 62, (1 << 62) + 1, 3 << 61], np.uint64))  # by their top bits in two slots and one
    units = attention.Units(RANKS, np.zeros(60_000, np.uint8), np.zeros(60_000), names)
    found, place = units.find(np.array([*names, 8, 1 << 63], np.uint64))
    assert found.tolist() == [True] * 6 + [False] * 2 and place[:6].tolist() == list(range(6))


def test_attention_learns_from_each_training_text_once(spark, monkeypatch):
    rows, share = coded(spark, [(k, f"word{k} " * 100) for k in range(60)])
    learnt = []
    monkeypatch.setattr(attention, "_fitted", lambda part, start, parts, rate: learnt.append([r.doc_id for r in part.collect()]) or start)
    monkeypatch.setattr(attention, "PART", 20)
    attention.train(rows, share)
    all_of_them = sorted(r.doc_id for r in rows.collect() if not r.held_out)
    assert len(learnt) == 2 and all(learnt) and sorted(learnt[0] + learnt[1]) == all_of_them
    learnt.clear()
    monkeypatch.setattr(attention, "PART", 1 << 20)  # too few windows for a full part a round
    attention.train(rows, share)
    assert [sorted(x) for x in learnt] == [all_of_them] * 2


# --- hard negatives --------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, norm double, rank int"


def brute_negatives(rows):
    good = []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out, asked = [], {}
    for i, label, t in sorted(good, key=lambda r: (r[0], r[1], r[2])):
        if i % 50 == 0:
            asked.setdefault(i, (label, t))
    for i, (label, t) in asked.items():
        scored = [(-sum(a * b for a, b in zip(t, u, strict=True)), j, other) for j, other, u in good if j != i and len(u) == len(t)]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("buckets", [(2048, 1024, 16), (16, 3, 2)])
def test_negatives(spark, monkeypatch, buckets):
    for name, value in zip(("BUCKET", "BLOCK", "LANE"), buckets, strict=True):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, rng.choice([0.2, 1, 3]), 6) + 0.4).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(500 + i, rows[7][1], 1) for i in range(40)]  # ties
    rows += [(None, [1.0] * 6, 1), (600, None, 1), (601, [1.0] * 6, None), (602, [float("nan")] * 6, 1), (603, [1.0, None] * 3, 1), (650, [], 1), (700, [1.0, 2.0], 1), (701, [1.0, 2.0], 1), (702, [0.8, 1.0], 2), (750, [0.0] * 6, 1), (800, [-1.0] * 6, 2)]
    rows += [(-50, [2.0] * 6, 0), (-7, [1.0] * 6, 9)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], VECTORS).repartition(4)
    given = negatives.labelled_vectors(df)
    got = negatives.hard_negatives(given, given.where("vec_id % 50 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_wide_empty_and_repeated(spark):
    given = negatives.labelled_vectors(spark.createDataFrame([], VECTORS))
    assert negatives.hard_negatives(given, given).count() == 0
    big = [(50, [2.0**20, 2.0**21], 1), (51, [2.0**20, 2.0**21], 1), (52, [2.0**19, 2.0**21], 2), (53, [2.0**20, 2.0**20], 3)]
    given = negatives.labelled_vectors(spark.createDataFrame([(*r, 1.0, 2) for r in big], VECTORS))
    assert sorted(map(tuple, negatives.hard_negatives(given, given.where("vec_id % 50 = 0")).collect())) == brute_negatives(big)
    huge = [(50, [2.0**40, 2.0**41], 1), (51, [2.0**40, 1.0], 1), (52, [2.0**38, 2.0**39], 2)]  # scores beyond 62 bits
    given = negatives.labelled_vectors(spark.createDataFrame([(*r, 1.0, 2) for r in huge], VECTORS))
    assert all(r.negative_score <= (1 << 63) - 1 for r in negatives.hard_negatives(given, given.where("vec_id % 50 = 0")).collect())
    twice = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (1, [0.9, 0.1], 1), (2, [0.6, 0.0], 2), (2, [0.6, 0.0], 2)]
    given = negatives.labelled_vectors(spark.createDataFrame([(*r, 1.0, 2) for r in twice], VECTORS))
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in negatives.hard_negatives(given, given.where("vec_id % 50 = 0")).collect())
    assert got == [(100, 1, 1, 2), (100, 1, 1, 2), (100, 1, 2, 2), (100, 1, 2, 2)]


# --- spelling variants -----------------------------------------------------------------------------------------------


def brute_variants(texts):
    counts = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    met = defaultdict(list)
    for a in known:
        met[a] = [b for b in known if a != b and near(a, b)]
    form = {}
    for w, n in known.items():
        best = min(met[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best and known[best] >= 2 * n else None
    out = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(met[w]), known[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants(spark):
    rng = random.Random(8)
    base = ["garden", "window", "Straße", "théâtre", "ÀÉÎÕÜß", "aabbcc", "mmmmmm", "letters", "settler"]
    def slip(w):
        kind, i = rng.randrange(4), rng.randrange(len(w))
        return [w, w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéÿmt") + w[i:], w[:i] + rng.choice("aeéÿmt") + w[i + 1 :]][kind]
    texts = [(k, " ".join(slip(rng.choice(base)) for _ in range(60)) + "×÷ 1garden2 gardenĀwindow x'garden") for k in range(80)]
    texts += [(None, "garden window garden"), (90, None), (91, ""), (92, "a" * 3000), (93, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999), (94, ("a" * 2999 + " ") * 3), (79, texts[79][1])]
    got = variants.variants(documents(spark, texts)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(texts)
    assert variants.variants(documents(spark, texts).limit(0)).count() == 0


def test_variants_with_a_filter_that_lets_all_through(spark, monkeypatch):
    monkeypatch.setattr(variants, "_filter_of", lambda words, many: variants.Filter(16, np.full(1 << 13, 255, np.uint8)))
    texts = [(k, "garden gardn gardens gaarden window") for k in range(4)]
    got = variants.variants(documents(spark, texts)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(texts)


def test_neighbours_are_all_distinct_edits():
    letters, alphabet = np.frombuffer(b"aabac" b"bbbbb", np.uint8).reshape(2, 5), np.frombuffer(b"abc", np.uint8)
    everything = variants.Filter(16, np.full(1 << 13, 255, np.uint8))
    made = [(int(r), w.tobytes().decode()) for rows, ws in variants.neighbours(letters, alphabet, everything) for r, w in zip(rows, ws, strict=True)]
    want = set()
    for k, w in enumerate(["aabac", "bbbbb"]):
        want |= {(k, w[:i] + c + w[i + 1 :]) for i in range(5) for c in "abc" if c != w[i]} | {(k, w[:i] + c + w[i:]) for i in range(6) for c in "abc"}
    assert len(made) == len(set(made)) and set(made) == want


def test_crc_and_words():
    texts = ["", "one", "Two  three\n", "é" * 40, "x" * 200]
    data, bounds = raw_texts(pa.array(texts))
    low = spans.lowered(data)
    starts, stops, row = spans.words(data, bounds)
    found = spans.strings(low, starts, stops).to_pylist()
    assert found == ["one", "two", "three", "é" * 40, "x" * 200] and row.tolist() == [1, 2, 2, 3, 4]
    before = np.array([zlib.crc32(b"7:")] * 5, np.uint32)
    assert variants.crc32_of(low, starts, stops, before).tolist() == [zlib.crc32(f"7:{w}".encode()) for w in found]


def test_registered_queries(spark):
    from quillstream.llm import queries

    for name in ("op11_attention", "op12_negatives", "op13_variants"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").where(F.lit(True)).count() > 0
