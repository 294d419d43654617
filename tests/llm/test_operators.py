"""Each operator against a brute-force version on small rows, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, lattice, lines, maxscore, minhash, mixing, pii, secrets, token_counts, toxicity
from quillstream.llm.shared import mix

RNG = random.Random(7)
WORDS = ["ka", "lo", "mi", "ne", "po", "ru", "sa", "ti", "Ve", "xé"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, pattern string"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(RNG.randint(20, 60)) for _ in range(25)]
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[RNG.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[0].upper(), None, "", "  \n ", "one two", "ONE  two", "tail " * 4000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", ["a", "b", "c", None][k % 4], len(t or ""), "x", "y", "z") for k, t in enumerate(texts)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def parts(nodes, links):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_minhash(spark, docs, texts):
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = parts(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].n_shingles == len(s) and got[k].kept == (want[k] == k) for k, s in sets.items())
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_row_without_doc_id_first(spark):
    a = prose(60)
    rows = [(None, a), (5, a), (6, a), (9, a + " tail"), (None, a + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.component_id or 0, bool(r.kept)) for r in minhash.near_duplicates(docs).collect())
    assert [x for x in got if x[0]] == [(5, 5, True), (6, 5, False), (9, 5, False)]
    assert len(got) == 5


def test_minhash_of_repeated_ids(spark):
    x, y = prose(40), prose(40)
    rows = [(5, x + " east"), (5, y + " west"), (7, x), (9, y), (8, None), (5, None), (None, y), (None, x), (11, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(5, 5), (5, 5), (5, 5), (7, 5), (8, 8), (9, 5), (11, 11)]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_of_many_repeated_rows(spark, monkeypatch):
    text = prose(60)
    near = text + " tail"
    compared = []
    whole = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, docs, percent: (compared.append(docs.count()), whole(pairs, docs, percent))[1])
    rows = [(1, text)] * 400 + [(2, near)] * 400 + [(3, prose(50)), (None, text)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 1), (3, 3)} and len(got) == 802
    assert max(compared) <= 4  # one row a text: a pair of documents is one comparison


def test_minhash_estimate(spark):
    a, b = np.arange(3000, dtype=np.uint64), np.arange(600, 3600, dtype=np.uint64)
    bits = [minhash.packed_bits(minhash.minima(mix(x))).tolist() for x in (a, b)]
    df = spark.createDataFrame([(bits[0], bits[1])], "a array<long>, b array<long>")
    got = df.select(minhash.estimated_similarity([F.col("a")[k] for k in range(minhash.WORDS)], [F.col("b")[k] for k in range(minhash.WORDS)]).alias("s")).first().s
    assert abs(got - 2400 / 3600) < 0.2


def test_minhash_parities_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 7, 100, 900, 5000):
        for share in (0.5, 0.7, 0.74, 0.75, 0.76, 0.9, 1.0):
            both = round(2 * size * share / (1 + share))
            x = mix(rng.integers(0, 2**62, 2 * size - both, dtype=np.uint64))
            a, b = x[:size], x[size - both :]
            similar = 100 * both >= 75 * (2 * size - both)
            rows.append((size, len(b), minhash.parities(a).tolist(), minhash.parities(b).tolist(), similar, share))
    df = spark.createDataFrame(rows, "n long, m long, a array<long>, b array<long>, similar boolean, share double")
    bits = lambda s: [F.col(s)[k] for k in range(minhash.ODD)]
    got = df.withColumn("can", minhash.can_reach(75, (F.col("n"), F.col("m")), bits("a"), bits("b"))).collect()
    assert all(r.can for r in got if r.similar)
    assert not any(r.can for r in got if r.n == 100 and r.share == 0.5)


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark):
    made = ["".join(RNG.choice("a1.@+- ()é59") for _ in range(RNG.randint(0, 60))) for _ in range(3000)]
    assert all(pii.base_spans(t) == brute_pii(t) for t in made)
    cases = [None, "", "mail x.y@host.org now", "call +1 (555) 010-1234 or 10.0.0.300", "4" * 40, "name [at] host [dot] org"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest_columns(pii.detect(df, windows=96)).collect()}
    for k, t in enumerate(cases):
        base = brute_pii(t or "")
        assert got[k].base_sha256 == pii.sha256_of(base)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[0] == n for x in base) for n in range(4))
        assert set(filter(None, got[k].spans.split(","))) >= {f"{pii.KINDS[n]}:{s}:{e}" for n, s, e in base}


def test_pii_gradients():
    model = pii.Tagger.fresh(3)
    x, y = pii.labelled_windows(3)
    _, g = model.gradients(x, y)
    for name in ("embed", "in", "re", "out", "move"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (0.01, -0.01):
            w = {k: v.copy() for k, v in model.w.items()}
            w[name][at] += step
            losses.append(pii.Tagger(w).gradients(x, y)[0])
        assert abs((losses[0] - losses[1]) / 0.02 - g[name][at]) < 0.1 * abs(g[name][at]) + 1e-3


def test_pii_held_out_accuracy(spark):
    x, y = pii.labelled_windows(400, seed=99)
    model = pii.Tagger(pii.fitted(spark))
    tags = model.viterbi(x)
    emit = model.emissions(x)
    assert (tags == model._best_paths(emit)).all()  # the bound leaves out no window with a span
    assert (tags == y).mean() > 0.98
    found, told = ({(row, *x) for row, runs in enumerate(pii._runs(t)) for x in runs} for t in (tags, y))
    whole = lambda spans: {x for x in spans if x[2] > 0 and x[3] < pii.LEARNT}  # noqa: E731  spans that a window's edge cuts can't be told
    assert len(whole(found) & told) >= 0.95 * len(whole(found)) and len(whole(told) & found) >= 0.95 * len(whole(told))


def test_pii_added_spans_are_checked():
    """A tagged number is a card only where Luhn holds, an ip only with four parts up to 255."""
    assert pii._checked(2, 5, "4111.1111.1111.1111") == [(2, 5, 24)] and pii._checked(2, 5, "4111.1111.1111.1112") == []
    assert pii._checked(1, 0, "192[.]168[.]0[.]1") and not pii._checked(1, 0, "192[.]168[.]0[.]256") and not pii._checked(1, 0, "1.2.3")
    rng = random.Random(5)
    numbers = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(300)]
    told = [pii._checked(2, 0, n) != [] for n in numbers]
    assert told == [pii.luhn(n) for n in numbers]


def test_pii_runs():
    tags = np.array([[0, 1, 2, 2, 1, 2, 0, 3, 4, 6], [2, 2, 0, 0, 0, 0, 0, 0, 8, 7]], np.int8)
    assert pii._runs(tags) == [[(0, 1, 4), (0, 4, 6), (1, 7, 9), (2, 9, 10)], [(0, 0, 2), (3, 8, 9), (3, 9, 10)]]


def test_pii_spelt_out_addresses_without_marks(spark):
    address = "jane.doe at example dot org"
    cases = [f"please write to {address} for news", "ask jane at example . com today about it", "word " * 18 + address + " word" * 30, "look at the gate. nothing is there, on the dot or at noon"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: {cases[r.doc_id][x.start : x.stop] for x in r.added if x.kind == 0} for r in pii.detect(df).collect()}
    assert got == {0: {address}, 1: {"jane at example . com"}, 2: {address}, 3: set()}


def test_pii_every_window_is_decoded(spark):
    class Asked(pii.Tagger):
        def viterbi(self, x):
            self.rows = len(x)
            return super().viterbi(x)

    model = Asked(pii.fitted(spark))
    text = "".join(chr(97 + k % 23) + " " * (k % 7 == 0) for k in range(1000))
    pii.tagged_spans([text], model)
    assert model.rows == -(-len(text) // pii.STEP)


def test_pii_best_paths(spark):
    rng = np.random.default_rng(4)
    model = pii.Tagger(pii.fitted(spark))
    x = rng.integers(0, pii.CLASSES, (3, 12)).astype(np.int16)
    emit, move = model.scores(x)[0], model.w["move"]
    assert np.allclose(emit, model.emissions(x).transpose(0, 2, 1), atol=1e-4)
    for row, tags in enumerate(model.viterbi(x)):
        score = lambda y, row=row: emit[np.arange(len(y)), row, y].sum() + move[y[:-1], y[1:]].sum()
        best = emit[0, row]
        for t in range(1, 12):
            best = (best[:, None] + move).max(0) + emit[t, row]
        assert abs(score(tags) - best.max()) < 1e-3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, n):
    out = list(text)
    for _ in range(n):
        k, how = RNG.randrange(len(out)), RNG.random()
        if how < 0.4:
            out[k] = RNG.choice("abc")
        elif how < 0.7:
            out.insert(k, RNG.choice("abc"))
        else:
            del out[k]
    return "".join(out)


def test_edit_distance(spark):
    pairs = []
    for _ in range(800):
        a = "".join(RNG.choice("abcé") for _ in range(RNG.randint(20, 40)))
        a, b = sorted((a, changed(a, RNG.randint(0, 4))), key=len)
        if len(b) - len(a) <= lines.EDITS:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == edits(r.a, r.b) if edits(r.a, r.b) <= lines.EDITS else r.d > lines.EDITS for r in got)


def check_lines(spark, rows):
    """Every line and every text against brute force; no two rows share a doc_id here."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, of_doc int, n_chars long").repartition(3)
    every = {(d, k): x.strip().lower() for d, t, *_ in rows for k, x in enumerate((t or "").split("\n"))}
    first = {}
    for at in sorted(every):
        first.setdefault(every[at], at)
    kinds = [x for x in first if len(x) >= lines.LEAST_CHARS]
    links = [(a, b) for a, b in combinations(kinds, 2) if abs(len(a) - len(b)) <= lines.EDITS and edits(a, b) <= lines.EDITS]
    low = parts([first[x] for x in kinds], [(first[a], first[b]) for a, b in links])
    got = {(r.doc_id, r.line_no): r for r in lines.repeated_lines(docs).collect()}
    assert set(got) == set(every)
    for at, x in every.items():
        where = low[first[x]] if x in kinds else first[x] if x else at
        assert ((got[at].first_doc, got[at].first_line), got[at].n_links) == (where, sum(x in p for p in links))
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    for d, t, *_ in rows:
        whole = (t or "").split("\n")
        kept = [x for k, x in enumerate(whole) if got[d, k].kept]
        if len(kept) == len(whole):
            assert left[d].text == t
        elif "".join(kept).strip():
            assert left[d].text == "\n".join(kept) and left[d].n_chars == len(left[d].text)
        else:
            assert d not in left
    return links


def test_lines(spark):
    base = ["".join(RNG.choice("abcé") for _ in range(RNG.randint(20, 30))) for _ in range(15)]
    texts = ["\n".join(changed(RNG.choice(base), RNG.randint(0, 2)) for _ in range(3)) + "\n short" for _ in range(20)]
    texts += [None, "", "a" * 60_000 + "\n" + "b " * 900, "b " * 900 + "c", "short\n\n"]
    assert check_lines(spark, [(k, t, "x", 1, len(t or "")) for k, t in enumerate(texts)])
    none = spark.createDataFrame([], DOCS)
    assert lines.repeated_lines(none).count() == 0 and lines.without_repeats(none).count() == 0


def test_lines_hot_segments(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 4)
    for depth in (1, 3):
        monkeypatch.setattr(lines, "DEPTH", depth)
        numbered = [f"printed on page {RNG.randint(0, 10**5):06d} of the whole record {RNG.choice('xyz')}" for _ in range(60)]
        numbered += [changed(RNG.choice(numbered), RNG.randint(0, 2)) for _ in range(40)] + ["=" * n for n in range(20, 32)]
        assert len(check_lines(spark, [(k, t, "x", 1, len(t)) for k, t in enumerate(numbered)])) > 40


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(5, "only here once\nsaid by both"), (5, "said by both\nonly there, too"), (6, "said by both\nlast"), (None, "said by both"), (6, "said by both\nlast")]
    left = sorted((str(r.doc_id), r.text) for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the class begins at line 0 of a row of 5; both rows of 6 are the same lines of one document
    assert left == [("5", "only here once"), ("5", "said by both\nonly there, too"), ("6", "last"), ("6", "last"), ("None", "said by both")]


def test_secrets_and_ledger(spark, tmp_path):
    rule = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)

    def brute(t):
        out = [(0, *m.span()) for m in rule.finditer(t) if len(m[2]) >= 8]
        out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(2, *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32], key=lambda x: (x[1], x[0]))

    made = ["".join(RNG.choice(["token", "Password", "=", ":", " ", "AKIA", "0123456789abcdef", "Zz9", "api_key", "'", "ſecret", "é"]) for _ in range(RNG.randint(0, 25))) for _ in range(300)]
    assert all([x for x in secrets.find(t) if x[0] < 3] == brute(t) for t in made)
    df = spark.createDataFrame([*enumerate(made), (900, None), (901, ""), (902, made[5])], "doc_id long, text string")
    ledger = str(tmp_path / "ledger")
    one = {r.doc_id: r for r in secrets.digest_columns(secrets.scan(df, ledger)).collect()}
    size = spark.read.parquet(ledger).count()
    again = {r.doc_id: r for r in secrets.digest_columns(secrets.scan(df, ledger)).collect()}
    assert one == again and spark.read.parquet(ledger).count() == size == len({*made, ""})
    for k, t in enumerate(made):
        want = ",".join(f"{secrets.KINDS[n]}:{s}:{e}" for n, s, e in brute(t))
        assert one[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert one[900].spans == "" and one[902].spans == one[5].spans


def plain_ftrl(texts, labels, epochs=3, seed=3, alpha=0.5, beta=1.0, l1=8.0, l2=0.5):
    """The method coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        x = z.get(i, 0.0)
        bound = 0.0 if i == "bias" else l1
        return 0.0 if abs(x) <= bound else -(x - math.copysign(bound, x)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    cut = [[*toxicity.slots_of(pa.array([t]))[0].tolist(), "bias"] for t in texts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)).tolist():
            w = {i: weight(i) for i in cut[k]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in cut[k]:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity(spark):
    rows = [(k, prose(30) + (" scum idiot" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "scum idiot " * 20_000), (None, "scum")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(5000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert len(got) == 404 and all((got[k] >= 0.5) == bool(y) for k, _, y in rows) and got[900] == got[901] < 0.5 <= got[902]
    assert len(weights[0]) < 200
    sample = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    want = plain_ftrl([t for _, t, _ in sample], [y for *_, y in sample])
    assert weights[2] == pytest.approx(want.pop("bias")) and dict(zip(weights[0].tolist(), weights[1].tolist(), strict=True)) == pytest.approx(want)
    for k, t, _ in rows[:40]:
        total = sum(want.get(i, 0.0) for i in toxicity.slots_of(pa.array([t]))[0].tolist()) + weights[2]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.train(empty(spark), labels) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0} and toxicity.score(empty(spark), weights).count() == 0
    assert [r.h for r in docs.where("doc_id is null").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()] == [True]


def test_mixing(spark, docs, texts):
    got = mixing.digest_columns(mixing.mix(docs, F.array("source"))).collect()
    sizes = {k: len((t or "").split()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in got} == sizes and all(r.taken <= 2 * r.size for r in got)
    total, by = 0, {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert sum(taken) == int(target)
        total += target
    assert abs(total - 1.5 * sum(sizes.values())) < 1e-6 * total
    rows = mixing.mixed_documents(docs, F.array("source"))
    assert rows.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in rows.collect()) == sum(r.taken for r in got)
    assert mixing.mix(empty(spark), F.array("source")).count() == 0 and mixing.mixed_documents(empty(spark), F.array("source")).count() == 0


def test_mixing_carries_rows(spark):
    schema = "doc_id long, text string, source string, n_chars long, of_doc int, of_words string, row string, size int, bucket string"
    rows = [(5 if k % 2 else None, f"{prose(k % 7)} end{k}", "ab"[k % 3 > 0], 0, k, "w", "r", 1, "b") for k in range(60)] + [(5, None, "a", 0, 99, "w", "r", 1, "b")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    given = {r.row.of_doc: r.taken for r in mixing.mix(docs, F.array("source"), with_row=True).collect()}
    got: dict = {}
    for r in mixing.mixed_documents(docs, F.array("source")).collect():
        assert (r.of_words, r.row, r.size, r.bucket) == ("w", "r", 1, "b") and r.text.split() == rows[r.of_doc][1].split()[: len(r.text.split())]
        got[r.of_doc] = got.get(r.of_doc, 0) + len(r.text.split())
    assert got == {k: n for k, n in given.items() if n}  # rows of one id, or of none, keep their own shares
    assert {r.row.of_doc: r.taken for r in mixing.mix(docs.repartition(5), F.array("source"), with_row=True).collect()} == given


def test_flow_answers_every_group(spark, monkeypatch):
    """Sources that share nothing go through the flow too, one group each."""
    groups = []
    whole = mixing._flow
    monkeypatch.setattr(mixing, "_flow", lambda *a: (groups.append(a), whole(*a))[1])
    docs = spark.createDataFrame([(k, "a b c d e", "en", "xyz"[k % 3], 9, "", "", "") for k in range(30)], DOCS)
    assert mixing.digest_columns(mixing.mix(docs, F.array("source"))).count() == 30 and len(groups) == 3


def test_flow_prefers_fresh_words():
    flow = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [15, 5], 2)
    assert sum(f.get(0, 0) for f in flow) == 15 and sum(f.get(1, 0) for f in flow) == 5
    assert all(sum(f.values()) == 10 for f in flow)  # no word is repeated while a fresh one fits
    assert mixing.water_fill([10, 10, 0], [5, 2, 1], 1.5, 2) == [20.0, 10.0, 0.0]


def vectors(n, dim=16):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + 0.06 * rng.normal(size=(n - n // 2, dim))
    x[1], x[2] = x[0], 0
    return x


def vector_frame(spark, x):
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(9000, None), (9001, [1.0, None]), (9002, [float("nan")] * x.shape[1]), (9003, [1.0, 2.0]), (9004, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("copies", F.lit(1)).repartition(3)


def test_maxscore(spark):
    x = vectors(700) / 8
    ints = maxscore.integer_vectors(vector_frame(spark, x))
    got = maxscore.top_k(ints, ints.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    whole = np.floor(256 * x).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        best = sorted((k for k in range(700) if k != q), key=lambda k: (-scores[k], k))[:5]
        want += [(q, n + 1, k, scores[k]) for n, k in enumerate(best)]
    assert [tuple(r) for r in got] == want


def brute_top(whole, ids, queries, k=5):
    out = []
    for q in queries:
        held = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
        scores = [(held(sum(int(a) * int(b) for a, b in zip(whole[q], row, strict=True))), i) for row, i in zip(whole, ids, strict=True) if i != ids[q]]
        out += [(ids[q], n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return out


def test_maxscore_sparse_ties_and_wide(spark):
    rng = np.random.default_rng(3)
    sparse = (rng.integers(-3, 9, (600, 12)) * (rng.random((600, 12)) < 0.2)).tolist()  # few distinct scores: ties
    wide = [[int(x) << s for x in row] for row, s in zip(rng.integers(-9, 9, (120, 5)).tolist(), RNG.choices([0, 20, 40, 58], k=120), strict=True)]
    wide += [[2**63 - 1, -(2**63), 1, 2, 3]]
    for terms in (sparse, wide):
        ids = [50 * k if k < 6 else 1000 + k for k in range(len(terms))] if terms is wide else list(range(len(terms)))
        df = spark.createDataFrame(list(zip(ids, terms, strict=True)), "vec_id long, terms array<long>").repartition(3)
        got = maxscore.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in got] == brute_top(terms, ids, [k for k, i in enumerate(ids) if i % 50 == 0])
    huge = spark.createDataFrame([(0, [1e12, -1e300]), (1, [1e12, 5.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    ints = maxscore.integer_vectors(huge)
    assert [(r.vec_id, r.score) for r in maxscore.top_k(ints, ints.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 0)]
    none = ints.where("vec_id < 0")
    assert maxscore.top_k(none, none).count() == 0 and maxscore.top_k(ints, none).count() == 0


def test_maxscore_split_moves_with_the_kth_best():
    rest = np.array([9.0, 5.0, 2.0, 0.0])
    assert [maxscore._split(rest, x) for x in (-np.inf, 0.0, 1.0, 3.0, 6.0, 10.0)] == [3, 3, 3, 2, 1, 0]
    rows = np.zeros((4, 600))
    rows[0, :100], rows[3, 100:] = 50, 1  # rows that hold only the weak term can't compete
    shard, asked = maxscore.Shard(rows, np.arange(600)), np.array([1.0, 0, 0, 1.0])
    shard.posted[3, 100:] = True
    assert shard.top_k(asked, -1, 3)[1].tolist() == [0, 1, 2]


def test_lattice_of_repeated_and_missing_ids(spark):
    east, north, near = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.01, 1.0, 0.0, 0.0]
    rows = [(1, east), (1, north), (3, near), (4, east), (5, None), (1, None), (None, north), (3, near)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 1), (3, 2, 1), (3, 2, 1), (4, 1, 1), (5, 0, 5)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert lattice.near_duplicates(none).count() == 0


def test_lattice(spark):
    x = vectors(900, 32)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in lattice.near_duplicates(vector_frame(spark, x)).collect()}
    assert len(got) == 905 and all(got[k].n_links == 0 and got[k].kept for k in (2, 9000, 9001, 9002, 9003, 9004))
    found = sum(r.n_links for r in got.values())
    assert 0.9 * near.sum() <= found <= near.sum() and all(got[k].n_links <= near[k].sum() for k in range(900))


def test_lattice_points():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    near = lattice.nearest_e8(x)
    dist = ((x - near) ** 2).sum(1)
    others = ((x[:, None, :] - near[:, None, :] - lattice.ROOTS[None]) ** 2).sum(2)
    assert (dist[:, None] <= others + 1e-9).all() and len(lattice.ROOTS) == 240


def test_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    cases = ["", None, "a\n\n", " \n a  b\t c\n\n\nd ", "x" * 700, "é" * 300, "don't 're\n's", "日本 12 <|endoftext|>", "ab" * 400 + " q"]
    cases += ["".join(RNG.choice("ab \n\t'1.é  😀") for _ in range(RNG.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.encode_documents(df, path, P.PATTERN, with_ids=True).collect()}
    for k, t in enumerate(cases):
        ids = library.encode_ordinary(t or "")
        assert np.frombuffer(bytes(got[k].ids), "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    cases = ["", None, "Two  words", " two words ", "don't stop, now!", "e ́ x́ ΑΣ", "<|startoftext|>a <|ENDOFTEXT|>", "a b", prose(500)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").withColumn("content", F.lit("clash"))
    cache = str(tmp_path / "counts")
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.count_tokens(df, path, cache).collect()}
        for k, t in enumerate(cases):
            assert got[k].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and got[k].n_bytes == len((t or "").encode())
    assert spark.read.parquet(cache).count() == len(cases) - 1


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force version on what the stage before kept; further columns have the stages' own names."""
    import corpus_pipeline
    import tiktoken

    rows = [(k, prose(40) + f"\n{prose(12)} line {k}" + ("\nscum idiot" if k % 4 == 0 else ""), "en", "ab"[k % 2], 0) for k in range(120)]
    rows += [(200, rows[3][1], "en", "a", 0), (201, None, "en", None, 0), (202, rows[5][1].replace("\n", " tail\n"), "en", "a", 0), (None, "nobody knows me at all", "en", "b", 0), (203, "", "en", "a", 0)]
    words = prose(60).split()
    rows += [(204 + k, " ".join([*words[:30], "abc"[k] * 6, *words[30:]]), "en", "b", 0) for k in range(3)] + [(207, "long " * 9_000, "en", "a", 0)]
    clash = {"score": F.lit(1), "gone": F.lit("g"), "of_doc": F.lit(2), "of_words": F.lit(3), "of_left": F.lit(4), "rep": F.lit("r"), "row": F.lit(5), "words": F.lit("w"), "size": F.lit(6)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).withColumns(clash)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = held.collect()
        stage(spark, held, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = out.collect()
        assert n == 4 or out.columns == docs.columns
        texts = {r.doc_id: r.text for r in after} if n < 4 else {}
        if name == "toxicity":
            assert set(texts) == {r.doc_id for r in before if "scum" not in (r.text or "")}
        elif name == "line_dedup":
            seen: dict = {}
            want = {}
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)):
                lines_, kept = (r.text or "").split("\n"), []
                for x in lines_:
                    plain = x.strip().lower()
                    near = [y for y in seen if abs(len(y) - len(plain)) <= 2 and min(len(y), len(plain)) >= lines.LEAST_CHARS and edits(y, plain) <= 2]
                    if r.doc_id is None or not plain or not (plain in seen or near):
                        kept.append(x)
                    seen.setdefault(plain, r.doc_id)
                if len(kept) == len(lines_):
                    want[r.doc_id] = r.text
                elif "".join(kept).strip():
                    want[r.doc_id] = "\n".join(kept)
            assert texts == want and len(texts) < len(before)
        elif name == "near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
            low = parts(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
            assert set(texts) == {d for d in low if low[d] == d} | {None} and len(texts) < len(before)
        elif name == "mixing":
            size = lambda rs: Counter((r.source, len((r.text or "").split())) for r in rs)
            of = lambda rs, s: sum(k * c for (x, k), c in size(rs).items() if x == s)
            sources = ["a", "b", None]
            whole = [of(before, s) for s in sources]
            for s, target in zip(sources, mixing.water_fill(whole, [5, 2, 1], 1.5, 2), strict=True):
                assert of(after, s) == int(target)
            full = {r.doc_id: (r.text or "").split() for r in before}
            assert all(r.text.split() == full[r.doc_id][: len(r.text.split())] and r.n_chars == len(r.text) for r in after)
        else:
            library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
            told = lambda t: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
            assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after) == Counter((r.doc_id, *told(r.text or "")) for r in before)
        held = out
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("operator", ["pii", "secrets", "bpe", "token_counts", "toxicity"])
def test_rows_whatever_they_hold(spark, operator):
    """One result a row for repeated, missing and shared ids, very long texts, nulls and columns with the operators' own names."""
    long_text = "word " * 60_000 + "call +1 555 010 1234 or mail a.b@host.org, token = abcdefgh1234"
    rows = [(1, "a text"), (1, "a text"), (1, "another text"), (None, "a text"), (2, None), (3, ""), (4, long_text), (5, long_text)]
    names = ["base", "added", "blob", "findings", "content", "n_tokens", "score", "packed", "rules", "doc", "words", "lang"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names}).repartition(3)
    weights = (toxicity.slots_of(pa.array(["word"]))[0].astype(np.int64), np.array([0.5]), 0.1)
    run = {
        "pii": lambda d: pii.digest_columns(pii.detect(d, windows=96)),
        "secrets": lambda d: secrets.digest_columns(secrets.scan(d)),
        "bpe": lambda d: bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "token_counts": lambda d: token_counts.count_tokens(d, P.path("word_bpe_49k.json")),
        "toxicity": lambda d: toxicity.score(d, weights),
    }[operator]
    got = [tuple(r) for r in run(docs).collect()]
    result = lambda k: sorted({r[1:] for r in got if r[0] == k}, key=repr)
    assert sorted((r[0] or 0) for r in got) == [0, 1, 1, 1, 2, 3, 4, 5]
    assert result(2) == result(3) and result(4) == result(5) != result(2) and len(result(1)) <= 2 and set(result(None)) <= set(result(1))
    none = run(docs.limit(0))
    assert none.count() == 0 and none.columns == run(docs).columns


def test_attention_learns_from_whole_texts():
    import inspect

    from quillstream.llm import attention

    assert not any(name.startswith("SLICE") for name in vars(attention)) and "% SLICE" not in inspect.getsource(attention._training_windows)
