"""Periodic runs, toxicity and whitening against brute force, and odd inputs."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.llm import periodic_runs, toxicity, whitening
from waymark.llm.queries import QUERIES


def _runs(w, shortest=6, copies=4):
    """Stretches of each period, the smallest of those that cover the same words."""
    found, seen, n = [], set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= max(shortest, copies * q):
                    found.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("copies", [2, 3, 4])
def test_runs_of_random_words(copies):
    rng = np.random.default_rng(copies)
    for t in range(700):
        w = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 60)))
        if t % 3 == 0 and len(w) > 4:
            a = int(rng.integers(len(w)))
            p = 1 + int(rng.integers(max(1, (len(w) - a) // 3 + 1)))
            w = w[[i if i < a else a + (i - a) % p for i in range(len(w))]]
        got = list(zip(*(x.tolist() for x in periodic_runs.word_runs(w.astype(np.int64), 6, copies)), strict=True))
        assert got == _runs(w.tolist(), 6, copies)


def _digest(doc_id, text):
    """op11's contract, word by word."""
    w = (text or "").encode().split()
    if doc_id is not None and w:
        g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
        if last == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = _runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_documents(spark):
    """The query against the contract word by word; the brute force is quadratic, so texts of up to 400 words are compared."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    assert set(got) == set(docs)
    short = [i for i, t in docs.items() if len((t or "").split()) <= 400]
    assert len(short) > 100 and sum(got[i][1] > 0 for i in short) > 8
    for i in short:
        assert got[i] == _digest(i, docs[i])


def test_runs_odd(spark):
    planted = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    long = " ".join(f"w{k}" for k in range(3000)) + " x y" * 40_000
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b a b a b a b a", "é é " * 9, "aab " * 3 + "b b b b b b b " + "c", long]
    rows = [(i, t, "s") for i in (planted, plain, None) for t in texts[:-1]] + [(plain, long, "s"), (plain, "a a a a a a", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = Counter(map(tuple, periodic_runs.digest(df).collect()))
    assert got - Counter(_digest(i, t) for i, t, _ in rows if t != long) == Counter([next(g for g in got if g[3] == 80_000)])
    found = {r.text: r for r in periodic_runs.collapse(df).collect()}
    assert found[long].runs == [(3000, 80_000, 2)] and found[long].collapsed.endswith("w2999 x y") and found[None].runs == [] and found[None].collapsed == ""
    assert found["a b a b a b a b a"].collapsed == "a b"
    assert periodic_runs.digest(df.limit(0)).count() == 0


def _kinds(text, stems=()):
    return [k for _, _, k in toxicity.matched_clauses(text, toxicity.grammar(), toxicity.Lexicon(stems=stems))[1]]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("You are an idiot.", ["insult+target"]),
        ("What a stupid day. A fool!", ["insult", "mild"]),
        ("He is not an idiot.", ["denied"]),
        ("It is not that long ago and yet an idiot came", ["insult"]),
        ("She said you are an idiot; you clown", ["reported", "mild+target"]),
        ('the word "moron" is old', ["reported"]),
        ("I will kill you!", ["vow+target"]),
        ("They kill time", ["threat+target"]),
        ("I'll hurt him", ["vow"]),
        ("never will I hurt you", ["denied"]),
        ("now SHUT up", ["order"]),
        ("the killer whale is ugly-looking", ["mild"]),
        ("Du bist ein Dummkopf", ["insult+target"]),
        ("İ an idiot", ["insult"]),
        ("", []),
    ],
)
def test_clauses(text, kinds):
    assert _kinds(text) == kinds


def test_clauses_stems_and_places():
    text = "Zorbling here. nothing there\nyou zorby thing"
    whole, lexicon = toxicity.grammar(), toxicity.Lexicon(stems=("zorb",))
    words, found = toxicity.matched_clauses(text, whole, lexicon)
    assert [(text[a:b], k) for a, b, k in found] == [("Zorbling here", "slur"), ("you zorby thing", "slur+target")] and words == 9


def test_composition_is_one_after_the_other():
    rng = np.random.default_rng(5)
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.vows(), toxicity.targets(), toxicity.verdicts()]
    whole = toxicity.grammar()
    for _ in range(200):
        symbols = [toxicity.SYMBOLS[i] for i in rng.integers(0, len(toxicity.SYMBOLS), 12)]
        states, state = [p.start for p in parts], whole.start
        for symbol in symbols:
            state, got = whole.step(state, symbol)
            for k, part in enumerate(parts):
                states[k], symbol = part.step(states[k], symbol)
            assert got == symbol


def test_toxicity_held_out(spark):
    """On the middle data: rows of the held-out fold that show a word of the grammar's lists are found, clean ones stay. Slurs of other
    languages need more labelled texts than these tables have: test_stems_are_learned."""
    sf = DATA.replace("0.001", "0.01")
    out = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in out.items())
    english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").collect()}
    held = [(labels[i], out[i].predicted) for i in labels if i in out and i in english and out[i].held_out]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.02 * len(held)


def test_stems_are_learned(spark):
    """Slurs that no list holds: a stem with many endings. Clean texts show it here and there, near copies count once."""
    rng = np.random.default_rng(3)
    syllables = "ka lo mi ren to su var pe nid gol".split()

    def text(toxic, k):
        words = ["".join(syllables[j] for j in rng.integers(0, 10, int(rng.integers(1, 4)))) for _ in range(80)]
        for at in rng.integers(0, 80, 6 if toxic else int(k % 9 == 0)):
            words[at] = "grunz" + syllables[int(rng.integers(10))]
        return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))

    rows = [(k, text(k % 6 == 0, k), int(k % 6 == 0)) for k in range(600)]
    copy = "once only this fleeb stands here. " + "and so on it goes " * 5
    rows += [(1000 + k, f"{copy}{k}", 1) for k in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.learned_stems(docs, labels) == ("gru",)
    got = {r.doc_id: (r.held_out, r.predicted) for r in toxicity.judge(docs, labels).collect()}
    held = [(y, got[i][1]) for i, _, y in rows[:600] if got[i][0]]
    assert sum(p for y, p in held if y) >= 0.95 * sum(y for y, _ in held) and sum(p for y, p in held if not y) <= 0.03 * len(held)


def test_toxicity_odd(spark):
    long = "fine words here. " * 100_000 + "you idiot"
    rows = [(1, None, "x"), (2, "", "x"), (3, "you idiot", "x"), (3, "you idiot", "x"), (None, "you idiot", "x"), (4, long, "x"), (5, " . ; ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (9, 0)], "doc_id long, toxic int")
    out = toxicity.judge(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _, _ in rows) and all(r.score is not None for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 5)}) == 1
    assert {r.predicted for r in out if r.doc_id == 3 or r.doc_id is None} == {1}
    (m,) = next(r for r in out if r.doc_id == 4).matches
    assert (m.start, m.end, m.kind) == (len(long) - 9, len(long), "insult+target")
    assert toxicity.judge(docs.limit(0), labels).count() == 0 and toxicity.judge(docs, labels.limit(0)).count() == len(rows)
    named = toxicity.clauses(docs.select("doc_id", F.col("text").alias("my.text"), F.lit(1).alias("matches")), text="my.text")
    assert named.columns == ["doc_id", "my.text", "n_words", "matches"] and named.where(F.size("matches") > 0).count() == 4


def _whitened(vectors):
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), centred @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitening(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    n, deviation, want, explained = _whitened(np.array([r.embedding for r in vectors]))
    out = QUERIES["op13_whitening"](spark, DATA).collect()
    assert len(out) == 32 * n
    at = {r.vec_id: k for k, r in enumerate(vectors)}
    got = np.zeros((n, 32))
    for r in out:
        k = at[r.vec_id]
        got[k, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[k] and abs(r.explained / explained[r.component - 1] - 1) < 1e-6 and 0 <= r.identity_error < 1e-6
    signs = np.sign((got * want[:, :32]).sum(axis=0))
    assert np.abs(got * signs - want[:, :32]).max() < 1e-6


def test_whitening_copies(spark):
    """Copies weigh as often as they stand; `once` weighs each distinct vector one time."""
    rng = np.random.default_rng(8)
    few = rng.normal(size=(12, 3)).astype(np.float32)
    rows = few[np.append(rng.integers(0, 12, 60), [0] * 40)]
    df = spark.createDataFrame([(k, v.tolist(), k) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, n long")
    n, deviation, want, explained = _whitened(rows)
    out = whitening.whitening(df).collect()
    assert len(out) == 300 and {(r.vec_id, r.deviation) for r in out} == {(k, int(d)) for k, d in enumerate(deviation)}
    got = np.zeros((100, 3))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    seen = whitening.multiplicities(whitening.usable(df))
    assert whitening.fit(seen, once=True).n == seen.count() == len({tuple(v) for v in np.floor(64 * rows)})


def test_whitening_odd(spark):
    kind = "vec_id long, embedding array<float>, x string"
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.5], [-2.0, 4.0]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = [(k, v, "c") for k, v in enumerate(good + bad)] + [(None, good[0], "c"), (0, good[0], "c")]
    out = whitening.whitening(spark.createDataFrame(rows, kind)).collect()
    assert Counter(r.vec_id for r in out) == Counter({0: 4, 1: 2, 2: 2, 3: 2, None: 2}) and {r.n for r in out} == {6}
    same = whitening.whitening(spark.createDataFrame([(k, [1.0, 2.0], "c") for k in range(5)], kind)).collect()
    assert len(same) == 10 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, None, None, None)}
    flat = whitening.whitening(spark.createDataFrame([(k, [float(k), 2.0 * k], "c") for k in range(5)], kind)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-9
    assert whitening.whitening(spark.createDataFrame(rows[:1] * 0, kind)).count() == 0
    assert whitening.whitening(spark.createDataFrame([(1, None, "c")], kind)).count() == 0
