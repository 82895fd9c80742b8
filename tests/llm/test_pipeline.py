"""The pipeline's stages, each on what the one before kept, against plain Python versions; run() against the stages."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import DATA
from waymark.llm import mixing, packing, quality

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return (text or "").encode().split()


def _score(text, model):
    at, shares = quality.document_features(text)
    z = model.bias + float(shares.astype(np.float64) @ model.weights[at].astype(np.float64)) if len(at) else model.bias
    return 1 / (1 + np.exp(-z))


def _near(texts, n, percent):
    sets = []
    for t in texts:
        w = _words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with null, empty, blank, repeated and nearly repeated texts, null and repeated keys, and a null source."""
    at = str(tmp_path_factory.mktemp("corpus"))
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    some = [r for r in docs if r[1] and 80 < len(_words(r[1])) < 400][:6]
    rows = docs + [(None, None, "en", "s", 0), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \t\n", "en", None, 3)]
    rows += [(9010 + k, r[1], *r[2:]) for k, r in enumerate(some[:2])] + [(None, some[2][1].replace(" ", "  "), "en", "s", 1), some[3], (some[3][0], "another text under a key that is taken", "en", "s", 40)]
    rows += [(9020 + k, r[1] + " and two more", *r[2:]) for k, r in enumerate(some)] + [(None, some[4][1] + " with a null key", "en", None, 2)]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before = _rows(docs)

    # 1. what the classifier rejects goes
    model = quality.fit(docs, labels)
    want = Counter(r for r in before if _score(r[1], model) >= quality.THRESHOLD)
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[0][1](spark, docs, folder))
    after = _rows(docs)
    assert Counter(after) == want and 0 < len(after) <= len(before)

    # 2. of equal texts the row with the smallest key stays, null keys last; rows that repeat key and text stay together
    groups = defaultdict(list)
    for r in after:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[1][1](spark, docs, folder))
    kept = _rows(docs)
    stay = Counter()
    for rs in groups.values():
        first = min(r[0] if r[0] is not None else 1 << 62 for r in rs)
        stay.update([r[:2] for r in rs if (r[0] if r[0] is not None else 1 << 62) == first][: None if first < 1 << 62 else 1])
    assert Counter(r[:2] for r in kept) == stay and all(r in after for r in kept)

    # 3. of near copies the first stays; rows without a key stay too
    order = sorted(set(kept), key=lambda r: (r[0] is None, r[0] or 0))
    found = _near([r[1] for r in order], 5, 80)
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[2][1](spark, docs, folder))
    apart = _rows(docs)
    assert set(apart) == {order[f] for f in set(found)} | {r for r in kept if r[0] is None} and len(apart) < len(kept)

    # 4. the mix repeats and leaves documents so that each source's words come near its target, none more than twice
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[3][1](spark, docs, folder))
    mixed = _rows(docs)
    times = Counter(mixed)
    assert set(times) <= set(apart) and all(n <= 2 * apart.count(r) for r, n in times.items()) and docs.columns == list(corpus_pipeline.COLUMNS)
    plan = {d.source_key: d.target for d in mixing.mix(spark.createDataFrame(apart, KIND)).documents.collect()}
    size, longest = defaultdict(int), defaultdict(int)
    for r in mixed:
        size["n" if r[3] is None else f"s{r[3]}"] += len(_words(r[1]))
    for r in apart:
        key = "n" if r[3] is None else f"s{r[3]}"
        longest[key] = max(longest[key], len(_words(r[1])))
    # documents stand whole, so that a source may miss its target by about its longest
    assert all(abs(size[k] - t) <= 2 * longest[k] + 4 for k, t in plan.items())

    # 5. every id of every document stands once, gapless, in sequences of 4096 at most
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = Counter()
    for r in mixed:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            pieces[r[0], s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= 4096
    tokens = sum(n for _, _, n, _, _ in pieces.elements())
    assert len(sequences) * 4096 - tokens <= 0.05 * tokens + 4096

    # run() is the stages one after the other
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in whole) == pieces


def test_run_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
