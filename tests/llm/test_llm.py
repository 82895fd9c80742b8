"""Operators of the subpackage llm: SQL twins, brute force, and odd inputs."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.llm import embedding_join, exact_dedup, line_dedup, mixing, ngram_join, packing, pii, quality, url_filter, warc
from waymark.llm.queries import ORACLE, QUERIES
from waymark.llm.shared import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, agree, name):
    agree(QUERIES[name](spark, DATA), ORACLE[name])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated and tied rows, and a column whose name clashes with results."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (7, long), (8, long + " end"), (None, "a b c d e f g h"), (9, None)]
    return spark.createDataFrame([(i, t, None, None if i in (1, 7) else "s", None, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_exact(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (9, 1, 3, False), (3, 3, 1, True), (6, 6, 3, True), (None, 6, 3, False), (7, 7, 1, True), (8, 8, 1, True)} <= got
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact(odd).columns == odd.columns


def test_exact_null_keys(spark):
    """Rows that share a key, null or not, go one by one."""
    rows = [(1, "one text"), (None, "one text"), (None, "only here"), (None, "and  this"), (2, "two"), (2, "one text"), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in exact_dedup.drop_exact(df).collect()}
    assert got == {(1, "one text"), (None, "only here"), (None, "and  this"), (2, "two"), (3, None)}


def test_mixed_null_keys(spark):
    """Each row stands once for each drawn block that holds its first word, whatever its key; rows follow their shards."""
    import corpus_pipeline

    rows = [(None if i % 3 == 0 else i // 2, f"w{i} " * (i % 7), "en", "ab"[i % 2] if i % 5 else None, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mix(df, row="n_chars")
    blocks = Counter((b.source_key, b.block) for b in plan.blocks.collect())
    want = {d.row: blocks[d.source_key, d.home] for d in plan.documents.collect()}
    got = [tuple(r) for r in corpus_pipeline.mixed(spark, df, DATA).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows for _ in range(want[r[4]])), key=str)
    assert any(r[0] is None for r in got) and max(want.values()) == 2
    assert abs(sum(len(r[1].split()) for r in got) - 1.5 * sum(len(r[1].split()) for r in rows)) < 40
    assert corpus_pipeline.mixed(spark, df.limit(0), DATA).count() == 0


def test_chunks_are_the_text(spark):
    text = spark.read.parquet(f"{DATA}/documents.parquet").select(exact_dedup.normalised(F.col("text")).alias("t"))
    assert text.where(F.array_join(exact_dedup.chunked(F.col("t")), "") != F.col("t")).count() == 0


def test_ngram_odd(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 5, 6), (None, 5, 6)} <= got
    assert {c for i, _, c in got if i in (7, 8)} == {7}
    assert ngram_join.near_groups(none).count() == 0


def test_ngram_null_keys(spark):
    """Rows with a null or a repeated key are no bridge between groups: each is near its own text only."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(9, b), (5, a), (None, a + " more"), (None, b + " more"), (None, c), (None, c + " more"), (7, a + " seven"), (7, "quite another text of seven words"), (11, b + " eleven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(df).collect()), key=str)
    assert got == sorted([(9, 197, 9), (5, 197, 5), (None, 198, 5), (None, 198, 9), (None, 197, None), (None, 198, None), (7, 198, 5), (7, 3, 7), (11, 198, 9)], key=str)
    kept = [tuple(r) for r in ngram_join.drop_near(df, n=4, percent=85).collect()]
    assert sorted(kept, key=str) == sorted([rows[i] for i in (0, 1, 2, 3, 4, 5, 7)], key=str)


def _brute(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [80, 85])
def test_ngram_brute_force(spark, percent):
    """Chains of edits of a few texts, such that many pairs are near the threshold and some link only through others."""
    rng = np.random.default_rng(percent)
    texts = []
    for family in range(6):
        words = [f"w{family}x{k}" for k in rng.integers(0, 5000, 60 if family < 3 else 500)]
        for _ in range(25):
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 1 + len(words) // 60))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(1 << 30)}"
    shared = " ".join(f"common{k}" for k in range(60))
    texts += [shared + " " + " ".join(f"u{i}v{k}" for k in range(40)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(df, n=5, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts, 5, percent)


def _families(seed):
    """Chains of edits of a few texts, texts that share a passage, and one that links two chains' ends only to themselves."""
    rng, texts = np.random.default_rng(seed), []
    for family in range(4):
        words = [f"w{family}x{k}" for k in rng.integers(0, 5000, 60 if family < 2 else 400)]
        for _ in range(14):
            texts.append(" ".join(words))
            for _ in range(int(rng.integers(0, 1 + len(words) // 60))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(1 << 30)}"
    shared = " ".join(f"common{k}" for k in range(60))
    return texts + [shared + " " + " ".join(f"u{i}v{k}" for k in range(40)) for i in range(12)]


@pytest.mark.parametrize("way", ["blocks", "poor"])
def test_ngram_ways_out(spark, monkeypatch, way):
    """All links by blocks, of several sizes and by lists as well as by families; and sets with too few hashes in their part."""
    texts = _families(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = ngram_join.CLASSES
    if way == "blocks":
        monkeypatch.setattr(ngram_join, "STARS", 0)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
    else:
        classes = ((0, None), (40, 1.02), (150, 1.01))
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(df, n=5, percent=80, classes=classes).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts, 5, 80)


def test_drops_on_odd_rows(spark, odd, none):
    """Rows out of both drops are those of a plain model: nulls, repeats, ties, and columns named like the operators' own."""
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "quite another text of words"), (None, "a b c d e f g h"), (None, "other"), (3, None), (4, ""), (5, None), (1, "a b c d e f g h"), (6, "A  b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("__gone", "__row", "key", "doc", "sha", "kept", "a.b", "component"):
        df = df.withColumn(c, F.lit(1))
    exact = [0, 2, 4, 5, 8, 9]  # of equal texts the smallest key's rows; the null key's copy goes, "other" stays
    near = [0, 2, 3, 4, 5, 6, 7, 8]  # rows without words or with a null key stay; doc 6 equals doc 1 in lower case
    for out, want in ((exact_dedup.drop_exact(df), exact), (ngram_join.drop_near(df), near)):
        assert out.columns == df.columns
        assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([rows[i] for i in want], key=str)
    for drop in (exact_dedup.drop_exact, ngram_join.drop_near):
        assert drop(none).count() == 0
        left = drop(odd)
        assert left.columns == odd.columns and left.count() == {exact_dedup.drop_exact: 8, ngram_join.drop_near: 9}[drop]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32))
    rows = [b for x in base for b in (x, x + 0.05 * rng.standard_normal(32), x + 0.22 * rng.standard_normal(32), 3 * x)]
    data = [(i, [float(np.float32(y)) for y in x]) for i, x in enumerate(rows)]
    data += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [None] * 32), (1005, [1.0, 2.0]), (1006, [float("inf")] + [1.0] * 31), (None, data[0][1]), (1007, data[0][1]), (1007, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    good = [(i, np.array(x, float)) for i, x in data if i is not None and (i < 1000 or i == 1007)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    links = x @ x.T >= 0.95
    want = {}
    for k, (i, _) in enumerate(good):
        seen, edge = {k}, [k]
        while edge:
            new = [j for j in np.flatnonzero(links[edge].any(0)) if j not in seen]
            seen.update(new)
            edge = new
        want[i] = (int(links[k].sum()) - 1, min(good[j][0] for j in seen))
    got = embedding_join.near_vectors(df).collect()
    assert len(got) == len(data)
    for r in got:
        if r.vec_id in want:
            assert (r.n_links, r.component_id) == want[r.vec_id]
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_pii(spark):
    text = "é mail a.b@x.org, call +44 (0)20 7946 0958; card 4111 1111 1111 1111 or 4111 1111 1111 1112; ip 10.0.0.255 10.0.0.256; iban DE89 3704 0044 0532 0130 00; ssn 123-45-6789, 123-45-6789"
    df = spark.createDataFrame([(1, text, "c"), (2, None, "c")], "doc_id long, text string, pii string")
    rows = {r.doc_id: r.pii for r in pii.find_pii(df).collect()}
    found = [(s.kind, text[s.start : s.end]) for s in rows[1]]
    assert found == [("email", "a.b@x.org"), ("phone", "+44 (0)20 7946 0958"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("ssn", "123-45-6789")]
    assert rows[2] == []
    assert "<card>" in pii.mask(pii.find_pii(df)).where("doc_id = 1").first().masked


def test_pii_context(spark):
    """Words on both sides count, past other matches of the kind, and only within the window; they raise the score."""
    far = "x" * 60
    cases = [
        ("Social security: 123-45-6789, 123-45-6780, 123-45-6781", [("ssn", 70)] * 3), ("123-45-6789 is my ssn", [("ssn", 70)]), ("123-45-6789", []), (f"ssn {far} 123-45-6789 {far} ssn", []),
        ("ip 10.0.0.1", [("ip", 90)]), ("ship 10.0.0.1", [("ip", 60)]), ("DE89370400440532013000", [("iban", 60)]), ("DE89370400440532013000 konto", [("iban", 90)]),
        ('token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', [("secret", 70)]), ("f33e61083db5dbdf4bd2369d2f80176e57f7fda2", []), ("password: abcdefghijklmnopqrstuvwxyz", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.score) for s in r.pii] == cases[r.doc_id][1], r.text


def _planted(kind, rng):
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    if kind == "iban":
        n = d(18)
        return f"DE{98 - int(n + '131400') % 97:02d}{n}"
    if kind == "ssn":
        return f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"
    if kind == "nir":
        n = f"{rng.integers(1, 3)}{d(2)}{rng.integers(1, 13):02d}{rng.integers(10, 95)}{d(6)}"
        return f"{n}{97 - int(n) % 97:02d}"
    if kind == "dni":
        n = d(8)
        return n + "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23]
    while kind == "nhs":
        n = d(9)
        c = (11 - sum(int(x) * (10 - i) for i, x in enumerate(n)) % 11) % 11
        if c < 10:
            return f"{n[:3]} {n[3:6]} {n[6:]}{c}"
    if kind == "aba":
        n = d(8)
        return n + str(-sum(int(x) * (3, 7, 1)[i % 3] for i, x in enumerate(n)) % 10)
    return "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 40))


def test_pii_recall_of_added_kinds(spark):
    """Planted spans of each kind, with a context word near by, are found; with one digit altered, those of a checksum go."""
    rng, words = np.random.default_rng(2), {"iban": "account", "ssn": "ssn", "nir": "securite sociale", "dni": "DNI", "nhs": "NHS number", "aba": "routing", "secret": "api_key"}
    rows, truth = [], {}
    for kind, word in words.items():
        for k in range(100):
            good = _planted(kind, rng)
            bad = good[:-2] + str((int(good[-2]) + 1) % 10) + good[-1] if kind not in ("ssn", "secret") else ""
            text = f"lorem {word}: {good} ipsum" if k % 2 else f"lorem {good} ({word}) ipsum"
            truth[len(rows)] = (kind, text.index(good), good)
            rows += [(len(rows), text), (len(rows) + 1, f"{word} {bad} end")]
    found = {r.doc_id: {(s.kind, s.start, r.text[s.start : s.end]) for s in r.pii} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in words:
        mine = [i for i, t in truth.items() if t[0] == kind]
        assert sum(truth[i] in found[i] for i in mine) >= 90, kind
        assert not any(kind == s[0] for i in mine for s in found[i + 1]), kind


def test_pii_odd(spark, none):
    """Clashing and dotted names, repeated rows, an empty table; a long text with very many matches takes no longer than its length."""
    began, many = time.time(), 40_000
    text = "".join(f"a{i}@x.org ssn 123-45-6789 DE89370400440532013000 é, " for i in range(many))
    df = spark.createDataFrame([(1, "b@x.org"), (1, "b@x.org"), (None, None), (2, ""), (3, text)], "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2)).withColumn("m_ip", F.lit(3)).withColumn("a`c", F.lit(4))
    got = pii.mask(pii.find_pii(df)).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "a.b", "row", "m_ip", "a`c", "pii", "masked"}
    assert sorted(len(r.pii) for r in got) == [0, 0, 1, 1, 3 * many]
    assert [r.masked for r in got if r.doc_id == 3] == ["<email> ssn <ssn> <iban> é, " * many] and {r.masked for r in got if r.doc_id != 3} == {"<email>", ""}
    assert time.time() - began < 90
    assert pii.find_pii(none).count() == 0 and pii.digest(none).count() == 0


def test_pii_iban_neighbours(spark):
    """Upper-case words and other IBANs next to an IBAN don't hide it."""
    es, de, at, no = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947"
    cases = [(f"{es} BIC", [es]), (f"é {es} BANK OF X", [es]), (f"{es} {de}", [es, de]), (f"{at} {es} {no}", [at, es, no]), (f"{es.replace(' ', '')} 12, {no}A", [es.replace(" ", "")]), (f"AB12 {de}", [de]), (f"{es[:-1]}3 BIC", []), (f"X{es}", []), ("", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [r.text[s.start : s.end] for s in r.pii if s.kind == "iban"] == cases[r.doc_id][1], r.text


def test_mix(odd, none):
    plan = mixing.mix(odd, block_words=64, shard_blocks=8)
    got = mixing.taken(plan).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 2 * 2 * 64
    blocks = plan.blocks.collect()
    assert len({(b.source_key, b["pass"], b.block) for b in blocks}) == len(blocks)
    per = np.bincount([b.shard for b in blocks])
    assert per.max() - per.min() <= 1
    assert mixing.taken(mixing.mix(none)).count() == 0


def test_mix_through_its_tree(spark):
    """The tree decides: strata give their quotas exactly, in whole passes every block once; shards hold what a draw
    without replacement gives them; pieces of a pass are disjoint; another tree takes other blocks; reruns agree."""
    rows = [(i, "w " * (20 + i * 7919 % 60), "ab"[i % 4 == 0]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    plan = mixing.mix(df, block_words=32, shard_blocks=40, least_blocks=1)
    blocks = plan.blocks.collect()
    target = {d.source_key[1:]: d.target for d in plan.documents.collect()}
    many = {s: -(-n // 32) for s, n in size.items()}
    given = Counter((b.source_key[1:], b["pass"]) for b in blocks)
    for s in "ab":
        whole = int(target[s] // size[s])
        assert all(given[s, p] == many[s] for p in range(whole))
        assert given[s, whole] == min(many[s], round((int(target[s]) - whole * size[s]) / 32))
    assert len({(b.source_key, b["pass"], b.block) for b in blocks}) == len(blocks) and {b.block for b in blocks if b.source_key == "sa"} == set(range(many["a"]))
    shards = max(b.shard for b in blocks) + 1
    assert sorted((b.shard, b.position) for b in blocks) == [(k, j + 1) for k, n in sorted(Counter(b.shard for b in blocks).items()) for j in range(n)]
    # sizes of one stratum's parts: mean and variance of a hypergeometric draw
    marked, per, total = given["a", 0], len(blocks) / shards, len(blocks)
    part = [sum(1 for b in blocks if b.shard == k and b.source_key == "sa" and b["pass"] == 0) for k in range(shards)]
    variance = per * (marked / total) * (1 - marked / total) * (total - per) / (total - 1)
    assert 0.4 * variance < np.var(part) < 2 * variance
    got = mixing.drawn(plan).collect()
    seen = [(r.source_key, r["pass"], r.start + r.doc_from + k) for r in got for k in range(r.length)]
    assert len(seen) == len(set(seen)) and all(0 <= r.doc_from < r.doc_from + r.length for r in got)
    took = lambda p: {r.doc_id: (r.taken, r.shard) for r in mixing.taken(p).collect()}
    one, again, other = took(plan), took(mixing.mix(df, block_words=32, shard_blocks=40, least_blocks=1)), took(mixing.mix(df, block_words=32, shard_blocks=7, least_blocks=1))
    assert one == again and {k: v[0] for k, v in one.items()} != {k: v[0] for k, v in other.items()}
    assert {k: v[0] for k, v in one.items()} == {k: sum(r.length for r in got if r.doc_id == k) for k in one}


def test_hypergeometric(spark):
    """Draws follow the distribution: 20 marked of 60, 15 drawn."""
    rows = spark.range(20_000).select(mixing.hypergeometric(F.lit(60), F.lit(20), F.lit(15), mixing._uniform(F.col("id"))).alias("x"))
    r = rows.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert abs(r.m - 5) < 0.06 and abs(r.v - 15 / 60 * 20 * 40 / 60 * 45 / 59) < 0.12 and 0 <= r.lo and r.hi <= 15


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x"), (2, "https://a.example.com/en/?q"), (3, "http://x.net/es/"), (4, "http://x.net/es"), (5, None), (6, "no scheme"), (7, "http://x.com"), (7, "http://x.com"), (8, "http://notexample.com/en/")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, rule string")
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.RULES).orderBy("page_id").collect()]
    assert got == [(1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, "net/es/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (7, None, "allow"), (8, "com/", "allow")]
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0


def test_line_chunks(spark):
    passage = "\n".join(f"line {k} of the passage" for k in range(12))
    rows = [(1, f"start one\n{passage}\nend"), (2, f"other\nlines\nhere\n{passage}\nand an end"), (3, None), (4, ""), (5, f"x\n{passage}")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text is None and got[4].text == ""
    assert got[2].removed_lines >= 6 and got[5].removed_lines >= 6


@pytest.mark.parametrize("line", ["строка отрывка", "γραμμή του κειμένου", "سطر من النص", "這是一行文字", "१२३"])
def test_line_chunks_any_script(spark, line):
    turns = "абвгде" if line.startswith("с") else "αβγδεζ"
    passage = "\n".join(f"{line} {a}{b}" for a in turns for b in turns)
    rows = [(1, f"start\n{passage}\nend"), (2, f"other\nlines\n{passage}\nand an end"), (3, "--\n==\n" * 9), (4, "--\n==\n" * 9)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].removed_lines >= 6 and got[4].text == rows[3][1]


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = packing.pack_documents(docs).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got[::7]:
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in got}.values()) + 9  # doc 6, of nine ids, stands twice
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
    assert packing.pack_documents(none).count() == 0


def test_first_fit_decreasing():
    lengths = np.random.default_rng(1).integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for k in np.argsort(-lengths, kind="stable"):
        at = next((i for i, r in enumerate(room) if r >= lengths[k]), len(room))
        if at == len(room):
            room.append(100)
        want[k] = (at, 100 - room[at])
        room[at] -= lengths[k]
    assert all((bins[k], offsets[k]) == v for k, v in want.items())


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    bad, good = ([r.score for r in rows if r.quality == k] for k in (0, 1))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert quality.judge(none, labels).count() == 0
    scores = quality.score(odd, quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0)).collect()
    assert len(scores) == odd.count() and {r.score for r in scores} == {0.5}
    assert quality.train([], np.empty(0)).bias == 0


def test_quality_scores_are_plain_means(spark, odd):
    """Remembered words give what a plain mean over all features and a softmax give, for long, empty and odd texts."""
    rng = np.random.default_rng(4)
    model = quality.Model(rng.standard_normal(quality.BUCKETS).astype(np.float32) * 5, 0.3)
    df = odd.unionByName(spark.createDataFrame([(20, "é ñ x x x \u2028 一二三 \ud83d\ude00"), (21, "w " * 300_000), (22, "solo")], "doc_id long, text string"), allowMissingColumns=True)
    for r in quality.score(df, model).collect():
        at, share = quality.document_features(r.text)
        z = model.bias + (float(share @ model.weights[at].astype(float)) if len(at) else 0.0)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_packing_loses_nothing():
    for text in [None, "", "a", "one two two two", "é 一二三 " * 9000]:
        want, got = quality.document_features(text), quality.unpacked_features(quality.packed_features(text))
        assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])


def test_quality_training_is_plain(spark):
    """train() against a loop that updates vector by vector."""
    texts, labels = ["good word one", "bad bad bad", "good two", "bad bad", ""], np.array([1, 0, 1, 0, 1])
    got = quality.train([quality.document_features(t) for t in texts], labels, epochs=3)
    rng = np.random.default_rng(quality.SEED)
    e = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32).astype(float)
    w, b, k = np.zeros((2, quality.DIM)), np.zeros(2), 0
    for _ in range(3):
        for i in rng.permutation(len(texts)):
            rate, k = quality.RATE * (1 - k / 15), k + 1
            f = list(zip(*quality.document_features(texts[i]), strict=True))
            mean = sum((s * e[a] for a, s in f), np.zeros(quality.DIM))
            p = np.exp(w @ mean + b) / np.exp(w @ mean + b).sum()
            p[labels[i]] -= 1
            back = p @ w
            w, b = w - rate * np.outer(p, mean), b - rate * p
            for a, s in f:
                e[a] -= rate * s / sum(x * x for _, x in f) * back
    assert np.allclose(got.weights, e @ (w[1] - w[0]), atol=1e-4) and abs(got.bias - (b[1] - b[0])) < 1e-4


def test_quality_odd_labels(spark, odd):
    """Null, repeated and one-sided labels, labels without documents, no labels at all."""
    fit = lambda rows: quality.fit(odd, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert not fit([]).weights.any() and not fit([(1, None), (None, 1), (99, 1)]).weights.any()
    one_sided = fit([(6, 1), (4, 1), (3, 1)])
    assert not one_sided.weights.any() and one_sided.bias > 0
    assert fit([(6, 1), (6, 1), (4, 0), (3, 1), (7, 0), (8, 1), (2, 0)]).weights.any()


def test_warc(spark):
    rows = [(1, "http://a/", "<head><title>t</title></head><p>one</p><script>x</script>two &amp; three"), (2, None, None)]
    got = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string")))
    text = {(r.page_id, r.warc_type): r for r in got.collect()}
    assert text[1, "conversion"].block == "one\ntwo & three" and text[2, "conversion"].block == ""
    assert text[1, "conversion"].warc_refers_to == text[1, "metadata"].warc_refers_to
    assert b"WARC-Refers-To: <urn:uuid:" in warc.to_bytes(got).first().record


def test_warc_odd(spark):
    """Nulls, repeated rows, clashing columns, an empty table; two captures of a page have different identifiers."""
    rows = [(None, None, None, 1), (1, "u", "<p>a</p>", 2), (1, "u", "<p>a</p>", 3), (1, "u", "<p>b</p>", 4), (2, "u", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, block int").withColumn("a.b", F.lit(1))
    got = warc.derivatives(warc.responses(df)).collect()
    assert len(got) == 10 and all(r.block is not None and r.content_length == len(r.block.encode()) for r in got)
    assert len({r.warc_refers_to for r in got if r.page_id == 1}) == 2 and len({r.warc_record_id for r in got}) == 8
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


@pytest.mark.parametrize("part", ["<", "<script ", "<!--", "<br ", "<head>", "<script>", "&lt", "\n "])
def test_warc_long(spark, part):
    """A page of one hostile piece, again and again: time grows with its length only."""
    began = time.time()
    df = spark.createDataFrame([(1, "u", part * (1_000_000 // len(part)))], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses(df)).count() == 2
    assert warc.derivatives(warc.responses(df)).select(F.sum("content_length")).first()[0] > 0
    assert time.time() - began < 30


def test_warc_records(spark):
    """Heads are read, and written again for what is derived."""
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nwarc-date: 2020-01-01T00:00:00Z\r\n\r\n"
    http = "HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=ISO-8859-1\r\nServer: x\r\n\r\n"
    rows = [(1, bytearray((head + http + "<p>caf\xe9</p>\r\n\r\nmore").encode("latin1"))), (2, bytearray(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\n")), (3, None), (4, bytearray(b""))]
    got = warc.parse_responses(spark.createDataFrame(rows, "page_id long, record binary"))
    (r,) = got.collect()
    assert (r.record_id, r.target_uri, r.date, r.status, r.charset, r.content_type) == ("<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", 404, "iso-8859-1", "text/html")
    assert r.payload == "<p>caf\xe9</p>\r\n\r\nmore" and r.headers == ["Content-Type: text/html; charset=ISO-8859-1", "Server: x"]
    made = {d.warc_type: d for d in warc.derivatives(got).collect()}
    assert "source-http-header: Server: x\r\n" in made["metadata"].block and "source-http-status: 404\r\n" in made["metadata"].block and made["conversion"].block == "caf\xe9\nmore"
    text = [x.record.decode() for x in warc.to_bytes(warc.derivatives(got), "2024-01-01T00:00:00Z").collect()]
    assert all(f"WARC-Refers-To: <urn:uuid:1>\r\nWARC-Refers-To-Target-URI: http://a/\r\nWARC-Refers-To-Date: 2020-01-01T00:00:00Z\r\nWARC-Refers-To-Payload-Digest: {made['metadata'].source_digest}\r\n" in x for x in text)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, DATA))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
