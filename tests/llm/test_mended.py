"""Cases that an earlier review found: WARC records as they come, keys that are null or repeated, low percents, groups of pieces."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from waymark.llm import line_dedup, mixing, ngram_join, packing, warc

HEAD = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\n\r\n"


def _parsed(spark, *records):
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(records)], "page_id long, record binary")
    return {r.page_id: r for r in warc.parse_responses(df).collect()}


def test_warc_many_headers(spark):
    http = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %d\r\n" % (i, i) for i in range(10_051)) + b"\r\n"
    (r,) = _parsed(spark, HEAD + http + b"<p>x</p>").values()
    assert len(r.headers) == 10_051 and r.headers[-1] == "X-10050: 10050" and r.payload == "<p>x</p>"


def test_warc_charset_and_bytes(spark):
    """The charset is the HTTP head's: a page that names another in its markup is read as the head says; broken bytes end no job."""
    utf = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    latin = b"HTTP/1.1 200 OK\r\n" + b"X: y\r\n" * 1000 + b"Content-Type: text/html; charset=ISO-8859-1\r\n\r\n"
    page = '<meta charset=iso-8859-1 content="charset=iso-8859-1"><p>caf\xe9</p>'
    got = _parsed(spark, HEAD + utf + page.encode(), HEAD + latin + page.encode("latin1"), HEAD + utf + b"<p>a\xff\xfeb \xc3</p>", b"\xff\xfe\x00", None, b"", HEAD + b"HTTP/1.1 204 No\n\n", HEAD)
    assert got[0].payload == page and got[1].payload == page and (got[0].charset, got[1].charset) == ("utf-8", "iso-8859-1")
    assert got[2].payload == "<p>a��b �</p>" and (got[6].status, got[6].payload, got[7].payload, got[7].status) == (204, "", "", None)
    assert set(got) == {0, 1, 2, 6, 7}


def test_warc_entities(spark):
    cases = {
        "a &#8217; &#x2019; &eacute;&Eacute; &hellip;": "a ’ ’ \xe9\xc9 …", "&amp;lt; &lt;b&gt; &quot;&#39;&apos;": "&lt; <b> \"''", "x&nbsp;&#160; y": "x y", "AT&T & &unknown; &#xD800; &#0; &#1114112; &;": "AT&T & &unknown; &#xD800; &#0; &#1114112; &;",
        "&#128512;": "\U0001f600", "&": "&", "&amp": "&amp",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "html string, want string").withColumn("got", warc.html_text(F.col("html")))
    assert [(r.html, r.got) for r in df.collect() if r.got != r.want] == []


def test_warc_content_types(spark):
    def block(kind, body):
        (r,) = [d for d in warc.derivatives(warc.parse_responses(spark.createDataFrame([(1, bytearray(HEAD + b"HTTP/1.1 200 OK\r\n" + kind + b"\r\n" + body))], "page_id long, record binary"))).collect() if d.warc_type == "conversion"]
        return r.block

    assert block(b"Content-Type: text/plain\r\n", b"1 < 2 and <b> stays & so") == "1 < 2 and <b> stays & so"
    assert block(b"Content-Type: application/pdf\r\n", b"%PDF-1.4 \xff\xfe") == "" and block(b"Content-Type: application/ld+json\r\n", b'{"a": "<b>"}') == '{"a": "<b>"}'
    assert block(b"", b"<p>x</p>") == "x" and block(b"Content-Type: TEXT/HTML\r\n", b"<p>x</p>") == "x"


PASSAGE = "\n".join(f"line {i} of a passage that two texts share" for i in range(40))


def _lines(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, `my.text` string, text string")
    return sorted(((r.doc_id, r.removed_lines, r["my.text"]) for r in line_dedup.drop_repeated_lines(df.withColumnRenamed("text", "n_lines"), text="my.text").withColumnRenamed("text", "my.text").collect()), key=str)


@pytest.mark.parametrize("keys", [(1, 2), (None, None), (5, 5), (None, 9223372036854775807), (7, None)])
def test_line_dedup_keys(spark, keys):
    """Of two texts with a passage in common one keeps it, whatever their keys."""
    texts = (f"alpha one\nalpha two\n{PASSAGE}\nalpha end", f"beta one\n{PASSAGE}\nbeta two\nbeta end")
    got = _lines(spark, list(zip(keys, texts, strict=True)))
    assert sorted(n for _, n, _ in got)[0] == 0 and max(n for _, n, _ in got) == 40
    assert sum(t.count("passage") for _, _, t in got) == 80 - max(n for _, n, _ in got)
    if keys == (1, 2) or keys[0] == 7:
        assert {n for k, n, _ in got if k == keys[0]} == {0}


def test_line_dedup_odd(spark):
    rows = [(1, None), (2, ""), (3, PASSAGE), (3, PASSAGE), (None, None), (4, "\n\n\n"), (None, PASSAGE)]
    got = _lines(spark, rows)
    assert len(got) == 7 and sum(n > 0 for _, n, _ in got) == 1 and (1, 0, None) in got and (2, 0, "") in got
    assert {n for k, n, _ in got if k == 3} == {0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_line_dedup_long_copies(spark):
    """What goes from a long text is found by a set, not chunk by chunk."""
    long = "\n".join(f"a line number {i}" for i in range(120_000))
    began = time.time()
    got = {r.doc_id: r.removed_lines for r in line_dedup.drop_repeated_lines(spark.createDataFrame([(1, long), (2, long + "\nx")], "doc_id long, text string")).collect()}
    assert got[1] == 0 and got[2] == 120_000 and time.time() - began < 60


@pytest.mark.parametrize("percent", [5, 20, 24, 40])
def test_ngram_low_percent(spark, percent):
    """Sets that a low percent would put into three size classes are linked too."""
    rng = np.random.default_rng(percent)
    texts = []
    for k, (small, large) in enumerate([(350, 1740), (20, 90), (60, 1100), (130, 3000), (8, 30)]):
        words = [f"w{k}x{i}" for i in rng.permutation(large)]
        texts += [" ".join(words), " ".join(words[:small]), " ".join(words[large // 2 :])]
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=2, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_pack_groups_are_bounded(spark):
    """A few long documents, or one row many times, still make groups of bounded size; every piece stands once, gapless, up to the size."""
    rows = [(d, s * 4096, 4096 if s < 499 else 100, 7, 499 * 4096 + 100) for d in range(4) for s in range(500)] + [(9, 0, 300, 3, 300)] * 1500
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack(pieces, group=200).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == sorted(r[:3] for r in rows)
    groups = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(groups) == 18 and max(map(len, groups.values())) < 300
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 4096
    assert sum(4096 - sum(n for _, n in s) for s in sequences.values()) < 0.05 * 4096 * len(sequences)


def test_mix_null_keys_are_spread(spark):
    df = spark.createDataFrame([(None, f"some words {i}", "s") for i in range(5000)], "doc_id long, text string, source string")
    out = mixing.taken(mixing.mix(df)).collect()
    assert len(out) == 5000 and abs(sum(r.taken for r in out) - 1.5 * 15_000) < 100
    slices = mixing.mix(df).documents.groupBy("source_key", "start").count().where("count > 1")
    assert slices.count() == 0


@pytest.mark.parametrize("long", [2, 3, 4])
def test_line_dedup_short_passages(spark, long):
    """Repeated passages of two to four lines go from all texts but the first, wherever they stand; what is said once stays."""
    rng = np.random.default_rng(long)
    passages = [[f"passage {p} line {i}" for i in range(long)] for p in range(30)]
    rows, copies = [], 0
    for d in range(120):
        body = [f"text {d} line {i}" for i in range(6)]
        for p in rng.choice(30, 2, replace=False):
            at = int(rng.integers(0, len(body) + 1))
            while 0 < at < len(body) and body[at].startswith("passage") and body[at - 1].startswith("passage"):
                at -= 1
            body[at:at] = passages[p]
            copies += 1
        rows.append((d, "\n".join(body)))
    first = {p for p in range(30) if any(f"passage {p} line 0" in t for _, t in rows)}
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = sum(r.text.count(" line 0\n") + r.text.endswith(" line 0") for r in got.values()) - 120
    assert left == len(first) and sum(r.removed_lines for r in got.values()) == (copies - len(first)) * long
    assert all(sum(x.startswith(f"text {d} ") for x in r.text.split("\n")) == 6 for d, r in got.items())


def test_line_dedup_rules(spark):
    """Single lines stay unless they have more than 50 words; lines without letters belong to the one before; repeats in one text count."""
    many, few = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"{many}\nb\n{few}\nc"), (2, f"d\n{many}\ne"), (3, f"f\n{few}\ng"), (4, "h\n\ni\n--\nj"), (5, "--\nh\n***\ni\n\n\nk"), (6, "x\ny\nz\nx\ny"), (7, "x\n\n7")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_chunks, r.removed_chunks, r.removed_lines) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 4, 1, 0, 0) and got[2] == ("d\ne", 3, 3, 1, 1) and got[3] == (rows[2][1], 3, 1, 0, 0)
    assert got[4] == (rows[3][1], 5, 1, 0, 0) and got[5] == ("--\nk", 7, 3, 1, 5) and got[6] == ("x\ny\nz", 5, 2, 1, 2) and got[7] == (rows[6][1], 3, 1, 0, 0)


def test_line_dedup_twin(spark, agree):
    agree(line_dedup.drop_repeated_lines(spark.read.parquet(f"{DATA}/documents.parquet")), line_dedup.ORACLE)


def test_new_words_are_learned_together():
    """Texts' ids are the tokenizer's own, and the words of many texts are learned at once, without the signs after them."""
    from tokenizers import Tokenizer

    from waymark.llm import packing, tokens

    path = packing.tokenizer_path()
    own, ids = Tokenizer.from_file(path), tokens.WordIds(path)
    learned = []
    learn = ids._learn
    ids._learn = lambda: (learned.append(len(ids.known.new)), learn())[1]
    texts = ["", "~", "a~ b~c. ~~", "Straße, É á.x é", "don't. I'LL! it's,", "x_y__ _", "3.14, 10%", "ǅ ǆ. ß,", "foo.bar, (foo) foo<", "foo< |bar <|endoftext|> x", "ﬁ ﬁ. İ i̇ Σς.", "aª, º. a,́b c.́", "日本語。 日,", *[f"mot{'abcdefghij'[k % 10] * (k % 7)}, oui." for k in range(100)]]
    assert [x.tolist() for x in ids.encode_all(texts)] == [own.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(learned) == 1 and b"oui" in ids.known
    assert [x.tolist() for x in ids.encode_all(texts)] == [own.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(learned) == 1


def test_shingles_take_little_memory():
    """Texts are hashed some at a time: what a worker takes doesn't follow the table."""
    import tracemalloc

    from waymark.llm.shingles import shingle_sets

    texts = [" ".join(f"w{k * 31 % 977}x{j}" for j in range(400)) for k in range(1000)]
    tracemalloc.start()
    found = sum(len(s) for s in shingle_sets(iter(texts), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 396_000 and peak < 25e6


def test_tokens_of_few_words_at_once():
    """One tokenizer, which gets few words at once, since what it returns is far larger than the ids."""
    from waymark.llm import packing, tokens

    ids = tokens.WordIds(packing.tokenizer_path())
    most, own = [], ids.tokenizer

    class Watched:
        def __getattr__(self, name):
            return getattr(own, name)

        def __setattr__(self, name, value):
            setattr(own, name, value)

        def encode_batch_fast(self, texts, **kw):
            most.append(sum(len(t.split()) for t in texts))
            return own.encode_batch_fast(texts, **kw)

    ids.tokenizer = Watched()
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q" for k in range(17_000))
    (got,) = ids.encode_all([text])
    assert got.tolist() == own.encode(text, add_special_tokens=False).ids and len(most) > 1 and max(most) <= 4096
