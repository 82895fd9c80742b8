"""Supervised subword embeddings for document quality, trained with numpy stochastic gradient descent."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the training sample: labelled rows, by a hash of their key.
TRAIN_DOCS = 4000
BUCKETS, DIM, GRAMS, EPOCHS, RATE, SEED = 1 << 16, 8, (3, 4, 5), 8, 0.5, 11
FOLDS, THRESHOLD = 5, 0.3
#: Words that a worker remembers before it forgets them all; words of a longer text are scored by parts of so many.
REMEMBERED, PART = 150_000, 20_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9)


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, counts, hashes): hashed features of each word, one after the other, and how many each has: the word itself
    and its character n-grams with marks at both ends; and each word's own hash."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    a = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts, owner = ends - sizes, np.repeat(np.arange(len(words)), sizes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), _P))
        hashes, owners = [np.add.reduceat((a + np.uint64(1)) * powers[np.arange(len(a)) - starts[owner]], starts)], [np.arange(len(words))]
        for n in GRAMS:
            if len(a) < n:
                continue
            h = np.full(len(a) - n + 1, np.uint64(n))
            for j in range(n):
                h = h * _P + a[j : len(a) - n + 1 + j]
            ok = np.arange(len(h)) + n <= ends[owner[: len(h)]]
            hashes.append(h[ok])
            owners.append(owner[: len(h)][ok])
        h, o = np.concatenate(hashes), np.concatenate(owners)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    order = np.argsort(o, kind="stable")
    return (h[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(o, minlength=len(words)), h[: len(words)]


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a text's word bigrams, from its words' hashes. A word that stands twice in a row is one and the same
    bigram, whatever the word."""
    a, b = hashes[:-1], hashes[1:]
    with np.errstate(over="ignore"):
        h = (a * _P + b) * _Q * (a != b)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def feature_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the distinct features of a text (words, their character n-grams, word bigrams), in order of bucket."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    counts, hashes = np.zeros(BUCKETS, np.int64), []
    for s in range(0, len(words), PART):
        b, _, h = word_features(words[s : s + PART])
        counts += np.bincount(b, minlength=BUCKETS)
        hashes.append(h)
    counts += np.bincount(pair_features(np.concatenate(hashes)), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares): the distinct features of a text and how much of all its features each is."""
    at, counts = feature_counts(text)
    return at, (counts / max(1, counts.sum())).astype(np.float32)


def packed_features(text: str | None) -> bytes:
    at, counts = feature_counts(text)
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + counts.astype("<u4").tobytes(), 1)


def unpacked_features(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    counts = np.frombuffer(raw, "<u4", n, 2 * n).astype(np.float64)
    return np.cumsum(np.frombuffer(raw, "<u2", n), dtype=np.int32), (counts / max(1.0, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """What a document's score needs: one number for each bucket (its vector times the difference of the softmax rows)
    and the difference of the biases."""

    weights: np.ndarray
    bias: float


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Softmax over the mean of hashed word and n-gram vectors (docs: document_features of each); one step for each document,
    in seeded random order, at a falling rate; the vectors' step is divided by the squared length of the shares, so that it
    moves short and long documents alike. Without rows of both classes the bias alone speaks."""
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), 2.0 * (share - 0.5) * 4)
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, k = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rate, k = RATE * (1 - k / steps), k + 1
            at, shares = docs[i]
            mean = shares @ e[at]
            z = w @ mean + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ w
            w -= rate * np.outer(p, mean)
            b -= rate * p
            if len(at):
                e[at] -= (rate / (shares @ shares)) * np.outer(shares, back)
    return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold: TRAIN_DOCS of them by a hash of their key. Null
    labels and keys are left out; a key with several labels has the largest, one with several texts the smallest. Features are
    counted by the executors: what comes to the driver is
    BUCKETS features a row at most, compressed to a byte or two each, however long its text."""
    import pyarrow as pa

    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("__k")).agg(F.max(label).alias("__y"))
    sample = known.orderBy(F.xxhash64(F.lit(SEED), "__k"), "__k").limit(TRAIN_DOCS)  # so few rows may be broadcast
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(sample), F.col("__key") == F.col("__k"))
    rows = rows.groupBy("__k", "__y").agg(F.min("__text").alias("t"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            packed = [packed_features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(packed, pa.binary())], names=["k", "y", "f"])

    got = sorted(rows.mapInArrow(run, "k long, y int, f binary").collect(), key=lambda r: r.k)
    return train([unpacked_features(r.f) for r in got], np.array([r.y for r in got], np.int64))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with `score`, the probability of label 1 (a column of that name is replaced); null and empty texts get the
    bias's. Whole texts count; repeated rows, null keys and extra columns pass through, an empty table gives an empty one. One
    narrow pass; a worker holds the model and a bounded memory of words it has seen."""
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if f.name != "score"]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at: dict[str, int] = {}
        sums, counts, hashes = np.empty(1 << 14), np.empty(1 << 14), np.empty(1 << 14, np.uint64)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(text_at)):
                words = (text.as_py() or "").split()
                if len(at) > REMEMBERED:
                    at.clear()
                new = list(dict.fromkeys(w for w in words if w not in at))
                for s in range(0, len(new), PART):
                    part = new[s : s + PART]
                    b, n, h = word_features(part)
                    while len(at) + len(part) > len(sums):
                        sums, counts, hashes = (np.resize(x, 2 * len(x)) for x in (sums, counts, hashes))
                    k = len(at)
                    sums[k : k + len(part)] = np.add.reduceat(model.weights[b], np.cumsum(n) - n, dtype=np.float64)
                    counts[k : k + len(part)], hashes[k : k + len(part)] = n, h
                    at.update(zip(part, range(k, k + len(part)), strict=True))
                z = model.bias
                if words:
                    k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
                    pairs = model.weights[pair_features(hashes[k])]
                    z += (sums[k].sum() + pairs.sum(dtype=np.float64)) / (counts[k].sum() + len(pairs))
                scores[i] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            cols = [batch.column(j) for j in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores)], names=[f.name for f in schema.fields])

    names = df.columns
    text_at, kept = names.index(text), [j for j, c in enumerate(names) if c != "score"]
    return df.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document: rows with a null key are never held out, null and empty texts get
    the bias's score, repeated rows stay; without usable labels all scores are equal."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
