"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, quoted
from .tokens import WordIds

SIZE, END = 4096, 2
#: Pieces of a group, on average.
GROUP = 4096
TOKENIZER = "word_bpe_49k.json"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
#: Rows whose texts a task turns into strings at once.
ROWS = 500


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first (ties in the given order), each into the first bin with room. A
    tournament tree over the bins' free room, each node holding the larger of its two, leads to that bin in log2(bins)
    steps. Lengths are 1 to capacity."""
    n = len(lengths)
    width = 1
    while width < n:
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[k]), 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - width, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens. A document is its text's ids and then `end`; pieces have
    `size` ids but for its last. Null text counts as empty: one piece, the end alone. Long texts take one worker's memory
    of a few dozen bytes a word; the tokenizer and its memory of words go with the task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordIds(path or tokenizer_path())
        last = np.array([end], np.uint32)
        for batch in batches:
            out: list[tuple] = []
            texts = (text or "" for at in range(0, batch.num_rows, ROWS) for text in batch.column(1).slice(at, ROWS).to_pylist())
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                ids = np.concatenate([found, last]).astype("<u4", copy=False)
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            columns = zip(*out, strict=True) if out else [()] * len(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECE)

    rows = df.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in PIECE))


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. Pieces are dealt by a hash into groups of about `group`, however many of them a document has, and each
    group is packed by first-fit decreasing on its own. Ids are unique: a group's number, then its bin's. Repeated rows are packed as often
    as they occur, each dealt by its own place in the table; empty input gives none. pieces is read twice: pass what is written."""
    groups = max(1, math.ceil(pieces.count() / group))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), size)
        return rows.assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(5), F.monotonically_increasing_id(), "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Pieces of all documents, each with its sequence and place. Pieces are few numbers each; they are written before they are dealt."""
    return pack(cut(token_pieces(df, key, text, size, END, path)), size)
