"""Token ids of whole texts, word by word."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Words that a worker remembers before it forgets them all.
REMEMBERED = 500_000
#: Parts the words that are encoded together: it's a token of its own between blanks. Words that hold it go alone.
MARK = "~"
#: A word of plain letters, which case, accents' composition and the tokenizer's pattern leave whole, and the signs after it, which are a part of their own.
PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-}]*)")
#: Words of texts that are looked up, and learned, together, about.
TOGETHER = 100_000
#: Words of one text for the tokenizer, and such texts that it gets at once: what it returns is far larger than the ids.
WORDS, TEXTS = 128, 32


class _Known(dict):
    """Words' numbers; a word that isn't known yet gets the next one and is listed in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = k = len(self)
        return k


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and treats what stands between it alone: words are
    told apart by ASCII white space, and each that is new is encoded once. Texts with "<|", which may hold special tokens,
    are encoded whole. A plain word and the signs after it are learned apart; plain words go through the tokenizer's model without its
    normalizer and pattern, which leave them as they are. tests/llm holds this against the tokenizer's own ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.light = self._light()
        self.clear()

    def _light(self) -> bool:
        """Whether plain words get the same ids between blanks alone. Words are told apart by the suffix of their last token; a model without one has none."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return False
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        probe = "the straße café garçon aaaaaaaaaaaaaaaaaaaa xqzwv ÿþð"
        apart, joined, whole = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (probe.replace(" ", " .,&&& "), probe.replace(" ", ".,&&& "), probe))
        with self._between_blanks():
            return apart == joined and self.tokenizer.encode(probe, add_special_tokens=False).ids == whole

    @contextlib.contextmanager
    def _between_blanks(self) -> Iterator[None]:
        """The tokenizer without its normalizer and pattern, for a while: a second one would hold the vocabulary twice."""
        from tokenizers import normalizers, pre_tokenizers

        t = self.tokenizer
        before = t.normalizer, t.pre_tokenizer
        t.normalizer = normalizers.Sequence([])
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        try:
            yield
        finally:
            t.normalizer, t.pre_tokenizer = before

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        for s in range(0, len(texts), TEXTS):
            for found in self.tokenizer.encode_batch_fast(texts[s : s + TEXTS], add_special_tokens=False):
                yield np.array(found.ids, np.uint32)

    def clear(self) -> None:
        self.known = _Known()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _store(self, k: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Words k have the ids from starts on, of given lengths."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k], self.lengths[k] = self.used + starts, lengths
        self.used += len(ids)

    def _joined(self, k: np.ndarray) -> np.ndarray:
        """The ids of words k, one after the other."""
        lengths = self.lengths[k]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[k] - ends + lengths, lengths) + np.arange(ends[-1])]

    def _learn(self) -> None:
        words = self.known.new
        before = len(self.known) - len(words)
        plain, odd, both = [], [], []
        for k, word in enumerate(words, before):  # parts that are new join the list
            found = PLAIN.fullmatch(word.decode()) if self.light else None
            stem, signs = found.groups() if found else ("", "")
            if stem and signs:
                both.append((k, self.known[stem.encode()], self.known[signs.encode()]))
            else:
                (plain if stem else odd).append(k)
        self.known.new = []
        while len(self.known) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.starts))
        cuts = lambda ks, n=WORDS: [ks[e : e + n] for e in range(0, len(ks), n)]
        text = lambda ks, between: between.join([words[k - before].decode() for k in ks])
        parts = cuts(plain)
        if parts:
            with self._between_blanks():
                for part, ids in zip(parts, self._encoded([text(part, " ") for part in parts]), strict=True):
                    ends = np.flatnonzero(self.last[ids]) + 1
                    assert len(ends) == len(part)
                    starts = np.append(0, ends[:-1])
                    self._store(np.array(part), ids, starts, ends - starts)
        parts = cuts(odd, 1 if any(MARK.encode() in words[k - before] for k in odd) else WORDS)
        if parts:
            for part, ids in zip(parts, self._encoded([text(part, f" {MARK} ") for part in parts]), strict=True):
                ends = np.append(np.flatnonzero(ids == self.mark) if len(part) > 1 else [], len(ids)).astype(np.int64)
                starts = np.append(0, ends[:-1] + 1)
                assert len(ends) == len(part)
                self._store(np.array(part), ids, starts, ends - starts)
        if both:
            k, *sides = np.array(both).T
            lengths = self.lengths[sides[0]] + self.lengths[sides[1]]
            self._store(k, self._joined(np.array(sides).T.ravel()), np.cumsum(lengths) - lengths, lengths)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Some texts' words are looked up before those that are new are learned together."""
        waiting: list[np.ndarray | None] = []
        held, count = [], 0

        def ready() -> Iterator[np.ndarray]:
            if self.known.new:
                self._learn()
            for k, text in zip(waiting, held, strict=True):
                if k is None:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield self._joined(k) if len(k) else np.empty(0, np.uint32)

        for text in texts:
            if "<|" in text:
                waiting.append(None)
                held.append(text)
            else:
                words = text.encode().lower().split()
                waiting.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
                held.append("")
                count += len(words)
            if count >= TOGETHER:
                yield from ready()
                waiting, held, count = [], [], 0
                if len(self.known) > REMEMBERED:
                    self.clear()
        yield from ready()
        if len(self.known) > REMEMBERED:
            self.clear()

    def encode(self, text: str) -> np.ndarray:
        (ids,) = self.encode_all([text])
        return ids
