"""Toxicity by a weighted finite-state grammar of clauses: who is insulted or threatened, and what is denied or only reported."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Hashable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, numbered, quoted

FOLDS, HELD, THRESHOLD, SEED = 4, 2, 0.3, 12
#: Bound of the training sample: labelled rows, by a hash of their key.
TRAIN_DOCS = 20_000
#: Learned stems: letters of a stem; how much more often toxic texts show it, as a share of their distinct words and as texts; texts that
#: must show it (at least, and of all toxic ones); stems that are weighed and kept.
STEM, MORE_WORDS, MORE_TEXTS, LEAST_TEXTS, LEAST_SHARE, WEIGHED, KEPT = (3, 10), 8.0, 4.0, 8, 0.01, 2000, 200
#: Words that a worker remembers before it forgets them all.
REMEMBERED = 400_000
#: Words over which a negation reaches, and characters of a text that are read at a time (to the end of their last clause).
REACH, PART = 3, 1 << 20
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]+|[\"“”«»„]")
MATCHES = "array<struct<start:long,end:long,kind:string>>"

#: The grammar's words by class, in English, German, French and Spanish. Phrases are words between blanks.
WORDS: dict[str, str] = {
    "insult": "idiot idiots moron morons stupid scum pathetic worthless disgusting imbecile imbeciles bastard bastards retard vermin subhuman asshole assholes bitch "
    "dumbass scumbag halfwit dimwit,abschaum arschloch dummkopf miststück wertlos widerlich erbärmlich schwachkopf,connard connards salaud imbécile débile ordure "
    "minable crétin,imbécil estúpido estúpida basura escoria asqueroso patético gilipollas cabrón".replace(",", " "),
    "mild": "loser losers clown clowns trash garbage fool fools dumb ugly lazy coward cowards liar liars versager feigling lügner lâche menteur cobarde mentiroso payaso",
    "threat": "kill hurt destroy strangle stab shoot murder beat punch hunt crush töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir",
    "order": "shut_up kill_yourself get_lost drop_dead halt_den_mund halt_die_klappe ferme_la ta_gueule cállate vete_al_diablo",
    "will": "will i'll we'll gonna going_to shall werde werden vais allons voy_a vamos_a",
    "target": "you your you're yours yourself u them they those these people du dich dir dein ihr euch tu te toi vous tú ustedes usted vosotros",
    "not": "not no never isn't aren't don't won't wasn't nobody nicht kein keine niemals pas jamais nunca jamás",
    "report": "said says say saying wrote writes called calls claimed claims according quote quoted reported sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
#: What a clause can be, and the weight that it has where no label says otherwise.
KINDS: dict[str, float] = {
    "insult": 2.5, "insult+target": 3.5, "slur": 1.0, "slur+target": 2.0, "mild": 1.0, "mild+target": 2.0, "threat": 0.5, "threat+target": 1.5, "vow": 2.0, "vow+target": 4.0, "order": 3.0, "denied": 0.0, "reported": 0.3,
}
BIAS, TIGHTNESS = -3.0, 1.0


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, symbol) leads to (state, symbol). What has no arc of its own keeps state and symbol."""

    arcs: Mapping[tuple[Hashable, str], tuple[Hashable, str]]
    start: Hashable = 0

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def after(self, other: Transducer, symbols: tuple[str, ...]) -> Transducer:
        """The composition that reads `symbols`: what this one writes, the other reads. Only states that can be reached are made."""
        arcs, seen, open_ = {}, {(self.start, other.start)}, [(self.start, other.start)]
        while open_:
            a, b = pair = open_.pop()
            for symbol in symbols:
                to_a, middle = self.step(a, symbol)
                to_b, out = other.step(b, middle)
                arcs[pair, symbol] = ((to_a, to_b), out)
                if (to_a, to_b) not in seen:
                    seen.add((to_a, to_b))
                    open_.append((to_a, to_b))
        return Transducer(arcs, (self.start, other.start))


#: A slur is a word that begins with a stem learned from labelled texts.
HARM = ("insult", "slur", "mild", "threat", "order")
#: What the grammar reads: classes of words, `word` for others, `"` for quotation marks, `#` for a clause's end.
SYMBOLS = (*HARM, "will", "target", "not", "report", "word", '"', "#")


def negation() -> Transducer:
    """Harm within REACH words after a negation is denied."""
    arcs: dict = {(s, "not"): (REACH, "word") for s in range(REACH + 1)}
    for s in range(1, REACH + 1):
        arcs |= {(s, x): (s - 1, x) for x in ("word", "will", "target", "report")}
        arcs |= {(s, x): (s - 1, "denied") for x in HARM}
        arcs[s, "#"] = (0, "#")
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """Harm after a verb of saying, or between quotation marks, is reported, to the clause's end."""
    arcs: dict = {(0, "report"): (1, "word"), (0, '"'): (2, "word"), (2, '"'): (0, "word"), (1, '"'): (1, "word"), (1, "report"): (1, "word"), (2, "report"): (2, "word")}
    for s in (1, 2):
        arcs |= {(s, x): (s, "reported") for x in HARM} | {(s, "#"): (0, "#")}
    return Transducer(arcs)


def vows() -> Transducer:
    """A threat after a word of intent is a vow."""
    arcs: dict = {(0, "will"): (1, "word"), (1, "will"): (1, "word"), (1, "threat"): (1, "vow"), (1, "#"): (0, "#")}
    return Transducer(arcs)


def targets() -> Transducer:
    """Someone spoken to or about, anywhere in the clause, is named at its end."""
    return Transducer({(0, "target"): (1, "word"), (1, "target"): (1, "word"), (1, "#"): (0, "#target")})


#: From the least to the most that a clause can do.
RANKS = ("", "denied", "reported", "threat", "slur", "mild", "insult", "order", "vow")


def verdicts() -> Transducer:
    """The worst harm of a clause, written at its end; other symbols write nothing."""
    arcs: dict = {}
    for state in range(len(RANKS)):
        for symbol in ("word", "will", "target", "not", "report", '"'):
            arcs[state, symbol] = (state, "")
        for k, symbol in enumerate(RANKS[1:], 1):
            arcs[state, symbol] = (max(state, k), "")
        kind = RANKS[state]
        arcs[state, "#"] = (0, kind)
        arcs[state, "#target"] = (0, f"{kind}+target" if f"{kind}+target" in KINDS else kind)
    return Transducer(arcs, 0)


def grammar() -> Transducer:
    """Negation, reported speech, vows, targets and verdicts, composed."""
    whole = negation()
    for part in (reported_speech(), vows(), targets(), verdicts()):
        whole = whole.after(part, SYMBOLS)
    return whole


class Lexicon:
    """Classes of words, phrases and stems. Of phrases that begin with a word the longest that fits counts; words go before stems."""

    def __init__(self, words: Mapping[str, str] = WORDS, stems: tuple[str, ...] = ()) -> None:
        self.single: dict[str, str] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        self.stems = stems
        for kind, listed in words.items():
            for entry in listed.split():
                parts = tuple(entry.split("_"))
                if len(parts) == 1:
                    self.single.setdefault(entry, kind)
                else:
                    self.phrases.setdefault(parts[0], []).append((parts, kind))
        for found in self.phrases.values():
            found.sort(key=lambda p: -len(p[0]))
        self._marks = {w for w, k in self.single.items() if k in HARM} | {max(p, key=len) for f in self.phrases.values() for p, k in f if k in HARM}
        self._known: dict[str, bool] = {}

    def harmful(self, token: str) -> bool:
        """Whether a clause with this word may do harm; one without any such word can't."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            found = self._known[token] = token in self._marks or (token not in self.single and token.startswith(self.stems))
        return found

    def symbols(self, tokens: list[str]) -> Iterator[str]:
        i = 0
        while i < len(tokens):
            for parts, kind in self.phrases.get(tokens[i], ()):
                if tuple(tokens[i : i + len(parts)]) == parts:
                    yield kind
                    i += len(parts)
                    break
            else:
                token = tokens[i].replace("’", "'")
                kind = self.single.get(token)
                yield kind or ('"' if token in '"“”«»„' else "slur" if token.startswith(self.stems) else "word")
                i += 1


def lowered(text: str) -> str:
    """The text in small letters, code point for code point: a letter whose small form is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def parts(text: str) -> Iterator[tuple[int, str]]:
    """(start, part) of a text in parts of about PART characters, each to the end of a clause."""
    base = 0
    while base < len(text):
        to = base + PART
        while to < len(text) and text[to - 1] not in ".!?;:\n":
            to += 1
        yield base, lowered(text[base:to])
        base = to


def matched_clauses(text: str, whole: Transducer, lexicon: Lexicon) -> tuple[int, list[tuple[int, int, str]]]:
    """How many words a text has, and (start, end, kind) of each clause that the grammar gives a verdict, by code points. Clauses end at
    . ! ? ; : and at line ends; case doesn't count."""
    out, words = [], 0
    for base, part in parts(text):
        tokens = TOKEN.findall(part)
        words += len(tokens)
        if not any(map(lexicon.harmful, tokens)):
            continue
        clause: list[re.Match] = []
        for m in [*TOKEN.finditer(part), None]:
            if m is not None and m.group()[0] not in ".!?;:\n":
                clause.append(m)
                continue
            tokens = [t.group() for t in clause]
            if any(map(lexicon.harmful, tokens)):
                state, kind = whole.start, ""
                for symbol in [*lexicon.symbols(tokens), "#"]:
                    state, kind = whole.step(state, symbol)
                if kind:
                    out.append((base + clause[0].start(), base + clause[-1].end(), kind))
            clause = []
    return words, out


def clauses(df: DataFrame, text: str = "text", words: Mapping[str, str] | None = None, stems: tuple[str, ...] = ()) -> DataFrame:
    """df with `n_words` (words and marks of the whole text) and `matches`: (start, end, kind) of each clause that the grammar matches, kinds being KINDS;
    columns of those names are replaced. `words` are the grammar's lists, `stems` those of learned slurs. Null and empty texts have none;
    repeated rows, null keys and extra columns pass through; an empty table gives an empty one. One narrow pass, a text in parts of about PART characters."""
    keep = [f for f in df.schema.fields if f.name not in ("n_words", "matches")]
    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("matches", T._parse_datatype_string(MATCHES))])
    at, kept = df.columns.index(text), [j for j, f in enumerate(df.schema.fields) if f in keep]
    lists = dict(words or WORDS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        whole, lexicon = grammar(), Lexicon(lists, stems)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            got = [matched_clauses(t.as_py() or "", whole, lexicon) for t in batch.column(at)]
            found = pa.array([[dict(zip(("start", "end", "kind"), m, strict=True)) for m in matched] for _, matched in got], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in kept), pa.array([n for n, _ in got], pa.int64()), found], names=[f.name for f in schema.fields])

    return numbered(df).mapInArrow(run, schema)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(quoted(key)).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


@dataclass(frozen=True)
class Weights:
    """What a text's score needs: a weight for each kind of clause, counted by log2(1 + clauses), and a bias."""

    bias: float
    kinds: Mapping[str, float]


#: What a text's clauses are counted by: log2(1 + clauses) of each kind, and the learned slurs' clauses among a thousand words.
MEASURES = (*KINDS, "slurs a thousand")
PRIOR = (*KINDS.values(), 0.5)


def measures(matches: Column, n_words: Column) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(matches, lambda m: m["kind"] == kind))

    slurs = F.size(F.filter(matches, lambda m: m["kind"].startswith("slur")))
    return [*(F.log2(1.0 + count(k)) for k in KINDS), F.log2(1.0 + 1000 * slurs / (20 + n_words))]


def train(rows: np.ndarray, labels: np.ndarray, times: np.ndarray) -> Weights:
    """Weights of the grammar's verdicts from rows of measures, each standing `times` times: logistic regression by Newton steps, held at the given
    weights (PRIOR, BIAS) as by TIGHTNESS rows, so that a kind which no labelled row shows keeps its own. The bias is free once there are rows of both classes."""
    at = np.array([BIAS, *PRIOR])
    hold = np.full(len(at), TIGHTNESS)
    if len(labels) and 0 < labels.sum() < len(labels):
        hold[0] = 1e-3
    x, w = np.column_stack([np.ones(len(labels)), rows.reshape(-1, len(PRIOR))]), at.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (times * (p - labels)) + hold * (w - at))
        w = w - step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return Weights(float(w[0]), dict(zip(MEASURES, map(float, w[1:]), strict=True)))


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold, (__k, __y): TRAIN_DOCS of them, by a hash of their key. Null labels and keys are left
    out; a key with several labels has the largest. So few rows may be broadcast."""
    known = labels.where(F.col(quoted(label)).isNotNull() & F.col(quoted(key)).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(quoted(key)).alias("__k")).agg(F.max(quoted(label)).cast("int").alias("__y"))
    return known.orderBy(F.xxhash64(F.lit(SEED), "__k"), "__k").limit(TRAIN_DOCS)


def learned_stems(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[str, ...]:
    """Beginnings of words that mark toxic texts in the sample, beside the grammar's own lists. Near copies, told by the least hash of their words,
    count once. A stem must make up MORE_WORDS times the share of distinct words that it has in other texts, and MORE_TEXTS times the share of
    texts; of stems that begin alike the one that says most is kept. Executors count; WEIGHED stems come to the driver."""
    rows = docs.select(F.col(quoted(key)).alias("__key"), F.col(quoted(text)).alias("__text"))
    rows = rows.join(F.broadcast(sample(labels, key, label)), F.col("__key") == F.col("__k")).select("__k", "__y", "__text")

    def distinct(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Lexicon().single
        for batch in batches:
            sets = [sorted({t for _, part in parts(text.as_py() or "") for t in TOKEN.findall(part) if t[0].isalnum() and t not in known}) for text in batch.column(2)]
            least = [min((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in s), default=None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(least, pa.int64()), pa.array(sets, pa.list_(pa.string()))], names=["k", "y", "least", "words"])

    texts = rows.mapInArrow(distinct, "k string, y int, least long, words array<string>").where("least is not null")
    texts = cut(texts.groupBy("least", "y").agg(F.min(F.struct("k", "words")).alias("t")).select("y", "t.words"))

    def beginnings(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.as_py()
                here = Counter(w[:n] for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1))
                for stem, n in here.items():
                    at = found.setdefault((stem, y), [0, 0])
                    at[0] += round(1e9 * n / len(words))
                    at[1] += 1
            cols = [[s for s, _ in found], [y for _, y in found], [v[0] for v in found.values()], [v[1] for v in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["stem", "y", "share", "n"])

    of = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    toxic, other = of.get(1, 0), sum(n for y, n in of.items() if y != 1)
    if not toxic or not other:
        return ()

    def total(name: str, y: bool) -> Column:
        return F.sum(F.when((F.col("y") == 1) == F.lit(y), F.col(name)).otherwise(0))

    sums = texts.mapInArrow(beginnings, "stem string, y int, share long, n long").groupBy("stem")
    sums = sums.agg(total("share", True).alias("s1"), total("share", False).alias("s0"), total("n", True).alias("n1"), total("n", False).alias("n0"))
    ratio = (F.col("s1") / (1e9 * toxic) + 1e-5) / (F.col("s0") / (1e9 * other) + 1e-5)
    strong = sums.where((F.col("n1") >= max(LEAST_TEXTS, int(LEAST_SHARE * toxic))) & (ratio > MORE_WORDS) & (F.col("n1") * other > MORE_TEXTS * (F.col("n0") + 1) * toxic))
    kept: list[str] = []
    for r in strong.orderBy(F.desc(F.col("s1") * F.log(ratio)), F.length("stem"), "stem").limit(WEIGHED).collect():
        if len(kept) < KEPT and not any(r.stem.startswith(s) or s.startswith(r.stem) for s in kept):
            kept.append(r.stem)
    return tuple(kept)


def fit(matched: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> Weights:
    """Weights of the grammar from what `clauses` gave, over the sample of labelled rows. What comes to the driver is each set of measures once, a dozen numbers."""
    rows = matched.select(F.col(quoted(key)).alias("__key"), F.array(*measures(F.col("matches"), F.col("n_words"))).alias("x"))
    found = rows.join(F.broadcast(sample(labels, key, label)), F.col("__key") == F.col("__k")).groupBy("x", "__y").count().collect()
    found = sorted((tuple(r["x"]), r["__y"], r["count"]) for r in found)
    return train(np.array([x for x, _, _ in found], float), np.array([y for _, y, _ in found], float), np.array([n for _, _, n in found], float))


def scored(matched: DataFrame, weights: Weights) -> DataFrame:
    """matched with `score`, the probability of label 1, from its clauses."""
    z = sum((F.lit(weights.kinds[k]) * c for k, c in zip(MEASURES, measures(F.col("matches"), F.col("n_words")), strict=True)), F.lit(weights.bias))
    return matched.withColumn("score", 1 / (1 + F.exp(-z)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses of every document: rows with a null key are never held out, null and empty texts have
    the bias's score, repeated rows stay; without usable labels the given lists and weights speak. What matched is cut, so that all texts are read once
    after the labelled ones."""
    texts = docs.select("doc_id", "text")
    matched = cut(clauses(texts, stems=learned_stems(texts, labels)).drop("text"))
    out = scored(matched, fit(matched, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "matches")
