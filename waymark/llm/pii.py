"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "nir", "dni", "nhs", "aba", "secret")
#: What each kind's pattern must find. Guards before a run of characters keep the search linear and change no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "nir": r"\b[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b",
    "dni": r"\b[0-9]{8}-?[A-Z]\b",
    "nhs": r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b",
    "aba": r"\b[0-9]{9}\b",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: Score in percent of a confirmed span, and what a context word within WINDOW characters before or after it adds. Base kinds
#: always reach ACCEPT; of the others those whose checksum is weak or absent need a context word.
SCORES = {"email": (90, 10), "ip": (60, 30), "card": (80, 20), "phone": (60, 30), "iban": (60, 30), "ssn": (30, 40), "nir": (60, 30), "dni": (40, 40), "nhs": (30, 40), "aba": (30, 40), "secret": (30, 40)}
CONTEXT = {
    "email": "mail|e-mail|email|contact|courriel|correo", "ip": "ip|address|adresse|host|server|client", "card": "card|carte|karte|tarjeta|visa|mastercard|amex|credit|payment",
    "phone": "phone|tel|telephone|mobile|call|fax|telefon|movil", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social|security|insurance|identity",
    "nir": "nir|insee|securite|sociale|social|security", "dni": "dni|nif|documento|identidad|identity", "nhs": "nhs|patient|health", "aba": "aba|routing|transit|bank",
    "secret": "token|tokens|secret|api[ _-]?key|apikey|password|passwd|pwd|bearer|credential|credentials|private[ _-]?key|access[ _-]?key",
}
WINDOW, ACCEPT = 48, 50
#: Characters of the longest text that the IBAN pattern matches; matches of a kind that a context window can reach over.
LONGEST, NEAR = 43, 12
#: Elements that are gathered into one array before arrays are joined, so that long lists aren't copied for each element.
PART = 256
_HAS = {"email": "instr({t}, '@') > 0", "phone": "instr({t}, '+') > 0"}
_SPAN = "struct<start:int,ord:int,kind:string,end:int,score:int>"
_NONE = f"CAST(array() AS array<{_SPAN}>)"


def let(value: str, name: str, body: str) -> str:
    """SQL: body, in which name is a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parts(array: str) -> str:
    """SQL: an array in slices of PART."""
    return let(array, "whole", f"IF(size(whole) = 0, slice(array(whole), 1, 0), transform(sequence(0, (size(whole) - 1) div {PART}), c -> slice(whole, c * {PART} + 1, {PART})))")


def running(lengths: str) -> str:
    """SQL: for each of an array's lengths, the sum of those before it."""
    sums = lambda a, at: f"aggregate({a}, named_struct('at', {at}, 'out', CAST(array() AS array<int>)), (s, v) -> named_struct('at', s.at + v, 'out', array_append(s.out, s.at)), s -> s.out)"
    return let(parts(lengths), "ps", f"flatten(zip_with(ps, {sums('transform(ps, p -> aggregate(p, 0, (s, v) -> s + v))', '0')}, (p, at) -> {sums('p', 'at')}))")


def apart(spans: str, kind: str = _SPAN) -> str:
    """SQL: of spans in order, those that don't start before the end of the last one that was kept."""
    inner = f"aggregate(p, named_struct('free', a.free, 'out', CAST(array() AS array<{kind}>)), (s, x) -> IF(x.start < s.free, s, named_struct('free', x.end, 'out', array_append(s.out, x))))"
    return f"flatten(aggregate({parts(spans)}, named_struct('free', 0, 'out', CAST(array() AS array<array<{kind}>>)), (a, p) -> {let(inner, 'z', "named_struct('free', z.free, 'out', array_append(a.out, z.out))")}, a -> a.out))"


def luhn(digits: str) -> str:
    """SQL: whether a text of digits passes Luhn."""
    at = f"(ascii(substring({digits}, length({digits}) + 1 - i, 1)) - 48)"
    return f"aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + IF(i % 2 = 1, {at}, IF({at} > 4, 2 * {at} - 9, 2 * {at}))) % 10 = 0"


def mod97(compact: str) -> str:
    """SQL: whether an IBAN without spaces leaves 1 at division by 97."""
    moved = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    return f"aggregate(split({moved}, ''), 0, (acc, ch) -> IF(ch = '', acc, IF(ch >= 'A', acc * 100 + ascii(ch) - 55, acc * 10 + ascii(ch) - 48) % 97)) = 1"


def _digit(digits: str, i: int) -> str:
    return f"CAST(substring({digits}, {i}, 1) AS INT)"


def _valid(kind: str, m: str, digits: str | None = None) -> str:
    """SQL, for Spark and (but for the first six kinds) DuckDB: what confirms a match."""
    digits = digits or f"regexp_replace({m}, '[^0-9]', '')"
    nir = f"replace(replace(replace({m}, ' ', ''), '2A', '19'), '2B', '18')"
    weighed = lambda ws: " + ".join(f"{w} * {_digit(digits, i + 1)}" for i, w in enumerate(ws))
    return {
        "email": "true",
        "ip": f"{m} RLIKE '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})[.]){{3}}0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})$'",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn(digits)}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"length(replace({m}, ' ', '')) BETWEEN 15 AND 34 AND {mod97(f"replace({m}, ' ', '')")}",
        "ssn": f"NOT {m} RLIKE '^(000|666|9)|-00-|-0000$'",
        "nir": f"97 - CAST(substring({nir}, 1, 13) AS BIGINT) % 97 = CAST(substring({nir}, 14, 2) AS BIGINT)",
        "dni": f"substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST({digits} AS BIGINT) % 23 AS INT) + 1, 1) = right({m}, 1)",
        "nhs": f"({weighed(range(10, 1, -1))} + {_digit(digits, 10)}) % 11 = 0",
        "aba": f"({weighed((3, 7, 1) * 3)}) % 10 = 0 AND {m} <> '000000000'",
        "secret": f"length(translate({m}, '0123456789', '')) < length({m}) AND lower({m}) <> upper({m})",
    }[kind]


def _word(kind: str) -> str:
    return f"(^|[^a-z0-9])({CONTEXT[kind]})([^a-z0-9]|$)"


def _score(kind: str, before: str, after: str) -> str:
    base, more = SCORES[kind]
    return f"{base} + IF(lower({before}) RLIKE '{_word(kind)}' OR lower({after}) RLIKE '{_word(kind)}', {more}, 0)"


def _spans(kind: str) -> Column:
    """From the columns text and m_<kind>: the kind's spans; places in code points. Between the matches stand the pieces that
    split gives; the context of a match is joined from the ends of the pieces and matches around it."""
    pattern, k = PATTERNS[kind].replace("\\", "\\\\"), KINDS.index(kind)
    before = f"right(concat(array_join(slice(lefts, greatest(1, i + 1 - {NEAR}), least({NEAR}, i)), ''), right(element_at(b, i + 1), {WINDOW})), {WINDOW})"
    after = f"left(array_join(slice(rights, i + 2, {NEAR}), ''), {WINDOW})"
    one = f"named_struct('start', at + length(element_at(b, i + 1)), 'ord', {k}, 'kind', '{kind}', 'end', at + length(element_at(b, i + 1)) + length(h), 'score', IF({_valid(kind, 'h')}, {_score(kind, before, after)}, 0))"
    hits = f"zip_with(m_{kind}, slice(ats, 1, size(m_{kind})), (h, at) -> named_struct('h', h, 'at', at))"
    spans = f"transform({hits}, (x, i) -> {let('x.h', 'h', let('x.at', 'at', one))})"
    ats = running(f"zip_with(b, m_{kind}, (x, h) -> length(x) + coalesce(length(h), 0))")
    lefts = f"zip_with(b, m_{kind}, (x, h) -> concat(right(x, {WINDOW}), right(coalesce(h, ''), {WINDOW})))"
    rights = f"zip_with(b, m_{kind}, (x, h) -> concat(left(x, {WINDOW}), left(coalesce(h, ''), {WINDOW})))"
    whole = let(f"split(text, '{pattern}', -1)", "b", let(ats, "ats", let(lefts, "lefts", let(rights, "rights", f"filter({spans}, s -> s.score >= {ACCEPT})"))))
    return F.expr(f"IF(size(m_{kind}) = 0, {_NONE}, {whole})")


def _ibans() -> Column:
    """As _spans, for IBANs: a match may swallow what follows, thus from each place where one can begin the longest part
    counts that ends at a word's end and leaves 1 at division by 97; what comes after it is tried again."""
    body = PATTERNS["iban"].removeprefix(r"\b").removesuffix(r"\b")
    begin = (r"(?=\b" + body + r"\b)").replace("\\", "\\\\")
    fits = f"substring(w, 1, n) RLIKE '^{body}$' AND NOT substring(w, n + 1, 1) RLIKE '[\\\\p{{L}}\\\\p{{N}}_]' AND {_valid('iban', 'substring(w, 1, n)')}"
    length = f"array_max(filter(sequence(15, {LONGEST}), n -> n <= length(w) AND {fits}))"
    window = f"array_join(slice(heads, i + 1, 2 * {NEAR}), '')"
    before = f"right(array_join(slice(tails, greatest(1, i + 1 - {NEAR}), least({NEAR}, i)), ''), {WINDOW})"
    span = f"named_struct('start', at, 'ord', {KINDS.index('iban')}, 'kind', 'iban', 'end', at + k, 'score', IF(k IS NULL, 0, {_score('iban', before, f'substring(w, k + 1, {WINDOW})')}))"
    at_each = f"transform(ats, (at, i) -> {let(window, 'w', let(length, 'k', span))})"
    heads, tails = f"transform(p, x -> left(x, {LONGEST + 1 + WINDOW}))", f"transform(p, x -> right(x, {WINDOW}))"
    found = let(f"split(text, '{begin}', -1)", "p", let(running("transform(p, x -> length(x))"), "ats", let(heads, "heads", let(tails, "tails", f"filter({at_each}, s -> s.score >= {ACCEPT})"))))
    return F.expr(f"IF(size(m_iban) = 0, {_NONE}, {apart(found)})")


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with an array column `out` of (start, ord, kind, end, score in percent), by start, then kind.

    Each kind's matches are leftmost and do not overlap; a match that its checksum or range refuses is dropped, without
    a second try inside it, but for IBANs (see _ibans). A context word among the 48 characters on either side adds to the
    score; spans under ACCEPT go: base kinds always stay, the added ones need a strong checksum (IBAN, NIR) or a context
    word (the others). Null text counts as empty. Rows are independent: repeated rows, ties and extra columns, whatever
    their names, pass through; an empty table gives an empty one. A column named like `out` is replaced. Work grows with
    the text's length, however many matches it has. No shuffle, no Python."""
    keep = [c for c in df.columns if c != out]
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    one = df.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), t.alias("text"))
    none = F.array().cast("array<string>")
    hits = {}
    for k in kinds:
        found = F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))
        hits[f"m_{k}"] = F.when(F.expr(_HAS[k].format(t="text")), found).otherwise(none) if k in _HAS else found
    found = one.withColumns(hits).select("row", F.array_sort(F.concat(*[_ibans() if k == "iban" else _spans(k) for k in kinds])).alias(out))
    return found.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in keep], F.col(quoted(out)))


def mask(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "masked") -> DataFrame:
    """df with `out`: the text with each span replaced by its kind in angle brackets; of overlapping spans the first one
    counts. Null text counts as empty, null spans as none; repeated rows and extra columns pass through. The text is held
    in pieces of 1000 characters, so that a span far behind costs no more than one at the start."""
    t, size = f"coalesce({quoted(text)}, '')", 1000
    piece = f"IF(b div {size} = a div {size}, substring(get(ps, a div {size}), a % {size} + 1, b - a), concat(substring(get(ps, a div {size}), a % {size} + 1), array_join(slice(ps, a div {size} + 2, b div {size} - a div {size} - 1), ''), coalesce(left(get(ps, b div {size}), b % {size}), '')))"
    kept = let(apart(f"coalesce({quoted(spans)}, {_NONE})"), "ss", "concat(ss, array(named_struct('start', CAST(NULL AS INT), 'ord', 0, 'kind', CAST(NULL AS STRING), 'end', CAST(NULL AS INT), 'score', 0)))")
    each = f"transform(ss, (s, i) -> {let('IF(i = 0, 0, get(ss, i - 1).end)', 'a', let('coalesce(s.start, n)', 'b', f"concat({piece}, coalesce(concat('<', s.kind, '>'), ''))"))})"
    whole = let(f"regexp_extract_all({t}, '(?s).{{1,{size}}}', 0)", "ps", let(f"length({t})", "n", let(kept, "ss", f"IF(n = 0, '', array_join({each}, ''))")))
    return df.withColumn(out, F.expr(whole))


def digest(documents: DataFrame) -> DataFrame:
    """The counts, the digest of base spans, the list of all spans and their scores in percent, of each document (columns
    doc_id and text); null and empty texts have no span."""
    found = find_pii(documents.select("doc_id", "text")).drop("text")
    join = lambda c: f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(pii, s -> s.ord < {len(BASE)})"
    counts = [F.expr(f"CAST(size(filter(pii, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(join(base)), 256).alias("base_sha256"), F.expr(join("pii")).alias("spans"), F.expr("array_join(transform(pii, s -> CAST(s.score AS STRING)), ',')").alias("scores"))


def _oracle() -> str:
    plain = PATTERNS | {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "secret": "[A-Za-z0-9_-]{20,}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    d = "CAST(substr(d, i, 1) AS INT)"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND (SELECT sum(CASE WHEN (length(d) - i) % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END) % 10 = 0 FROM (SELECT {digits} AS d, unnest(range(1, length({digits}) + 1)) AS i))",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    } | {k: _valid(k, "m", digits) for k in ("nir", "dni", "nhs", "aba", "secret")}
    ok["iban"] = "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, c: CASE WHEN c > 9 THEN (a * 100 + c) % 97 ELSE (a * 10 + c) % 97 END) = 1"
    ok["ssn"] = "NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')"
    found = []
    for k in KINDS:
        p = plain[k].replace("'", "''")
        found.append(f"""SELECT doc_id, t, '{k}' AS kind, {KINDS.index(k)} AS ord, {SCORES[k][0]} AS base, {SCORES[k][1]} AS more, '{_word(k)}' AS words, m[i] AS m,
          coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT doc_id, t, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS b FROM t))""")
    checks = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ok.items())
    joined = lambda x: f"string_agg({x}, ',' ORDER BY a, ord)"
    span = joined("kind || ':' || a || ':' || e")
    near = lambda x: f"regexp_matches(lower({x}), words)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(found)}),
      v AS (SELECT *, CAST(s AS BIGINT) AS a, CAST(s + length(m) AS BIGINT) AS e FROM f WHERE CASE kind {checks} END),
      w AS (SELECT *, base + CASE WHEN {near(f'substr(t, greatest(a - {WINDOW}, 0) + 1, least(a, {WINDOW}))')} OR {near(f'substr(t, e + 1, {WINDOW})')} THEN more ELSE 0 END AS score FROM v),
      g AS (SELECT * FROM w WHERE score >= {ACCEPT}),
      a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {span} FILTER (ord < {len(BASE)}) AS j, {span} AS spans, {joined('score')} AS scores FROM g GROUP BY doc_id)
      SELECT t.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(j, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
