"""WARC derivative builder: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted

#: What goes with all it holds: comments, and elements whose text is not the page's. One without an end goes on to the page's
#: end, as in browsers; so each opener is the start of a match, and no search runs in vain to the end of the page.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}(?:\s[^<>]*)?>.*?(?:</{e}>|\z)" for e in ("script", "style", "noscript", "title"))
#: Tags that end a line get a line break before them; then all tags go.
BREAK, TAG = r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table)", r"(?s)</?[A-Za-z!?][^>]*(?:>|\z)"
#: An entity after its `&`: by number, by hexadecimal number, or by a name of HTML 4 (the standard library's table, and apos).
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Those that pages are full of go first; one by one only where there are others, but for the ampersand's own. None of them makes a new one.
OFTEN, OTHER = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")), r"&(?!amp;)(?:#[0-9xX]|[A-Za-z])"
NAMES = {**{name: chr(at) for name, at in name2codepoint.items()}, "nbsp": " ", "apos": "'"}
#: Blanks that aren't one space; line ends with blanks about them.
BLANKS, LINES = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", r" ?\n[ \n]*"


def _unescaped(text: Column) -> Column:
    """Entities by number and by name become what they stand for, a non-breaking space a space; what is no entity or no character stays."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])

    def one(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, ENTITY, 1)
        number = F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        fine = ((number >= 1) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        char = F.when(number == 160, " ").when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(number.isNull() & (name != ""), F.try_element_at(names, name))
        known = F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece)))
        return F.when(i == 0, piece).otherwise(F.coalesce(known, F.concat(F.lit("&"), piece)))

    for entity, to in OFTEN:
        text = F.replace(text, F.lit(entity), F.lit(to))
    rest = lambda t: F.when(t.rlike(OTHER), F.array_join(F.transform(F.split(t, "&", -1), one), "")).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))
    return F.element_at(F.transform(F.array(text), rest), 1)  # so that the text is made once


def html_text(html: Column) -> Column:
    """Plain text of HTML: comments, scripts, styles and the title go, block ends become line breaks, entities what they stand for; null stays null. A `<`
    before no letter is text. Time grows with the length of the page, whatever it holds."""
    text = _unescaped(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAK, "\n<$1"), TAG, " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINES, "\n"), F.lit(" \n"))


def plain_text(payload: Column, content_type: Column) -> Column:
    """A payload's text by its content type: of HTML (or of no type) html_text, other text as it is, of what is no text none."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    markup = kind.isin("", "text/html", "application/xhtml+xml")
    text = kind.startswith("text/") | kind.rlike(r"^application/(.+\+)?(json|xml|javascript)$")
    return F.when(markup, html_text(payload)).when(text, payload).otherwise("")


def uuid_urn(*parts: Column) -> Column:
    """A record identifier that depends on nothing but its parts, so that reruns agree."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts]))
    cut = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


#: What a response may know of its capture; null where it doesn't.
CAPTURE = {"date": "string", "status": "int", "charset": "string", "headers": "array<string>"}


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Captured pages as WARC response records, for inputs that hold bare HTML: a record's identifier depends on key, url
    and payload, so that two captures of a page stay apart. Date, status, charset and HTTP headers are unknown (null)."""
    payload = F.col(quoted(html))
    return pages.select(
        F.col(quoted(key)).alias("page_id"),
        uuid_urn(F.lit("response"), F.col(quoted(key)).cast("string"), F.col(quoted(url)), F.sha2(payload, 256)).alias("record_id"),
        F.col(quoted(url)).alias("target_uri"),
        F.lit("text/html").alias("content_type"),
        payload.alias("payload"),
        *[F.lit(None).cast(t).alias(c) for c, t in CAPTURE.items()],
    )


def parse_responses(records: DataFrame, record: str = "record", key: str = "page_id") -> DataFrame:
    """Whole WARC response records (text or bytes: WARC head, HTTP head, body) in the form of responses().

    Heads end at the first empty line; field names are matched without regard to case; a field that is absent is null.
    Rows that aren't responses (another WARC-Type, null, no head) are left out. Bytes are read as UTF-8, or as ISO-8859-1 (latin1) where the
    Content-Type of the HTTP head, not of the page, says so; what isn't valid becomes U+FFFD. A record without a WARC-Record-ID gets one from its text."""
    raw = F.col(quoted(record))
    binary = dict(records.dtypes)[record] == "binary"
    # bytes are split as ISO-8859-1, of which a character is a byte
    one = records.select(F.col(quoted(key)).alias("page_id"), raw.alias("raw"), (F.decode(raw, "ISO-8859-1") if binary else raw).alias("all"))
    rest = lambda c: F.get(F.split(c, r"\r?\n\r?\n", 2), F.lit(1))
    one = one.withColumn("http", rest(F.col("all"))).withColumn("payload", F.coalesce(rest(F.col("http")), F.lit("")))
    field = lambda c, name: F.nullif(F.trim(F.regexp_extract(c, rf"(?im)^{name}:([^\r\n]*)", 1)), F.lit(""))
    begin = lambda c: F.length("all") - F.length(c)
    valid = lambda c: F.make_valid_utf8(c.cast("string"))
    if binary:
        w, h = F.substring("raw", F.lit(1), begin("http")), F.substring("raw", begin("http") + 1, F.length("http") - F.length("payload"))
        latin = F.regexp_extract(field(F.substring("http", F.lit(1), F.length("http") - F.length("payload")), "Content-Type"), r"(?i)charset=[\"']?([^\s;\"']+)", 1).rlike(r"(?i)^(iso-8859-1|latin-?1)$")
        body = F.when(F.coalesce(latin, F.lit(False)), F.col("payload")).otherwise(valid(F.substring("raw", begin("payload") + 1, F.length("payload"))))
        text = valid(F.col("raw"))
        w, h = valid(w), valid(h)
    else:
        w, h, body, text = F.substring("all", F.lit(1), begin("http")), F.substring("http", F.lit(1), F.length("http") - F.length("payload")), F.col("payload"), F.col("raw")
    one = one.where("http IS NOT NULL OR all IS NOT NULL").select("page_id", text.alias("raw"), F.coalesce(w, F.col("all")).alias("w"), h.alias("h"), body.alias("payload"))
    kind = field(F.col("h"), "Content-Type")
    headers = F.filter(F.transform(F.split("h", r"\r?\n"), lambda x: F.trim(x)), lambda x, i: (i > 0) & (x != ""))
    w = F.col("w")
    return one.where(F.lower(field(w, "WARC-Type")) == "response").select(
        "page_id", F.coalesce(field(w, "WARC-Record-ID"), uuid_urn(F.lit("response"), F.col("raw"))).alias("record_id"), field(w, "WARC-Target-URI").alias("target_uri"),
        F.nullif(F.trim(F.split(kind, ";")[0]), F.lit("")).alias("content_type"), "payload", field(w, "WARC-Date").alias("date"),
        F.regexp_extract("h", r"^HTTP/\S+\s+([0-9]{3})", 1).try_cast("int").alias("status"),
        F.nullif(F.lower(F.regexp_extract(kind, r"(?i)charset=[\"']?([^\s;\"']+)", 1)), F.lit("")).alias("charset"), headers.alias("headers"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """One metadata and one conversion record for each response.

    Both carry warc_refers_to (the response's identifier), the response's target URI, date and payload digest; the
    metadata record's block lists the source headers (URI, content type, length, digest; date, status, charset and each
    HTTP header where the response has them) as warc-fields, the conversion record's block is the plain text. Digests are
    labelled sha256 of UTF-8 bytes. A null payload counts as empty (its conversion block is empty), a null URI gives an empty
    field; repeated rows give repeated records with equal identifiers, an empty table none. One narrow pass, no shuffle;
    extra columns, whatever their names, are left behind."""
    known = [F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in CAPTURE.items()]
    payload = F.coalesce("payload", F.lit(""))
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    base = records.select(
        "page_id", F.col("record_id").alias("warc_refers_to"), F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        F.coalesce("content_type", F.lit("")).alias("source_type"),
        F.octet_length(payload).cast("long").alias("source_length"), digest(payload).alias("source_digest"),
        plain_text(payload, F.col("content_type")).alias("text"), *known,
    )
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n")), F.lit(""))
    fields = F.concat(
        line("source-uri", F.col("target_uri")), line("source-content-type", F.col("source_type")), line("source-content-length", F.col("source_length")),
        line("source-payload-digest", F.col("source_digest")), line("source-date", F.col("date")), line("source-http-status", F.col("status")), line("source-charset", F.col("charset")),
        F.coalesce(F.array_join(F.transform("headers", lambda h: F.concat(F.lit("source-http-header: "), h, F.lit("\r\n"))), ""), F.lit("")),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = base.select("*", F.explode(kinds).alias("k")).select("*", "k.*").drop("k", "text")
    return out.select(
        "page_id", "warc_type", uuid_urn(F.col("warc_type"), F.col("warc_refers_to")).alias("warc_record_id"), "warc_refers_to",
        "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "source_digest", "source_length", F.col("date").alias("source_date"), "block",
    )


def to_bytes(records: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Each record as WARC/1.1 bytes, ready for a binary sink: it refers to its response by identifier, URI, date (where
    known) and payload digest. WARC-Date is `date`, the time of the derivation: given, so that reruns agree."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("warc_record_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("warc_refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("source_date")), line("WARC-Refers-To-Payload-Digest", F.col("source_digest")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")), F.lit("\r\n"), "block", F.lit("\r\n\r\n"),
    )
    return records.select("page_id", "warc_type", F.encode(head, "UTF-8").alias("record"))


def _sql_text(c: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, {q(HIDDEN)}, ' ', 'g'), {q(BREAK)}, chr(10) || '<\\1', 'g'), {q(TAG)}, ' ', 'g')"
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMES.items()) + "}"
    m, n = f"regexp_extract(p, {q(ENTITY)}, 1)", "(CASE WHEN m.m ILIKE '#x%' THEN CAST('0x' || substr(m.m, 3) AS INT) WHEN m.m LIKE '#%' THEN CAST(substr(m.m, 2) AS INT) END)"
    char = f"CASE WHEN m.n = 160 THEN ' ' WHEN m.n BETWEEN 1 AND {0xD7FF} OR m.n BETWEEN {0xE000} AND {0x10FFFF} THEN chr(m.n) WHEN m.n IS NULL AND m.m <> '' THEN {names}[m.m] END"
    piece = f"list_transform([{{'m': {m}}}], lambda m: list_transform([{{'m': m.m, 'n': {n}}}], lambda m: coalesce(({char}) || substr(p, length(m.m) + 2), '&' || p))[1])[1]"
    c = f"list_aggregate(list_transform(string_split({c}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), 'string_agg', '')"
    return f"trim(regexp_replace(regexp_replace({c}, {q(BLANKS)}, ' ', 'g'), {q(LINES)}, chr(10), 'g'), ' ' || chr(10))"


_URN = lambda *p: "(SELECT '<urn:uuid:' || substr(m,1,8) || '-' || substr(m,9,4) || '-' || substr(m,13,4) || '-' || substr(m,17,4) || '-' || substr(m,21,12) || '>' FROM (SELECT md5(" + " || chr(31) || ".join(p) + ") AS m))"

ORACLE = f"""
WITH b AS (SELECT page_id, {_URN("'response'", "coalesce(CAST(page_id AS VARCHAR), chr(0))", "coalesce(url, chr(0))", "coalesce(sha256(html), chr(0))")} AS warc_refers_to,
  coalesce(url, '') AS target_uri, strlen(coalesce(html, '')) AS source_length, 'sha256:' || sha256(coalesce(html, '')) AS source_digest,
  {_sql_text("coalesce(html, '')")} AS text FROM pages),
k AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
  'source-uri: ' || target_uri || chr(13) || chr(10) || 'source-content-type: text/html' || chr(13) || chr(10) || 'source-content-length: ' || source_length
  || chr(13) || chr(10) || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) AS block FROM b
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM b)
SELECT page_id, warc_type, {_URN("warc_type", "warc_refers_to")} AS warc_record_id, warc_refers_to, target_uri, content_type,
  strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_digest, source_length, CAST(NULL AS VARCHAR) AS source_date, block FROM k"""
