"""Secret scans: multipart credential linking over whole texts, in DataFrame functions only.

Strong findings (assignments with a long value, access keys, long hex runs) stand alone. Weak candidates are an access
identifier, a secret-looking value or an endpoint; alone each is too common to report. They are joined with the scope
(paragraph) that their interval lies in, and reported only where complementary parts co-occur there: a secret together
with an identifier or an endpoint. Strong findings take part in that: an access key as an identifier, an assignment or
a hex run as a secret. An identifier and an endpoint without a secret give nothing.

Scale. Everything is a projection of one scan: parts never link across rows, so no shuffle and no key is involved. Cheap
substring tests guard each pattern, so clean texts cost one pass. Inside a text, cost grows with its length and with the
number of its parts (times its logarithm, for one sort): positions and running ends are prefix sums in chunks, and the
join of parts with scopes is one sweep over parts and scope ends in order of start. No part looks at another one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import text_column

#: Fixed patterns of the strong kinds; in the first the key's letters match in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
#: What looks like a secret by itself: a whole run of 20 or more letters, digits and signs with a digit and a capital, no access key.
SECRET = r"(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?![A-Za-z0-9+/_-]*AKIA[A-Z0-9]{12})[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Weak parts by role: what names an account, what may be its secret, where it is used. A key may follow an underscore
#: (DB_USER) and a value its key's equals sign; none has a greatest length. What looks like a secret names no account.
WEAK = {
    "ident": rf"""(?i:(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?(?!{SECRET})[A-Za-z0-9@._-]{{3,}}""",
    "value": rf"(?<![A-Za-z0-9+/_-]){SECRET}",
    "endpoint": r"""(?i:\b(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://)[^\s"'<>]{3,}""",
}
#: The end of a scope: a line end before a blank line. No pattern above matches across a line end.
SCOPE_END = r"\n(?=[ \t\r]*\n)"
#: The role that a strong kind plays for its weak neighbours.
ROLE = {"assign": "value", "access": "ident", "hex": "value"}
KINDS = ["assign", "access", "hex", *WEAK]
CHUNK = 64
#: Code points of the blocks from which a text's pieces are cut.
BLOCK = 4096
SPAN = "array<struct<start:long,kind:int,end:long>>"
LONGS = "array<long>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: str, combine: str) -> str:
    """SQL of the running results of an associative ``combine`` of {a} and {b}, with zero as its identity, over an array of longs.

    Chunks keep the copying near linear: results inside each of them, then moved on by the last of those before.
    """
    now, moved = combine.format(a="acc.last", b="x"), combine.format(a="acc.last", b="c.last")
    inside = f"aggregate(slice(v, i, {CHUNK}), named_struct('last', 0L, 'out', cast(array() as {LONGS})), (acc, x) -> named_struct('last', {now}, 'out', concat(acc.out, array({now}))))"
    chunks = f"transform(sequence(1, greatest(size(v), 1), {CHUNK}), i -> {inside})"
    carried = f"aggregate({chunks}, named_struct('last', 0L, 'out', cast(array() as array<{LONGS}>)), (acc, c) -> named_struct('last', {moved}, 'out', concat(acc.out, array(transform(c.out, x -> {now})))))"
    return f"element_at(transform(array({values}), v -> flatten({carried}.out)), 1)"


def _spans(pattern: str, kind: int, guard: Column | None = None, least: int = 0) -> Column:
    """Code-point spans of a pattern's leftmost non-overlapping matches in _text; ``least``: characters that its second group needs.

    A match starts where the text before it and the matches before it end, a running sum of their lengths.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    valid = f"length(regexp_extract(hit, {quoted}, 2)) >= {least}" if least else "true"
    hits = f"transform(array(regexp_extract_all(_text, {quoted}, 0)), hits -> zip_with(slice(split(_text, {quoted}, -1), 1, size(hits)), hits, (gap, hit) -> named_struct('gap', cast(length(gap) as long), 'width', cast(length(hit) as long), 'valid', {valid})))"
    ends = _running("transform(p, x -> x.gap + x.width)", "{a} + {b}")
    placed = f"zip_with(p, {ends}, (x, e) -> if(x.valid, named_struct('start', e - x.width, 'kind', {kind}, 'end', e), null))"
    spans = F.expr(f"element_at(transform({hits}, p -> filter({placed}, s -> s is not null)), 1)").cast(SPAN)
    seen = F.col("_text").rlike(pattern)
    return F.when(seen if guard is None else guard & seen, spans).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(parts: Column) -> Column:
    """The weak ones of ``parts``, spans and scope ends in order of start, whose scope has a secret and an identifier or endpoint.

    The parts' roles make a string, a letter each; scopes are what its bars part, and one that lacks a role is struck out.
    """
    letters = {"value": "v", "ident": "i", "endpoint": "e"}
    role = F.array(*[F.lit(letters[ROLE.get(k, k)]) for k in KINDS], F.lit("|"))

    def complete(scope: Column) -> Column:
        return F.when(F.contains(scope, F.lit("v")) & scope.rlike("[ie]"), scope).otherwise(F.repeat(F.lit("-"), F.length(scope)))

    def kept(seq: Column) -> Column:
        roles = F.array_join(F.transform(seq, lambda p: role[p["kind"]]), "")
        marks = F.regexp_extract_all(F.array_join(F.transform(F.split(roles, r"\|", -1), complete), "|"), F.lit("."), F.lit(0))
        marked = F.zip_with(seq, marks, lambda p, mark: F.struct(p.alias("p"), mark.alias("mark")))
        return F.transform(F.filter(marked, lambda x: (x["mark"] != "-") & x["p"]["kind"].between(len(ROLE), len(KINDS) - 1)), lambda x: x["p"])

    return _let(parts, kept)


def _scanned(rows: DataFrame) -> DataFrame:
    """``rows`` with a column _text: what is found of each kind, the strong spans as _base and the linked weak ones as _linked."""
    text, lowered = F.col("_text"), F.lower("_text")
    has_key = F.lit(False)
    for key in ASSIGN_KEYS:
        has_key = has_key | F.contains(lowered, F.lit(key))
    found = {"_assign": _spans(ASSIGN, 0, has_key, ASSIGN_LEAST), "_access": _spans(ACCESS, 1, F.contains(text, F.lit("AKIA"))), "_hex": _spans(HEX, 2)}
    guards = {"ident": lowered.rlike("user|login|client|account|access"), "endpoint": F.contains(text, F.lit("://"))}
    found |= {f"_{k}": _spans(p, KINDS.index(k), guards.get(k)) for k, p in WEAK.items()}
    rows = rows.withColumns(found).withColumn("_base", F.array_sort(F.concat(*[f"_{k}" for k in ROLE])))
    secret = (F.size("_assign") > 0) | (F.size("_hex") > 0) | (F.size("_value") > 0)
    other = (F.size("_access") > 0) | (F.size("_ident") > 0) | (F.size("_endpoint") > 0)
    weak = F.size("_ident") + F.size("_value") + F.size("_endpoint") > 0
    rows = rows.withColumn("_ends", F.when(secret & other & weak, _spans(SCOPE_END, len(KINDS))))
    parts = F.array_sort(F.concat("_base", *[f"_{k}" for k in WEAK], "_ends"))
    return rows.withColumn("_linked", F.when(F.col("_ends").isNotNull(), _linked(parts)).otherwise(F.array().cast(SPAN)))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_assign, n_access, n_hex, n_weak, base_sha256, spans).

    spans lists kind:start:end of strong findings and of linked weak parts by start, then kind; positions are code
    points, ends exclusive. base_sha256 hashes the strong ones alone, in the same form. A weak part is linked if its
    paragraph (blank lines part them) holds a secret and an identifier or endpoint, itself included; it may overlap a
    strong one, then both are listed.

    Null texts count as empty: no spans. Null or repeated ids do not matter, a row is scanned by itself. Very long
    texts are scanned whole. Ties in start are in the order of KINDS. An empty table gives an empty result; further
    columns are not read.
    """
    rows = _scanned(docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text")))
    return rows.select(
        F.col("_id").alias(id_col),
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ROLE],
        F.size("_linked").cast("long").alias("n_weak"),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", "_linked"))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span, strong or linked, replaced by ``mask``; overlapping spans are replaced together.

    All rows and columns stay as they are otherwise, a null text null.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("_no_text"))
    rows = _scanned(docs.select(others.alias("_row"), text_column(f"`{text_col}`").alias("_text")))
    rows = rows.withColumn("_spans", F.array_sort(F.concat("_base", "_linked")))
    # A span begins a masked run unless one before it reaches further; the text since the last run's end is kept.
    reach, kept = _running("transform(_spans, s -> s.end)", "greatest({a}, {b})"), "named_struct('from', a, 'to', s.start)"
    inner = f"filter(zip_with(concat(array(0L), slice(r, 1, size(r) - 1)), _spans, (a, s) -> {kept}), g -> g.from <= g.to)"
    gaps = F.expr(f"element_at(transform(array({reach}), r -> concat({inner}, array(named_struct('from', element_at(r, -1), 'to', {1 << 40}L)))), 1)")

    def cut(blocks: Column, g: Column) -> Column:
        first, last = F.floor(g["from"] / BLOCK).cast("int"), F.least(F.floor((g["to"] - 1) / BLOCK).cast("int"), F.size(blocks))
        width = F.least(g["to"] - g["from"], F.lit((1 << 31) - 1)).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(g["to"] > g["from"], F.substring(near, (g["from"] % BLOCK + 1).cast("int"), width)).otherwise("")

    rows = rows.withColumn("_gaps", F.when(F.size("_spans") > 0, gaps))
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    text = F.when(F.col("_gaps").isNull(), F.col("_text")).otherwise(_let(F.struct(blocks.alias("b"), F.col("_gaps").alias("g")), lambda x: F.array_join(F.transform(x["g"], lambda g: cut(x["b"], g)), mask)))
    text = F.when(~F.col("_row")["_no_text"], text).alias(text_col)
    return rows.select(*[text if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
