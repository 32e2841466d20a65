"""Personal data in texts, with DataFrame and SQL functions only.

Patterns propose spans, checks confirm them (parts of an address, Luhn, mod 97, number of
digits), and words near a span raise its score. The base kinds email, ip, card and phone
are reported whenever their check holds; the further kinds (iban, national_id) also
need a score of `KEEP_AT`.

Places come from the pieces between matches: `split` and `regexp_extract_all` with one
pattern give n + 1 pieces and n matches, so a match starts after the pieces up to
it and the matches before it. Possessive quantifiers keep every pattern linear and free of
recursion; `(?:(?<!x)|\\G)` lets a run of x be tried only where it begins or where the last match ended,
which finds the same leftmost matches. Parts of a text at given places (the words around a match, what
lies between two masks) are taken from its blocks of `BLOCK` code points, as a substring of the whole text would be
read from its beginning each time; so the work grows with the text, not with its square.

Defined cases: a null text is an empty one (`redact` leaves it null); a text without matches has zero
counts, the hash of the empty string and an empty span list; rows that repeat a doc_id
are each searched; an empty table gives no rows; other columns, of whatever names, are ignored (`redact` keeps
them); offsets are code points, the end exclusive; spans that start together are in the order of `KINDS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.shared import free_name, quoted

#: Kind, pattern, a cheap test that must hold for any match, score without and rise with a context word, context words.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", 0.7, 0.2, "mail|contact|write|correo|courriel"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"{t} rlike '[0-9][.][0-9]'", 0.6, 0.2, "ip|address|host|server|adresse"),
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", r"{t} rlike '[0-9](?:[ -]?[0-9]){{11}}'", 0.7, 0.2, "card|visa|credit|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", 0.6, 0.2, "phone|call|tel|mobile|telefon"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,4})?+)(?![A-Za-z0-9])", r"{t} rlike '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]'", 0.8, 0.2, "iban|account|bank|konto|cuenta|compte"),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"{t} rlike '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'", 0.3, 0.5, "ssn|social security|national id"),
}
BASE = ("email", "ip", "card", "phone")
KEEP_AT = 0.5
#: Code points on each side of a span in which context words count.
CONTEXT = 40
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: SQL on a match `x`.
_CHECK = {
    "email": "true",
    "ip": f"x.value rlike '^{_PART}(?:[.]{_PART}){{3}}$'",
    "card": "length(translate(x.value, ' -', '')) between 12 and 19 and luhn_check(translate(x.value, ' -', ''))",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15",
    "iban": """length(translate(x.value, ' ', '')) between 15 and 34 and aggregate(
        split(concat(substring(translate(x.value, ' ', ''), 5), substring(x.value, 1, 4)), ''), 0,
        (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1""",
    "national_id": "substring(x.value, 1, 3) not in ('000', '666') and substring(x.value, 5, 2) != '00' and substring(x.value, 8, 4) != '0000'",
}
#: Elements taken together in one step of a running sum or maximum.
_STEP = 64
#: Code points of a block of a text.
BLOCK = 256


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(df: DataFrame, name: str, values: str, first: str, both: str) -> DataFrame:
    """Add `name`: for each element of the array `values`, the combination `both` (SQL on a and y) of all up to it, itself included.

    Arrays that go element by element are arguments of one function: an array that a lambda reads by index, and that is
    read only there, would be worked out again for every element.
    """
    fold = lambda part: f"aggregate({part}, {first}, (a, y) -> {both})"
    df = df.withColumn(f"{name}_c", F.expr(f"transform(sequence(0, (size({values}) - 1) div {_STEP}), k -> slice({values}, cast(k * {_STEP} + 1 as int), {_STEP}))"))
    df = df.withColumn(f"{name}_s", F.expr(f"transform({name}_c, c -> {fold('c')})"))
    df = df.withColumn(f"{name}_b", F.expr(f"transform({name}_s, (z, k) -> {fold(f'slice({name}_s, 1, k)')})"))
    within = f"transform(c, (z, i) -> {fold('concat(array(b), slice(c, 1, cast(i + 1 as int)))')})"
    return df.withColumn(name, F.expr(f"flatten(zip_with({name}_c, {name}_b, (c, b) -> {within}))")).drop(f"{name}_c", f"{name}_s", f"{name}_b")


def _between(blocks: str, a: str, b: str) -> str:
    """SQL for the text from place `a` to `b`, of its blocks."""
    block = lambda x: f"{blocks}[cast(({x}) div {BLOCK} as int)]"
    inside = lambda x: f"cast(({x}) % {BLOCK} as int)"
    return f"""case when ({a}) >= ({b}) then '' when ({a}) div {BLOCK} = (({b}) - 1) div {BLOCK} then substring({block(a)}, {inside(a)} + 1, cast(({b}) - ({a}) as int))
        else concat(substring({block(a)}, {inside(a)} + 1), array_join(slice({blocks}, cast(({a}) div {BLOCK} + 2 as int), cast((({b}) - 1) div {BLOCK} - ({a}) div {BLOCK} - 1 as int)), ''),
            substring({block(f'({b}) - 1')}, 1, {inside(f'({b}) - 1')} + 1)) end"""


def _spans(df: DataFrame, tag: str, kind: str, order: int) -> DataFrame:
    """Add `<tag>_s_<kind>`, a sorted array of (start, nr, end, kind, score), from the kind's matches and the lengths of the pieces between them."""
    _, _, low, rise, words = KINDS[kind]
    m, p, blocks = f"{tag}_m_{kind}", f"{tag}_p_{kind}", f"{tag}_blocks"
    df = df.withColumn(f"{tag}_steps", F.expr(f"zip_with({m}, slice({p}, 1, size({m})), (y, n) -> cast(n + length(y) as long))"))  # from one end to the next
    df = _running(df, f"{tag}_ends", f"{tag}_steps", "0L", "a + y")
    found = f"filter(zip_with({m}, {tag}_ends, (y, e) -> struct(e - length(y) as start, e as end, y as value)), x -> {_CHECK[kind]})"
    near = f"lower(concat({_between(blocks, f'greatest(x.start - {CONTEXT}, 0)', 'x.start')}, ' ', {_between(blocks, 'x.end', f'least(x.end + {CONTEXT}, {tag}_n)')}))"
    scored = f"transform({found}, x -> struct(x.start as start, {order} as nr, x.end as end, '{kind}' as kind, case when {near} rlike {_sql(rf'(?<![a-z])(?:{words})(?![a-z])')} then {low + rise:.1f}D else {low:.1f}D end as score))"
    if kind not in BASE:
        scored = f"filter({scored}, x -> x.score >= {KEEP_AT})"
    return df.withColumn(f"{tag}_s_{kind}", F.expr(scored)).drop(m, p, f"{tag}_steps", f"{tag}_ends")


def _searched(df: DataFrame, text: str, tag: str) -> DataFrame:
    """Add `<tag>_spans`, and `<tag>_blocks` of texts that have any match; `tag` begins no other column's name."""
    t, none = f"{tag}_t", "cast(array() as array<string>)"
    df = df.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit("")))
    for kind, (pattern, quick, *_) in KINDS.items():  # in steps, so that no expression is worked out twice
        df = df.withColumn(f"{tag}_m_{kind}", F.expr(f"case when {quick.format(t=t)} then regexp_extract_all({t}, {_sql(pattern)}, 0) else {none} end"))
        df = df.withColumn(f"{tag}_p_{kind}", F.expr(f"case when size({tag}_m_{kind}) > 0 then transform(split({t}, {_sql(pattern)}, -1), y -> length(y)) else cast(array() as array<int>) end"))
    matched = " or ".join(f"size({tag}_m_{kind}) > 0" for kind in KINDS)
    df = df.withColumn(f"{tag}_blocks", F.expr(f"case when {matched} then regexp_extract_all({t}, '(?s).{{1,{BLOCK}}}', 0) else {none} end")).withColumn(f"{tag}_n", F.length(t))
    for order, kind in enumerate(KINDS):
        df = _spans(df, tag, kind, order)
    names = [f"{tag}_s_{k}" for k in KINDS]
    return df.withColumn(f"{tag}_spans", F.array_sort(F.flatten(F.array(*names)))).drop(*names)


def find_spans(df: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """Add the column `into`: array of (start, nr, end, kind, score) in order; other columns stay."""
    tag = free_name(df, "_pii")
    found = _searched(df, text, tag)
    return found.withColumn(into, F.col(f"{tag}_spans")).drop(f"{tag}_t", f"{tag}_n", f"{tag}_blocks", f"{tag}_spans")


def _said(spans: str) -> F.Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and scores (one for each span, in order) of every row."""
    found = find_spans(docs.select("doc_id", "text")).withColumn("base", F.expr(f"filter(pii_spans, x -> x.nr < {len(BASE)})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    scores = F.expr("array_join(transform(pii_spans, x -> cast(x.score as string)), ',')").alias("scores")
    return found.select("doc_id", *counts, F.sha2(_said("base").cast("binary"), 256).alias("base_sha256"), _said("pii_spans").alias("spans"), scores)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns; each span of `text` is replaced by its kind, as in [EMAIL].

    A span that starts inside an earlier one is part of it; a null text stays null.
    """
    tag = free_name(docs, "_pii")
    spans, reach, leads = f"{tag}_spans", f"{tag}_reach", f"{tag}_leads"
    found = _searched(docs, text, tag).withColumn(f"{tag}_e", F.expr(f"transform({spans}, x -> x.end)"))
    found = _running(found, reach, f"{tag}_e", "0L", "greatest(a, y)")
    # spans that start outside all before them, by number; each masks what is reached before the next of them
    found = found.withColumn(leads, F.expr(f"filter(transform({spans}, (x, i) -> case when i = 0 or x.start >= {reach}[i - 1] then i end), i -> i is not null)"))
    before = f"case when j = 0 then 0L else {reach}[i - 1] end"
    parts = f"transform({leads}, (i, j) -> concat({_between(f'{tag}_blocks', before, f'{spans}[i].start')}, '[', upper({spans}[i].kind), ']'))"
    rest = _between(f"{tag}_blocks", f"{reach}[size({reach}) - 1]", f"{tag}_n")
    masked = F.when(F.size(spans) > 0, F.concat(F.array_join(F.expr(parts), ""), F.expr(rest))).otherwise(F.col(quoted(text)))
    return found.withColumn(f"{tag}_out", masked).select(*[F.col(f"{tag}_out").alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
