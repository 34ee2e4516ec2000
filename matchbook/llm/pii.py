"""Personal data in texts, with DataFrame functions alone.

Each kind has a pattern that proposes spans, a validator that confirms them, and
context words that raise the score of a span shortly behind them. The patterns are
written so that each start costs constant time however long a run of letters or
digits is: possessive repeats, and starts only at the begin of a run (or where the
last match ended), which finds the same leftmost matches.

Positions come from the gaps between matches, summed in two levels, so a text with
very many matches stays near linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.common import whole_text


@dataclass(frozen=True)
class Kind:
    """needs: a cheap test without which the pattern can't match. valid: SQL over the
    match x.m. score: before context. least: score to reach; None keeps whatever is valid."""

    name: str
    pattern: str
    needs: str
    valid: str
    score: float
    words: str
    least: float | None = None


_MOD97 = """aggregate(sequence(1, length(regexp_replace(x.m, ' ', ''))), 0L, (a, i) ->
  (CASE WHEN {c} BETWEEN '0' AND '9' THEN a * 10 + ascii({c}) - 48 ELSE a * 100 + ascii({c}) - 55 END) % 97)
""".format(c="substring(concat(substring(regexp_replace(x.m, ' ', ''), 5), substring(regexp_replace(x.m, ' ', ''), 1, 4)), i, 1)")

BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", 0.8, r"e-?mail|contact|write to|mailto"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"text RLIKE r'[0-9]\.[0-9]'", r"forall(split(x.m, r'\.'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND coalesce(try_cast(regexp_replace(p, '^0+', '') AS int), 0) <= 255)", 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "text RLIKE r'[0-9][ -]?[0-9]'", "length(regexp_replace(x.m, '[ -]', '')) BETWEEN 16 AND 19 AND luhn_check(regexp_replace(x.m, '[ -]', ''))", 0.7, r"card|visa|master|credit|debit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "text RLIKE r'\\+[0-9]'", "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 8 AND 15", 0.6, r"phone|tel|call|mobile|fax"),
)
#: Characters that differ in a secret, at least; words that stand before one.
DISTINCT, _SECRET = 8, r"token|secret|passw|api[ _-]?key|bearer|credential"
#: Kinds that the method adds; they need a checksum or context to reach `least`.
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "text RLIKE '[A-Z][A-Z][0-9][0-9]'", f"length(regexp_replace(x.m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97} = 1", 0.8, r"iban|bank|account|konto|cuenta|compte", 0.7),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "text RLIKE '[0-9]-[0-9]'", "true", 0.4, r"\bssn\b|social security|social insurance", 0.7),
    Kind("key", r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,200}+|xox[abprs]-[A-Za-z0-9-]{10,200}+|sk-[A-Za-z0-9_-]{20,200}+|eyJ[A-Za-z0-9_-]{10,2000}+\.[A-Za-z0-9_-]{10,2000}+\.[A-Za-z0-9_-]{10,2000}+)(?![A-Za-z0-9_-])", "text RLIKE 'AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ'", f"size(array_distinct(split(x.m, ''))) >= {DISTINCT}", 0.9, _SECRET),
    Kind("private_key", r"-----BEGIN (?:[A-Z0-9]{2,12}\x20){0,3}PRIVATE KEY-----", "contains(text, 'PRIVATE KEY-----')", "true", 1.0, _SECRET),
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,200}+={0,2}+(?![A-Za-z0-9_+/=-])", f"lower(text) RLIKE r'{_SECRET}'", f"x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]' AND size(array_distinct(split(x.m, ''))) >= {DISTINCT}", 0.4, _SECRET, 0.7),
)
CONTEXT_CHARS, CONTEXT_BONUS, GROUP = 40, 0.3, 256


def _located(k: Kind) -> tuple[str, str, str]:
    """SQL for: the matches; (gap, match) lengths in groups of GROUP; spans as structs (s, e, m)."""
    pattern = k.pattern.replace("'", r"\x27")
    found = f"CASE WHEN {k.needs} THEN regexp_extract_all(text, r'{pattern}', 0) ELSE cast(array() AS array<string>) END"
    sizes = f"""CASE WHEN size(m_{k.name}) > 0 THEN transform(sequence(0, size(m_{k.name}) - 1, {GROUP}), i -> slice(
      zip_with(slice(split(text, r'{pattern}', -1), 1, size(m_{k.name})), m_{k.name}, (g, m) -> named_struct('g', length(g), 'm', m)), i + 1, {GROUP})) END"""
    spans = f"""CASE WHEN g_{k.name} IS NULL THEN array() ELSE flatten(zip_with(g_{k.name},
      transform(g_{k.name}, (unused, i) -> aggregate(slice(g_{k.name}, 1, i), 0, (t, g) -> t + aggregate(g, 0, (u, x) -> u + x.g + length(x.m)))),
      (g, o) -> aggregate(g, named_struct('p', o, 'a', cast(array() AS array<struct<s: int, e: int, m: string>>)),
        (t, x) -> named_struct('p', t.p + x.g + length(x.m), 'a', concat(t.a, array(named_struct('s', t.p + x.g, 'e', t.p + x.g + length(x.m), 'm', x.m)))),
        t -> t.a))) END"""
    return found, sizes, spans


def _scored(k: Kind) -> Column:
    near = f"regexp_like(lower(substring(text, greatest(x.s - {CONTEXT_CHARS} + 1, 1), least(x.s, {CONTEXT_CHARS}))), r'{k.words}')"
    score = f"{k.score}D + CASE WHEN {near} THEN {CONTEXT_BONUS}D ELSE 0D END"
    spans = f"transform(filter(s_{k.name}, x -> {k.valid}), x -> named_struct('kind', '{k.name}', 'start', x.s, 'end', x.e, 'match', x.m, 'score', round(least({score}, 1D), 2)))"
    return F.expr(spans if k.least is None else f"filter({spans}, y -> y.score >= {k.least})")


def find_pii(docs: DataFrame, text: str = "text", id_col: str = "doc_id", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """id and spans: array of (kind, start, end, match, score), by kind as listed, then
    start. Positions count code points, the end is exclusive.

    Null texts count as empty and have no spans. Within a kind, matches are leftmost and
    don't overlap; those that their validator refuses are dropped without another try.
    Spans of different kinds may overlap. Repeated rows are each answered.
    """
    rows = docs.select(F.col(id_col), whole_text(text).alias("text"))
    parts = {k.name: _located(k) for k in kinds}
    rows = rows.withColumns({f"m_{n}": F.expr(p[0]) for n, p in parts.items()})
    rows = rows.withColumns({f"g_{n}": F.expr(p[1]) for n, p in parts.items()})
    rows = rows.withColumns({f"s_{n}": F.expr(p[2]) for n, p in parts.items()})
    return rows.select(id_col, F.concat(*[_scored(k) for k in kinds]).alias("spans"))


def redact(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.0) -> DataFrame:
    """id and the text with each span of at least that score replaced by [KIND]; of
    overlapping spans the one that starts first (then the longer) counts."""
    found = find_pii(docs.select(id_col, F.col(text).alias("text")).withColumn(id_col, F.struct(F.col(id_col).alias("id"), whole_text("text").alias("t"))), "text", id_col)
    ordered = F.expr(f"array_sort(filter(spans, x -> x.score >= {least}D), (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END)")
    body = F.expr(f"""aggregate(ordered, named_struct('p', 0, 'o', ''),
      (s, x) -> CASE WHEN x.start < s.p THEN s ELSE named_struct('p', x.end, 'o', concat(s.o, substring({id_col}.t, s.p + 1, x.start - s.p), '[', upper(x.kind), ']')) END,
      s -> concat(s.o, substring({id_col}.t, s.p + 1)))""")
    return found.withColumn("ordered", ordered).select(F.col(f"{id_col}.id").alias(id_col), body.alias("text"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """A row a document: counts of the base kinds, a digest of their spans, all spans, and how
    many of them are secrets and how many there are."""
    found = find_pii(docs)
    names = ", ".join(f"'{k.name}'" for k in BASE)
    said = "x -> concat(x.kind, ':', x.start, ':', x.end)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k.name}')) AS long)").alias(f"n_{k.name}") for k in BASE],
        F.sha2(F.expr(f"array_join(transform(filter(spans, x -> x.kind IN ({names})), {said}), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(spans, {said}), ',')").alias("spans"),
        F.expr("cast(size(filter(spans, x -> x.kind IN ('key', 'private_key', 'secret'))) AS long)").alias("n_secret"),
        F.expr("cast(size(spans) AS long)").alias("n_spans"),
    )
