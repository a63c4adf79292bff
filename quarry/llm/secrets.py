"""Secret scans in SQL functions only: fixed patterns, and sliding-window entropy of candidate strings.

Patterns. ``assign``, ``access`` and ``hex`` find matches from left to right, not overlapping within a kind; a match that is
too short is dropped without another try. Places come from splitting the text at the matches, in code points.

Entropy. Candidates are runs of ``[A-Za-z0-9+/=_-]`` with a letter and a digit. A window of ``WINDOW`` characters moves
over each; the sum of c * log2(c) over its character counts is kept up by the character that enters and the one that
leaves. The time is linear in the length of a text and nearly so in its matches, for tokens of any length. A candidate counts if its highest window reaches the limit of its character class. Strings that match the
allow list are left out, and so are those that a pattern's span covers.

Null texts are empty: no spans, and the hash of the empty string. Repeated rows come out as often as they stand; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns with the group whose length counts and the least length (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need no match of their own
]
#: Texts without these strings (lower case) can't match.
HINTS = {"assign": ["passw", "secret", "token", "apikey", "api_key"], "access": ["akia"]}
KINDS = ["assign", "access", "hex", "entropy"]
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
WINDOW = 20
#: Least bits per character of the best window, by class.
LIMITS = {"hex": 3.0, "upper": 3.4, "mixed": 3.6}
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|(.)\1{5,}|0123456789|abcdefgh"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
ENTROPY = KINDS.index("entropy")
#: Items of a block of results, and characters of a piece of a text that is cut.
BLOCK, PIECE = 512, 1024
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, join, zero: int) -> Column:
    """For each of the numbers, all before it put together by ``join`` (an associative function), or zero.

    A fold copies what it holds at each step, so it goes over blocks of ``BLOCK`` numbers, and then over the blocks.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1)
        return F.transform(numbers, lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start, step))

    def put_together(found: Column) -> Column:
        heads = F.aggregate(found, start, lambda acc, x: step(acc, x["at"]), lambda acc: acc["all"])
        return F.flatten(F.zip_with(found, heads, lambda b, h: F.transform(b["all"], lambda x: join(h, x))))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), put_together)).otherwise(F.array().cast("array<int>")))


def _places(text: Column, pattern: str) -> Column:
    """Structs (start, end, m) of the matches, in order."""

    def spans(x: Column) -> Column:
        gaps, matches = x["gaps"], x["matches"]
        before = _before(F.zip_with(gaps, matches, lambda g, m: g + F.length(m)), lambda p, q: p + q, 0)
        out = F.zip_with(F.arrays_zip(gaps.alias("gap"), matches.alias("m")), before, lambda y, at: F.struct((at + y["gap"]).alias("start"), (at + y["gap"] + F.length(y["m"])).alias("end"), y["m"].alias("m")))
        return out

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return _let(F.struct(matches.alias("matches"), gaps.alias("gaps")), lambda x: _let(F.struct(x["matches"].alias("matches"), F.slice(x["gaps"], F.lit(1), F.size(x["matches"])).alias("gaps")), spans))


def _kind(text: Column, rank: int, low: Column) -> Column:
    name, pattern, group, least = PATTERNS[rank]
    found = _places(text, pattern)
    if group:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least)
    else:
        found = F.filter(found, lambda x: F.length(x["m"]) >= least)
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    hints = HINTS.get(name)
    hit = F.lit(False) if hints else text.rlike(pattern)
    for hint in hints or []:
        hit = hit | low.contains(hint)
    return F.when(hit, spans).otherwise(F.array().cast(_SPAN))


#: Counts up to a window's size have FIELD bits each in numbers that hold FIELDS of them.
FIELD, FIELDS = 6, 10


def _gain(n: Column) -> Column:
    """What a character adds to the sum of c * log2(c) when its count rises from n."""
    return F.element_at(F.array(*[F.lit(float((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0))) for c in range(WINDOW + 1)]), n + 1)


def peak_entropy(text: Column) -> Column:
    """Bits per character of the window of ``WINDOW`` characters with the highest entropy; 0 for shorter strings.

    One step for each character: the counts of the window are fields of a few numbers, one of them rises and one falls.
    """
    words = -(-(len(ALPHABET) + 1) // FIELDS)
    names = [f"c{w}" for w in range(words)]
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    # 0 stands for what isn't in the alphabet; -1 for no character
    none = F.array_repeat(F.lit(-1), WINDOW)
    pairs = F.arrays_zip(codes.alias("enters"), F.concat(none, codes).alias("leaves"))
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in names], F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def count(acc: Column, code: Column) -> Column:
        held = F.element_at(F.array(*[acc[n] for n in names]), (code / FIELDS).cast("int") + 1)
        return F.call_function("shiftright", held, FIELD * (code % FIELDS)).bitwiseAND(F.lit((1 << FIELD) - 1)).cast("int")

    def unit(code: Column, word: int) -> Column:
        return F.when((code / FIELDS).cast("int") == word, F.call_function("shiftleft", F.lit(1).cast("long"), FIELD * (code % FIELDS))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        gone = leaves >= 0
        after = F.when(gone, count(acc, leaves) + F.when(leaves == enters, 1).otherwise(0) - 1).otherwise(0)
        s = acc["s"] + _gain(count(acc, enters)) - F.when(gone, _gain(after)).otherwise(0.0)
        counts = [(acc[n] + unit(enters, w) - F.when(gone, unit(leaves, w)).otherwise(F.lit(0).cast("long"))).alias(n) for w, n in enumerate(names)]
        best = F.when(acc["i"] + 1 >= WINDOW, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - s / WINDOW)).otherwise(acc["best"])
        return F.struct(*counts, (acc["i"] + 1).alias("i"), s.alias("s"), best.alias("best"))

    return F.aggregate(F.slice(pairs, F.lit(1), F.length(text)), start, step, lambda acc: acc["best"])


def _entropic(text: Column) -> Column:
    """Structs (start, rank, end) of the candidates whose entropy counts."""
    found = F.filter(_places(text, CANDIDATE), lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & ~x["m"].rlike(ALLOWED))
    limit = lambda m: F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"]).when(m.rlike("^[A-Z0-9]+$"), LIMITS["upper"]).otherwise(LIMITS["mixed"])
    found = F.filter(found, lambda x: peak_entropy(x["m"]) >= limit(x["m"]))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(ENTROPY).alias("rank"), x["end"].alias("end")))
    return F.when(text.rlike(CANDIDATE) & text.rlike("[0-9]"), spans).otherwise(F.array().cast(_SPAN))


def _reach(spans: Column) -> Column:
    """For each of the sorted spans, the furthest end before it."""
    return _before(F.transform(spans, lambda x: x["end"]), F.greatest, 0)


def _uncovered(base: Column, entropic: Column) -> Column:
    """Both, by start and kind, without candidates within one base span."""

    def keep(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: F.when(x["rank"] < ENTROPY, x["end"]).otherwise(0))
        marked = F.zip_with(spans, _before(ends, F.greatest, 0), lambda x, reach: F.when((x["rank"] < ENTROPY) | (x["end"] > reach), x))
        return F.filter(marked, lambda x: x.isNotNull())

    return F.when(F.size(entropic) > 0, _let(F.sort_array(F.concat(base, entropic)), keep)).otherwise(base)


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(row, base, entropic, spans): each row as a struct, the patterns' spans, the candidates that count, and all spans.

    Spans are arrays of (start, rank, end); candidates that lie within a pattern's span aren't in ``spans``.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    base = F.sort_array(F.concat(*[_kind(text, rank, F.lower(text)) for rank in range(len(PATTERNS))]))
    out = docs.select(F.struct("*").alias("row")).select("row", base.alias("base"), _entropic(text).alias("entropic"))
    return out.withColumn("spans", _uncovered(F.col("base"), F.col("entropic")))


def _is(rank: int, x: Column) -> Column:
    return x["rank"] == rank


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the hash of the patterns' spans, all spans as text, and the number of candidates that count."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", partial(_is, r))).cast("long").alias(f"n_{KINDS[r]}") for r in range(len(PATTERNS))]
    return found.select("row.doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), F.size("entropic").cast("long").alias("n_entropic"))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with every span of text replaced by the mark, and n_chars, if there is one, set anew; other columns stay, whatever their names."""
    text = F.col("row.text")

    def between(spans: Column) -> Column:
        # a span inside the one before is gone with it; one that overlaps it gets no mark of its own
        found = F.zip_with(spans, _reach(spans), lambda x, at: F.when(x["start"] >= at, F.struct(at.alias("start"), x["start"].alias("end"))))
        return F.filter(found, lambda x: x.isNotNull())

    end = F.length(text)
    kept = _let(F.concat("spans", F.array(F.struct(end.alias("start"), F.lit(0).alias("rank"), end.alias("end")))), between)
    found = scan(docs).withColumn("kept", kept)
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def piece(x: Column, parts: Column) -> Column:
        part = lambda k: F.element_at(parts, k + 1)
        low = lambda k: F.greatest(x["start"] - k * PIECE, F.lit(0))
        inner = lambda k: F.substring(part(k), low(k) + 1, F.least(x["end"] - k * PIECE, F.lit(PIECE)) - low(k))
        parts = F.transform(F.sequence((x["start"] / PIECE).cast("int"), ((x["end"] - 1) / PIECE).cast("int")), inner)
        return F.when(x["end"] > x["start"], F.array_join(parts, "")).otherwise("")

    clean = _let(F.struct(F.col("kept").alias("kept"), parts.alias("parts")), lambda v: F.array_join(F.transform(v["kept"], lambda x: piece(x, v["parts"])), mark))
    clean = F.when(F.size("spans") > 0, clean).otherwise(text)
    out = found.select("row", F.size("spans").alias("n"), clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("n") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: The same in DuckDB; its entropy is counted anew for each window.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES ('assign', 0), ('access', 1), ('hex', 2), ('entropy', 3)) AS v(kind, rank)),
f AS (SELECT doc_id, kind, rank,
    CASE rank WHEN 0 THEN regexp_extract_all(t, '{ASSIGN.replace("'", "''")}') WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+')
      WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, '[A-Za-z0-9+/=_-]{{20,}}') END AS m,
    CASE rank WHEN 0 THEN string_split_regex(t, '{ASSIGN.replace("'", "''")}') WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+')
      WHEN 2 THEN string_split_regex(t, '[0-9a-f]+') ELSE string_split_regex(t, '[A-Za-z0-9+/=_-]{{20,}}') END AS g
  FROM d, p),
i AS (SELECT doc_id, kind, rank, m, g, unnest(range(1, len(m) + 1)) AS n FROM f),
c AS (SELECT doc_id, kind, rank, m[n] AS x, n, length(g[n]) AS gap, length(m[n]) AS size FROM i),
s AS (SELECT doc_id, kind, rank, x, size, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY n) - size AS a FROM c),
w AS (SELECT *, CASE WHEN rank = 3 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
      AND NOT regexp_matches(x, '(?i)example|sample|placeholder|changeme|dummy|0123456789|abcdefgh')
      AND len(list_filter(range(1, size - 4), lambda j: x[j:j + 5] = repeat(x[j], 6))) = 0
    THEN list_max(list_transform(range(1, size - {WINDOW} + 2), lambda j: list_aggregate(string_split(x[j:j + {WINDOW - 1}], ''), 'entropy'))) END AS bits FROM s),
k AS (SELECT *, a + size AS b FROM w WHERE CASE rank
    WHEN 0 THEN length(regexp_extract(x, '{ASSIGN.replace("'", "''")}', 2)) >= 12 WHEN 1 THEN size >= 18 WHEN 2 THEN size >= 16
    ELSE bits >= CASE WHEN regexp_matches(x, '^([0-9a-f]+|[0-9A-F]+)$') THEN {LIMITS["hex"]} WHEN regexp_matches(x, '^[A-Z0-9]+$') THEN {LIMITS["upper"]} ELSE {LIMITS["mixed"]} END END),
v AS (SELECT *, concat(kind, ':', CAST(a AS VARCHAR), ':', CAST(b AS VARCHAR)) AS span,
    rank = 3 AND EXISTS (SELECT 1 FROM k AS o WHERE o.doc_id = k.doc_id AND o.rank < 3 AND o.a <= k.a AND o.b >= k.b) AS covered FROM k),
r AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY a, rank, b) FILTER (WHERE NOT covered) AS spans,
    count(*) FILTER (WHERE rank = 3) AS n_entropic FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropic, 0) AS n_entropic
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
