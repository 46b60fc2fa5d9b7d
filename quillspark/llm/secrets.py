"""Secret scans: named patterns, and sliding-window Shannon entropy over candidate strings.

Patterns give assign, access and hex spans. Candidates are unbroken strings of a character class
(hex digits; letters and digits; these with + / _ -); over each a window slides one
character at a time, and sum(c * log2(c)) of its character counts is updated from the two counts that change, so
a step costs no recount. A candidate is a secret if the entropy of some window reaches its class's
threshold and no allow rule suppresses it. Everything is built-in functions.

Positions are code points: the text between matches and the matches have lengths, whose running sums
are starts and ends; they are summed in blocks, so a text with very many matches costs little more for each.

Defined results: null and empty texts have no spans; every row gives one row; an entropy span equal to
a pattern's span is listed too, being of another kind; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import characters, let, running_sums
from quillspark.llm.shared import read

# The patterns of named kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# End of fixed values.

KINDS = ["assign", "access", "hex", "entropy"]


@dataclass(frozen=True)
class CharClass:
    """A character class of candidates: which strings are of it, its alphabet, the window, and the bits a character that make a secret."""

    name: str
    whole: str
    alphabet: str
    window: int
    bits: float


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A candidate: a maximal unbroken string of the widest class that has a digit and a letter.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: A candidate is of the first class that it fits. Thresholds lie below what random strings nearly always reach and above what words with numbers do.
CLASSES = [
    CharClass("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", 20, 2.91),
    CharClass("base62", "^[A-Za-z0-9]+$", _DIGITS + _LOWER + _UPPER, 20, 3.61),
    CharClass("base64", "^.*$", _DIGITS + _LOWER + _UPPER + "+/_-", 20, 3.71),
]
#: Allow-list: a candidate that one of these matches is no secret (a word with a number, a path of words, a placeholder, a counting run).
ALLOW = [
    "^[A-Za-z]+[0-9]{1,4}$",
    "^[0-9]{1,4}[A-Za-z]+$",
    "^/?([A-Za-z]+[/_-])+[A-Za-z0-9]{0,12}$",
    "(?i:example|sample|dummy|placeholder|changeme|xxxx)",
    "(?i:0123456789|1234567890|abcdefghij)",
]

_SPAN = "struct<s:int,k:int,e:int,kind:string,m:string>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a pattern's matches, leftmost and not overlapping; keep says of (match, group 1) whether it stays."""
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(pieces: Column) -> Column:
        starts = running_sums(F.transform(pieces, lambda x: F.length(x["gap"]) + F.length(x["m"])))

        def span(x, before):
            s = before + F.length(x["gap"])
            return F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (s + F.length(x["m"])).alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m"), x["g"].alias("g"))

        spans = F.zip_with(pieces, starts, span)
        left = spans if keep is None else F.filter(spans, lambda x: keep(x["m"], x["g"]))
        return F.transform(left, lambda x: x.dropFields("g"))

    def matched(matches: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if pattern == ASSIGN else matches
        return let(F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("m"), groups.alias("g")), placed)

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matched)).otherwise(none)


def _weight(count: Column) -> Column:
    """c * log2(c), 0 for c = 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(string: Column, cls: CharClass) -> Column:
    """The highest Shannon entropy, in bits a character, over windows of cls.window characters of a string of the class, by incremental counts."""
    w = cls.window
    codes = F.transform(characters(string), lambda c: F.instr(F.lit(cls.alphabet), c) - 1)
    none = F.lit(None).cast("int")
    #: each step's character and the one that leaves the window, as one array: lambda variables are not evaluated anew
    steps = let(codes, lambda own: F.zip_with(own, F.concat(F.array_repeat(none, w), own), lambda new, old: F.struct(new.alias("new"), old.alias("old"))))
    steps = F.slice(steps, F.lit(1), F.length(string))
    zero = F.struct(F.array_repeat(F.lit(0), len(cls.alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(1e9).alias("least"))

    def step(acc, x):
        gone = F.coalesce(F.get(acc["counts"], x["old"]), F.lit(0))
        come = F.get(acc["counts"], x["new"]) - F.when(x["new"] == x["old"], 1).otherwise(0)
        total = acc["sum"] + F.when(x["old"].isNotNull(), _weight(gone - 1) - _weight(gone)).otherwise(F.lit(0.0)) + _weight(come + 1) - _weight(come)
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == x["new"], 1).otherwise(0) - F.when(j == x["old"], 1).otherwise(0))
        least = F.when((acc["n"] >= w - 1) & (total < acc["least"]), total).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), (acc["n"] + 1).alias("n"), least.alias("least"))

    return F.lit(math.log2(w)) - F.aggregate(steps, zero, step)["least"] / F.lit(float(w))


def _secret(m: Column) -> Column:
    of_class = F.lit(False)
    for cls in reversed(CLASSES):
        of_class = F.when(m.rlike(cls.whole), window_entropy(m, cls) >= cls.bits).otherwise(of_class)
    allowed = reduce(lambda a, b: a | b, (m.rlike(p) for p in ALLOW))
    return F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~allowed, of_class).otherwise(F.lit(False))


def secret_spans(text: Column) -> Column:
    """All spans of a text as array of (s, k, e, kind, m), by start, then kind."""
    own = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _spans(own, ASSIGN, "assign", lambda m, g: F.length(g) >= 6),
            _spans(own, ACCESS, "access"),
            _spans(own, HEX, "hex"),
            F.filter(_spans(own, CANDIDATE, "entropy", lambda m, g: m.rlike("[0-9]")), lambda x: _secret(x["m"])),
        )
    )


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans hold code point positions and the matched text."""
    return df.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found, spans = secret_scan(read(spark, sf_dir, "documents")), F.col("spans")
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(_joined(F.filter(spans, lambda x: x["kind"] != "entropy")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined(spans).alias("spans"))


def oracle() -> str:
    def spans(pattern: str, kind: str, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        m = f"regexp_extract_all(t, '{p}')"
        g = f"regexp_extract_all(t, '{p}', {group})"
        return f"""
    SELECT doc, {KINDS.index(kind)} AS k, '{kind}' AS kind, m[i] AS m, g[i] AS g,
        coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc, {m} AS m, {g} AS g, string_split_regex(t, '{p}') AS gaps FROM docs))"""

    quote = lambda p: "'" + p.replace("'", "''") + "'"
    allow = " OR ".join(f"regexp_matches(m, {quote(p)})" for p in ALLOW)
    cases = " ".join(f"WHEN regexp_matches(m, {quote(c.whole)}) THEN list_max(list_transform(range(1, length(m) - {c.window - 2}), lambda i: list_entropy(string_split(substr(m, i, {c.window}), '')))) >= {c.bits}" for c in CLASSES)
    listed = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT, ',' ORDER BY s, k){0}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({spans(ASSIGN, "assign", 1)}
    UNION ALL {spans(ACCESS, "access")}
    UNION ALL {spans(HEX, "hex")}
    UNION ALL {spans(CANDIDATE, "entropy")}),
kept AS (
    SELECT doc, k, kind, m, s FROM spans
    WHERE (kind = 'assign' AND length(g) >= 6) OR kind IN ('access', 'hex')
        OR (kind = 'entropy' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({allow}) AND CASE {cases} END)),
grouped AS (
    SELECT doc, {counts}, {listed.format(" FILTER (kind <> 'entropy')")} AS base, {listed.format("")} AS spans
    FROM kept GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN grouped USING (doc)
"""
