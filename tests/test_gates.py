"""Gates, verdicts and text functions, with expectations by hand and an independent fold."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text, verdicts
from quillspark.operators import gates

MARK = "array<struct<kind:string,description:string,context:string,placement:string,cnt:int,confidence:double>>"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first().x


def mark(placement="inline", count=1, context="", description="d"):
    return ("unknown", description, context, placement, count, None)


def test_lines_are_python_lines(spark):
    r = random.Random(0)
    samples = ["", "\n", "a", "a\n", "a\r\nb", "\r\r\n", *("".join(r.choice("ab\n\r\x0b\x0c\x1c\x1e\x85\u2028\u2029 é") for _ in range(r.randint(0, 12))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string").select("i", text.lines(F.col("t")).alias("x")).collect()
    assert {r_.i: r_.x for r_ in rows} == {i: s.splitlines() for i, s in enumerate(samples)}


def test_ascii_gate(spark):
    g = one(spark, gates.ascii_gate(F.col("t")), t=("string", "clean\nbad Σ here"))
    (f,) = g.failures
    assert (f.line, f.column, f.excerpt) == (2, 5, "bad Σ here") and "U+03A3" in f.detail
    for declared in ("\\usepackage{fontspec}", "\\usepackage[utf8]{inputenc}", "\\DeclareUnicodeCharacter{1}{x}"):
        assert one(spark, gates.ascii_gate(F.col("t")), t=("string", declared + " Σ")).failures == []
        assert len(one(spark, gates.ascii_gate(F.col("t"), allow_declared=False), t=("string", declared + " Σ")).failures) == 1
    assert one(spark, gates.ascii_gate(F.col("t")), t=("string", "")).failures == []


def fold(source):
    """The delimiter rules once more, as a plain loop."""
    pattern = re.compile(r"(?<!\\)%.*?$|\\[\\$%&#_{}]|\\begin\{[^}]*\}|\\end\{[^}]*\}|\\\(|\\\)|\\\[|\\\]|(?<!\\)\$\$|(?<!\\)\$", re.M)
    stack, bad = [], []
    for m in pattern.finditer(source):
        t, line = m[0], source.count("\n", 0, m.start()) + 1
        if t[0] == "%" or (len(t) == 2 and t[0] == "\\" and t[1] in "\\$%&#_{}"):
            continue
        if t in ("$", "$$"):
            if stack and stack[-1][0] == t:
                stack.pop()
            else:
                stack.append((t, line))
        elif t.startswith("\\begin") or t in ("\\(", "\\["):
            stack.append((t[7:-1] if t.startswith("\\begin") else t, line))
        else:
            want = t[5:-1] if t.startswith("\\end") else {"\\)": "\\(", "\\]": "\\["}[t]
            if stack and stack[-1][0] == want:
                stack.pop()
            else:
                bad.append(line)
    return sorted(bad + [line for _, line in stack])


def test_delimiters_against_a_plain_fold(spark):
    r = random.Random(1)
    parts = ["$", "$$", "\\", "\\\\", "%", "\n", "a", "\\(", "\\)", "\\[", "\\]", "\\begin{a}", "\\end{a}", "\\begin{b}", "\\end{b}", "\\$", "\\%", "{", " "]
    samples = ["".join(r.choice(parts) for _ in range(r.randint(0, 18))) for _ in range(1500)] + ["\\\\$x$", "a % $ b\n$", ""]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string").repartition(4).select("i", gates.delimiter_findings(F.col("t")).alias("x")).collect()
    for r_ in rows:
        assert [f.line for f in r_.x] == fold(samples[r_.i]), samples[r_.i]


def test_long_texts(spark):
    r = random.Random(2)
    parts = ["$", "$$", "\\(", "\\)", "\\begin{a}", "\\end{a}", "\\begin{b}", "\\end{b}", "\n", "é", "x"]
    samples = ["".join(r.choice(parts) for _ in range(30_000)), "\\begin{a}\n" * 20_000, "\\end{a}\n" * 20_000, "\\begin{a}" * 9_000 + "\\end{a}" * 9_500]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, t string").repartition(4).select("i", gates.delimiter_findings(F.col("t")).alias("x"), gates.ascii_findings(F.col("t")).alias("y")).collect()
    for r_ in rows:
        s = samples[r_.i]
        assert [f.line for f in r_.x] == fold(s)
        assert [(f.line, f.column) for f in r_.y] == [(i, j) for i, line in enumerate(s.splitlines(), 1) for j, c in enumerate(line, 1) if ord(c) > 127]


@pytest.mark.parametrize(("source", "n"), [("$a$", 0), ("\\begin{x}\\end{x}", 0), ("$a", 1), ("\\begin{x}", 1), ("\\end{x}", 1), ("\\)", 1), ("\\begin{a}\\begin{b}\\end{a}", 3), ("costs \\$5", 0), ("$$a$$", 0)])
def test_delimiter_gate(spark, source, n):
    assert len(one(spark, gates.delimiter_gate(F.col("t")), t=("string", source)).failures) == n


def coverage(spark, source, marks, failed=False, **options):
    return one(spark, gates.coverage_gate(F.col("t"), F.col("m"), F.col("f"), **options), t=("string", source), m=(MARK, marks), f=("boolean", failed))


def test_coverage(spark):
    assert coverage(spark, "x", []).checked and coverage(spark, "x", []).failures == []
    assert not coverage(spark, "x", [], failed=True).checked
    assert len(coverage(spark, "x", [mark()] * 4).failures) == 5
    assert len(coverage(spark, "[[DIAGRAM: a]]", [mark(count=3)]).failures) == 2
    assert coverage(spark, "[[DIAGRAM: a]] [TODO diagram: b]", [mark(), mark()]).failures == []
    assert coverage(spark, "x", [mark("block")]).failures == []
    assert len(coverage(spark, "x", [mark("block")], require_block_marks=True).failures) == 2
    many = coverage(spark, "x", [mark()] * 60).failures
    assert len(many) == 12 and "50 more" in many[-1].detail
    (_, f) = coverage(spark, "one\nthe HOUSE has\n", [mark(context="the house, more")]).failures
    assert f.line == 2 and f.excerpt == "the house, more"
    (f,) = coverage(spark, "a\n[TODO fabricated: a plot]", []).failures
    assert f.line == 2
    # what a mark is called never decides
    assert [len(coverage(spark, "x", [mark(description=d)]).failures) for d in ("dog", "", "[[DIAGRAM: x]]")] == [2, 2, 2]


COLOUR = "array<struct<r:int,g:int,b:int>>"


@pytest.mark.parametrize(("source", "colours", "state"), [("x", None, "skipped"), ("x", [], "pass"), ("x", [(0, 0, 0)], "pass"), ("x", [(0, 0, 0), (1, 1, 1)], "fail"), ("\\textcolor{red}{x}", [(0, 0, 0), (1, 1, 1)], "pass"), ("\\usepackage[a]{b,xcolor}", [(0, 0, 0), (1, 1, 1)], "pass"), ("the colour textcolor", [(0, 0, 0), (1, 1, 1)], "fail")])
def test_colour(spark, source, colours, state):
    assert one(spark, verdicts.state(gates.colour_gate(F.col("t"), F.col("c"))), t=("string", source), c=(COLOUR, colours)) == state


def test_colour_names_six(spark):
    g = one(spark, gates.colour_gate(F.col("t"), F.col("c")), t=("string", "x"), c=(COLOUR, [(i, 0, 0) for i in range(9)]))
    assert g.failures[0].detail.count("rgb(") == 6 and "and 3 more" in g.failures[0].detail


LOG = "noise\n! Missing $ inserted.\ntext\nl.12 a_b\nl.13 more\n! Second\n! Third \nl.9   rest of it\n"


def test_build_logs(spark):
    got = one(spark, gates.tex_errors(F.col("t")), t=("string", LOG))
    assert [(e.detail, e.line, e.excerpt) for e in got] == [("Missing $ inserted.", 12, "a_b"), ("Second", None, ""), ("Third", 9, "rest of it")]
    state = lambda log, code: one(spark, gates.compile_gate(F.col("t"), F.col("c")), t=("string", log), c=("int", code))
    assert not state(LOG, None).checked and state("x", 0).failures == [] and len(state("x", 1).failures) == 1 and len(state(LOG, 1).failures) == 3
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(LOG.split("\n"))], "run int, pos int, text string")
    assert sorted((r.error_no, r.detail, r.line) for r in gates.tex_error_rows(rows, "run", "pos", "text").collect()) == [(1, "Missing $ inserted.", 12), (2, "Second", None), (3, "Third", 9)]


def test_verdicts(spark):
    ok, bad, not_run = verdicts.gate("a"), verdicts.gate("b", F.array(verdicts.failure(F.lit("x"), F.lit(3)))), verdicts.skipped("c")
    case = lambda *g: spark.range(1).select(verdicts.verdict(F.array(*g)).alias("v"), verdicts.states(F.array(*g)).alias("s"), verdicts.report(F.array(*g)).alias("r")).first()
    assert [case(ok).v, case(ok, not_run).v, case(ok, not_run, bad).v] == ["pass", "unverified", "fail"]
    assert case(ok, bad, not_run).s == {"a": "pass", "b": "fail", "c": "skipped"}
    assert "unverified: c" in case(ok, not_run).r and "line 3: x" in case(bad).r and not case(ok).r.endswith("PASS")
    empty = F.array().cast(f"array<{verdicts.GATE}>")
    assert spark.range(1).select(verdicts.verdict(empty).alias("v")).first().v == "pass"


def test_numbers_wider_than_their_field(spark):
    """Five-digit pages and characters beyond the basic plane keep all their digits."""
    from quillspark.functions import scalars, text
    from quillspark.operators import manifest

    row = spark.createDataFrame([(7, "é"), (12345, "😀")], "page int, c string").select(
        manifest.output_name(F.col("page"), F.lit("fail")).alias("name"), text.code_name(F.col("c")).alias("code"),
        scalars.outcome_line(F.col("page"), F.lit("pass"), F.create_map(F.lit("ascii"), F.lit("pass")), F.lit(None)).alias("line"),
    )
    assert [tuple(r) for r in row.collect()] == [
        ("page-0007.fail.tex", "U+00E9", "page    7  ok    ascii=pass"),
        ("page-12345.fail.tex", "U+1F600", "page 12345  ok    ascii=pass"),
    ]
