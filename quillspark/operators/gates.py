"""Quality gates as column functions: text and evidence in, one gate result out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import LINE_END, code_name, excerpt, first_line_with, half_even, in_blocks, let, lines, located, longest_word, running_sums, strip
from quillspark.functions.verdicts import FAILURE, failure, gate, no_failures, skipped

# What a preamble says to allow Unicode; colour commands; markers; delimiter tokens; limits.
UNICODE_PREAMBLE = r"\\usepackage\{(?:fontspec|unicode-math)\}|\\DeclareUnicodeCharacter|\\usepackage\[utf8\]\{inputenc\}"
COLOUR_COMMAND = r"\\(?:textcolor|color|colorbox|fcolorbox|pagecolor|definecolor)\b|\\usepackage(?:\[[^\]]*\])?\{[^}]*\bxcolor\b"
MARKER = r"(?s)\[\[DIAGRAM:.*?\]\]|\[TODO diagram:.*?\]"
FABRICATED = r"(?s)\[TODO fabricated:\s*(.*?)\]"
DELIMITER = r"(?md)(?<!\\)%.*?$|\\[\\$%&#_{}]|\\begin\{[^}]*\}|\\end\{[^}]*\}|\\\(|\\\)|\\\[|\\\]|(?<!\\)\$\$|(?<!\\)\$"
MAX_LOCATED = 10
NEEDLE = 30
SWATCHES = 6
LEAST_COLOURS = 2
BEYOND = r"[^\x00-\x7f]"
# End of fixed values.


def ascii_findings(text: Column) -> Column:
    """Every character beyond ASCII as a failure with line, column and the line's excerpt. Unicode names are a dimension to join: see unicode_names."""

    def of_line(line):
        def found(own):  # a line's characters beyond ASCII; each is one long, so its column follows from the gaps before
            gaps = F.transform(F.slice(F.split(line["own"], BEYOND, -1), F.lit(1), F.size(own)), lambda g: F.length(g))
            columns = let(gaps, lambda g: F.zip_with(running_sums(F.transform(g, lambda n: n + 1)), g, lambda n, x: n + x + 1))
            one = lambda c, j, shown: failure(F.concat(F.lit("non-ASCII '"), c, F.lit("' ("), code_name(c), F.lit(")")), line["i"], j, shown)
            return let(excerpt(line["own"]), lambda shown: F.zip_with(own, columns, lambda c, j: one(c, j, shown)))

        return let(F.regexp_extract_all(line["own"], F.lit(BEYOND), F.lit(0)), found)

    marked = F.filter(F.transform(lines(text), lambda line, i: F.struct(line.alias("own"), (i + 1).alias("i"))), lambda x: x["own"].rlike(BEYOND))
    return F.when(text.rlike(BEYOND), F.flatten(F.transform(marked, of_line))).otherwise(no_failures())


def ascii_gate(text: Column, allow_declared: bool = True) -> Column:
    """Fails on characters beyond ASCII, unless the document declares that it can have them."""
    plain = ~text.rlike(BEYOND)
    if allow_declared:
        plain = plain | text.rlike(UNICODE_PREAMBLE)
    return gate("ascii", F.when(plain, no_failures()).otherwise(ascii_findings(text)))


_OPEN, _BAD = "array<struct<kind:string,line:int,shown:string>>", "array<struct<line:int,detail:string>>"


def _folded(tokens: Column, below: Column) -> Column:
    """(pops, open, bad) after some tokens, when the stack `below` stood before them: how many of its entries are closed, what is open on top, closers that fit nothing."""
    zero = F.struct(F.lit(0).alias("pops"), F.array().cast(_OPEN).alias("open"), F.array().cast(_BAD).alias("bad"))

    def step(acc, x):
        t, own = x["token"], F.size(acc["open"])
        top = F.when(own > 0, F.try_element_at(acc["open"], F.lit(-1))).otherwise(F.try_element_at(below, -1 - acc["pops"]))
        opens_env, closes_env = F.startswith(t, F.lit("\\begin{")), F.startswith(t, F.lit("\\end{"))
        env = F.when(opens_env, F.substring(t, 8, 1 << 30)).when(closes_env, F.substring(t, 6, 1 << 30))
        env = F.substring_index(env, "}", 1)
        kind = F.when(opens_env | closes_env, F.concat(F.lit("env:"), env)).when(t.isin("\\(", "\\)"), "inline").when(t.isin("\\[", "\\]"), "display").otherwise(t)
        fits = F.coalesce(top["kind"] == kind, F.lit(False))
        grows = opens_env | t.isin("\\(", "\\[") | (t.isin("$", "$$") & ~fits)
        opened = F.struct(kind.alias("kind"), x["line"].alias("line"), F.when(opens_env, env).otherwise(t).alias("shown"))
        says = F.when(closes_env, F.concat(F.lit("\\end{"), env, F.lit("} closes "), F.coalesce(top["shown"], F.lit("nothing")), F.lit(", which is not what is open"))).when(t == "\\)", F.lit("\\) with no matching \\(")).otherwise(F.lit("\\] with no matching \\["))
        refused = F.struct(x["line"].alias("line"), says.alias("detail"))
        return F.struct(
            F.when(~grows & fits & (own == 0), acc["pops"] + 1).otherwise(acc["pops"]).alias("pops"),
            F.when(grows, F.array_append(acc["open"], opened)).when(fits, F.slice(acc["open"], F.lit(1), F.greatest(own - 1, F.lit(0)))).otherwise(acc["open"]).alias("open"),
            F.when(grows | fits, acc["bad"]).otherwise(F.array_append(acc["bad"], refused)).alias("bad"),
        )

    return F.aggregate(tokens, zero, step)


def delimiter_findings(text: Column) -> Column:
    """Unbalanced delimiters by line and detail: a fold over tokens with a stack. A closer that fits nothing leaves the stack as it is.

    The tokens are folded in blocks of about the square root of their number: a step copies what its block has
    opened and refused, and only from block to block the whole.
    """
    zero = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(_BAD).alias("bad"))

    def join(acc, block):
        below = lambda pops: F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - pops)
        return let(_folded(block, acc["open"]), lambda x: F.struct(F.concat(below(x["pops"]), x["open"]).alias("open"), F.concat(acc["bad"], x["bad"]).alias("bad")))

    def left(acc):
        still = F.transform(
            acc["open"], lambda s: F.struct(s["line"].alias("line"), F.concat(F.when(F.startswith(s["kind"], F.lit("env:")), F.lit("environment")).otherwise(F.lit("math mode")), F.lit(" opened by '"), s["shown"], F.lit("' is never closed")).alias("detail"))
        )
        return F.array_sort(F.concat(acc["bad"], still))

    tokens = F.filter(located(text, DELIMITER), lambda x: ~(F.startswith(x["token"], F.lit("%")) | x["token"].rlike(r"^\\[\\$%&#_{}]$")))
    return let(tokens, lambda own: F.when(F.size(own) == 0, F.array().cast(_BAD)).otherwise(F.aggregate(in_blocks(own), zero, join, left)))


def delimiter_gate(text: Column) -> Column:
    return gate("delimiters", F.transform(delimiter_findings(text), lambda x: failure(x["detail"], x["line"])))


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MARKER))


def fabrications(text: Column) -> Column:
    """Descriptions of drawings that were invented and refused."""
    return F.transform(F.regexp_extract_all(text, F.lit(FABRICATED), F.lit(1)), strip)


def coverage_gate(text: Column, inventory: Column, inventory_failed: Column | None = None, require_block_marks: bool = False) -> Column:
    """Fails where an independent inventory has marks that the text doesn't account for.

    inventory: array of (kind, description, context, placement, cnt). Descriptions play no part in the
    decision. An empty inventory is a pass only if it was read.
    """
    unread = F.lit(False) if inventory_failed is None else inventory_failed
    expected = F.filter(inventory, lambda m: m["placement"].isin("inline", "block") if require_block_marks else m["placement"] == "inline")
    wanted = F.aggregate(expected, F.lit(0), lambda n, m: n + m["cnt"])
    found = marker_count(text)

    def made_up(invented):  # the lines are split only where a line is looked for, and once
        shown = let(lines(text), lambda own: F.transform(invented, lambda d: failure(F.concat(F.lit("a drawing was invented here; crop the region instead: "), d), first_line_with(own, F.substring(d, 1, NEEDLE)))))
        return F.when(F.size(invented) > 0, shown).otherwise(no_failures())

    def place(own, m):
        anchor = F.lower(longest_word(m["context"]))
        what = F.concat(m["placement"], F.lit(" mark x"), m["cnt"].cast("string"), F.lit(" unaccounted for (called '"), m["description"], F.lit("', which is not reliable)"))
        return let(anchor, lambda a: failure(what, first_line_with(own, a), None, F.substring(m["context"], 1, 80)))

    def dropped(marks):
        summary = F.array(failure(F.concat(wanted.cast("string"), F.lit(" mark(s) seen, "), found.cast("string"), F.lit(" accounted for, "), (wanted - found).cast("string"), F.lit(" dropped silently"))))
        shown = let(F.transform(lines(text), lambda x: F.lower(x)), lambda own: F.transform(F.slice(marks, 1, MAX_LOCATED), lambda m: place(own, m)))
        more = F.when(F.size(marks) > MAX_LOCATED, F.array(failure(F.concat(F.lit("... and "), (F.size(marks) - MAX_LOCATED).cast("string"), F.lit(" more not listed; so many marks are an upper bound"))))).otherwise(no_failures())
        return F.concat(summary, shown, more)

    def judged(invented):
        nothing = (F.size(inventory) == 0) & (F.size(invented) == 0)
        return F.when(nothing & unread, skipped("coverage")).otherwise(gate("coverage", F.when(wanted <= found, made_up(invented)).otherwise(F.concat(made_up(invented), let(expected, dropped)))))

    return let(fabrications(text), judged)


def colour_gate(text: Column, colours: Column) -> Column:
    """Fails where ink has colours that distinguish and the text has no colour command; unknown colours (null) are unchecked, never clean.

    colours: array of (r, g, b).
    """
    swatch = F.array_join(F.transform(F.slice(colours, 1, SWATCHES), lambda c: F.concat(F.lit("rgb("), c["r"].cast("string"), F.lit(", "), c["g"].cast("string"), F.lit(", "), c["b"].cast("string"), F.lit(")"))), ", ")
    more = F.when(F.size(colours) > SWATCHES, F.concat(F.lit(" and "), (F.size(colours) - SWATCHES).cast("string"), F.lit(" more"))).otherwise("")
    lost = F.array(failure(F.concat(F.size(colours).cast("string"), F.lit(" distinct ink colours ("), swatch, more, F.lit(") and the document carries none"))))
    clean = (F.size(colours) < LEAST_COLOURS) | text.rlike(COLOUR_COMMAND)
    return F.when(colours.isNull(), skipped("colour")).otherwise(gate("colour", F.when(clean, no_failures()).otherwise(lost)))


def compile_gate(log: Column, exit_code: Column) -> Column:
    """From a build's log: null exit code means that no engine ran (unchecked); 0 passes; else its errors, or one failure without a parsed error."""
    errors = tex_errors(log)
    parsed = F.transform(errors, lambda e: failure(e["detail"], e["line"], None, e["excerpt"]))
    none = F.array(failure(F.concat(F.lit("the engine exited "), exit_code.cast("string"), F.lit(" with no parsed error"))))
    return F.when(exit_code.isNull(), skipped("compile")).when(exit_code == 0, gate("compile")).otherwise(gate("compile", F.when(F.size(errors) > 0, parsed).otherwise(none)))


_ERROR, _PLACE = r"^! (.+)$", r"^l\.(\d+)(.*)$"


def tex_errors(log: Column) -> Column:
    """Errors of a log as (detail, line, excerpt): each with the first line mark before the next error, or null. One pass carries the open error."""
    kind = "array<struct<detail:string,line:int,excerpt:string>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<detail:string,line:int,excerpt:string>").alias("open"))
    shut = lambda acc: F.concat(acc["done"], F.when(acc["open"].isNotNull(), F.array(acc["open"])).otherwise(F.array().cast(kind)))

    def step(acc, line):
        error, place = line.rlike(_ERROR), line.rlike(_PLACE)
        opened = F.struct(strip(F.regexp_extract(line, _ERROR, 1)).alias("detail"), F.lit(None).cast("int").alias("line"), F.lit("").alias("excerpt"))
        put = F.struct(acc["open"]["detail"].alias("detail"), F.regexp_extract(line, _PLACE, 1).try_cast("int").alias("line"), F.substring(strip(F.regexp_extract(line, _PLACE, 2)), 1, 80).alias("excerpt"))
        waits = acc["open"].isNotNull() & acc["open"]["line"].isNull()
        return F.when(error, F.struct(shut(acc).alias("done"), opened.alias("open"))).when(place & waits, F.struct(acc["done"].alias("done"), put.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), acc["open"].alias("open")))

    return F.aggregate(F.split(log, "\n"), zero, step, shut)


def tex_error_rows(logs: DataFrame, key: str, line_no: str, text: str) -> DataFrame:
    """The same on logs that lie as one row a line: errors of (key) with the first mark up to the next error, as-of by windows."""
    w = Window.partitionBy(key).orderBy(line_no)
    error, place = F.col(text).rlike(_ERROR), F.col(text).rlike(_PLACE)
    kept = logs.where(error | place).withColumn("err", F.sum(error.cast("int")).over(w)).where("err > 0")
    first = F.min(F.when(place, F.struct(F.col(line_no), F.col(text))))
    grouped = kept.groupBy(key, "err").agg(F.min(F.when(error, F.struct(F.col(line_no), F.col(text)))).alias("e"), first.alias("m"))
    return grouped.select(key, F.col("err").cast("int").alias("error_no"), strip(F.regexp_extract(F.col("e")[text], _ERROR, 1)).alias("detail"), F.regexp_extract(F.col("m")[text], _PLACE, 1).try_cast("int").alias("line"))


def all_gates(text: Column, inventory: Column, inventory_failed: Column, colours: Column, log: Column | None = None, exit_code: Column | None = None) -> Column:
    """The five gates in their order; without a build's log the compile gate is unchecked."""
    build = skipped("compile") if log is None else compile_gate(log, exit_code)
    return F.array(ascii_gate(text), delimiter_gate(text), build, coverage_gate(text, inventory, inventory_failed), colour_gate(text, colours))


__all__ = ["FAILURE", "LINE_END", "all_gates", "ascii_findings", "ascii_gate", "colour_gate", "compile_gate", "coverage_gate", "delimiter_findings", "delimiter_gate", "fabrications", "half_even", "marker_count", "tex_error_rows", "tex_errors"]
