"""Analytics over the log of human decisions: counts, costs of two ways of working, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import filled, half_even, lines, strip

# Decisions that judge the output, the control arm, and decisions that verify nothing.
GOLD = ["edited", "cropped", "keep-reviewed"]
BASELINE = ["transcribed"]
UNEXAMINED = ["keep-unreviewed", "skipped"]
# What rows of the two timed arms say they are about.
FROM_BLANK = "exit criterion: transcription from blank"
CORRECTED = "exit criterion: correction of emitted output"
SELF_REPORTED = "exit criterion: correction of emitted output (self-reported time)"
ANNOTATED = "exit criterion: correction by annotating the typeset output"
# End of fixed values.


def is_gold(verdict: Column) -> Column:
    return verdict.isin(GOLD)


def summary(log: DataFrame) -> DataFrame:
    """One row: rows, findings covered, gold pairs, unexamined, seconds to a tenth, pages touched, sorted modes. Seconds are summed as decimals, so their order doesn't matter."""
    v = F.col("verdict")
    return log.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("instances"), F.lit(0)).alias("findings_covered"),
        F.count_if(is_gold(v)).alias("gold_pairs"),
        F.count_if(v.isin(UNEXAMINED)).alias("unexamined"),
        half_even(F.coalesce(F.sum(F.col("seconds").cast("decimal(18,6)")), F.lit(0)), 1).cast("double").alias("total_seconds"),
        F.count_distinct("page").alias("pages_touched"),
        F.array_sort(F.collect_set(F.when(F.col("mode") != "", F.col("mode")))).alias("modes"),
    )


def by_verdict(log: DataFrame) -> DataFrame:
    return log.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def exit_criterion(log: DataFrame) -> DataFrame:
    """(page, correcting, transcribing) of pages that have both: seconds spent on corrections, and on typing from blank where a text came of it. One grouping; each arm is a conditional sum."""
    base = F.col("verdict").isin(BASELINE)
    counts = base & (strip(F.coalesce("after", F.lit(""))) != "")
    s = F.col("seconds").cast("decimal(18,6)")
    arms = log.groupBy("page").agg(F.sum(F.when(~base, s)).alias("c"), F.sum(F.when(counts, s)).alias("t"))
    return arms.where("c is not null and t is not null").select("page", half_even(F.col("c"), 1).cast("double").alias("correcting"), half_even(F.col("t"), 1).cast("double").alias("transcribing"))


def exit_report(log: DataFrame) -> DataFrame:
    """exit_criterion with the winner of each page and, over more than one page, a total row (page null), by rollup."""
    d = lambda c: F.sum(F.col(c).cast("decimal(18,1)"))
    rolled = exit_criterion(log).rollup("page").agg(d("correcting").alias("c"), d("transcribing").alias("t"), F.count(F.lit(1)).alias("n"), F.grouping("page").alias("total"))
    winner = F.when(F.col("total") == 0, F.when(F.col("c") < F.col("t"), "correcting wins").otherwise("TRANSCRIBING WINS"))
    return rolled.where("total = 0 or n > 1").select("page", F.col("c").cast("double").alias("correcting"), F.col("t").cast("double").alias("transcribing"), winner.alias("winner"))


def mode_costs(log: DataFrame) -> DataFrame:
    """An extension: mean seconds a row of each arm and mode, unpaired, since the arms are seldom run on one page. The mean is not rounded here: who shows it rounds once."""
    mean = F.try_divide(F.sum(F.col("seconds").cast("decimal(18,6)")).cast("double"), F.count("seconds"))
    return log.groupBy("mode", F.when(F.col("verdict").isin(BASELINE), "transcribing").otherwise("correcting").alias("arm")).agg(F.count(F.lit(1)).alias("rows"), mean.alias("mean_seconds"))


def finding_text(gate: Column, detail: Column) -> Column:
    return F.concat(gate, F.lit(": "), detail)


def open_findings(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings (page, gate, detail, line) without a decision: anti-join on page, text and line, where two unknown lines are equal. Skipped means deferred, and decides nothing."""
    decided = log.where("verdict <> 'skipped'").select(F.col("page").alias("p"), F.col("finding").alias("f"), F.col("line").alias("l")).distinct()
    same = (F.col("page") == F.col("p")) & (finding_text(F.col("gate"), F.col("detail")) == F.col("f")) & F.col("line").eqNullSafe(F.col("l"))
    return findings.join(decided, same, "left_anti")


def hidden_count(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Findings in all, open and hidden, by page."""
    kept = open_findings(findings, log).groupBy("page").agg(F.count(F.lit(1)).alias("open"))
    return findings.groupBy("page").agg(F.count(F.lit(1)).alias("findings")).join(kept, "page", "left").select("page", "findings", F.coalesce("open", F.lit(0)).alias("open"), (F.col("findings") - F.coalesce("open", F.lit(0))).alias("hidden"))


def finding_groups(findings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Findings equal in page, gate, detail and line, once, with how often, numbered by first appearance on the page."""
    grouped = findings.groupBy("page", "gate", "detail", "line").agg(F.count(F.lit(1)).alias("instances"), F.min(ordinal).alias("first"))
    return grouped.withColumn("group_no", F.row_number().over(Window.partitionBy("page").orderBy("first")).cast("int"))


def untouched_pages(outcomes: DataFrame, log: DataFrame) -> DataFrame:
    return outcomes.select("page").distinct().join(log.select("page").distinct(), "page", "left_anti")


def first_untouched(outcomes: DataFrame, log: DataFrame, n: int = 8) -> DataFrame:
    """The first pages without a decision: a top-n for a message."""
    return untouched_pages(outcomes, log).orderBy("page").limit(n)


def refusals(log: DataFrame) -> DataFrame:
    """(page, no_transcribe, no_fix): a page with decisions on its text can't be the control arm any more, nor one transcribed be fixed."""
    base = F.col("verdict").isin(BASELINE)
    return log.groupBy("page").agg(F.bool_or(~base).alias("no_transcribe"), F.bool_or(base).alias("no_fix"))


def finding_context(findings: DataFrame, texts: DataFrame, radius: int = 2, width: int = 90) -> DataFrame:
    """Findings with the lines around them: numbered, cut to width, the line itself marked. texts: (page, text); findings without a line have an empty context."""
    near = F.filter(F.transform(lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda r: F.abs(r["n"] - F.col("line")) <= radius)
    shown = F.transform(near, lambda r: F.concat(F.when(r["n"] == F.col("line"), "  >> ").otherwise("     "), filled(r["n"].cast("string"), 4, " "), F.lit(" | "), F.substring(r["x"], 1, width)))
    joined = findings.join(texts, "page", "left")
    return joined.withColumn("context", F.when(F.col("line") > 0, F.coalesce(F.array_join(shown, "\n"), F.lit(""))).otherwise("")).drop("text")


def replay(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """Keystrokes on finding groups as log rows.

    groups: (page, group_no, gate, detail, line, excerpt, instances, source_image); answers: (page, group_no, key,
    seconds, reason, after, crop_ok). k keeps, e edits, c crops if a crop came of it, f flags; a blank or any other key skips;
    from q on nothing is written. Groups are numbered over all pages in their order.
    """
    order = Window.partitionBy("session").orderBy("page", "group_no").rowsBetween(Window.unboundedPreceding, 0)
    key = F.lower(F.substring(strip(F.coalesce("key", F.lit(""))), 1, 1))
    joined = groups.join(answers, ["session", "page", "group_no"], "left").withColumn("k", key)
    going = joined.withColumn("quit", F.max((F.col("k") == "q").cast("int")).over(order)).where("quit = 0")
    verdict = F.when(F.col("k") == "k", "keep-reviewed").when(F.col("k") == "e", "edited").when((F.col("k") == "c") & F.coalesce("crop_ok", F.lit(False)), "cropped").when(F.col("k") == "f", "flagged").otherwise("skipped")
    rows = going.withColumn("verdict", verdict)
    return rows.select(
        "session", "page", "verdict", F.coalesce("source_image", F.lit("")).alias("source_image"), F.when(F.coalesce("excerpt", F.lit("")) != "", F.col("excerpt")).otherwise(F.col("detail")).alias("before"),
        F.when(F.col("verdict").isin("edited", "cropped"), F.coalesce("after", F.lit(""))).otherwise("").alias("after"), F.when(F.col("verdict") == "flagged", strip(F.coalesce("reason", F.lit("")))).otherwise("").alias("reason"),
        half_even(F.coalesce("seconds", F.lit(0.0)), 2).alias("seconds"), finding_text(F.col("gate"), F.col("detail")).alias("finding"), "instances", "line",
    )


def timed_arms(attempts: DataFrame, log: DataFrame, emitted: DataFrame) -> DataFrame:
    """Attempts at typing a page from blank or at correcting it: (page, arm, exit_code, row); row is null where nothing is to be logged.

    attempts: (page, arm, text, seconds, reported, correct, typeset, mode, source_image): arm is transcribe or fix; reported says
    that the seconds are the author's own; correct that an unchanged text was right; typeset is the annotated file of a mode that begins with pdf.
    emitted: (page, text), what the tool wrote. Exit codes: 0 logged; 1 nothing was typed, or an unchanged text nobody vouches for; 2 refused:
    the page was seen in the other arm, or there is nothing to correct.
    """
    fix = F.col("arm") == "fix"
    known = attempts.join(refusals(log), "page", "left").join(emitted.select("page", F.col("text").alias("was")), "page", "left")
    pdf = F.startswith(F.coalesce("mode", F.lit("")), F.lit("pdf"))
    reported, after = F.coalesce("reported", F.lit(False)), F.coalesce("text", F.lit(""))
    refused = F.when(fix, F.coalesce("no_fix", F.lit(False)) | F.col("was").isNull() | (pdf & ~reported & F.col("typeset").isNull())).otherwise(F.coalesce("no_transcribe", F.lit(False)))
    same = fix & ~reported & ~pdf & (after == F.col("was"))
    empty = ~fix & (strip(after) == "")
    code = F.when(refused, 2).when(empty | (same & ~F.coalesce("correct", F.lit(False))), 1).otherwise(0)
    row = F.struct(
        F.when(~fix, "transcribed").when(same, "keep-reviewed").otherwise("edited").alias("verdict"),
        F.coalesce("source_image", F.lit("")).alias("source_image"),
        F.when(fix, F.col("was")).otherwise("").alias("before"),
        F.when(fix & reported, "").when(fix & pdf, F.col("typeset")).otherwise(after).alias("after"),
        F.when(fix & reported, F.col("seconds")).otherwise(half_even(F.coalesce("seconds", F.lit(0.0)), 2)).alias("seconds"),
        F.when(~fix, FROM_BLANK).when(reported, SELF_REPORTED).when(pdf, ANNOTATED).otherwise(CORRECTED).alias("finding"),
        F.coalesce("mode", F.lit("")).alias("mode"),
    )
    return known.select("page", "arm", code.alias("exit_code"), F.when(code == 0, row).alias("row"))


def arm_rows(judged: DataFrame) -> DataFrame:
    """The log rows of timed_arms."""
    return judged.where("row is not null").select("page", "row.*", F.lit(1).alias("instances"), F.lit(None).cast("int").alias("line"), F.lit("").alias("reason"))
