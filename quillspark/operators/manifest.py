"""Page outcomes: the latest of each page, what is left to do, counters, and the assembled document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import filled
from quillspark.operators.normalize import PREAMBLE

OUTCOME = "page INT, output STRING, verdict STRING, gates MAP<STRING,STRING>, error STRING, rules INT, findings ARRAY<STRUCT<gate:STRING,detail:STRING,line:INT,excerpt:STRING>>, source STRING"
MASTER = "chapter.tex"


def done(error: Column) -> Column:
    return error.isNull()


def latest(outcomes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The last row of each page: a retried page has several. An aggregate, not a window: pages combine before the shuffle."""
    kept = [c for c in outcomes.columns if c != "page"]
    return outcomes.groupBy("page").agg(F.max_by(F.struct(*kept), F.col(ordinal)).alias("o")).select("page", "o.*")


def pending(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pages without a finished outcome; those with an error are to be tried again. Put this before the expensive stage."""
    return pages.join(outcomes.where(done(F.col("error"))).select("page").distinct(), "page", "left_anti")


def counters(outcomes: DataFrame) -> DataFrame:
    """(failed, unverified, errored, exit_code) of a run."""
    ok = done(F.col("error"))
    out = outcomes.agg(F.count_if(ok & (F.col("verdict") == "fail")).alias("failed"), F.count_if(ok & (F.col("verdict") == "unverified")).alias("unverified"), F.count_if(~ok).alias("errored"))
    return out.withColumn("exit_code", F.when(F.col("failed") + F.col("errored") > 0, 1).otherwise(0))


def needs_review(outcomes: DataFrame, page: int | None = None, everything: bool = False) -> DataFrame:
    kept = outcomes if page is None else outcomes.where(F.col("page") == page)
    return kept if everything else kept.where(F.size("findings") > 0)


def output_name(page: Column, verdict: Column) -> Column:
    """The page's file; failing pages get a name that a build doesn't take up."""
    return F.concat(F.lit("page-"), filled(page.cast("string"), 4, "0"), F.when(verdict == "fail", ".fail.tex").otherwise(".tex"))


def is_standalone(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("\\documentclass")), F.lit(False))


def page_entry(page: Column, output: Column, verdict: Column, gates: Column, text: Column) -> Column:
    """What the assembled document says of a page: its inclusion, or a placeholder where it failed or can't be included."""
    name = F.coalesce(F.substring_index(output, "/", -1), F.concat(F.lit("page-"), filled(page.cast("string"), 4, "0")))
    bad = F.array_join(F.transform(F.filter(F.map_entries(gates), lambda e: e["value"] == "fail"), lambda e: e["key"]), ", ")
    bad = F.coalesce(F.nullif(bad, F.lit("")), F.lit("a gate"))
    box = lambda *parts: F.concat(F.lit("\\begin{center}\\fbox{\\texttt{[PAGE "), page.cast("string"), *parts, F.lit("]}}\\end{center}\n"))
    missing = F.concat(F.lit("% "), name, F.lit(" failed: "), bad, F.lit("\n"), box(F.lit(" MISSING: failed "), bad, F.lit("; not included")))
    alone = F.concat(F.lit("% "), name, F.lit(" is a document of its own and cannot be included.\n"), box(F.lit(": standalone, not assemblable")))
    return F.when((verdict == "fail") | output.isNull(), missing).when(is_standalone(text), alone).otherwise(F.concat(F.lit("\\input{"), F.regexp_replace(name, r"\.tex$", ""), F.lit("}\n")))


def assemble(outcomes: DataFrame, run: str = "run") -> DataFrame:
    """(run, pages, usable, document): each run's pages by number, never a silent hole. outcomes: (run, page, output, verdict, gates, text)."""
    entry = page_entry(F.col("page"), F.col("output"), F.col("verdict"), F.col("gates"), F.col("text"))
    usable = (F.col("verdict") != "fail") & F.col("output").isNotNull() & ~is_standalone(F.col("text"))
    grouped = outcomes.select(run, "page", entry.alias("entry"), usable.alias("usable")).groupBy(run).agg(F.array_sort(F.collect_list(F.struct("page", "entry"))).alias("e"), F.count_if("usable").alias("usable"))
    none = F.when(F.col("usable") == 0, F.lit("\n% no page passed its gates\n\\begin{center}\\texttt{[no page passed: nothing to assemble]}\\end{center}\n")).otherwise("")
    body = F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), none)
    return grouped.select(run, F.size("e").alias("pages"), "usable", F.concat(F.lit(PREAMBLE + "% pages that failed a gate stand here as placeholders\n\\begin{document}\n"), body, F.lit("\\end{document}\n")).alias("document"))


def page_images(files: DataFrame) -> DataFrame:
    """The first image of each page by name. files: (page, path)."""
    return files.groupBy("page").agg(F.min("path").alias("image"))


def with_run_order(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("run").orderBy(*by)))
