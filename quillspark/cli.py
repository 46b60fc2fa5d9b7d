"""Commands: convert a document's pages, review what was found, sum up decisions. Exit codes: 0 clean, 1 something failed, 2 usage."""

from __future__ import annotations

import argparse
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import corrections, manifest
from quillspark.plans import convert as plan
from quillspark.sources import records

PROMPTS = {"transcribe": "Transcribe this page to LaTeX. Mark drawings as [[DIAGRAM: ...]]; invent nothing.", "inventory": 'List every drawing on this page as JSON: {"marks": [{"description", "context", "inline_or_block", "count"}]}.'}


def page_range(spec: str | None) -> tuple[int, int | None]:
    if not spec:
        return 1, None
    low, dash, high = spec.partition("-")
    return int(low), int(high) if dash else int(low)


def recorded(spark: SparkSession, read: Callable[[SparkSession, str], DataFrame], path: str) -> DataFrame | None:
    """A log that may not be there yet."""
    try:
        return read(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def convert(spark: SparkSession, pages: DataFrame, out: str, model: Callable[[bytes, str], str], *, standalone: bool = False, resume: bool = False, source: str = "", say=print) -> int:
    """pages (page, image) to page files, manifest and the assembled document in out."""
    path = f"{out}/{records.MANIFEST_NAME}"
    before = recorded(spark, records.read_manifest, path)
    todo = manifest.pending(pages, before) if resume and before is not None else pages
    done = plan.outcomes(plan.emit(records.recognise(todo, model, PROMPTS), standalone), source=source)
    batch = f"{out}/outcomes/batch={uuid.uuid4().hex}"
    done.withColumn("at", F.unix_micros(F.current_timestamp())).write.parquet(batch)  # the model is asked once; all that follows reads this
    rows = spark.read.parquet(batch)
    records.write_manifest(rows.drop("text", "at"), path)
    records.write_pages(rows.where("error is null"), f"{out}/pages")
    for r in rows.select("page", scalars.outcome_line(F.col("page"), F.col("verdict"), F.col("gates"), F.col("error")).alias("line")).orderBy("page").toLocalIterator():
        say(r.line)
    every = spark.read.parquet(f"{out}/outcomes")
    latest = every.groupBy("page").agg(F.max_by(F.struct("output", "verdict", "gates", "text"), F.struct(F.col("error").isNull(), "at")).alias("o")).select(F.lit(1).alias("run"), "page", "o.*")
    manifest.assemble(latest).select("document").coalesce(1).write.mode("overwrite").text(f"{out}/{manifest.MASTER}")
    c = manifest.counters(rows).first()
    say("Gates show that these documents build, not that they say what the pages say.")
    if c.unverified:
        say(f"{c.unverified} page(s) unverified: a gate could not run, which is neither a pass nor a failure.")
    if c.failed or c.errored:
        say(f"{c.failed} page(s) failed a gate, {c.errored} could not be recognised; failing pages are quarantined.")
    return c.exit_code


def summary(spark: SparkSession, out: str, say=print) -> int:
    log = recorded(spark, records.read_corrections, f"{out}/{records.LOG_NAME}")
    if log is None:
        say("no decisions")
        return 0
    s = corrections.summary(log).first()
    say(f"{s.rows} decision(s) covering {s.findings_covered} finding(s) across {s.pages_touched} page(s), {s.total_seconds}s")
    for r in corrections.by_verdict(log).orderBy("verdict").toLocalIterator():
        say(f"  {r.verdict:<16} {r.n}")
    say(f"{s.gold_pairs} row(s) carry evidence about correctness; {s.unexamined} record only that somebody passed through.")
    pages = 0
    for r in corrections.exit_report(log).orderBy(F.col("page").asc_nulls_last()).toLocalIterator():
        pages += r.page is not None
        say(f"  {'total' if r.page is None else f'page {r.page}':>10}   correcting {r.correcting:>7.1f}s   transcribing {r.transcribing:>7.1f}s   {r.winner or ''}")
    say(f"  mode: {s.modes[0]}" if len(s.modes) == 1 else f"  modes are mixed: {', '.join(s.modes)}" if s.modes else "  mode: not recorded")
    return 0


def review(spark: SparkSession, out: str, answers: DataFrame, *, page: int | None = None, say=print) -> int:
    """Answers (page, group_no, key, seconds, reason, after, crop_ok) to findings not decided yet, appended to the log."""
    outcomes = recorded(spark, records.read_manifest, f"{out}/{records.MANIFEST_NAME}")
    if outcomes is None:
        say("no manifest")
        return 2
    found = manifest.needs_review(outcomes, page).select("page", F.posexplode("findings").alias("ordinal", "f")).select("page", "ordinal", "f.*")
    log = recorded(spark, records.read_corrections, f"{out}/{records.LOG_NAME}")
    left = found if log is None else corrections.open_findings(found, log)
    if hidden := found.count() - left.count():
        say(f"{hidden} finding(s) already decided are hidden")
    groups = corrections.finding_groups(left).join(left.groupBy("page", "gate", "detail", F.coalesce("line", F.lit(-1)).alias("at")).agg(F.first("excerpt").alias("excerpt")).withColumnRenamed("page", "p").withColumnRenamed("gate", "g").withColumnRenamed("detail", "d"), F.expr("page = p and gate = g and detail = d and coalesce(line, -1) = at"))
    own = groups.select(F.lit(0).alias("session"), "page", "group_no", "gate", "detail", "line", "excerpt", "instances", F.lit(None).cast("string").alias("source_image"))
    rows = corrections.replay(own, answers.withColumn("session", F.lit(0))).drop("session").withColumns({"mode": F.lit(""), "at": F.unix_timestamp().cast("double")})
    records.append_corrections(rows, f"{out}/{records.LOG_NAME}")
    return summary(spark, out, say)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("pdf")
    c.add_argument("--out", required=True)
    c.add_argument("--pages")
    c.add_argument("--standalone", action="store_true")
    c.add_argument("--resume", action="store_true")
    c.add_argument("--dpi", type=int, default=150)
    c.add_argument("--endpoint", default="http://localhost:11434/api/chat")
    c.add_argument("--model", required=True)
    r = commands.add_parser("review")
    r.add_argument("out")
    r.add_argument("--summary", action="store_true")
    r.add_argument("--page", type=int)
    r.add_argument("--answers", help="JSON lines of page, group_no, key, seconds, reason, after, crop_ok")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if args.command == "convert":
        if missing := records.missing_tools("pdfinfo", "pdftoppm", "pdftocairo"):
            print(f"not installed: {', '.join(missing)}", file=sys.stderr)
            return 2
        spark.dataSource.register(records.DocumentPages)
        first, last = page_range(args.pages)
        reader = spark.read.format("document_pages").options(path=args.pdf, first=first, dpi=args.dpi)
        pages = (reader if last is None else reader.option("last", last)).load()
        return convert(spark, pages, args.out, records.http_model(args.endpoint, args.model), standalone=args.standalone, resume=args.resume, source=args.pdf)
    if args.summary or not args.answers:
        return summary(spark, args.out)
    answers = spark.read.schema("page int, group_no int, key string, seconds double, reason string, after string, crop_ok boolean").json(args.answers)
    return review(spark, args.out, answers, page=args.page)


if __name__ == "__main__":
    raise SystemExit(main())
