"""Ink, inventories, logs, outcomes, sources, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import corrections, ink, inventory, manifest
from quillspark.plans import convert
from quillspark.sources import records
from quillspark.streaming import convert as streaming

SVG = """<svg><path fill="none" stroke-width="2" stroke="rgb(50%, 0%, 100%)" transform="matrix(0.5 0 0 0.5 10 20)" d="M 0 0 L 20 40"/>
<path stroke-width="1" stroke="rgb(0%, 0%, 0%)" transform="matrix(1 0 0 1 0 0)" d="M 0 5 L 400 5"/>
<path stroke-width="1" stroke="rgb(0%, 0%, 0%)" transform="matrix(1 0 0 1 0 0)" d="M 0 100 L 30 120"/>
<path d="M 0 0"/></svg>"""


def test_strokes_to_blocks(spark):
    s = ink.strokes(spark.createDataFrame([(1, SVG), (2, "<svg/>")], "page int, svg string")).cache()
    rows = {r.ordinal: r for r in s.collect()}
    assert len(rows) == 3 and (rows[0].x0, rows[0].y0, rows[0].x1, rows[0].y1) == (10.0, 20.0, 20.0, 40.0) and tuple(rows[0].colour) == (128, 0, 255) and rows[0].stroke_w == 1.0
    blocks = sorted((b.block, b.y, b.height, b.paths) for b in ink.page_blocks(s).collect())
    assert blocks == [(0, 20.0, 20.0, 1), (1, 100.0, 20.0, 1)]
    (c,) = ink.ink_colours(s).collect()
    assert [tuple(x) for x in c.colours] == [(128, 0, 255), (0, 0, 0)]
    (p,) = ink.ink_profile(ink.ink_points(spark.createDataFrame([(1, SVG)], "page int, svg string"))).collect()
    assert p.points == 7 and abs(sum(p.bands) - 1) < 1e-9


def test_strokes_read_each_attribute_once(spark):
    """A filter below the numbers, and a colour looked at from many sides, read the source again and again."""
    svg = """<svg><path transform="matrix(1 0 0 1 0 0)" d="M 1 2 L 3 4 L 9"/><path stroke="rgb(1%, 2%)" stroke-width="." transform="matrix(1 0 0 1 0 0)" d="M 1 2 L 3 4"/>
<path stroke="rgb(0.98%,%50%,100)" stroke-width="2" transform="matrix(1 0 0 1 0)" d="M 1 2 L 3 4"/><path d="M 1 2 L 3 4"/><path stroke="rgb(0.98%,%50%,100)" stroke-width="2" transform="matrix(2 0 0 2 1 1 7)" d="M 1 2 L 3 4"/></svg>"""
    s = ink.strokes(spark.createDataFrame([(1, svg), (2, None)], "page int, svg string"))
    rows = [(r.ordinal, r.colour and tuple(r.colour), r.stroke_w, r.x0, r.y0, r.x1, r.y1, r.span_w, r.span_h) for r in s.orderBy("ordinal").collect()]
    assert rows == [(0, None, None, 1.0, 2.0, 3.0, 4.0, 2.0, 2.0), (1, None, None, 1.0, 2.0, 3.0, 4.0, 2.0, 2.0), (4, (2, 128, 255), 4.0, 3.0, 5.0, 7.0, 9.0, 4.0, 4.0)]
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(ink.SVG_NUMBER) == 2 and plan.count("split(") == 1


def test_blocks_are_dealt_by_the_size_of_the_input(spark, sf_dir, tmp_path, monkeypatch):
    """What a task sorts doesn't grow with the input; nothing is dealt where Spark doesn't know the size."""
    from quillspark.functions import workers
    from quillspark.plans import queries

    monkeypatch.setattr(ink, "BYTES_SORTED", 10_000, raising=False)
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    strokes = queries.strokes(spark, sf_dir)
    kept = strokes.where(~ink.is_rule(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).count()
    dealt = ink.page_blocks(strokes).select(F.spark_partition_id().alias("p"), "*").agg(F.count_distinct("p").alias("n"), F.sum("paths").alias("paths")).first()
    assert dealt.n > 8 and dealt.paths == kept
    wanted = workers.parts(table, 10_000)
    assert wanted > 8 and workers.parts(table.join(table, "l_orderkey"), 10_000) in (2 * wanted - 1, 2 * wanted)
    assert workers.parts(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "x int")) == 0


def test_rounding_to_even_colour(spark):
    got = spark.createDataFrame([("50%, 10%, 0.98%",), ("1,2",), ("a,b,c",)], "c string").select(ink.rgb(F.col("c")).alias("x")).collect()
    assert tuple(got[0].x) == (round(127.5), round(25.5), round(0.98 * 2.55)) and got[1].x is None and got[2].x is None


def test_inventories(spark):
    raws = ['{"marks":[{"inline_or_block":"inline","count":2.7},{"count":"x"}]}', 'so: {"marks": []} ok', "nothing", '{"marks":[{"inline_or_block":"block","count":0},{"de', '{"ma', None, '{"marks": null}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, r string").select("i", inventory.parse_inventory(F.col("r")).alias("x")).collect()
    got = {r.i: (r.x.failed, [(m.placement, m.cnt) for m in r.x.marks]) for r in rows}
    assert got == {0: (False, [("inline", 2), ("block", 1)]), 1: (False, []), 2: (True, []), 3: (False, [("block", 1)]), 4: (True, []), 5: (True, []), 6: (False, [])}
    loose = spark.createDataFrame([("nothing",)], "r string").select(inventory.parse_inventory(F.col("r"), strict=False)["failed"].alias("f")).first()
    assert loose.f is False


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [tuple(one(scalars.page_range(F.lit(s).cast("string")))) for s in (None, "4", "3-9")] == [(1, None), (4, 4), (3, 9)]
    assert [one(scalars.strip_fence(F.lit(s))) for s in ("```latex\nx\n```", "```tex x```", "```x", "x")] == ["x"] * 4
    assert one(scalars.swap_pressure(F.lit("vm.swapusage: total = 2048.00M  used = 1024.00M  free"))) == 0.5 and one(scalars.swap_pressure(F.lit("none"))) is None
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("x", "y", "width", "height"), strict=True)))
    assert one(scalars.iou(box(0, 0, 2, 2), box(1, 0, 2, 2))) == pytest.approx(1 / 3) and one(scalars.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(scalars.document_body(F.lit("a\\begin{document} b \\end{document} c"))) == "b"
    corners = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    masked = lambda b: one(scalars.masked_box(b, F.array(b), F.lit(200), F.lit(100)))
    assert tuple(masked(corners(10, 10, 50, 50))) == (17.0, 8.5, 103.0, 51.5) and tuple(masked(corners(100, 100, 500, 500))) == (17.0, 8.5, 103.0, 51.5)


def test_log_reads_strictly(spark, tmp_path):
    good = {"page": 1, "verdict": "edited", "source_image": "i", "before": "b", "at": 1.5}
    path = str(tmp_path / "log.jsonl")
    write = lambda *rows: (tmp_path / "log.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    write(good, "", {**good, "instances": 3, "line": 2})
    rows = records.read_corrections(spark, path).orderBy("instances").collect()
    assert [(r.instances, r.after, r.line) for r in rows] == [(1, "", None), (3, "", 2)]
    for bad in ("not json at all", {**good, "strange": 1}, {**good, "page": "one"}):
        write(good, "", bad)
        with pytest.raises(Exception, match=r"log\.jsonl:3: "):
            records.read_corrections(spark, path).collect()


LOG = "page int, verdict string, seconds double, instances int, mode string, after string, line int, finding string"


def test_exit_criterion_and_summary(spark):
    log = spark.createDataFrame([
        (1, "edited", 2.25, 2, "ink", "", 3, "ascii: d"), (1, "transcribed", 9.0, 1, "ink", "text", None, ""), (1, "transcribed", 50.0, 1, "", "  ", None, ""), (2, "transcribed", 5.0, 1, "pdf", "x", None, ""),
        (3, "skipped", 1.0, 1, "", "", None, "ascii: e"), (3, "transcribed", 1.0, 1, "", "t", None, ""), (4, "keep-unreviewed", 1.0, 1, "", "", None, "ascii: f"),
    ], LOG)
    assert sorted(tuple(r) for r in corrections.exit_criterion(log).collect()) == [(1, 2.2, 9.0), (3, 1.0, 1.0)]
    report = {r.page: (r.correcting, r.winner) for r in corrections.exit_report(log).collect()}
    assert report == {1: (2.2, "correcting wins"), 3: (1.0, "TRANSCRIBING WINS"), None: (3.2, None)}
    s = corrections.summary(log).first()
    assert (s.rows, s.findings_covered, s.gold_pairs, s.unexamined, s.total_seconds, s.pages_touched, s.modes) == (7, 8, 1, 2, 69.2, 4, ["ink", "pdf"])
    findings = spark.createDataFrame([(1, "ascii", "d", 3, 0), (1, "ascii", "d", 4, 1), (3, "ascii", "e", None, 2), (4, "ascii", "f", None, 3), (1, "ascii", "d", 4, 4)], "page int, gate string, detail string, line int, ordinal int")
    assert sorted(r.ordinal for r in corrections.open_findings(findings, log).collect()) == [1, 2, 4]
    assert sorted((r.page, r.group_no, r.instances) for r in corrections.finding_groups(findings).collect()) == [(1, 1, 1), (1, 2, 2), (3, 1, 1), (4, 1, 1)]
    assert {r.page: (r.no_transcribe, r.no_fix) for r in corrections.refusals(log).collect()} == {1: (True, True), 2: (False, True), 3: (True, True), 4: (True, False)}


def test_mean_seconds_are_rounded_once(spark, tmp_path):
    """50.347 is 50.3, not 50.4 by way of 50.35; a mode without seconds has no mean."""
    import duckdb

    from quillspark.plans.queries import ORACLES, QUERIES

    rows = [(1, 7, 50.347), (2, 7, 49.349), (3, 8, 0.5), (4, 8, None), (9, 8, 50.347)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["mode_costs"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["mode_costs"]).fetchall()) and ("ink", "correcting", 2, 50.3) in got


def test_replay(spark):
    groups = spark.createDataFrame([(1, p, g, "ascii", "d", 1, x, 2, None) for p, g, x in ((1, 1, "ex"), (1, 2, ""), (1, 3, ""), (2, 1, ""), (2, 2, ""), (2, 3, ""))], "session int, page int, group_no int, gate string, detail string, line int, excerpt string, instances int, source_image string")
    keys = [(1, 1, "k"), (1, 2, " F why"), (1, 3, ""), (2, 1, "c"), (2, 2, "q"), (2, 3, "e")]
    answers = spark.createDataFrame([(1, p, g, k, 1.005, " why ", "fig", True) for p, g, k in keys], "session int, page int, group_no int, key string, seconds double, reason string, after string, crop_ok boolean")
    rows = corrections.replay(groups, answers).collect()
    assert sorted((r.page, r.verdict, r.before, r.after, r.reason) for r in rows) == [(1, "flagged", "d", "", "why"), (1, "keep-reviewed", "ex", "", ""), (1, "skipped", "d", "", ""), (2, "cropped", "d", "fig", "")]


def test_context(spark):
    texts = spark.createDataFrame([(1, "a\nb\nc\nd\ne")], "page int, text string")
    out = {r.line: r.context for r in corrections.finding_context(spark.createDataFrame([(1, 1), (1, 4), (1, None)], "page int, line int"), texts).collect()}
    assert out[1] == "  >>    1 | a\n        2 | b\n        3 | c" and out[4].count("\n") == 3 and out[None] == ""


def test_convert_and_stream(spark, tmp_path):
    pages = [(1, "fine", '{"marks": []}', None), (2, None, None, "no reply"), (3, "bad $x", '{"marks": []}', None), (4, "fine", "unreadable", None)]
    df = spark.createDataFrame(pages, streaming.INPUT)
    out = {r.page: r for r in convert.convert(df).collect()}
    assert [out[p].verdict for p in (1, 2, 3, 4)] == ["unverified", "fail", "fail", "unverified"]
    assert out[3].output == "page-0003.fail.tex" and out[2].output is None and out[1].gates["compile"] == "skipped" and out[4].gates["coverage"] == "skipped"
    again = convert.convert(df, done=spark.createDataFrame([(1, None), (2, "no reply")], "page int, error string"))
    assert sorted(r.page for r in again.collect()) == [2, 3, 4]
    at = str(tmp_path)
    for batch in ((1, 2), (1, 2, 3, 4)):
        df.where(F.col("page").isin(*batch)).coalesce(1).write.mode("append").parquet(f"{at}/in")
        streaming.run_stream(streaming.read_pages(spark, f"file://{at}/in"), convert.emit, f"file://{at}/manifest", f"file://{at}/checkpoint")
    rows = records.read_manifest(spark, f"file://{at}/manifest").collect()
    assert sorted(r.page for r in rows) == [1, 2, 2, 3, 4]  # the page without a reply was tried again
    texts = {r.page: r.text for r in streaming.stream_outcomes(spark, f"file://{at}/manifest").collect()}
    assert texts[1].endswith("fine") and texts[2] is None and len(texts) == 4
    latest = manifest.latest(spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 1, "c")], "page int, ordinal int, verdict string"))
    assert {r.page: r.verdict for r in latest.collect()} == {1: "b", 2: "c"}


def test_stream_files_grow_with_the_input(spark, sf_dir, monkeypatch):
    """A task reads its share of the pages, not half of them."""
    from pathlib import Path

    from quillspark.functions import workers
    from quillspark.plans.queries import QUERIES

    folder = Path(workers.shared_folder(spark).removeprefix("file://"), "quillspark")
    monkeypatch.setattr(workers, "BYTES_PER_PART", 20_000, raising=False)
    before = set(folder.glob("stream-*"))
    assert QUERIES["stream_convert"](spark, sf_dir).count() == 200
    (own,) = set(folder.glob("stream-*")) - before
    wanted = -(-Path(sf_dir, "documents.parquet").stat().st_size // 20_000)
    assert len(list((own / "in").glob("*.parquet"))) == wanted > 4 and len(list((own / "manifest").glob("batch=*"))) == 1


def test_assembly(spark):
    rows = [(1, 10, "o/page-10.tex", "pass", {}, "x"), (1, 2, "o/page-2.fail.tex", "fail", {"ascii": "fail", "d": "pass"}, "x"), (1, 3, "o/page-3.tex", "pass", {}, "\\documentclass"), (2, 1, None, "pass", {}, None)]
    out = {r.run: r for r in manifest.assemble(spark.createDataFrame(rows, "run int, page int, output string, verdict string, gates map<string,string>, text string")).collect()}
    d = out[1].document
    assert d.index("PAGE 2 MISSING: failed ascii") < d.index("PAGE 3: standalone") < d.index("\\input{page-10}") and out[1].usable == 1
    assert "failed a gate" in out[2].document and "nothing to assemble" in out[2].document


def test_routed_pages_and_csv(spark, tmp_path):
    at = f"file://{tmp_path}"
    records.write_pages(spark.createDataFrame([(1, "pass", "a"), (2, "fail", "b"), (3, "unverified", "c")], "page int, verdict string, text string"), f"{at}/pages")
    assert sorted(r["name"] for r in spark.read.parquet(f"{at}/pages").where("not quarantine").collect()) == ["page-0001.tex", "page-0003.tex"]
    records.write_csv(spark.createDataFrame([("d", 1, 2, 3, "PASS", "FAIL", "a b", None)], records.SWEEP), f"{at}/sweep")
    assert records.read_sweep(spark, f"{at}/sweep").first().undefined == "a b"


def test_tex_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "pass", "a é"), (2, "fail", "b"), (3, "unverified", "c"), (4, "fail", None)], "page int, verdict string, text string")
    assert records.write_tex(rows.repartition(2), f"file://{tmp_path}/out") == 3 == records.write_tex(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["page-0001.tex", "page-0002.fail.tex", "page-0003.tex"]
    assert (tmp_path / "out" / "page-0001.tex").read_text(encoding="utf-8") == "a é"


def test_engine(spark):
    import subprocess

    def run(command, **_):
        text = open(f"{_['cwd']}/page.tex").read()
        if text == "slow":
            raise subprocess.TimeoutExpired(command, 1)
        return subprocess.CompletedProcess(command, int(text == "bad"), b"! Oops\nl.3 here\n" if text == "bad" else b"fine")

    from quillspark.functions import verdicts
    from quillspark.operators import gates

    pages = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "slow")], "page int, text string")
    state = verdicts.state(gates.compile_gate(F.col("log"), F.col("exit_code")))
    got = {r.page: (r.state, r.exit_code) for r in records.run_engine(pages, run=run).select("page", "exit_code", state.alias("state")).collect()}
    assert got == {1: ("pass", 0), 2: ("fail", 1), 3: ("fail", 1)}
    none = records.run_engine(pages, engine="no-such-engine").select("exit_code", state.alias("state")).collect()
    assert all(r.exit_code is None and r.state == "skipped" for r in none)


def test_crops(spark, tmp_path):
    import subprocess

    def run(command, **_):
        open(f"{tmp_path}/said", "a").write(" ".join(map(str, command)) + "\n")
        return subprocess.CompletedProcess(command, int("bad.pdf" in command), b"", b"no such page")

    requests = spark.createDataFrame([(4, "d.pdf", 1.5, 2.0, 30.0, 40.0, "o.pdf"), (5, "bad.pdf", 0.0, 0.0, 1.0, 1.0, "p.pdf"), (6, "d.pdf", 0.0, 0.0, 0.0, 1.0, "q.pdf")], "page int, document string, x double, y double, width double, height double, path string")
    got = {r.page: (r.crop_ok, r.error) for r in records.crop_regions(requests.coalesce(1), run=run).collect()}
    assert got == {4: (True, None), 5: (False, "no such page"), 6: (False, "an empty region")}
    said = open(f"{tmp_path}/said").read().splitlines()
    assert said[0].startswith("pdftocairo -pdf -f 4 -l 4 -x 1 -y 2 -W 30 -H 40") and said[1] == "pdfcrop --margins 4 o.pdf o.pdf" and len(said) == 3


def test_timed_arms(spark):
    log = spark.createDataFrame([(1, "edited"), (2, "transcribed")], "page int, verdict string")
    emitted = spark.createDataFrame([(p, f"text {p}") for p in (1, 2, 3)], "page int, text string")
    rows = [(1, "transcribe", "typed", 3.0, None, None, None), (2, "fix", "new", 3.0, None, None, None), (3, "transcribe", " \n", 9.0, None, None, None), (3, "transcribe", "typed", 9.005, None, None, None), (3, "fix", "text 3", 2.0, None, None, None), (3, "fix", "text 3", 2.0, None, True, None), (4, "fix", "x", 1.0, None, None, None), (3, "fix", "", 480.0, True, None, None)]
    attempts = spark.createDataFrame(rows, "page int, arm string, text string, seconds double, reported boolean, correct boolean, typeset string").withColumns({"mode": F.lit("paper"), "source_image": F.lit(None).cast("string")})
    judged = corrections.timed_arms(attempts, log, emitted)
    got = [(r.page, r.arm, r.exit_code, r.row and r.row.verdict) for r in judged.collect()]
    want = [(1, "transcribe", 2, None, None), (2, "fix", 2, None, None), (3, "transcribe", 1, None, None), (3, "transcribe", 0, "transcribed", 9.0), (3, "fix", 1, None, None), (3, "fix", 0, "keep-reviewed", 2.0), (4, "fix", 2, None, None), (3, "fix", 0, "edited", 480.0)]
    assert sorted(map(repr, (x[:4] for x in got))) == sorted(map(repr, (x[:4] for x in want)))
    (r,) = corrections.arm_rows(judged).where("seconds = 480").collect()
    assert "self-reported" in r.finding and r.mode == "paper" and r.before == "text 3" and r.after == ""
    pdf = attempts.where("page = 3 and seconds = 480").withColumns({"mode": F.lit("pdf tablet"), "reported": F.lit(False)})
    assert [r.exit_code for r in corrections.timed_arms(pdf, log, emitted).collect()] == [2]
    (r,) = corrections.arm_rows(corrections.timed_arms(pdf.withColumn("typeset", F.lit("p.pdf")), log, emitted)).collect()
    assert r.after == "p.pdf" and "annotating" in r.finding


def test_recogniser_port(spark):
    def model(image, prompt):
        if image == b"dead":
            raise TimeoutError
        if image == b"garbled":
            json.loads("<html>")
        return "" if image == b"blank" else f"```latex\n{prompt} {image.decode()}\n```"

    pages = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"blank")), (3, bytearray(b"dead")), (4, bytearray(b"garbled"))], "page int, image binary")
    rows = {r.page: r for r in records.recognise(pages, model, {"transcribe": "T", "inventory": "I"}).collect()}
    assert (rows[1].markup, rows[1].inventory_raw, rows[1].error) == ("T ok", "I ok", None)
    assert "3 attempts" in rows[2].error and rows[2].inventory_raw is None and "TimeoutError" in rows[3].error and "JSONDecodeError" in rows[4].error
    with pytest.raises(ValueError):
        records.http_model("http://x", scalars.REFUSED_ALIASES[0])


def test_document_info(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(records.page_count(F.lit("Title: x\nPages:   12\n"))) == 12 and tuple(one(records.page_size(F.lit("Page size:      514 x 685.5 pts")))) == (514.0, 685.5)
    with pytest.raises(Exception):
        one(records.page_count(F.lit("none")))
    assert records.missing_tools("surely-no-such-tool") == ["surely-no-such-tool"]
