"""Sources and sinks: JSON-lines logs, routed page files, result tables, and pages of documents by external tools."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions.workers import importable
from quillspark.operators.manifest import OUTCOME, output_name

CORRECTION = "page INT, verdict STRING, source_image STRING, before STRING, after STRING, reason STRING, seconds DOUBLE, finding STRING, instances INT, mode STRING, line INT, at DOUBLE"
MANIFEST_NAME, LOG_NAME = "manifest.jsonl", "corrections.jsonl"
SWEEP = "doc STRING, page INT, seconds INT, chars INT, ascii STRING, compile STRING, undefined STRING, err STRING"
MASKING = "page INT, boxes INT, fab_unmasked INT, fab_masked INT, prose_kept DOUBLE, len_unmasked INT, len_masked INT, seconds INT"

_DEFAULTS = {"after": "", "reason": "", "seconds": 0.0, "finding": "", "instances": 1, "mode": ""}
_FIELDS = [f.split()[0] for f in CORRECTION.split(", ")]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes as they were written; blank lines are skipped, a malformed line fails the read."""
    rows = spark.read.schema(OUTCOME).option("mode", "FAILFAST").json(path)
    return rows.select(*(f.split(" ", 1)[0] for f in re.split(r", (?![^<]*>)", OUTCOME)))  # a stream's manifest has its batches as folders


def write_manifest(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("append").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The log with its defaults; a row that isn't JSON or has a field of another name fails the read by its file and line, since a record that loses rows is none."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    raw = files.where(F.trim("value") != "")
    kind = "struct<" + ", ".join(f.replace(" ", ":", 1) for f in CORRECTION.split(", ")) + ">"
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    names = F.json_object_keys("value")
    strange = F.array_except(names, F.array(*map(F.lit, _FIELDS)))
    where = F.concat("file", F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(": "))
    # a value of the wrong type is null where the line has one
    lost = F.filter(F.array(*(F.when(parsed[f].isNull() & F.get_json_object("value", f"$.{f}").isNotNull(), F.lit(f)) for f in _FIELDS)), lambda f: f.isNotNull())
    why = F.when(F.trim("value") == "", None).when(strange.isNull(), F.concat(F.lit("not a correction row: "), F.substring("value", 1, 200))).when(F.size(strange) > 0, F.concat(F.lit("unknown fields "), F.array_join(strange, ", "))).when(F.size(lost) > 0, F.concat(F.lit("wrong values of "), F.array_join(lost, ", ")))
    rows = raw.select(F.when(why.isNotNull(), F.raise_error(F.concat(where, why))).otherwise(parsed).alias("r")).select("r.*")
    return rows.select(*(F.coalesce(c, F.lit(_DEFAULTS[c])).alias(c) if c in _DEFAULTS else F.col(c) for c in _FIELDS))


def append_corrections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_pages(outcomes: DataFrame, folder: str) -> None:
    """(page, verdict, text) to folder as (name, text), failing pages under quarantine=true: a build reads the other branch alone."""
    named = outcomes.select(output_name(F.col("page"), F.col("verdict")).alias("name"), "text", (F.col("verdict") == "fail").alias("quarantine"))
    named.write.mode("append").partitionBy("quarantine").option("compression", "none").parquet(folder)


def write_tex(outcomes: DataFrame, folder: str) -> int:
    """(page, verdict, text) as files that a build can read, page-0001.tex in folder and failing ones as page-0001.fail.tex; the number of files.

    Tasks write by pyarrow's file systems, each file under a passing name first and then renamed, so a task that runs again leaves whole files.
    """

    def write(batches):
        fs, root = pa_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                passing = f"{root}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(passing) as out:
                    out.write((text or "").encode())
                fs.move(passing, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    importable()
    named = outcomes.where("text is not null").select(output_name(F.col("page"), F.col("verdict")).alias("name"), "text")
    return named.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def run_engine(pages: DataFrame, engine: str = "pdflatex", timeout: int = 120, run: Callable = subprocess.run) -> DataFrame:
    """(page, log, exit_code) of building each page's text by an engine where tasks run; without the engine the exit code is null, which is unchecked. A build that takes too long failed."""

    def build(text: str) -> tuple[str, int | None]:
        if run is subprocess.run and shutil.which(engine) is None:
            return "", None
        with tempfile.TemporaryDirectory() as own:
            (Path(own) / "page.tex").write_text(text, encoding="utf-8")
            try:
                done = run([engine, "-interaction=nonstopmode", "-halt-on-error", "page.tex"], cwd=own, capture_output=True, timeout=timeout, check=False)
            except subprocess.TimeoutExpired:
                return f"! the engine took more than {timeout} s\n", 1
            return done.stdout.decode("utf-8", "replace"), done.returncode

    def builds(batches):
        for b in batches:
            got = [build(t or "") for t in b["text"]]
            yield pd.DataFrame({"page": b["page"], "log": [x[0] for x in got], "exit_code": pd.array([x[1] for x in got], dtype="Int32")})

    importable()
    return pages.select("page", "text").mapInPandas(builds, f"page {pages.schema['page'].dataType.simpleString()}, log string, exit_code int")


def crop_regions(requests: DataFrame, run: Callable = subprocess.run) -> DataFrame:
    """(page, path, crop_ok, error) of cutting regions in points out of a document's pages as vector files; the result's box is tightened, with margins of 4, where the program for it is there.

    requests: (page, document, x, y, width, height, path). A region that cannot be cut has its error in a column and the others go on.
    """

    def cut(r) -> tuple[bool, str | None]:
        if run is subprocess.run and (missing := missing_tools("pdftocairo")):
            return False, f"not installed: {', '.join(missing)}"
        if not (r.width > 0 and r.height > 0):
            return False, "an empty region"
        region = ["-x", str(int(r.x)), "-y", str(int(r.y)), "-W", str(int(r.width)), "-H", str(int(r.height)), "-paperw", str(int(r.width)), "-paperh", str(int(r.height))]
        done = run(["pdftocairo", "-pdf", "-f", str(r.page), "-l", str(r.page), *region, r.document, r.path], capture_output=True, check=False)
        if done.returncode:
            return False, done.stderr.decode("utf-8", "replace")[:200]
        if run is not subprocess.run or shutil.which("pdfcrop"):
            run(["pdfcrop", "--margins", "4", r.path, r.path], capture_output=True, check=False)  # at best: an untightened crop is a crop
        return True, None

    def cuts(batches):
        for b in batches:
            got = [cut(r) for r in b.itertuples()]
            yield pd.DataFrame({"page": b["page"], "path": b["path"], "crop_ok": [x[0] for x in got], "error": pd.Series([x[1] for x in got], dtype=object)})

    importable()
    return requests.mapInPandas(cuts, "page int, path string, crop_ok boolean, error string")


def read_sweep(spark: SparkSession, path: str, schema: str = SWEEP) -> DataFrame:
    """Result tables of batch runs: CSV with a header."""
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def missing_tools(*names: str) -> list[str]:
    """Which of the programs a connector needs are not here: to be asked before a run."""
    return [n for n in names if shutil.which(n) is None]


def page_count(info: Column) -> Column:
    """Pages by a document's info text; fails where there is no count."""
    n = F.regexp_extract(info, r"(?m)^Pages:\s*(\d+)", 1)
    return F.when(n == "", F.raise_error(F.lit("no page count in the document's info"))).otherwise(n.try_cast("int"))


def page_size(info: Column) -> Column:
    size = lambda k: F.regexp_extract(info, r"Page size:\s+([0-9.]+) x ([0-9.]+)", k).try_cast("double")
    return F.when(size(1).isNotNull(), F.struct(size(1).alias("width"), size(2).alias("height")))


class _PageRange(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class _DocumentReader(DataSourceReader):
    """A partition a page; a page range in the options prunes partitions before any tool is started."""

    def __init__(self, options: dict) -> None:
        self.path, self.first, self.last, self.dpi = options["path"], int(options.get("first", 1)), options.get("last"), int(options.get("dpi", 150))
        if missing := missing_tools("pdfinfo", "pdftoppm", "pdftocairo"):
            raise RuntimeError(f"not installed: {', '.join(missing)}")

    def partitions(self) -> list[InputPartition]:
        info = subprocess.run(["pdfinfo", self.path], capture_output=True, text=True, check=True).stdout
        pages = int(re.search(r"^Pages:\s*(\d+)", info, re.M)[1])
        last = pages if self.last is None else int(self.last)
        if not 1 <= self.first <= last <= pages:
            raise ValueError(f"pages {self.first} to {last} of {pages}")
        return [_PageRange(p) for p in range(self.first, last + 1)]

    def read(self, partition: _PageRange) -> Iterator[tuple]:
        p = str(partition.page)
        png = subprocess.run(["pdftoppm", "-png", "-r", str(self.dpi), "-f", p, "-l", p, self.path], capture_output=True, check=True).stdout
        svg = subprocess.run(["pdftocairo", "-svg", "-f", p, "-l", p, self.path, "/dev/stdout"], capture_output=True, text=True, check=False).stdout
        yield partition.page, png, svg


class DocumentPages(DataSource):
    """spark.read.format("document_pages").option("path", ...).load(): (page, image, svg), by poppler's programs."""

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return "page int, image binary, svg string"

    def reader(self, schema) -> DataSourceReader:
        return _DocumentReader(self.options)


def recognise(pages: DataFrame, model: Callable[[bytes, str], str], prompts: dict[str, str], attempts: int = 3) -> DataFrame:
    """(page, markup, inventory_raw, error): two independent questions to a model a page, with bounded retries.

    model(image, prompt) gives text; an empty reply counts as none. A page that gets none has its error in a column
    and the run goes on; an inventory that gets none is null, which is not an empty inventory.
    """

    def ask(image: bytes, prompt: str) -> tuple[str | None, str | None]:
        why = "no attempt"
        for _ in range(attempts):
            try:
                if text := _unfenced((model(image, prompt) or "").strip()):
                    return text, None
                why = "empty reply"
            except Exception as e:  # whatever a reply that failed raises, the page is asked again and then has its error
                why = f"{type(e).__name__}: {e}"
        return None, f"no reply after {attempts} attempts ({why})"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, image in zip(b["page"], b["image"], strict=True):
                markup, error = ask(image, prompts["transcribe"])
                rows.append((page, markup, None if error else ask(image, prompts["inventory"])[0], error))
            yield pd.DataFrame(rows, columns=["page", "markup", "inventory_raw", "error"])

    return pages.select("page", "image").mapInPandas(run, "page int, markup string, inventory_raw string, error string")


def _unfenced(text: str) -> str:
    return re.sub(r"\A```(?:latex|tex)?|```\Z", "", text).strip()


def http_model(endpoint: str, model: str, timeout: int = 300, num_ctx: int = 8192) -> Callable[[bytes, str], str]:
    """A model behind a chat endpoint. The call is a plain function, so tests put another in its place."""
    import base64
    import urllib.request

    from quillspark.functions.scalars import REFUSED_ALIASES

    if model in REFUSED_ALIASES:
        raise ValueError(f"{model} stands for a reasoning checkpoint; name an instruct one")

    def ask(image: bytes, prompt: str) -> str:
        body = {"model": model, "stream": False, "messages": [{"role": "user", "content": prompt, "images": [base64.b64encode(image).decode()]}], "options": {"temperature": 0.1, "num_predict": -1, "num_ctx": num_ctx}}
        request = urllib.request.Request(endpoint, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read()).get("message", {}).get("content") or ""

    return ask
