"""The page pipeline as one plan: recognitions and ink facts to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scalars, verdicts
from quillspark.operators import gates, normalize
from quillspark.operators.inventory import parse_inventory
from quillspark.operators.manifest import output_name, pending


def emit(pages: DataFrame, standalone: bool = False, provider: str = "local", model: str = "unknown", assets: frozenset[str] = frozenset()) -> DataFrame:
    """pages (page, markup, inventory_raw, error, ...) with text, rules and inventory: normalised once, with its header."""
    marks = parse_inventory(F.coalesce("inventory_raw", F.lit("")))
    read = pages.withColumn("inventory", marks).withColumn("n", normalize.normalize_column(standalone, assets)("markup"))
    header = scalars.provenance(F.col("page"), F.lit(provider), F.lit(model), F.size("inventory.marks"))
    return read.withColumn("text", F.concat(header, F.col("n.text"))).withColumn("rules", F.size("n.rules")).drop("n")


def outcomes(emitted: DataFrame, colours: DataFrame | None = None, source: str = "") -> DataFrame:
    """One row a page: (page, output, verdict, gates, error, rules, findings, source, text).

    colours: (page, colours); pages without a row are unknown. A page with an error has no text, no gates and the
    verdict fail, and the others go on. A fragment's compile gate is unchecked.
    """
    facts = emitted.withColumn("colours", F.lit(None).cast("array<struct<r:int,g:int,b:int>>")) if colours is None else emitted.join(colours, "page", "left")
    checked = facts.withColumn("g", gates.all_gates(F.col("text"), F.col("inventory.marks"), F.col("inventory.failed"), F.col("colours")))
    ok = F.col("error").isNull()
    verdict = F.when(ok, verdicts.verdict(F.col("g"))).otherwise("fail")
    return checked.select(
        "page",
        F.when(ok, output_name(F.col("page"), verdict)).alias("output"),
        verdict.alias("verdict"),
        F.when(ok, verdicts.states(F.col("g"))).otherwise(F.create_map().cast("map<string,string>")).alias("gates"),
        "error",
        F.when(ok, F.col("rules")).otherwise(0).alias("rules"),
        F.when(ok, verdicts.findings(F.col("g"))).otherwise(F.array()).cast(f"array<{verdicts.FINDING}>").alias("findings"),
        F.lit(source).alias("source"),
        F.when(ok, F.col("text")).alias("text"),
    )


def convert(pages: DataFrame, done: DataFrame | None = None, **options) -> DataFrame:
    """Outcomes of the pages not done yet: the anti-join stands below the expensive stages."""
    todo = pages if done is None else pending(pages, done)
    return outcomes(emit(todo, **options))
