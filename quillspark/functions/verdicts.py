"""The algebra of gates: failures, three gate states, three page verdicts.

A gate that could not run is neither passed nor failed; the difference survives into every verdict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILURE = "struct<detail:string,line:int,column:int,excerpt:string>"
GATE = f"struct<gate:string,checked:boolean,failures:array<{FAILURE}>>"
FINDING = "struct<gate:string,detail:string,line:int,excerpt:string>"


def failure(detail: Column, line: Column | None = None, column: Column | None = None, excerpt: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        detail.alias("detail"), (null if line is None else line).cast("int").alias("line"), (null if column is None else column).cast("int").alias("column"), (F.lit("") if excerpt is None else excerpt).alias("excerpt")
    )


def no_failures() -> Column:
    return F.array().cast(f"array<{FAILURE}>")


def gate(name: str, failures: Column | None = None, checked: Column | bool = True) -> Column:
    on = F.lit(checked) if isinstance(checked, bool) else checked
    return F.struct(F.lit(name).alias("gate"), on.alias("checked"), (no_failures() if failures is None else failures.cast(f"array<{FAILURE}>")).alias("failures"))


def skipped(name: str) -> Column:
    return gate(name, checked=False)


def passed(g: Column) -> Column:
    return g["checked"] & (F.size(g["failures"]) == 0)


def state(g: Column) -> Column:
    """pass, skipped or fail."""
    return F.when(passed(g), "pass").when(~g["checked"], "skipped").otherwise("fail")


def failed(gates: Column) -> Column:
    """Some gate ran and refused."""
    return F.exists(gates, lambda g: g["checked"] & (F.size(g["failures"]) > 0))


def unverified(gates: Column) -> Column:
    """Names of gates that could not run, in order."""
    return F.transform(F.filter(gates, lambda g: ~g["checked"]), lambda g: g["gate"])


def verdict(gates: Column) -> Column:
    """fail before unverified before pass; without gates, pass."""
    return F.when(failed(gates), "fail").when(F.exists(gates, lambda g: ~g["checked"]), "unverified").otherwise("pass")


def all_passed(gates: Column) -> Column:
    return verdict(gates) == "pass"


def states(gates: Column) -> Column:
    return F.map_from_entries(F.transform(gates, lambda g: F.struct(g["gate"], state(g))))


def findings(gates: Column) -> Column:
    """Failures of all gates, gate by gate, as (gate, detail, line, excerpt)."""
    return F.flatten(F.transform(gates, lambda g: F.transform(g["failures"], lambda f: F.struct(g["gate"].alias("gate"), f["detail"].alias("detail"), f["line"].alias("line"), f["excerpt"].alias("excerpt")))))


def failure_text(f: Column) -> Column:
    where = F.when(f["line"] > 0, F.concat(F.lit("line "), f["line"].cast("string"))).otherwise("document")
    where = F.concat(where, F.coalesce(F.concat(F.lit(", col "), f["column"].cast("string")), F.lit("")))
    return F.concat(F.lit("  "), where, F.lit(": "), f["detail"], F.when(f["excerpt"] != "", F.concat(F.lit("\n    "), f["excerpt"])).otherwise(""))


def gate_text(g: Column) -> Column:
    failing = F.concat(g["gate"], F.lit(": FAIL ("), F.size(g["failures"]).cast("string"), F.lit(")\n"), F.array_join(F.transform(g["failures"], failure_text), "\n"))
    return F.when(~g["checked"], F.concat(g["gate"], F.lit(": SKIPPED (could not run), which is no pass"))).when(F.size(g["failures"]) == 0, F.concat(g["gate"], F.lit(": PASS"))).otherwise(failing)


def report(gates: Column) -> Column:
    """A gate a line; gates that could not run; and a last line that never says PASS without its limits."""
    open_ = unverified(gates)
    last = F.concat(F.upper(verdict(gates)), F.lit(": gates show that this builds, not that it says what the page says."))
    parts = F.concat(F.transform(gates, gate_text), F.when(F.size(open_) > 0, F.array(F.concat(F.lit("  unverified: "), F.array_join(open_, ", ")))).otherwise(F.array().cast("array<string>")), F.array(last))
    return F.array_join(parts, "\n")
