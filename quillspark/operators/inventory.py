"""Model replies to rows: mark inventories, box lists, verifications; malformed replies become flags, never failures of a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

MARK = "struct<kind:string,description:string,context:string,placement:string,cnt:int,confidence:double>"
_ENTRY = "struct<description:string,context:string,inline_or_block:string,count:string>"


def json_part(raw: Column) -> Column:
    """From the first opening brace to the last closing one; null without them."""
    return F.when(F.instr(raw, "{") > 0, F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit("")))


def _count(text: Column) -> Column:
    """At least 1; a number is cut to whole, a text must be a whole number, anything else is 1."""
    return F.greatest(F.lit(1), F.coalesce(F.when(strip(text).rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), strip(text).try_cast("double").cast("int")), F.lit(1)))


def _mark(e: Column) -> Column:
    return F.struct(
        F.lit("unknown").alias("kind"),
        strip(F.coalesce(e["description"], F.lit(""))).alias("description"),
        strip(F.coalesce(e["context"], F.lit(""))).alias("context"),
        F.when(F.startswith(F.coalesce(e["inline_or_block"], F.lit("")), F.lit("inline")), "inline").otherwise("block").alias("placement"),
        _count(e["count"]).alias("cnt"),
        F.lit(None).cast("double").alias("confidence"),
    )


def salvage(raw: Column) -> Column:
    """Whole flat objects of a reply that was cut off, those with a placement, in order."""
    objects = F.transform(F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.when(F.get_json_object(o, "$.inline_or_block").isNotNull(), F.from_json(o, _ENTRY)))
    return F.filter(objects, lambda e: e.isNotNull())


def parse_inventory(raw: Column, strict: bool = True) -> Column:
    """(marks, failed). A whole reply gives its marks, a cut one what can be salvaged; failed if neither.

    A reply without any object is failed; with strict=False it is an inventory without marks.
    """
    part = json_part(raw)
    whole = F.try_parse_json(part).isNotNull()
    entries = F.when(whole, F.coalesce(F.from_json(part, f"struct<marks:array<{_ENTRY}>>")["marks"], F.array().cast(f"array<{_ENTRY}>"))).otherwise(salvage(part))
    marks = F.transform(F.filter(entries, lambda e: e.isNotNull()), _mark)
    failed = F.when(part.isNull(), F.lit(strict)).otherwise(~whole & (F.size(entries) == 0))
    empty = F.array().cast(f"array<{MARK}>")
    return F.struct(F.coalesce(F.when(~failed, marks), empty).cast(f"array<{MARK}>").alias("marks"), failed.alias("failed"))


def marks_of(inventory: Column, placement: str | None = None) -> Column:
    return inventory if placement is None else F.filter(inventory, lambda m: m["placement"] == placement)


def parse_boxes(raw: Column) -> Column:
    """Boxes of a reply, under either key; empty for anything else."""
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    listed = F.from_json(json_part(raw), f"struct<boxes:{kind},diagrams:array<struct<what:string,box:array<double>>>>")
    corners = F.transform(F.filter(listed["diagrams"], lambda d: F.size(d["box"]) == 4), lambda d: F.struct(*(d["box"][i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))
    return F.coalesce(listed["boxes"], corners, F.array()).cast(kind)


def verification(raw: Column) -> Column:
    """(matches, missing, invented, changed, raw): sizes of the lists, 0 where absent; a reply that can't be read keeps 120 characters of itself."""
    part = json_part(raw)
    readable = F.try_parse_json(part).isNotNull()
    v = F.from_json(part, "struct<matches:boolean,missing:array<string>,invented:array<string>,changed:array<string>>")
    n = lambda c: F.when(v[c].isNull(), 0).otherwise(F.size(v[c]))
    return F.struct(F.when(readable, v["matches"]).alias("matches"), n("missing").alias("missing"), n("invented").alias("invented"), n("changed").alias("changed"), F.when(~F.coalesce(readable, F.lit(False)), F.substring(raw, 1, 120)).alias("raw"))
