"""Small parsers and projections: page ranges, fences, host facts, boxes, choices, header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import filled, half_even, strip

# Model names that stand for a reasoning checkpoint and are refused; patterns and limits of the experiments.
REFUSED_ALIASES = ["qwen3-vl", "qwen3-vl:2b", "qwen3-vl:4b", "qwen3-vl:8b", "qwen3-vl:30b", "qwen3-vl:32b", "qwen3-vl:235b"]
FABRICATION = r"\\begin\{(?:tikzpicture|array|tikzcd|matrix)\}|\\xrightarrow|\\xleftarrow|\\downarrow|\\uparrow|\\longrightarrow"
SWAP_WARNING = 0.85
# End of fixed values.


def page_range(spec: Column) -> Column:
    """(first, last): null or empty is from 1 to the end, a number that page, 3-9 these pages; other text has null bounds."""
    low = F.regexp_extract(spec, r"^([^-]*)-?(.*)$", 1)
    high = F.when(F.contains(spec, F.lit("-")), F.regexp_extract(spec, r"^([^-]*)-(.*)$", 2)).otherwise(spec)
    none = spec.isNull() | (spec == "")
    return F.struct(F.when(none, 1).otherwise(_int(low)).alias("first"), F.when(~none, _int(high)).alias("last"))


def _int(text: Column) -> Column:
    return F.when(strip(text).rlike(r"^[+-]?[0-9]+$"), strip(text).try_cast("int"))


def strip_fence(text: Column) -> Column:
    """Without one opening code fence (with or without a language) and one closing one."""
    opened = F.when(F.startswith(text, F.lit("```latex")), F.substring(text, 9, 1 << 30)).when(F.startswith(text, F.lit("```tex")), F.substring(text, 7, 1 << 30)).when(F.startswith(text, F.lit("```")), F.substring(text, 4, 1 << 30)).otherwise(text)
    return strip(F.regexp_replace(opened, r"```\z", ""))


def swap_pressure(sysctl: Column) -> Column:
    """Used part of swap from a host's report; null where the total is absent or zero."""
    total = F.regexp_extract(sysctl, r"total\s*=?\s*([0-9.]+)M?", 1).try_cast("double")
    used = F.coalesce(F.regexp_extract(sysctl, r"used\s*=?\s*([0-9.]+)M?", 1).try_cast("double"), F.lit(0.0))
    return F.when(total > 0, used / total)


def refused_model(model: Column) -> Column:
    return model.isin(REFUSED_ALIASES)


def document_body(text: Column) -> Column:
    """After the last begin of the document, before the first end of it."""
    after = F.substring_index(text, "\\begin{document}", -1)
    return strip(F.substring_index(after, "\\end{document}", 1))


def fabrication_score(text: Column) -> Column:
    return F.regexp_count(text, F.lit(FABRICATION))


def prose_words(text: Column) -> Column:
    """The set of words of more than three letters a to z, commands left out."""
    plain = F.regexp_replace(F.lower(text), r"\\[a-zA-Z]+|[^a-z ]", " ")
    return F.array_distinct(F.filter(F.split(plain, " +"), lambda w: F.length(w) > 3))


def prose_kept(before: Column, after: Column) -> Column:
    """Part of the words of one text that another still has."""
    return half_even(F.size(F.array_intersect(before, after)) / F.greatest(F.size(before), F.lit(1)), 2)


def box_points(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box on the 0 to 1000 grid in whole points."""
    cut = lambda v, size: (v / 1000 * size).cast("int")
    return F.struct(cut(x0, width).alias("x"), cut(y0, height).alias("y"), cut(x1 - x0, width).alias("width"), cut(y1 - y0, height).alias("height"))


def iou(a: Column, b: Column) -> Column:
    """Shared area by joint area; 0 where both are empty."""
    side = lambda p, size: F.greatest(F.lit(0), F.least(a[p] + a[size], b[p] + b[size]) - F.greatest(a[p], b[p]))
    shared = side("x", "width") * side("y", "height")
    joint = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(joint != 0, shared / joint).otherwise(F.lit(0.0))


def masked_box(box: Column, boxes: Column, width: Column, height: Column, pad: float = 1.5) -> Column:
    """A box in pixels, padded; the grid is 0 to 1000 if any far corner of the page's boxes exceeds 100, else percent. Null if nothing is left."""
    scale = F.when(F.exists(boxes, lambda b: F.greatest(b["x1"], b["y1"]) > 100), 1000.0).otherwise(100.0)
    k = F.lit(pad) * scale / 100
    low = lambda v, size: F.greatest(F.lit(0.0), (v - k) / scale * size)
    high = lambda v, size: F.least(size.cast("double"), (v + k) / scale * size)
    out = F.struct(low(box["x0"], width).alias("x0"), low(box["y0"], height).alias("y0"), high(box["x1"], width).alias("x1"), high(box["y1"], height).alias("y1"))
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


def region_choice(answer: Column, blocks: Column) -> Column:
    """A block by number, or x y w h in points; null if the answer is neither or goes back."""
    said = strip(F.coalesce(answer, F.lit("")))
    number = F.when(said.rlike("^[0-9]+$"), said.try_cast("int"))
    parts = F.transform(F.split(said, r"\s+"), lambda p: p.try_cast("double").cast("int"))
    typed = F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height"))))
    picked = F.get(blocks, number - 1)
    own = F.struct(*(picked[n].cast("int").alias(n) for n in ("x", "y", "width", "height")))
    return F.when((said == "") | F.lower(said).startswith("b"), None).when((number >= 1) & (number <= F.size(blocks)), own).when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), typed)


def provenance(page: Column, provider: Column, model: Column, marks: Column) -> Column:
    """Four comment lines: tool and page, recogniser, marks inventoried, what was not checked."""
    where = F.coalesce(F.concat(F.lit(" page "), page.cast("string")), F.lit(""))
    return F.concat(F.lit("% quillspark"), where, F.lit("\n% recognizer: "), provider, F.lit("/"), model, F.lit("\n% marks inventoried: "), marks.cast("string"), F.lit("\n% NOT CHECKED: whether this says what the page says; gates show that it builds\n"))


def outcome_line(page: Column, verdict: Column, gates: Column, error: Column) -> Column:
    """A page a line: number, label, gates; an error instead where there is one. gates: a map."""
    label = F.when(verdict == "pass", "ok  ").when(verdict == "unverified", "?   ").otherwise("FAIL")
    marks = F.array_join(F.transform(F.map_entries(gates), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "  ")
    number = F.concat(F.lit("page "), filled(page.cast("string"), 4, " "))
    return F.when(error.isNotNull(), F.concat(number, F.lit("  ERROR  "), error)).otherwise(F.concat(number, F.lit("  "), label, F.lit("  "), marks))
