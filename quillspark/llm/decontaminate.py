"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some positions of a window and ignores the others; a training text and a benchmark item
that agree on the looked-at tokens of a window meet under the hash of these, whatever stands on the
ignored positions. A hit fixes an alignment, at which the whole item is compared with the text token by
token; the pair stays if at least THRESHOLD of the item's tokens agree.

MASKS look at five tokens. Whichever fifth of an item's tokens is substituted, one of them meets it, but for some
lengths up to SHORT: for these, each set of positions that MASKS lose has a mask of its own that ignores just
that set (see own_masks), so no overlap of THRESHOLD or more is lost at any length.

Everything is built-in functions. Texts become arrays of token hashes, windows are exploded inside
generated code, and hashes are probed against the benchmark's. Items with equal tokens are one class and
are compared once. The benchmark's side is broadcast only if it was counted and has at most BROADCAST_KEYS
seeds; beyond, seeds are joined by shuffle, each to SALTS places, so that a frequent one is split. Where a text
and an item both repeat one token, only the first place of either is probed, which gives the same alignments. Hits hold ids and
alignments; only the texts that have some are read again and compared.

Defined results: null and empty texts and items have no tokens and meet nothing; a text that holds an item twice has
it once, at the first of its best places; of items with equal tokens the smallest item_id stands for the class and
`members` has its size; rows with one doc_id count as one document, rows with a null one too; tables may be empty; other columns are not looked at.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import in_files, read, stage_table

#: Looked-at positions, five each, over spans of six to nine tokens.
MASKS = [(0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 8)]
THRESHOLD = 0.8
#: The longest items of which MASKS may lose some.
SHORT = 10
#: Seeds of the benchmark up to which its side is broadcast (some tens of MB), and places of a seed beyond.
BROADCAST_KEYS = 200_000
#: Benchmark items of a file; each becomes a seed for each of its tokens and masks in the task that reads it.
ITEMS_PER_FILE = 1 << 10
SALTS = 16
NOT_WORD = "[^\\p{L}\\p{N}]+"
LONGEST_SPAN = max(m[-1] + 1 for m in MASKS)


def lost_sets(n: int, threshold: float = THRESHOLD) -> list[tuple[int, ...]]:
    """The sets of positions of an item of n tokens, as large as the threshold lets differ, with which no mask of MASKS meets it."""
    most = next(k for k in range(n, -1, -1) if (n - k) / n >= threshold)
    meets = lambda away: any(all(at + p not in away for p in m) for m in MASKS for at in range(n - m[-1]))
    return [away for away in itertools.combinations(range(n), most) if not meets(away)]


def own_masks(threshold: float = THRESHOLD) -> dict[int, list[tuple[tuple[int, ...], int]]]:
    """(mask, place in the item) by length of items: masks from position 0 that ignore one lost set each."""
    out: dict[int, list] = {}
    for n in range(1, SHORT + 1):
        left = [[p for p in range(n) if p not in away] for away in lost_sets(n, threshold)]
        if left:
            out[n] = sorted({(tuple(p - own[0] for p in own), own[0]) for own in left})
    return out


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, members, t, n): a row per class of items with equal tokens."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("t")).where(F.size("t") > 0)
    return own.groupBy("t").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("members")).select("item_id", "members", "t", F.size("t").alias("n"))


def _seed(t: Column, at: Column, mask: tuple[int, ...], n: Column) -> Column:
    """Hash of the mask and the looked-at tokens of the window at `at`; null where the window doesn't fit."""
    return F.when(at + mask[-1] < n, F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(t, at + p) for p in mask)))


def _again(t: Column, at: Column) -> Column:
    """The token before `at` and those from there on, as far as a mask looks, are all the same."""
    same = F.get(t, at - 1) == F.get(t, at)
    for p in range(1, max(LONGEST_SPAN, SHORT)):
        same = same & (F.get(t, at) == F.get(t, at + p))
    return F.coalesce((at > 0) & same, F.lit(False))


def item_seeds(own: DataFrame, masks: dict[int, list[tuple[tuple[int, ...], int]]]) -> DataFrame:
    """(seed, kind, item_id, j): where each seed lies in items; kind 1 has only the first of places that repeat one token, kind 0 all."""
    rows = own.select("item_id", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    every = F.array(*(_seed(F.col("t"), F.col("j"), mask, F.col("n")) for mask in MASKS))
    seeds = rows.select("item_id", "j", _again(F.col("t"), F.col("j")).alias("again"), F.explode(every).alias("seed"))
    for n, listed in masks.items():
        for mask, j in listed:
            whole = own.where(F.col("n") == n).select("item_id", F.lit(j).alias("j"), F.lit(False).alias("again"), _seed(F.col("t"), F.lit(j), mask, F.col("n")).alias("seed"))
            seeds = seeds.unionByName(whole)
    kinds = F.when(F.col("again"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return seeds.where("seed is not null").distinct().select("seed", F.explode(kinds).alias("kind"), "item_id", "j")


def _agreeing(text: Column, item: Column, shift: Column) -> Column:
    """Tokens of the item that the text has when item token 0 stands at text token `shift`."""
    return F.aggregate(item, F.struct(shift.alias("p"), F.lit(0).alias("n")), lambda a, x: F.struct((a["p"] + 1).alias("p"), (a["n"] + F.coalesce((F.get(text, a["p"]) == x).cast("int"), F.lit(0))).alias("n")))["n"]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, item_id, members, similarity, start): documents that hold an item, and where. threshold: THRESHOLD or more."""
    if threshold < THRESHOLD:
        raise ValueError(f"masks are made for a similarity of {THRESHOLD} or more")
    own = stage_table(in_files(items(benchmark), benchmark.count(), ITEMS_PER_FILE), "decontaminate-items")
    lengths = {r[0] for r in own.where(F.col("n") <= SHORT).select("n").distinct().collect()}  # at most SHORT numbers
    masks = {n: listed for n, listed in own_masks().items() if n in lengths}
    seeds = stage_table(item_seeds(own, masks), "decontaminate-seeds")
    looked = [*MASKS, *sorted({mask for listed in masks.values() for mask, _ in listed} - set(MASKS))]
    tokens = docs.select(F.col(id_col).alias("doc_id"), token_hashes(F.col(text_col)).alias("w"))
    windows = tokens.where(F.size("w") > 0).select("doc_id", "w", F.size("w").alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    # token arrays stay inside the generated code that explodes them: carried on, each window would hold a copy
    every = F.array(*(_seed(F.col("w"), F.col("i"), mask, F.col("size")) for mask in looked))
    probes = windows.select("doc_id", "i", _again(F.col("w"), F.col("i")).cast("int").alias("kind"), F.explode(every).alias("seed")).where("seed is not null")
    if seeds.count() <= broadcast_keys:
        met = probes.join(F.broadcast(seeds), ["seed", "kind"])
    else:
        spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = probes.withColumn("salt", F.col("i") % SALTS).join(spread, ["seed", "kind", "salt"])
    hits = stage_table(met.select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("shift")).distinct(), "decontaminate-hits")
    hits = hits.withColumnRenamed("doc_id", "hit")
    with_hits = stage_table(in_files(hits.select("hit").distinct(), hits.count()), "decontaminate-met")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(with_hits, F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi").select("doc_id", token_hashes(F.col("text")).alias("w"))
    pairs = kept.join(hits, F.col("doc_id").eqNullSafe(F.col("hit"))).join(own, "item_id")
    scored = pairs.select("doc_id", "item_id", "members", "shift", (_agreeing(F.col("w"), F.col("t"), F.col("shift")) / F.col("n")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.greatest("shift", F.lit(0))).alias("back"))).alias("b"), F.max("members").alias("members"))
    return best.select("doc_id", "item_id", "members", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.back")).alias("start"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same without any mask: tokens that agree, counted for every alignment."""
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents),
items AS (SELECT min(item_id) AS item_id, count(*) AS members, w AS t FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w),
own AS (SELECT item_id, members, len(t) AS n, unnest(t) AS word, unnest(range(0, len(t))) AS j FROM items),
texts AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
aligned AS (
    SELECT doc_id, item_id, members, i - j AS shift, count(*) / n::DOUBLE AS similarity
    FROM texts JOIN own USING (word) GROUP BY doc_id, item_id, members, n, i - j HAVING count(*) / n::DOUBLE >= {THRESHOLD})
SELECT doc_id, item_id, max(members) AS members, round(max(similarity), 6) AS similarity,
    greatest(arg_max(shift, (similarity, -greatest(shift, 0))), 0)::INT AS start
FROM aligned GROUP BY doc_id, item_id
"""
