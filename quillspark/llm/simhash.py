"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most
three bits differ in at most one bit of one of the segments, so both share a key made of that
segment with one bit left out. Every distinct fingerprint is indexed under its 64 such keys, equal
keys meet, and each meeting is verified on all 64 bits.

Within a bucket no pairs are emitted: its members are linked to the smallest member that they reach
there. A pair counts only in the first bucket that it shares, so repeated meetings cost nothing. A
bucket of more than BUCKET members is not gathered: its members stream on to a finer index, in which
the other segment is cut in two and one bit of a half left out as well, and then once more; there a
bucket has at most 2^11 distinct fingerprints, so memory is bounded and no link is lost. Keys that a sample shows
to hold a thousandth of all fingerprints go to the finer index at once, so no task sees such a bucket whole.

Defined results: null and empty texts have fingerprint zero and link like others, as rows with a null id do; rows with equal texts
have one component; a component without any id has none; a text of any length is hashed in blocks; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions.workers import importable
from quillspark.llm.shared import forget, in_files, map_rows, read, stage_table

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Members that one bucket may gather in memory; larger buckets are cut finer.
BUCKET = 2048
#: A key with over a SHARE-th of all rows goes a way of its own; SAMPLED fingerprints tell which.
SHARE = 1000
SAMPLED = 1 << 16
#: Distinct fingerprints of a file; each becomes 64 keys in the task that reads it.
NODES_PER_FILE = 1 << 12


def fingerprint(text: str | None, block: int = 1 << 16) -> int:
    """Bits set in over half of the XXH64 values of the text's three-word shingles, repeats included; shingles are made and hashed a block at a time."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), b"", b""]
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, block):
        end = min(n, at + block)
        shingles = map(b" ".join, zip(words[at:end], words[at + 1 : end + 1], words[at + 2 : end + 2], strict=True)) if words[-1] else words[:1]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=end - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp): fp as a signed 64-bit number."""

    def make():
        forget()
        return lambda ids, texts: (ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return map_rows(df.select(id_col, text_col), T.StructType([df.schema[id_col], T.StructField("fp", T.LongType())]), make)


def _part(fp, seg):
    return F.when(seg == 0, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def _segment_keys(nodes: DataFrame) -> DataFrame:
    """64 keys of each fingerprint: segment, left-out bit, the segment without it."""
    keys = nodes.select("fp", "node", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    seg, bit = F.col("v").bitwiseAND(F.lit(1)), F.shiftright("v", 1)
    left = _part(F.col("fp"), seg)
    cleared = left.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v div 2)")))
    return keys.select((F.lit(0)).alias("level"), (F.shiftleft(cleared, 6) + F.col("v").cast("long")).alias("key"), F.lit(0).cast("long").alias("key2"), "fp", "node", seg.cast("int").alias("seg"), bit.cast("int").alias("bit"))


def _finer_keys(rows: DataFrame, level: int) -> DataFrame:
    """Members of large buckets under keys that also hold one part of the rest without one bit: 16 bits at level 1, 8 at level 2."""
    width = 16 if level == 1 else 8
    parts = 2
    wide = rows.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(parts * width - 1))))
    value = F.expr(f"shiftrightunsigned(rest, cast((u div {width}) * {width} as int)) & {(1 << width) - 1}L")
    if level == 1:  # halves of the other segment
        rest = _part(F.col("fp"), 1 - F.col("seg"))
    else:  # quarters of the half that the first finer key leaves open
        rest = F.expr("shiftrightunsigned(rest0, cast((1 - (cast(key2 & 31 as int) div 16)) * 16 as int)) & 65535L")
        wide = wide.withColumn("rest0", _part(F.col("fp"), 1 - F.col("seg")))
    wide = wide.withColumn("rest", rest).withColumn("value", value)
    cleared = F.expr(f"value & ~shiftleft(1L, u % {width})")
    key2 = F.shiftleft(F.col("key2"), 22) + F.shiftleft(cleared, 5) + F.col("u").cast("long")
    return wide.select(F.lit(level).alias("level"), "key", key2.alias("key2"), "fp", "node", "seg", "bit")


_LINK_TYPE = "kind int, a long, b long, key long, key2 long, fp long, seg int, bit int"


def _linked(fps: np.ndarray, nodes: np.ndarray, seg: int, bit: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the smallest member of its part of the bucket."""
    diff = fps[:, None] ^ fps[None, :]
    near = np.bitwise_count(diff) <= MAX_BITS
    low = (diff & np.uint64(0xFFFFFFFF)) if seg == 0 else (diff >> np.uint64(32))
    first = (low == np.uint64(1 << bit)) | ((low == 0) & (bit == 0))
    if seg == 1:  # the first bucket of a pair is one of segment 0 if there is one
        first &= np.bitwise_count(diff & np.uint64(0xFFFFFFFF)) > 1
    near &= first
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return nodes[:0], nodes[:0]
    near, own = near[np.ix_(rows, rows)], nodes[rows]
    label = own.copy()
    while True:
        best = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == label).all():
            break
        label = best
    far = label != own
    return own[far], label[far]


def _bucket_links(keys: DataFrame, level: int, bucket: int = BUCKET) -> DataFrame:
    """kind 0: a link (a, b); kind 1: a member of a bucket that is too large, to be cut finer."""
    last = level == 2
    limit = (1 << 30) if last else bucket  # at the last level a bucket cannot exceed 2^11 distinct fingerprints

    schema = to_arrow_schema(T.StructType.fromDDL(_LINK_TYPE))

    def run(batches):
        def links(a, b):
            z = np.zeros(len(a), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((z, np.int32), (a, np.int64), (b, np.int64), (z, np.int64), (z, np.int64), (z, np.int64), (z, np.int32), (z, np.int32))], schema=schema)

        def later(m):
            n = len(m["fp"])
            return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((np.ones(n), np.int32), (m["node"], np.int64), (m["node"], np.int64), (m["key"], np.int64), (m["key2"], np.int64), (m["fp"], np.int64), (m["seg"], np.int32), (m["bit"], np.int32))], schema=schema)

        def solve(m):
            order = np.argsort(m["node"], kind="stable")
            return _linked(m["fp"][order].view(np.uint64), m["node"][order], int(m["seg"][0]), int(m["bit"][0]), level)

        forget()
        held, large = None, None  # the run that may go on; the keys of a run that is already being passed on
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            m = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "key2", "fp", "node", "seg", "bit")}
            if held is not None:
                m = {c: np.concatenate((held[c], m[c])) for c in m}
                held = None
            if large is not None and len(m["fp"]):  # the rest of a run that is being passed on
                same = (m["key"] == large[0]) & (m["key2"] == large[1])
                more = len(same) if same.all() else int(np.argmin(same))
                if more:
                    yield later({c: v[:more] for c, v in m.items()})
                    m = {c: v[more:] for c, v in m.items()}
                if len(m["fp"]):
                    large = None
            n = len(m["fp"])
            if not n:
                continue
            cut = np.flatnonzero((m["key"][1:] != m["key"][:-1]) | (m["key2"][1:] != m["key2"][:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
            for k in np.flatnonzero((ends - starts > 1) | (ends == n)):
                s, e = int(starts[k]), int(ends[k])
                run_rows = {c: v[s:e] for c, v in m.items()}
                if e - s > limit:
                    yield later(run_rows)
                    if e == n:
                        large = (int(m["key"][s]), int(m["key2"][s]))
                elif e == n:
                    held = run_rows
                else:
                    found.append(solve(run_rows))
            if sum(len(a) for a, _ in found) > 4096:
                yield links(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found = []
        if held is not None and len(held["fp"]) > 1:
            found.append(solve(held))
        if found:
            yield links(*(np.concatenate(x) for x in zip(*found, strict=True)))

    importable()
    by = ["key", "key2"] if level else ["key"]
    return keys.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _LINK_TYPE)


def _hot_keys(nodes: DataFrame, n: int, bucket: int) -> DataFrame:
    """(key) of level 0 that seem to hold over `bucket` fingerprints and a SHARE-th of all, by a sample: at most 64 * SHARE keys or so. It only says which way they go; every way finds the same links."""
    step = max(1, n // SAMPLED)
    some = _segment_keys(nodes.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0))
    return some.groupBy("key").count().where(F.col("count") * step > max(bucket, n // SHARE)).select("key")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join exactly the nodes whose fingerprints reach each other by steps of at most MAX_BITS bits. nodes: (fp, node), distinct fingerprints."""
    hot = stage_table(_hot_keys(nodes, nodes.count(), bucket), "simhash-hot")
    keys, found = _segment_keys(nodes), None
    finer = []  # members of large buckets: those that were seen before never meet in one task
    if not hot.isEmpty():
        finer.append(keys.join(F.broadcast(hot), "key", "left_semi").select("key", "key2", "fp", "node", "seg", "bit"))
        keys = keys.join(F.broadcast(hot), "key", "left_anti")
    for level in range(3):
        got = stage_table(_bucket_links(keys, level, bucket), f"simhash-links{level}")
        edges = got.where("kind = 0").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        if level == 2:
            break
        large = got.where("kind = 1")
        if not large.isEmpty():
            finer.append(large.select("key", "key2", "fp", F.col("a").alias("node"), "seg", "bit"))
        if not finer:
            break
        keys, finer = _finer_keys(reduce(DataFrame.unionByName, finer), level + 1), []
    return found.distinct()


def by_key(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of table, which has each key once and in n its number of rows, `total` in all.

    Keys of over a SHARE-th of all rows are SHARE at most: they are broadcast, so their rows stay where they are. The rest is joined by shuffle.
    """
    hot = F.col("n") > total // SHARE
    frequent = F.broadcast(table.where(hot).drop("n"))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).drop("n"), key)
    return rows.join(frequent, key).unionByName(rest)


def _starred(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Edges (a, b), a > b, from each node's neighbours to the smallest of these and itself: the larger neighbours (large), or the smaller ones and the node."""
    rows = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select("a", "b")
    least = rows.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = by_key(rows, least, "a", total * (1 + large))
    if large:
        return met.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Every round links each node's larger neighbours to the smallest neighbour, then its smaller ones and itself to their
    smallest, and ends when nothing changes: stars around the smallest nodes. Edges never become more, and
    paths halve from round to round, so a path of a thousand nodes takes some eleven. Rounds are written tables, in files by the number of edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage_table(in_files(edges.distinct(), edges.count()), "component-edges")
    state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        total = state[0]
        wide = stage_table(in_files(_starred(edges, total, True), total), "component-wide")  # at most as many edges as before
        edges = stage_table(in_files(_starred(wide, total, False), total), "component-edges")
        before, state = state, edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id reachable."""
    fps = stage_table(fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), text_col), "doc_id", text_col), "simhash-fps")
    classes = stage_table(classes_of(fps, F.min("doc_id"), bucket), "simhash-classes")
    return by_key(fps, classes, "fp", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("chosen").alias("component_id"))


def classes_of(fps: DataFrame, choose: Column, bucket: int = BUCKET) -> DataFrame:
    """(fp, n, chosen) for each fingerprint of fps, a written table: its number of rows, and the least of choose, an aggregate of rows, in its component."""
    nodes = stage_table(in_files(fps.groupBy("fp").agg(choose.alias("least"), F.count(F.lit(1)).alias("n")), fps.count(), NODES_PER_FILE), "simhash-nodes")
    linked = components(links(nodes.select("fp", F.col("fp").alias("node")), bucket))
    labelled = stage_table(nodes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.col("n").alias("rows"), "least", F.coalesce("component", "fp").alias("label")), "simhash-labels")
    chosen = labelled.groupBy("label").agg(F.min("least").alias("chosen"), F.count(F.lit(1)).alias("n"))
    total = labelled.count()
    return in_files(by_key(labelled, chosen, "label", total).select("fp", F.col("rows").alias("n"), "chosen"), total)


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
