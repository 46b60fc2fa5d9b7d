"""Language-model scoring with a log-frequency Bloom filter.

Counts. Training words and pairs of neighbouring words are counted exactly, all of them; the end token
counts as a word. A pair's key is a 64-bit hash of its two words.

Filter. A pair of count c is put in as (key, 1) ... (key, q) with q = 1 + floor(log2 c): a membership
probe for each level, upwards until one fails, gives the quantised count back, 2^(q-1), the least count that
it stands for. Pairs seen once are level 1. The filter is cut into shards that grow in number with the
training tokens, and each shard's bit array has BITS_PER_ENTRY bits for each entry counted in it, so neither
words nor pairs are left out at any size.

Shards. A pair lies in the shard of its second word, the pairs of words that are a FREQUENT-th of all training
tokens or more (FREQUENT words at most, by their number) in that of their key (their counts ride with the tasks, so no shard holds all of a frequent word). A
shard so knows its words' exact counts, by the word itself. Texts are packed into chunks, one row for a
chunk and shard; a shard counts the training pairs of its rows, builds its array, and then reads the rows
again to probe. What it finds is added up by chunk. Nothing that grows is broadcast or collected.

Score. p(w | h) = (c2(h, w) + MU * p1(w)) / (c1(h) + MU), with c2 from the filter, c1 exact and p1 the base
model's probability. The context of the first word is the end token, so contexts are the document's tokens in
another order, and the sum of log(c1 + MU) is taken word by word.

Base. Exact counts of every token.

Defined results: null and empty texts have one token, the end; a null id counts as the empty text where
folds are dealt; without training rows every base probability is 1; repeated rows give repeated results;
other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections import Counter
from itertools import repeat
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.shared import arrow_ready, crc_mod, read, stage_table

FOLDS = 10
#: A word that is one of so many training tokens or more often is frequent: its count rides with the tasks. There are this many at most. No bound of the model.
FREQUENT = 1 << 16
#: So that a shard's largest word stays in proportion to it, there are more in a corpus of very many shards, up to this number.
MOST_FREQUENT = 1 << 22
RARE, END = 0, 1
BITS_PER_ENTRY = 12
HASHES = 3
LEVELS = 48
MU = 64.0
#: Training tokens that a shard of the filter has on average.
SHARD_TOKENS = 1 << 21
LEAST_SHARDS = 8
#: Documents and characters of text that are packed together.
CHUNK_ROWS, CHUNK_CHARS = 2048, 8 << 20
#: Bytes of a shard's packed rows beyond which they wait in a file.
HELD_BYTES = 64 << 20
#: Distinct words that a task counts before it passes its counts on.
HELD = 400_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces


def _positions(keys: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    """Bit positions of (key, level), HASHES of them; keys are unsigned 64-bit."""
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return [(x + np.uint64(k) * step) % np.uint64(bits) for k in range(HASHES)]


class LogBloom:
    """A bit array that answers for the quantised count of a key."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.bits = words, len(words) * 64

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts: 0, or 2^(q-1) * 1.5 for level q (the middle of the counts it stands for; 1 for the first)."""
        found = np.zeros(len(keys), np.float64)
        alive = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            if not len(alive):
                break
            hit = np.ones(len(alive), bool)
            for p in _positions(keys[alive], level, self.bits):
                hit &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            alive = alive[hit]
            found[alive] = 1.0 if level == 1 else 1.5 * 2.0 ** (level - 1)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of (context, word) by their 64-bit hashes."""
    with np.errstate(over="ignore"):
        return mixed(context * np.uint64(0x9E3779B97F4A7C15) + mixed(word))


def shard_filter(keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The 64-bit words of an array for all of the distinct keys, sized by their entries."""
    q = np.floor(np.log2(c)).astype(int) + 1
    n = max(1, -(-int(q.sum()) * BITS_PER_ENTRY // 64))
    bits = np.zeros(n * 64, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for p in _positions(keys[q >= level], level, n * 64):
            bits[p.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def _partial_counts(df: DataFrame, make, key: str) -> DataFrame:
    """Counts of what make()(text) lists, summed within tasks and then over all: (key, c)."""
    arrow_ready(df.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(f"key {key}, c long"))

    def run(batches):
        add, held = make()
        for b in batches:
            for text in b.column(0).to_pylist():
                add(text)
                if not held(False):
                    continue
                for keys, counts in held(True):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(counts, pa.int64())], schema=schema)
        for keys, counts in held(True):
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(counts, pa.int64())], schema=schema)

    return df.mapInArrow(run, f"key {key}, c long").groupBy("key").agg(F.sum("c").alias("c"))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c), without the end token."""

    def make():
        counts: Counter = Counter()

        def held(out):
            if not out:
                return len(counts) > HELD
            keys, values = list(counts), list(counts.values())
            counts.clear()
            return ((([k.decode() for k in keys[i : i + 50_000]]), values[i : i + 50_000]) for i in range(0, len(keys), 50_000))

        return (lambda text: counts.update(tokens(text))), held

    return _partial_counts(train, make, "string").withColumnRenamed("key", "word")


_known: list = [None, {}]


def word_ids(words: list[bytes]) -> dict[bytes, int]:
    """Ids of a model's words, from 2, in their order; made once for a process and list."""
    if _known[0] is not words:
        _known[:] = words, {w: i for i, w in enumerate(words, 2)}
    return _known[1]


#: Packed rows: keys that a chunk has in a shard, by word; w has a frequent word's id or -1 - the place in words (joined by
#: spaces, which no word has), of_w the number of its keys, times the occurrences of each key, and at, for each of these,
#: twice the document's place in the chunk, and one more if it is held out. One more row for a chunk has its documents.
PACKED = "shard int, chunk long, words binary, w binary, of_w binary, keys binary, times binary, at binary, docs array<struct<doc_id: {}, held_out: boolean, n_tokens: long>>"
FOUND = "chunk long, docs array<struct<doc_id: {}, held_out: boolean, n_tokens: long>>, at binary, base binary, known binary, score binary"


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each that hold them all."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    """The n numbers that _small wrote."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def _chunks(b: pa.RecordBatch):
    """Pieces of a batch, of CHUNK_ROWS rows and about CHUNK_CHARS characters at most, a longer text alone."""
    at = size = 0
    lengths = [len(t or "") for t in b.column(2).to_pylist()]
    for i, x in enumerate(lengths):
        if i > at and (i - at >= CHUNK_ROWS or size + x > CHUNK_CHARS):
            yield b.slice(at, i - at)
            at, size = i, 0
        size += x
    if at < len(lengths):
        yield b.slice(at)


def _packed(part: pa.RecordBatch, of: dict[bytes, int], shards: int, chunk: int):
    """The packed rows of a piece with (doc_id, held_out, text)."""
    doc_ids, held, texts = (c.to_pylist() for c in part.columns)
    codes_of: dict[bytes, int] = {b" ": 0}  # the end token: no word has a space
    flat, sizes = [], []
    for t in texts:
        words = tokens(t)
        flat += words
        flat.append(b" ")
        sizes.append(len(words) + 1)
    codes = np.fromiter((codes_of.setdefault(w, len(codes_of)) for w in flat), np.int64, len(flat))
    del flat
    unique = list(codes_of)
    ids = np.fromiter(map(of.get, unique, repeat(RARE)), np.int64, len(unique))
    ids[0] = END
    hashes = hash_array(np.array(unique, dtype=object), categorize=False)
    before = np.concatenate(([0], codes[:-1]))  # a document's last token is the end, the next one's first context
    keys = pair_keys(hashes[before], hashes[codes])
    shard = (np.where(ids[codes] != RARE, mixed(keys), mixed(hashes)[codes]) % np.uint64(shards)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    mark = 2 * doc + np.array(held, bool)[doc]
    order = np.lexsort((keys, codes, shard))
    keys, codes, shard, mark = keys[order], codes[order], shard[order], mark[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1]))))
    times = np.diff(np.append(first, len(keys)))
    edges = np.searchsorted(shard, np.arange(shards + 1))
    cuts = np.searchsorted(first, edges)
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        a, z = cuts[k], cuts[k + 1]
        own = codes[first[a:z]]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        own, of_w = own[starts], np.diff(np.append(starts, len(own)))
        w = ids[own].astype(np.int32)
        rare = own[w == RARE]
        w[w == RARE] = -1 - np.arange(len(rare))
        yield {"shard": k, "chunk": chunk, "words": b" ".join([unique[i] for i in rare.tolist()]), "w": w.tobytes(), "of_w": _small(of_w), "keys": keys[first[a:z]].tobytes(), "times": _small(times[a:z]), "at": _small(mark[edges[k] : edges[k + 1]]), "docs": None}
    docs = [{"doc_id": i, "held_out": h, "n_tokens": n} for i, h, n in zip(doc_ids, held, sizes, strict=True)]
    yield {"shard": chunk % shards, "chunk": chunk, "docs": docs}


class _Shard:
    """A shard's packed rows: their training pairs are counted as they come; then the filter is made and the rows are read again, from a file if they are large."""

    def __init__(self) -> None:
        self.counts: dict[bytes, int] = {}
        self.parts: list = []
        self.rows, self.n = SpooledTemporaryFile(HELD_BYTES), 0

    def learn(self, chunk: int, words: bytes, w: bytes, of_w: bytes, keys: bytes, times: bytes, at: bytes) -> None:
        names = words.split(b" ") if words else []
        ids, keys_ = np.frombuffer(w, np.int32), np.frombuffer(keys, np.uint64)
        per_word, per_key = _large(of_w, len(ids)), _large(times, len(keys_))
        mark = _large(at, int(per_key.sum()))
        c = np.add.reduceat(1 - (mark & 1), np.cumsum(per_key) - per_key)
        of_word = np.add.reduceat(c, np.cumsum(per_word) - per_word)
        rare = ids < 0
        for x, m in zip(names, of_word[rare].tolist(), strict=True):
            if m:
                self.counts[x] = self.counts.get(x, 0) + m
        self.parts.append((keys_[c > 0], c[c > 0]))
        pickle.dump((chunk, names, ids, of_w, keys_, times, at), self.rows, pickle.HIGHEST_PROTOCOL)
        self.n += 1

    def filter(self) -> LogBloom:
        keys, c = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(keys)
        keys, c = keys[order], c[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        return LogBloom(shard_filter(keys[first], np.add.reduceat(c, first) if len(c) else c))

    def found(self, freq: np.ndarray, total: float):
        """(chunk, documents' places, base, known, score) of each packed row."""
        if not self.n:
            return
        bloom = self.filter()
        self.rows.seek(0)
        for _ in range(self.n):
            chunk, names, ids, of_w, keys, times, at = pickle.load(self.rows)
            of_w, times = _large(of_w, len(ids)), _large(times, len(keys))
            got = bloom.counts(keys)
            c2 = np.where(got > 1, got / 1.5, got)  # the least count that the level stands for
            c = freq[np.maximum(ids, 0)].astype(np.int64)
            c[ids < 0] = [self.counts.get(x, 0) for x in names]
            c = np.repeat(c, of_w)
            p1 = (c + 0.1) / total
            places, doc = np.unique(_large(at, int(times.sum())) >> 1, return_inverse=True)
            yield chunk, places.astype(np.int32), *(np.bincount(doc, np.repeat(x, times)) for x in (np.log10(p1), c > 0, np.log10(c2 + MU * p1) - np.log10(c + MU)))
        self.rows.close()


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, frequent: int = FREQUENT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of all rows by a model of the rows whose fold is not 0; see the module. frequent and shard_tokens change no count, only where counting is done."""
    spark = df.sparkSession
    fold = crc_mod(id_col, folds)
    train = df.where(fold != 0).select(text_col)
    counts = stage_table(word_counts(train), "lm-words")
    n_docs = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = words + n_docs, distinct + (n_docs > 0)
    frequent = max(frequent, min(MOST_FREQUENT, 4 * n // shard_tokens))
    head = counts.where(F.col("c") * frequent >= n).collect()  # their counts sum to n at most, so there are `frequent` at most
    names, freq = [r["word"].encode() for r in head], np.array([0, n_docs, *(r["c"] for r in head)], np.int64)
    model = spark.sparkContext.broadcast((names, freq))
    shards = max(LEAST_SHARDS, -(-n // shard_tokens))
    total = n + 0.1 * (v + 1)
    arrow_ready(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    packed_type, found_type = PACKED.format(id_type), FOUND.format(id_type)
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    packed_schema, found_schema, out_schema = (to_arrow_schema(T.StructType.fromDDL(x)) for x in (packed_type, found_type, out))

    def pack(batches):
        of, k = word_ids(model.value[0]), TaskContext.get().partitionId() << 33
        for b in batches:
            for part in _chunks(b):
                rows = list(_packed(part, of, shards, k))
                k += 1
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=packed_schema)

    def probe(batches):
        freq_, now, own = model.value[1], None, _Shard()

        def rows():
            for k, at, base, known, score in own.found(freq_, total):
                yield pa.RecordBatch.from_pylist([{"chunk": k, "at": at.tobytes(), "base": base.tobytes(), "known": known.astype(np.int32).tobytes(), "score": score.tobytes()}], schema=found_schema)

        for b in batches:
            for r in b.to_pylist():
                if now != r["shard"]:
                    yield from rows()
                    now, own = r["shard"], _Shard()
                if r["docs"] is not None:
                    yield pa.RecordBatch.from_pylist([{"chunk": r["chunk"], "docs": r["docs"]}], schema=found_schema)
                else:
                    own.learn(*(r[x] for x in ("chunk", "words", "w", "of_w", "keys", "times", "at")))
        yield from rows()

    def add(batches):
        now, docs, parts = None, None, []

        def whole():
            at, base, known, score = (np.concatenate([np.frombuffer(p[j], t) for p in parts]) for j, t in enumerate((np.int32, np.float64, np.int32, np.float64)))
            sums = [np.bincount(at, x, len(docs)) for x in (known, base, score)]
            columns = [[d[k] for d in docs] for k in ("doc_id", "held_out", "n_tokens")]
            columns += [sums[0].astype(np.int64), sums[1], sums[2]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for b in batches:
            chunk_, docs_, *rest = (b.column(j) for j in range(b.num_columns))
            for i in range(b.num_rows):
                if now != (k := chunk_[i].as_py()):
                    if parts:
                        yield whole()
                    now, docs, parts = k, None, []
                if docs_[i].is_valid:
                    docs = docs_[i].as_py()
                else:
                    parts.append([x[i].as_py() for x in rest])
        if parts:
            yield whole()

    source = df.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), text_col)
    by_shard = source.mapInArrow(pack, packed_type).repartition(shards, "shard").sortWithinPartitions("shard")
    found = by_shard.mapInArrow(probe, found_type).repartition("chunk").sortWithinPartitions("chunk")
    sums = found.mapInArrow(add, out)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).alias("train_tokens"), "base_score", "score")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
