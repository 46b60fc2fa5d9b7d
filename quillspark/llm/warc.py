"""WARC archives: written as one gzip stream, normalised to one member per record, read by offset.

write_archives   pages to archives that are single gzip streams (what a careless crawler leaves)
normalise        inflates each stream once, in chunks, and rewrites every record as a gzip member of
                 its own, with a sidecar index of offsets; records whose payload another record
                 keeps become revisits
read_records     opens members by offset and length alone

Archives lie in a folder of the shared store and roll over at ROLL bytes of records. A file is written
under a temporary name and moved, and its name depends only on the partition, so a repeated task puts
the same file in the same place. Decisions on revisits are made on digests only: page bodies are
never shuffled.

Defined results: a null html is an empty payload; a null url is written as an empty target; among equal
payloads the largest page_id answers (a null id is the smallest; among equal ids the last written),
and the others revisit it; an empty table gives no archives and no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions.workers import importable
from quillspark.llm.shared import new_path, read, stage_table

#: Bytes of records, before compression, after which an archive is full.
ROLL = 64 << 20
CHUNK = 1 << 20
#: Over so many parts the rows of one digest are dealt when revisits are decided.
SALTS = 64
#: Tasks that normalise archives at most.
TASKS = 20_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "archive string, ordinal int, page_id long, payload_bytes long, payload_digest string"
INDEX = "archive string, ordinal int, page_id long, record_type string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str):
    """(file system, path) of a folder named by a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive}/{ordinal}')}>"


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))])
    return b"".join((b"WARC/1.1\r\n", head.encode(), b"\r\n", body, b"\r\n\r\n"))


def response(archive: str, ordinal: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(archive, ordinal)), ("WARC-Date", _DATE), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    return record(fields + ([] if page_id is None else [("X-Page-ID", str(page_id))]), _HTTP + payload)


def revisit(fields: dict[str, str], size: int, to_id: str, to_page: int | None) -> bytes:
    """A response turned into a revisit: no payload, but whose record has it."""
    kept = [(k, v) for k, v in fields.items() if k not in ("WARC-Type", "Content-Length")]
    kept += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", to_id), ("X-Payload-Length", str(size))]
    return record([("WARC-Type", "revisit"), *kept] + ([] if to_page is None else [("X-Refers-To-Page-ID", str(to_page))]), _HTTP)


class RecordReader:
    """Splits a stream of WARC bytes, fed in chunks, into (header fields, body, whole record)."""

    def __init__(self) -> None:
        self._held = bytearray()
        self._need = 0  # bytes without which another look is useless

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        self._held += data
        at = 0
        while len(self._held) - at >= max(self._need, 1):
            end = self._held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = bytes(self._held[at:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record where one should start: {lines[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            body = end + 4
            stop = body + int(fields["Content-Length"])
            if len(self._held) < stop + 4:
                self._need = stop + 4 - at
                break
            self._need = 0
            yield fields, bytes(self._held[body:stop]), bytes(self._held[at : stop + 4])
            at = stop + 4
        del self._held[:at]

    def close(self) -> None:
        if self._held:
            raise ValueError(f"{len(self._held)} bytes after the last whole record")


def inflate(source, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces of at most chunk bytes."""
    unzip = zlib.decompressobj(wbits=31)
    while data := source.read(chunk):
        while data:
            out = unzip.decompress(data, chunk)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data = unzip.unused_data
                unzip = zlib.decompressobj(wbits=31)
    while out := unzip.decompress(unzip.unconsumed_tail, chunk):
        yield out


class _File:
    """A file that appears under its name only when it is whole."""

    def __init__(self, fs, path: str) -> None:
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out, self.at = fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        from pyarrow import fs

        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:  # an earlier attempt at the task has put the same file here
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; returns their written manifest."""
    importable()
    schema = to_arrow_schema(T.StructType.fromDDL(MANIFEST))

    def run(batches):
        from pyspark import TaskContext

        fs, root = store(folder)
        fs.create_dir(f"{root}/mono", recursive=True)
        task, n, out, rows = TaskContext.get().partitionId(), 0, None, []

        def finish():
            out.write(zipped.flush())
            out.close()

        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, ordinal, size = f"{task:05d}-{n:05d}", 0, 0
                    out, zipped, n = _File(fs, f"{root}/mono/{name}.warc.gz"), zlib.compressobj(6, wbits=31), n + 1
                payload = (html or "").encode()
                data = response(name, ordinal, page_id, url, payload)
                out.write(zipped.compress(data))
                rows.append((name, ordinal, page_id, len(payload), digest(payload)))
                ordinal, size = ordinal + 1, size + len(data)
                if size >= roll:
                    finish()
                    out = None
            yield _batches(rows, schema)
            rows = []
        if out is not None:
            finish()

    kept = pages.select(F.col("page_id").cast("long"), "url", "html")
    return stage_table(kept.mapInArrow(run, MANIFEST), "warc-manifest")


def revisits(manifest: DataFrame) -> DataFrame:
    """(archive, ordinal, to_archive, to_ordinal, to_page) of records whose payload another record keeps."""
    key = ["payload_digest", "payload_bytes"]
    groups = manifest.groupBy(*key).agg(F.max(F.struct("page_id", "archive", "ordinal")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(*key, "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = manifest.withColumn("salt", F.pmod(F.hash("archive", "ordinal"), F.lit(SALTS)))
    others = dealt.join(groups, [*key, "salt"]).where("archive <> keep.archive or ordinal <> keep.ordinal")
    return others.select("archive", "ordinal", F.col("keep.archive").alias("to_archive"), F.col("keep.ordinal").alias("to_ordinal"), F.col("keep.page_id").alias("to_page"))


def normalise(folder: str, manifest: DataFrame) -> DataFrame:
    """Rewrite the archives of manifest in folder, member by member; returns the written offset index.

    One task handles an archive: it holds the archive's revisit decisions, as many as the archive
    has records at most, and a record at a time.
    """
    importable()
    names = manifest.groupBy("archive").agg(F.lit(-1).alias("ordinal")).select("archive", "ordinal", F.lit(None).cast("string").alias("to_archive"), F.lit(None).cast("int").alias("to_ordinal"), F.lit(None).cast("long").alias("to_page"))
    schema = to_arrow_schema(T.StructType.fromDDL(INDEX))

    def run(table: pa.Table) -> pa.Table:
        fs, root = store(folder)
        fs.create_dir(f"{root}/members", recursive=True)
        name = table.column("archive")[0].as_py()
        again = {o: (a, k, p) for o, a, k, p in zip(*(table.column(c).to_pylist() for c in ("ordinal", "to_archive", "to_ordinal", "to_page")), strict=True)}
        out, index, rows, ordinal, reader = _File(fs, f"{root}/members/{name}.warc.gz"), _File(fs, f"{root}/members/{name}.idx"), [], 0, RecordReader()
        with fs.open_input_stream(f"{root}/mono/{name}.warc.gz", compression=None) as source:
            for data in inflate(source):
                for fields, body, whole in reader.feed(data):
                    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
                    if to := again.get(ordinal):
                        whole = revisit(fields, len(body) - len(_HTTP), record_id(to[0], to[1]), to[2])
                    zipped = zlib.compressobj(6, wbits=31)
                    member = zipped.compress(whole) + zipped.flush()
                    rows.append((name, ordinal, page, "revisit" if to else "response", out.at, len(member)))
                    index.write((json.dumps({"offset": out.at, "length": len(member), "id": fields["WARC-Record-ID"], "type": rows[-1][3], "uri": fields["WARC-Target-URI"]}) + "\n").encode())
                    out.write(member)
                    ordinal += 1
        reader.close()
        out.close()
        index.close()
        return pa.Table.from_batches([_batches(rows, schema)])

    # the decisions are few bytes an archive, the archives are not: as many tasks as archives, which are not to be put together by size
    tasks = min(max(1, manifest.select("archive").distinct().count()), TASKS)
    decided = revisits(manifest).unionByName(names).repartition(tasks, "archive")
    return stage_table(decided.groupBy("archive").applyInArrow(run, INDEX), "warc-index")


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """One row per indexed record, read from its member alone; payloads are hashed anew and compared with the header."""
    importable()
    schema = to_arrow_schema(T.StructType.fromDDL(RECORDS))

    def run(batches):
        fs, root = store(folder)
        name, source = None, None
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{root}/members/{archive}.warc.gz")
                source.seek(offset)
                member = source.read(length)
                reader = RecordReader()
                ((fields, body, _),) = list(reader.feed(zlib.decompress(member, wbits=31)))
                reader.close()
                named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                to = fields.get("X-Refers-To-Page-ID")
                size = int(fields["X-Payload-Length"]) if fields["WARC-Type"] == "revisit" else len(body) - len(_HTTP)
                if fields["WARC-Type"] == "response" and (found := digest(body[len(_HTTP) :])) != named:
                    raise ValueError(f"{archive} at {offset}: digest {found}, the header has {named}")
                page = fields.get("X-Page-ID")
                rows.append((page and int(page), size, named, fields["WARC-Type"], to and int(to)))
            yield _batches(rows, schema)
        if source:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, RECORDS)


def members(data: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member: to test a sidecar index."""
    at = 0
    while at < len(data):
        unzip = zlib.decompressobj(wbits=31)
        unzip.decompress(data[at:])
        n = len(data) - at - len(unzip.unused_data)
        yield at, n
        at += n


def warc_round_trip(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    folder = folder or new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, roll)
    return read_records(folder, normalise(folder, manifest))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))
