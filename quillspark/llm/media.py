"""Media columns: ISO base media containers written, walked and sampled without decoding.

A container holds one raw 8-bit audio track. Every sample is one unit of UNIT bytes, every
KEY_EVERY-th sample is listed in stss, samples lie in chunks of CHUNK samples. The reader walks
any nesting of boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables and the runs of
fragments of every track and gives codec, duration, the time that an edit list presents, and the byte
ranges of key samples; only read_payload touches the media data. The single columns are of the first
track with samples, `tracks` has all.

Defined results: a null text counts as empty; an empty text gives one unit of spaces; a container
that is cut short or has no usable track gives a null codec and the reason in `error`. Rows are
handled one by one, so repeated rows give repeated results and extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm.shared import map_rows

UNIT = 192
KEY_EVERY = 16
CHUNK = 64
TIMESCALE = 8000
KEYS = "array<struct<offset: long, length: long>>"
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 size and the payload: the text's bytes, then spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    units = max(1, -(-len(raw) // UNIT))
    return len(raw), raw.ljust(units * UNIT, b" ")


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _moov(samples: int, first_byte: int) -> bytes:
    ticks = samples * UNIT
    chunks = -(-samples // CHUNK)
    last = samples - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] if last == CHUNK else ([(1, CHUNK)] if chunks > 1 else []) + [(chunks, last)]
    offsets = first_byte + np.arange(chunks, dtype=np.int64) * CHUNK * UNIT
    wide = int(offsets[-1]) >= 1 << 32
    keys = np.arange(1, samples + 1, KEY_EVERY, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">HQHHHHI", 1, 0, 1, 8, 0, 0, TIMESCALE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, samples)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    return _box(
        b"moov",
        _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1),
        _box(b"trak", _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7), media),
    )


def write_container(payload: bytes) -> bytes:
    """An ISO media file whose media data is payload, whole units of it."""
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")
    samples = len(payload) // UNIT
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(_moov(samples, 0))
    first = len(brand) + size + head
    moov = _moov(samples, first)
    if len(moov) != size:  # the offsets have become wide
        first += len(moov) - size
        moov = _moov(samples, first)
    return b"".join((brand, moov, _box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Every box below start as (path, first body byte, end), depth first; raises ValueError where a box leaves its parent."""
    todo = [(start, len(data) if end is None else end, path)]
    while todo:
        at, stop, above = todo.pop()
        if at + 8 > stop:
            if at < stop:
                raise ValueError(f"{stop - at} stray bytes at {at}")
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > stop:
                raise ValueError(f"box at {at} is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = stop - at
        if size < body - at or at + size > stop:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        here = (*above, kind)
        yield here, body, at + size
        todo.append((at + size, stop, above))
        if kind in CONTAINERS:
            todo.append((body, at + size, here))


def _ints(data: bytes, at: int, count: int, kind: str, end: int) -> np.ndarray:
    if count < 0 or at + count * np.dtype(kind).itemsize > end:
        raise ValueError(f"table at {at} is cut short")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


_TABLES = {b"stts": 2, b"stsc": 3, b"stss": 1, b"stco": 1, b"co64": 1}


def _laid_out(track: dict, data: bytes) -> None:
    """Offset, size and duration of every sample of the track's own tables, and the key samples' numbers."""
    tables = track["tables"]
    if missing := {b"stts", b"stsc", b"stsz", b"offsets"} - tables.keys():
        raise ValueError(f"no {min(missing).decode()}")
    sizes, chunks, runs, times = tables[b"stsz"], tables[b"offsets"], tables[b"stsc"], tables[b"stts"]
    per_chunk = np.zeros(0, np.int64)
    if len(runs):
        if (np.diff(runs[:, 0], prepend=0, append=len(chunks) + 1) < 1).any():
            raise ValueError("runs of chunks are out of order")
        per_chunk = np.repeat(runs[:, 1], np.append(runs[1:, 0], len(chunks) + 1) - runs[:, 0])[: len(chunks)]
    if per_chunk.sum() != len(sizes) or times[:, 0].sum() != len(sizes):
        raise ValueError("sample tables disagree")
    first = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
    offsets = chunks[chunk_of] + before - before[first[chunk_of]] if len(sizes) else before
    sync = tables[b"stss"] - 1 if b"stss" in tables else np.arange(len(sizes))
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise ValueError("a key sample isn't there")
    track["parts"].insert(0, (offsets, sizes, int((times[:, 0] * times[:, 1]).sum()), sync))


def _fragment_run(data: bytes, at: int, end: int, of: dict) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """One run of a fragment: offsets, sizes, ticks, key samples; `of` holds the fragment's defaults and where the last run ended."""
    flags, count = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    start = of["behind"]
    if flags & 1:
        start = of["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    head = None
    if flags & 4:
        (head,) = struct.unpack_from(">I", data, at)
        at += 4
    given = [name for bit, name in ((0x100, "time"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    table = _ints(data, at, count * len(given), ">u4", end).reshape(count, len(given)) if given else None
    if not given and count > len(data):
        raise ValueError("a run has more samples than bytes")
    column = lambda name: table[:, given.index(name)] if name in given else np.full(count, of[name], np.int64)
    sizes, marks = column("size"), column("flags").copy()
    if head is not None and count:
        marks[0] = head
    offsets = start + np.cumsum(sizes) - sizes
    of["behind"] = int(start + sizes.sum())
    return offsets, sizes, int(column("time").sum()), np.flatnonzero((marks & 0x10000) == 0)


def tracks(data: bytes) -> list[dict]:
    """Every track: id, kind, codec, timescale, duration, `presented` (seconds by its edit list, or of all its samples), offset and size of
    every sample, `ticks` of all, and `sync`, the key samples' numbers from 0. Samples of fragments follow those of the track's own tables."""
    found: list[dict] = []
    defaults: dict[int, dict] = {}
    movie = moof = 0
    of: dict = {}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"id": 0, "kind": None, "codec": None, "timescale": 0, "duration": 0, "edits": None, "tables": {}, "parts": []})
        elif kind in (b"mvhd", b"mdhd"):
            wide = data[at] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
            if kind == b"mvhd":
                movie = scale
            elif found:
                found[-1] |= {"timescale": scale, "duration": length}
        elif kind == b"trex":
            number, _, time, size, flags = struct.unpack_from(">5I", data, at + 4)
            defaults[number] = {"time": time, "size": size, "flags": flags}
        elif kind == b"moof":
            moof = at - (8 if data[at - 4 : at] == kind else 16)
            of = {}
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", data, at)
            # without a base of its own a fragment counts from its moof, or goes on where the one before it ended
            base = of.get("behind", moof) if not flags & 0x20000 else moof
            at += 8
            if flags & 1:
                (base,) = struct.unpack_from(">Q", data, at)
                at += 8
            of = {"id": number, "base": base, "behind": base, "time": 0, "size": 0, "flags": 0} | defaults.get(number, {})
            for bit, name in ((0x2, "entry"), (0x8, "time"), (0x10, "size"), (0x20, "flags")):
                if flags & bit:
                    (of[name],) = struct.unpack_from(">I", data, at)
                    at += 4
        elif kind == b"trun":
            own = next((t for t in found if t["id"] == of.get("id")), None)
            if own is None:
                raise ValueError("a fragment of no track")
            own["parts"].append(_fragment_run(data, at, end, of))
        elif not found:
            continue
        elif kind == b"tkhd":
            (found[-1]["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
        elif kind == b"hdlr":
            found[-1]["kind"] = data[at + 8 : at + 12].decode("latin-1")
        elif kind == b"elst":
            (n,) = struct.unpack_from(">I", data, at + 4)
            width = 5 if data[at] == 1 else 3
            rows = _ints(data, at + 8, n * width, ">u4", end).reshape(n, width)
            found[-1]["edits"] = int((rows[:, 0] * (1 << 32) + rows[:, 1]).sum() if width == 5 else rows[:, 0].sum())
        elif kind == b"stsd":
            if end - at < 16:
                raise ValueError("no sample entry")
            found[-1]["codec"] = data[at + 12 : at + 16].decode("latin-1")
        elif kind in _TABLES:
            (n,) = struct.unpack_from(">I", data, at + 4)
            width = _TABLES[kind]
            got = _ints(data, at + 8, n * width, ">u8" if kind == b"co64" else ">u4", end)
            found[-1]["tables"][b"offsets" if kind in (b"stco", b"co64") else kind] = got.reshape(-1, width) if width > 1 else got
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", data, at + 4)
            if one * n > len(data):
                raise ValueError("samples lie beyond the end")
            found[-1]["tables"][kind] = np.full(n, one, np.int64) if one else _ints(data, at + 12, n, ">u4", end)
    for t in found:
        _laid_out(t, data)
        offsets, sizes, ticks, sync = zip(*t.pop("parts"), strict=True)
        starts = np.cumsum([0, *map(len, sizes)])
        t |= {"offsets": np.concatenate(offsets), "sizes": np.concatenate(sizes), "ticks": sum(ticks), "sync": np.concatenate([s + n for s, n in zip(sync, starts, strict=False)])}
        if len(t["sizes"]) and (t["offsets"].min() < 0 or (t["offsets"] + t["sizes"]).max() > len(data)):
            raise ValueError("samples lie beyond the end")
        t["duration"] = t["duration"] or t["ticks"]  # fragmented files leave it open
        t["presented"] = t["edits"] / movie if t["edits"] and movie else t["duration"] / t["timescale"] if t["timescale"] else None
        del t["tables"]
    return found


def sample_table(data: bytes) -> dict:
    """The first track with samples, as tracks() gives it."""
    return with_samples(tracks(data))


def with_samples(found: list[dict]) -> dict:
    for t in found:
        if len(t["sizes"]):
            return t
    raise ValueError("no track with samples")


def read_payload(data: bytes, table: dict) -> bytes:
    """The samples' bytes in order."""
    return b"".join(data[o : o + n] for o, n in zip(table["offsets"].tolist(), table["sizes"].tolist(), strict=True))


def key_ranges(table: dict) -> list[dict]:
    keys = table["sync"]
    return [{"offset": o, "length": n} for o, n in zip(table["offsets"][keys].tolist(), table["sizes"][keys].tolist(), strict=True)]


def feature(table: dict) -> str:
    keys = table["sync"]
    ranges = ",".join(f"{o}+{n}" for o, n in zip(table["offsets"][keys].tolist(), table["sizes"][keys].tolist(), strict=True))
    return f"codec={table['codec'].strip()};timescale={table['timescale']};duration={table['duration']};samples={len(table['sizes'])};keys={ranges}"


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the container of each text."""

    def make():
        def step(ids, texts):
            sizes, media = [], []
            for text in texts:
                n, payload = padded(text)
                sizes.append(n)
                media.append(write_container(payload))
            return ids, sizes, media

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), f"`{id_col}` {kind}, n_bytes long, media binary", make)


def probe_media(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Container facts of a binary column: codec, timescale, duration, samples, key sample byte ranges, and the payload's digests."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = (
        f"{kinds}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        f"codec string, timescale long, duration long, n_samples long, keyframes {KEYS}, error string, "
        f"tracks array<struct<id: long, kind: string, codec: string, timescale: long, duration: long, presented: double, n_samples: long, keyframes: {KEYS}>>"
    )

    def make():
        def step(*columns):
            rows = []
            for media in columns[-1]:
                media = media or b""
                own = (len(media), hashlib.sha256(media).hexdigest())
                try:
                    found = tracks(media)
                    t = with_samples(found)
                    payload = read_payload(media, t)
                except (ValueError, struct.error, IndexError, AttributeError) as e:
                    rows.append((None, None, None, *own, None, None, None, None, None, None, str(e), None))
                    continue
                facts = [{k: x[k] for k in ("id", "kind", "codec", "timescale", "duration", "presented")} | {"n_samples": len(x["sizes"]), "keyframes": key_ranges(x)} for x in found]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, feature(t), t["codec"], t["timescale"], t["duration"], len(t["sizes"]), key_ranges(t), None, facts))
            return [*columns[:-1], *(map(list, zip(*rows, strict=True)))]

        return step

    return map_rows(df.select(*keep, media_col), schema, make)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm.shared import read

    out = probe_media(encode_media(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_samples")
