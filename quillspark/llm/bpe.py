"""Byte-level BPE by a lazily determinised finite-state transducer.

Encoding. A place in the text is live while what was read since begins some token. A state is the live
places, with the last token of the encoding up to each. Reading a byte gives the last token up to there:
the one token ending there that is compatible with the last token before its start (two tokens are
compatible if BPE leaves their concatenation as these two). Once no place is live, or as far as the
encodings up to all live places agree, tokens are settled; in a long piece they are emitted every 128 bytes.
A place lives no longer than the longest token, which bounds the lookahead. States and transitions are made when they are first taken.

Decoding. Bytes of the ids pass through an incremental UTF-8 state machine, which gives out whole
characters and holds at most three bytes.

Defined results: null and empty texts give no ids (n_tokens 0, digests of nothing); every text gives
one row; equal texts give equal rows; special tokens' strings are ordinary text; other columns are not
looked at. Ids not in the vocabulary raise KeyError. Bytes that are not UTF-8 raise UnicodeDecodeError.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from itertools import accumulate
from operator import getitem

import numpy as np
from pyspark.sql import DataFrame

from quillspark.llm.shared import kept, map_rows, read

#: Pieces and states that a worker remembers, some 550 MB as measured on 139 million characters when states were larger; beyond, it starts to remember anew. Results don't depend on it.
PIECES = 600_000
STATES = 150_000
CHUNK_IDS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Node(dict):
    """A beginning of tokens: what it becomes by a further byte, its length, and the token that it is itself, if it is one."""

    __slots__ = ("depth", "token")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.token: bytes | None = None

    __hash__, __eq__ = object.__hash__, object.__eq__


class _Before(dict):
    """A token (or nothing) as the last of an encoding: by token, whether BPE leaves the two as these two and that one as itself; found when first asked for."""

    __slots__ = ("owner", "parts")

    def __init__(self, owner: Transducer, token: bytes) -> None:
        self.owner = owner
        self.parts = owner.spine(token, 1) if token else None

    __hash__, __eq__ = object.__hash__, object.__eq__

    def __missing__(self, token: bytes) -> bool:
        parts = self.owner.lefts[token]
        self.owner.pairs += 1
        known = self[token] = bool(parts) and (self.parts is None or self.owner.never_joined(self.parts, parts))
        return known


class _Lefts(dict):
    """By token, its parts at the left; none if joins don't make it."""

    def __init__(self, owner: Transducer) -> None:
        self.owner = owner

    def __missing__(self, token: bytes) -> tuple:
        parts = self[token] = self.owner.spine(token, 0) if len(token) == 1 or self.owner.halves(token) else ()
        return parts


class _Places(dict):
    """By token, the place after it, where nothing was read yet."""

    def __init__(self, owner: Transducer) -> None:
        self.owner = owner

    def __missing__(self, token: bytes) -> tuple[_Node, _Before]:
        place = self[token] = (self.owner.root, _Before(self.owner, token))
        return place


class _State(dict):
    """Next states by byte, made when first asked for.

    places: the live places, the longest first, each as what was read since and the last token before it; token: the last one up to here.
    """

    __slots__ = ("owner", "places", "token")

    def __init__(self, owner: Transducer, places: tuple, token: bytes) -> None:
        self.owner, self.places, self.token = owner, places, token

    def __missing__(self, byte: int) -> _State:
        live, token, own = [], None, self.owner
        for node, before in self.places:
            if (to := node.get(byte)) is not None:
                if token is None and (whole := to.token) is not None and before[whole]:
                    token = whole
                if to:
                    live.append((to, before))
        if token is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        live.append(own.places[token])
        name = tuple(live)
        if (got := own.names.get(name)) is None:
            got = own.names[name] = _State(own, name, token)
        self[byte] = got
        return got


class Transducer:
    """Encodes byte strings by BPE ranks, one byte at a time."""

    #: Bytes from one look at what is settled to the next.
    HELD = 128

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.root = _Node(0)
        for token in ranks:
            node = self.root
            for byte in token:
                if (to := node.get(byte)) is None:
                    to = node[byte] = _Node(node.depth + 1)
                node = to
            node.token = token  # everything holds this one object of a token
        self._parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.lefts = _Lefts(self)
        self.names: dict[tuple, _State] = {}
        self.pairs, self.places = 0, _Places(self)
        self._reset()

    def _reset(self) -> None:
        for state in self.names.values():
            state.clear()  # states lead back to each other; without this they would stay
        self.names = {}
        if self.pairs > 2 * STATES:
            self.pairs, self.places = 0, _Places(self)
        place = self.places[b""]
        self._begin = self.names[(place,)] = _State(self, (place,), b"")

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """BPE by its definition: join the pair of lowest rank, leftmost first, until none or `until` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose join makes a token; None if joins don't make it."""
        if token not in self._parts:
            parts = self.merge(token, 2)
            self._parts[token] = tuple(parts) if len(parts) == 2 else None
        return self._parts[token]

    def spine(self, token: bytes, side: int) -> tuple[tuple[bytes, int], ...]:
        """A token, its half on a side, that one's and so on to a byte, each with its rank (a byte: -1)."""
        out = []
        while len(token) > 1:
            out.append((token, self.ranks[token]))
            token = self.halves(token)[side]
        return *out, (token, -1)

    def never_joined(self, left: tuple, right: tuple) -> bool:
        """Joins are undone from the last; at no moment may the two that meet have had an earlier join of their own."""
        rank, limit = self.ranks.get, 1 << 40
        lefts, rights = iter(left), iter(right)
        (a, at_a), (b, at_b) = next(lefts), next(rights)
        while True:
            if rank(a + b, limit) < limit:
                return False
            if at_a > at_b:  # of equal joins the left one comes first, so the right one is undone first
                limit = at_a
                a, at_a = next(lefts)
            elif at_b >= 0:
                limit = at_b + 1
                b, at_b = next(rights)
            else:
                return True

    def _shared(self, states: list[_State]) -> int:
        """Up to where the encodings up to all live places agree."""
        at = len(states) - 1
        open_ = {at - node.depth for node, _ in states[at].places}
        while len(open_) > 1:
            far = max(open_)
            open_.remove(far)
            open_.add(far - len(states[far].token))
        return open_.pop()

    def encode(self, data: bytes) -> list[bytes]:
        if data in self.ranks:
            return [data]
        if len(self.names) > STATES:
            self._reset()
        if len(data) <= self.HELD:
            return self._trace([*accumulate(data, getitem, initial=self._begin)])
        out: list[bytes] = []
        states = [self._begin]  # the one after what is settled, and one for each byte since
        for at in range(0, len(data), self.HELD):
            states += accumulate(data[at : at + self.HELD], getitem, initial=states.pop())
            shared = self._shared(states)
            out += self._trace(states[: shared + 1])
            del states[:shared]
            if len(self.names) > STATES:
                self._reset()
        return out + self._trace(states)

    @staticmethod
    def _trace(states: list[_State]) -> list[bytes]:
        """The tokens that led from the first of these states to the last."""
        out, at = [], len(states) - 1
        while at:
            token = states[at].token
            out.append(token)
            at -= len(token)
        out.reverse()
        return out


class Utf8Machine:
    """Incremental UTF-8 decoder: a table of states over byte classes finds where the last whole character ends."""

    #: Bytes still to come after a lead byte; 0 for ASCII, -1 for a continuation byte.
    LEAD = [0] * 0x80 + [-1] * 0x40 + [1] * 0x20 + [2] * 0x10 + [3] * 0x10

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        """Characters that are whole by now; the bytes of one that isn't are held."""
        data = self.held + data
        end = len(data)
        for back in range(1, min(4, end) + 1):
            need = self.LEAD[data[-back]]
            if need >= 0:
                if need >= back:
                    end -= back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8")

    def close(self) -> None:
        if self.held:
            self.held.decode("utf-8")  # raises


class _Pieces(dict):
    """Ids of pieces as decimal text, made when first asked for."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer
        self.name = {t: str(i) for t, i in transducer.ranks.items()}.__getitem__

    def __missing__(self, piece: str) -> str:
        if len(self) > PIECES:
            self.clear()
        ids = self[piece] = " ".join(map(self.name, self.transducer.encode(piece.encode())))
        return ids


#: The public pattern, and its equal for texts up to U+024F without number signs other than digits and without controls that the two engines see differently.
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN = rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search


class Tokenizer:
    """Splits text by a pattern and encodes each match by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.transducer = Transducer(ranks)
        self._general = regex.compile(pattern).findall
        self._latin = re.compile(LATIN).findall if pattern == GENERAL else None
        self.pieces = _Pieces(self.transducer)
        self._all = np.frombuffer(b"".join(ranks), np.uint8)
        size = np.array([*map(len, ranks)])
        #: by id, a token's length and its place in _all; 0 where no token has the id
        self._size, self._at = np.zeros((2, max(ranks.values()) + 1), np.int64)
        for of, value in ((self._size, size), (self._at, np.cumsum(size) - size)):
            of[[*ranks.values()]] = value

    def find(self, text: str) -> list[str]:
        return self._latin(text) if self._latin and not _NOT_LATIN(text) else self._general(text)

    def encode(self, text: str) -> str:
        """Ids as decimal text, joined by spaces."""
        return " ".join(map(self.pieces.__getitem__, self.find(text)))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes; KeyError if an id is none's."""
        known = (ids >= 0) & (ids < len(self._size))
        size = np.where(known, self._size[np.where(known, ids, 0)], 0)
        if not size.all():
            raise KeyError(int(ids[size == 0][0]))
        before = np.cumsum(size) - size
        return self._all[np.repeat(self._at[ids] - before, size) + np.arange(size.sum())].tobytes()

    def decode(self, ids: list[str] | np.ndarray):
        """The text's characters, in pieces, by way of the UTF-8 machine. ids: numbers, or their decimal text."""
        machine, ids = Utf8Machine(), np.asarray(ids, np.int64)
        for at in range(0, len(ids), CHUNK_IDS):
            yield machine.feed(self.bytes_of(ids[at : at + CHUNK_IDS]))
        machine.close()


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """This process's tokenizer of a file; what it has learnt of pieces and states serves all tasks."""

    def make() -> Tokenizer:
        gc.set_threshold(200_000, 50, 1000)  # states and pieces live long, and states are taken apart when they go: looking through them often is vain
        return Tokenizer(load_ranks(path), pattern)

    return kept(("bpe", path, pattern), make)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256; with_ids adds token_ids, little-endian 32-bit numbers."""
    if path is None or pattern is None:
        path, pattern = vocabulary()

    def make():
        own = tokenizer(path, pattern)

        def step(*columns):
            counts, hashes, decoded, packed = [], [], [], []
            for text in columns[-1]:
                listed = own.encode(text or "")
                ids = np.fromstring(listed, np.int64, sep=" ") if listed else np.zeros(0, np.int64)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(listed.encode()).hexdigest())
                sha = hashlib.sha256()
                for part in own.decode(ids):
                    sha.update(part.encode())
                decoded.append(sha.hexdigest())
                if with_ids:
                    packed.append(ids.astype("<u4").tobytes())
            return [*columns[:-1], counts, hashes, decoded, *([packed] if with_ids else [])]

        return step

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids
    return map_rows(df.select(*keep, text_col), schema, make)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
