"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder."""

from __future__ import annotations

import base64
import gc
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import fresh, kept, over_batches

#: Bytes of pieces with their ids that a worker remembers in each of two generations; what an
#: entry takes besides its piece and ids; and states it keeps.
REMEMBERED = 24 << 20
ENTRY = 160
STATES = 1 << 15
#: Pairs of tokens whose border is remembered; an entry takes some 80 bytes.
PAIRS = 1 << 18
MADE_AT = 6
#: Texts longer than this are matched piece by piece instead of into one list.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(data: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Plain merging: join the neighbours of least rank, leftmost first, until `least` are left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
        if rank == 1 << 31:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State:
    """What the output of the bytes so far may still depend on.

    `root` is the last token that is certain, `tail` the bytes after it, and `sizes[k]` the
    size of the last token of the encoding of tail[:k] (0 where none passes through the root).
    `live` has the places from which the tail may still grow into a token.
    """

    __slots__ = ("root", "tail", "sizes", "live", "arcs")

    def __init__(self, root: bytes | None, tail: bytes, sizes: tuple, live: tuple):
        self.root, self.tail, self.sizes, self.live, self.arcs = root, tail, sizes, live, {}


class Transducer:
    """Bytes in, token ids out, after a lookahead bounded by the longest token.

    A token sequence is the BPE encoding of its bytes if and only if merging any two
    neighbours' bytes gives those two tokens again. So the encoding of each prefix is
    one more token behind the encoding of a shorter prefix, and which one follows from
    neighbours alone. A prefix matters only while the bytes after it may still grow into a
    token; what all of these prefixes share is emitted. A state is what is left: its last
    certain token and the bytes since. An arc and its state are made when they are asked for
    the MADE_AT-th time; before, the rest of the piece is only simulated, so that what is rare
    (most of the different pieces of a large corpus) leaves no state behind.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: Bit 0: a token, bit 1: what a longer token begins with; above them the token's rank.
        self.kind = dict.fromkeys((t[:k] for t in ranks for k in range(1, len(t))), 2)
        for token, rank in ranks.items():
            self.kind[token] = self.kind.get(token, 0) + 1 + 4 * rank
        self.span = max(ranks.values(), default=0) + 1
        self.bytes = [bytes((b,)) for b in range(256)]
        #: By the ranks of two neighbours: left * span + right, -1 for no left one.
        self.fits: dict[int, bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.states: dict[tuple[bytes | None, bytes], State] = {}
        self.emptied = False
        self.begin = State(None, b"", (0,), ())

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge into `token`; None for a byte.

        A token that merging its bytes doesn't give has two empty parts.
        """
        if token not in self.halves:
            parts = merged(token, self.ranks, 2)
            whole = len(parts) < 2 or len(merged(token, self.ranks)) == 1
            self.halves[token] = None if len(parts) < 2 else tuple(parts) if whole else (b"", b"")
        return self.halves[token]

    def _fit(self, left: bytes | None, right: bytes) -> bool:
        pair = (-1 if left is None else self.ranks[left]) * self.span + self.ranks[right]
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._stays(left, right)
        return known

    def _stays(self, left: bytes | None, right: bytes) -> bool:
        """Whether the border between two tokens outlives the merging of their bytes.

        Going back from the whole tokens, the merge of higher rank was the later one. At each
        moment the two parts at the border must not be the next to merge.
        """
        if self._halves(right) == (b"", b""):
            return False
        if left is None:
            return True
        ranks, never = self.ranks, 1 << 31
        until_left = until_right = never
        while True:
            across = ranks.get(left + right, never)
            if across < until_left and across <= until_right and across < never:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and ranks[left] > ranks[right]):
                if ranks[left] > until_left:
                    return merged(left + right, ranks) == [left, right]
                until_left, left = ranks[left], a[1]
            else:
                if ranks[right] > until_right:
                    return merged(left + right, ranks) == [left, right]
                until_right, right = ranks[right], b[0]

    def _arc(self, state: State, byte: int) -> tuple[list[int], State]:
        tail = state.tail + self.bytes[byte]
        end, sizes, root, kind = len(tail), state.sizes, state.root, self.kind
        size, live = 0, []
        for k in (*state.live, end - 1):
            found = kind.get(tail[k:])
            if found is None:
                continue
            if found & 1 and not size and self._fit(tail[k - sizes[k] : k] if k else root, tail[k:]):
                size = end - k
            if found & 2:
                live.append(k)
        if not size:
            raise ValueError(f"no token ends after {tail!r}: the vocabulary lacks a byte")
        if not live:
            out = [self.ranks[t] for t in self._back(tail, sizes, 0, end - size)]
            out.append(self.ranks[tail[end - size :]])
            return out, self._known(tail[end - size :], b"", (0,), ())
        sizes = (*sizes, size)
        cut = min(live)
        path, k = {0}, end
        while k:
            path.add(k)
            k -= sizes[k]
        for k in live:
            while k not in path:
                k -= sizes[k]
            cut = min(cut, k)
        if not cut:
            return [], self._known(root, tail, sizes, tuple(live))
        shared = self._back(tail, sizes, 0, cut)
        through = [0]
        for k in range(cut + 1, end + 1):
            at = k - sizes[k] - cut
            through.append(sizes[k] if sizes[k] and at >= 0 and (at == 0 or through[at]) else 0)
        # A place that is not passed through from the new root starts no further token.
        moved = tuple(k - cut for k in live if k == cut or through[k - cut])
        out = [self.ranks[t] for t in shared]
        return out, self._known(shared[-1], tail[cut:], tuple(through), moved)

    def _known(self, root: bytes | None, tail: bytes, sizes: tuple, live: tuple) -> State:
        known = self.states.get((root, tail))
        if known is None:
            if len(self.states) >= STATES:
                self.states.clear()
                self.emptied = True
                self.begin = State(None, b"", (0,), ())
            known = self.states[root, tail] = State(root, tail, sizes, live)
        return known

    @staticmethod
    def _back(tail: bytes, sizes: tuple, begin: int, at: int) -> list[bytes]:
        """The tokens between two places that one encoding passes through."""
        out = []
        while at > begin:
            out.append(tail[at - sizes[at] : at])
            at -= sizes[at]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.begin
        for at, byte in enumerate(piece):
            arc = state.arcs.get(byte, 1)
            if arc.__class__ is int:
                if arc < MADE_AT:
                    state.arcs[byte] = arc + 1
                    return out + self._simulated(state, piece[at:])
                arc = state.arcs[byte] = self._arc(state, byte)
            if arc[0]:
                out += arc[0]
            state = arc[1]
        return out + [self.ranks[t] for t in self._back(state.tail, state.sizes, 0, len(state.tail))]

    def _simulated(self, state: State, rest: bytes) -> list[int]:
        """The output of what follows `state`, found without making states or arcs."""
        tail, sizes, live = state.tail + rest, list(state.sizes), state.live
        kind, fits, root, span = self.kind.get, self.fits.get, state.root, self.span
        # last[k]: rank of the last token of the encoding of tail[:k], times span.
        last = [(-1 if root is None else self.ranks[root]) * span]
        last += [self.ranks[tail[k - sizes[k] : k]] * span if sizes[k] else 0 for k in range(1, len(sizes))]
        for end in range(len(sizes), len(tail) + 1):
            size, now = 0, []
            for k in (*live, end - 1):
                found = kind(tail[k:end])
                if found is None:
                    continue
                if found & 1 and not size:
                    fit = fits(last[k] + (found >> 2))
                    if fit or (fit is None and self._fit(tail[k - sizes[k] : k] if k else root, tail[k:end])):
                        size, token = end - k, found >> 2
                if found & 2:
                    now.append(k)
            if not size:
                raise ValueError(f"no token ends after {tail[:end]!r}: the vocabulary lacks a byte")
            sizes.append(size)
            last.append(token * span)
            live = now
        out, at = [], len(tail)
        while at:
            out.append(last[at] // span)
            at -= sizes[at]
        return out[::-1]


class Encoder:
    """Splits texts by a pattern and encodes each match; repeated pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = REMEMBERED):
        # States are many small objects that stay; looking for cycles among them often is wasted.
        gc.set_threshold(200_000, 20, 100)
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memory, self.held = memory, 0

    def _packed(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if self.transducer.emptied:
                # The old states point at each other; only the collector frees them.
                self.transducer.emptied = False
                gc.collect()
        self.held += ENTRY + len(piece) + len(packed)
        if self.held > self.memory:
            self.known, self.older, self.held = {}, self.known, 0
        self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG_TEXT:
            return self._joined(self.pattern.findall(text))
        matches = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: self._joined(islice(matches, 1 << 16)), b""))

    def _joined(self, pieces: Iterable[str]) -> bytes:
        known, packed = self.known.get, self._packed
        return b"".join([known(p) or packed(p) for p in pieces])


#: Well-formed UTF-8: first byte's range, then the range of the second byte and how many follow.
LEADS = [
    (0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2), (0xEE, 0xEF, 0x80, 0xBF, 2), (0xF0, 0xF0, 0x90, 0xBF, 3),
    (0xF1, 0xF3, 0x80, 0xBF, 3), (0xF4, 0xF4, 0x80, 0x8F, 3),
]


class Utf8Machine:
    """Takes bytes in any cuts and gives whole characters as soon as they are complete.

    The state is the range that the next byte must be in and how many bytes follow it; a byte
    that does not fit gives U+FFFD for what was begun and is then looked at anew.
    """

    def __init__(self):
        self.lead = {b: (lo, hi, n) for a, z, lo, hi, n in LEADS for b in range(a, z + 1)}
        self.state: tuple[int, int, int] | None = None
        self.begun = b""

    def feed(self, data: bytes) -> str:
        if self.state is None and (whole := self._whole(data)) is not None:
            return whole
        out = []
        for byte in data:
            if self.state is not None:
                lo, hi, left = self.state
                if lo <= byte <= hi:
                    self.begun += bytes((byte,))
                    self.state = (0x80, 0xBF, left - 1) if left > 1 else None
                    if self.state is None:
                        out.append(self.begun.decode())
                        self.begun = b""
                    continue
                out.append("�")
                self.state, self.begun = None, b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                self.state, self.begun = self.lead[byte], bytes((byte,))
            else:
                out.append("�")
        return "".join(out)

    @staticmethod
    def _whole(data: bytes) -> str | None:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    def finish(self) -> str:
        rest, self.state, self.begun = self.begun, None, b""
        return "�" if rest else ""


class Decoder:
    """Ids to text in stretches; characters cut by a token border wait for their other bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def pieces(self, packed: bytes, stretch: int = 1 << 14) -> Iterator[str]:
        """Text of each `stretch` of ids. Ids outside the vocabulary stand for nothing."""
        machine, tokens, size = Utf8Machine(), self.tokens, len(self.tokens)
        ids = np.frombuffer(packed, "<u4")
        for k in range(0, len(ids), stretch):
            part = ids[k : k + stretch]
            yield machine.feed(b"".join([tokens[i] for i in part[part < size].tolist()]))
        yield machine.finish()


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", decoded: bool = False,
    keep_text: bool = True, memory: int = REMEMBERED,
) -> DataFrame:
    """`docs` with the columns ids (binary, little-endian unsigned 32-bit) and n_tokens.

    With `decoded` also with the text that decoding the ids gives, in the same pass: that takes
    one Python worker a core instead of two.

    Each match of `pattern` in a whole text is encoded separately, without special tokens; a
    match that is itself a token stays whole. Null and empty texts give no ids. All other
    columns are kept (the text itself only with `keep_text`); a column that is called ids or
    n_tokens is replaced. A worker remembers pieces of up to twice `memory` bytes; ids don't depend on it. The vocabulary is broadcast (its size does not depend on the data); rows need no shuffle.
    """
    adds = {"ids": "binary", "n_tokens": "long"} | ({"decoded": "string"} if decoded else {})
    return _mapped(docs, ranks, text_col, adds, _encoder(pattern, decoded, memory), () if keep_text else (text_col,))


def _encoder(pattern: str, decoded: bool, memory: int):
    def work(ranks, key, texts):
        encoder = kept("encoder", (pattern, memory, key), lambda: Encoder(ranks(), pattern, memory))
        packed = [encoder.encode(t or "") for t in texts]
        made = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
        return made + (_decoded(ranks, key, packed) if decoded else [])

    return work


def decode(docs: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """`docs` with the column decoded: the text of the ids (null ids: empty)."""

    return _mapped(docs, ranks, ids_col, {"decoded": "string"}, _decoded)


def _decoded(ranks, key, packed) -> list[pa.Array]:
    decoder = kept("decoder", key, lambda: Decoder(ranks()))
    return [pa.array(["".join(decoder.pieces(p or b"")) for p in packed], pa.string())]


def _mapped(
    docs: DataFrame, ranks: dict[bytes, int], column: str, adds: dict[str, str], work, drops: tuple[str, ...] = ()
) -> DataFrame:
    names = [c for c in docs.columns if c not in adds and c not in drops]
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    vocabulary = (len(ranks), zlib.crc32(b"\n".join(ranks)), sum(ranks.values()))
    # Whole texts are large: one that is kept anyway is sent once.
    given = column if column in names else fresh(docs, "given")[0]
    read = [] if given == column else [F.col(f"`{column}`").alias(given)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *read)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
        + [f"{n} {t}" for n, t in adds.items()]
    )

    def batch_work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(batch.schema.get_field_index(given)).to_pylist()
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        made = work(lambda: sent.value, vocabulary, values)
        return pa.RecordBatch.from_arrays([*columns, *made], [*names, *adds])

    return over_batches(rows, batch_work, schema, ("encoder", "decoder"))
