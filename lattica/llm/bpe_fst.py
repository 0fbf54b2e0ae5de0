"""Byte-level BPE by a finite-state transducer that is determinised as texts need it, and streaming UTF-8 decoding.

The merges are compiled into a trie of the tokens and a relation between neighbours: tokens a, b may follow each other
if merging their joined bytes gives back exactly a, b. The encoding of a byte string is its only cut into tokens whose
neighbours may all follow each other, and each prefix has one too. The non-deterministic transducer guesses where tokens
begin: its live guesses are the trie's nodes that a suffix of the bytes so far leads to, so a deterministic state is named by
the deepest of them. A transition tells the next state and the tokens that may end there; it is made when first taken and kept.
Of these tokens one may follow what ends where it begins. What the encodings of all places where a live guess began
share is certain and is emitted, so lookahead is bounded.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, sliced
from .tokens import WordCache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_all(ranks: dict[bytes, int], data: bytes, least: int = 1) -> list[int]:
    """The encoding by its definition: merge the pair of lowest rank, the leftmost first, until none (or `least` parts) are left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


#: Bytes after which what is certain is emitted.
SPAN = 64


class Transducer:
    """encode(part) gives the ids of one part of the pattern. About `kept` transitions are kept, then the machine starts anew."""

    def __init__(self, ranks: dict[bytes, int], kept: int = 200_000):
        self.ranks, self.kept = ranks, kept
        #: The two tokens whose merge makes a token last; None for bytes, and for tokens that merging does not reach, which
        #: stand for themselves only as a whole part.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.down: dict[int, int] = {}  # by trie node (a multiple of 256) and byte: the next node
        self.ends: dict[int, tuple[int, int]] = {}  # likewise: the token that ends there, and its length
        self.depth = {0: 0}
        for data, i in ranks.items():
            halves = merge_all(ranks, data, 2) if len(data) > 1 else None
            self.halves[i] = tuple(halves) if halves and len(halves) == 2 and merge_all(ranks, data) == [i] else None
            at = 0
            for n, c in enumerate(data[:-1], 1):
                at = self.down.setdefault(at | c, (len(self.down) + 1) << 8)
                self.depth[at] = n
            if len(data) == 1 or self.halves[i]:
                self.ends[at | data[-1]] = i, len(data)
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.follows: dict[int, bool] = {}
        self.found: dict[tuple, tuple] = {}
        self._start()

    def _start(self) -> None:
        #: By state and byte: the next state, and token and length of all that may end there, the longest first.
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}
        #: By state: the nodes of its live guesses, the deepest (its name) first, the root last.
        self.live: dict[int, tuple[int, ...]] = {0: (0,)}

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Determinise a transition."""
        nodes = self.live[state]
        now = (*(self.down[n | byte] for n in nodes if n | byte in self.down), 0)
        ends = tuple(self.ends[n | byte] for n in nodes if n | byte in self.ends)
        if not ends:
            raise ValueError(f"byte {byte} has no token")
        self.live.setdefault(now[0], now)
        move = self.moves[state | byte] = now[0], self.found.setdefault(ends, ends)
        return move

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves a, b: undo the latest merge next to the border, again and again; a pair across
        the border that would have merged before that one did breaks the border."""
        left, right, token, halves, rank = a, b, self.token, self.halves, self.ranks.get
        bound = 1 << 40  # the pair across the border must not merge before the merge of this rank
        while True:
            joined = rank(token[left] + token[right])
            if joined is not None and joined < bound:
                known = False
                break
            x, y = halves[left], halves[right]
            if x and (left > right or not y):
                bound, left = left, x[1]
            elif y:  # on the right, an equal rank across the border comes first, as it lies further left
                bound, right = right + 1, y[0]
            else:
                known = True
                break
        if len(self.follows) > 500_000:
            self.follows.clear()
        self.follows[a << 32 | b] = known
        return known

    def _certain(self, state: int, last: list[int]) -> int:
        """The latest place that the encodings of all places where a live guess began go through."""
        places = {len(last) - 1 - self.depth[n] for n in self.live[state]}
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - self.size[last[latest]])
        return places.pop()

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens that end at `at`, from the first."""
        out, size = [], self.size
        while at:
            token = last[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.kept:
            self._start()
            self.found.clear()
        out: list[int] = []
        state, follows = 0, self.follows.get
        moves = self.moves
        last = [-1]  # by place after the last emitted token: the token that ends there; at the first, the emitted one
        for at in range(0, len(data), SPAN):
            i = len(last)
            part = data[at : at + SPAN]
            last += part
            for byte in part:
                try:
                    state, ends = moves[state | byte]
                except KeyError:
                    state, ends = self._move(state, byte)
                for token, size in ends:
                    before = last[i - size] if size <= i else -2
                    if before < 0:
                        if before == -1:  # all bytes so far are this token
                            break
                        continue
                    fits = follows(before << 32 | token)
                    if fits is None:
                        fits = self.may_follow(before, token)
                    if fits:
                        break
                else:
                    raise ValueError(f"byte {byte} has no token")
                last[i] = token
                i += 1
            if at + SPAN < len(data) and (place := self._certain(state, last)):
                out += self._back(last, place)
                del last[:place]
        return out + self._back(last, len(last) - 1)


class Encoder(WordCache):
    """The transducer's ids of texts, cut by the pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__(pattern)
        self.machine, self.matches = Transducer(read_ranks(path)), regex.compile(pattern).finditer

    def new_parts(self, parts: list[str]) -> list[bytes]:
        encode = self.machine.encode
        return [array("I", encode(x.encode("utf-8", "surrogatepass"))).tobytes() for x in parts]

    def whole(self, text: str) -> bytes:
        return b"".join(self.new_parts(m[0] for m in self.matches(text)))


#: The incremental UTF-8 machine's states: how many continuation bytes must follow, and the range of the next.
#: Rows: first byte's range, state after it; the ranges of second bytes rule out overlong forms and surrogates.
LEADS = (
    ((0x00, 0x7F), 0),
    ((0xC2, 0xDF), 1),
    ((0xE0, 0xE0), 4),
    ((0xE1, 0xEC), 2),
    ((0xED, 0xED), 5),
    ((0xEE, 0xEF), 2),
    ((0xF0, 0xF0), 6),
    ((0xF1, 0xF3), 3),
    ((0xF4, 0xF4), 7),
)
NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def _table() -> list[list[int]]:
    """Next state by state and byte; -1 where the byte breaks the sequence."""
    rows = [[-1] * 256 for _ in range(8)]
    for (low, high), state in LEADS:
        rows[0][low : high + 1] = [state] * (high - low + 1)
    for state, (low, high, then) in NEXT.items():
        rows[state][low : high + 1] = [then] * (high - low + 1)
    return rows


TABLE = _table()


class StreamDecoder:
    """Feed tokens in any slices; text comes out as soon as its characters are whole. Broken sequences become U+FFFD each.

    What a token does is kept by the bytes left before it: text, and the table for the bytes left after it.
    """

    def __init__(self, tokens: list[bytes], cached: int = 100_000):
        self.tokens, self.cached, self.count = tokens, cached, 0
        self.states: dict[bytes, dict] = {}
        self.state = self._state(b"")

    def _state(self, left: bytes) -> dict:
        """The table for these left bytes; they stand under -1."""
        return self.states.setdefault(left, {-1: left})

    def _step(self, left: bytes, token: int) -> tuple[str, bytes]:
        """Text and left bytes after a token: run the machine over left + token."""
        data, out, state, start = left + self.tokens[token], [], 0, 0
        i = 0
        while i < len(data):
            now = TABLE[state][data[i]]
            if now < 0:
                if state:  # the bytes so far are one broken sequence; this byte is looked at again
                    out.append("\ufffd")
                    start, state = i, 0
                    continue
                out.append("\ufffd")
                start = i + 1
            elif now == 0:
                out.append(data[start : i + 1].decode())
                start = i + 1
            state = max(now, 0)
            i += 1
        return "".join(out), data[start:]

    def feed(self, ids: list[int]) -> str:
        out, state = [], self.state
        for token in ids:
            try:
                text, state = state[token]
            except KeyError:
                if token < 0:
                    raise IndexError(f"no token {token}") from None
                left = state[-1]
                if self.count >= self.cached:
                    self.states, self.count = {}, 0
                    state = self._state(left)
                text, now = self._step(left, token)
                self.count += 1
                state[token] = text, self._state(now)
                state = state[token][1]
            out.append(text)
        self.state = state
        return "".join(out)

    def end(self) -> str:
        """What is left at the end: a broken sequence, if anything."""
        left, self.state = self.state[-1], self._state(b"")
        return "\ufffd" if left else ""


def _machines(path: str, pattern: str | None) -> tuple[Encoder | None, list[bytes]]:
    """The encoder, where a pattern is given, and the tokens' bytes by id."""

    def make() -> tuple[Encoder | None, list[bytes]]:
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for data, i in ranks.items():
            tokens[i] = data
        found = Encoder(path, pattern) if pattern is not None else None, tokens
        gc.freeze()  # the trie stays; the garbage collector need not walk it again and again
        return found

    return resident((Encoder, path, pattern), make)


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) for every row; null text counts as empty and has no ids. Equal rows all stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _machines(path, pattern)[0].encode_all
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(encode(part.column(1)))], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text: the ids decoded as a stream. Null ids give null text; an id outside the vocabulary fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(_machines(path, None)[1])
        for part in sliced(batches):
            column = part.column("ids")
            text = [decoder.feed(x.tolist()) + decoder.end() if x is not None else None for x in column.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode_ids(encode_texts(docs)) in one pass: doc_id, ids, and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = _machines(path, pattern)
        encode, decoder = encoder.encode_all, StreamDecoder(tokens)
        for part in sliced(batches):
            ids = encode(part.column(1))
            text = [decoder.feed(array("I", x).tolist()) + decoder.end() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")
