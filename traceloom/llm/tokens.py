"""Encoding texts with a public byte-level BPE vocabulary through a lazily determinised finite-state transducer.

A list of tokens is the BPE encoding of its bytes exactly if every two neighbouring tokens encode, taken together, to themselves. So for
each prefix of a piece there is one last token, and the encoding of the whole is one of the chains that are still open: each open chain
ends in a token that has begun but may not have ended. A state of the transducer is the set of open chains, without what they have in
common; that common part is what a transition emits, after a lookahead no longer than the longest token. States and transitions
are made when first met and kept, up to a bound, so later texts only follow them. Decoding goes through a UTF-8 state machine that takes
tokens one at a time and gives out characters as they are complete.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pieces into which this vocabulary's texts are split before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of what a worker keeps: states of the transducer, encoded pieces, and characters of a piece that is kept.
STATES, KEPT, KEPT_CHARS = 400_000, 400_000, 64
#: Characters handled at a time.
BLOCK = 1 << 20


class Transducer:
    """The transducer of one vocabulary ``{bytes: id}``, ids in order of merging; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.next: list[dict[int, int]] = [{}]  # trie: node -> byte -> node
        self.ends: list[int] = [-1]  # trie: node -> token id
        for token, i in ranks.items():
            node = 0
            for b in token:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = to
            self.ends[node] = i
        self._fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets states and transitions."""
        self._of: dict[tuple, int] = {}
        self._chains: list[tuple] = []
        self._moves: list[dict[int, tuple[int, tuple]]] = []
        self._rest: list[tuple] = []
        self.start = self._state((-1, ((0, ()),)), ())

    def _state(self, chains: tuple, rest: tuple) -> int:
        s = self._of.get(chains)
        if s is None:
            s = self._of[chains] = len(self._chains)
            self._chains.append(chains)
            self._moves.append({})
            self._rest.append(rest)
        return s

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: the pair of lowest rank is merged, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens may stand side by side."""
        key = left << 32 | right
        ok = self._fits.get(key)
        if ok is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            ok = self._fits[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        before, chains = self._chains[state]
        alive: list[tuple[int, tuple]] = []
        ended: tuple | None = None
        for node, pending in chains:
            to = self.next[node].get(byte)
            if to is None:
                continue
            token = self.ends[to]
            if token >= 0 and ended is None:
                last = pending[-1] if pending else before
                if last < 0 or self.fits(last, token):
                    ended = (*pending, token)
            if self.next[to]:
                alive.append((to, pending))
        if ended is None:
            raise ValueError("a byte of the vocabulary is missing")
        alive.append((0, ended))
        common = 0
        least = min(len(p) for _, p in alive)
        while common < least and all(p[common] == ended[common] for _, p in alive):
            common += 1
        out = ended[:common]
        if common:
            before = ended[common - 1]
        rest = ended[common:]
        got = (self._state((before, tuple((n, p[common:]) for n, p in alive)), rest), out)
        self._moves[state][byte] = got
        return got

    def piece(self, data: bytes) -> tuple:
        """The ids of one piece."""
        if len(self._chains) > STATES:
            self.reset()
        state, out, moves = self.start, [], self._moves
        for b in data:
            got = moves[state].get(b)
            if got is None:
                if len(self._chains) > 4 * STATES:  # inside one very long piece: carry the state over
                    chains, rest = self._chains[state], self._rest[state]
                    self.reset()
                    moves, state = self._moves, self._state(chains, rest)
                got = self._move(state, b)
            state = got[0]
            if got[1]:
                out += got[1]
        return (*out, *self._rest[state])


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pieces: str = PIECES):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pieces)
        self.kept: dict[str, tuple] = {}

    def into(self, text: str, out: array) -> None:
        """Appends the ids of a text to ``out``. Texts are gone through piece by piece, whatever their length."""
        kept, piece = self.kept, self.transducer.piece
        words = self.split.findall(text) if len(text) <= BLOCK else (m.group() for m in self.split.finditer(text))
        for w in words:
            ids = kept.get(w)
            if ids is None:
                ids = piece(w.encode())
                if len(w) <= KEPT_CHARS:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[w] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.into(text, out)
        return out.tolist()


class Utf8Machine:
    """Turns byte strings that may end inside a character into text; bytes that are not UTF-8 give U+FFFD."""

    def __init__(self):
        self.wants, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.wants and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.wants:
                if self.low <= b <= self.high:
                    self.value, self.wants, self.low, self.high = self.value << 6 | b & 0x3F, self.wants - 1, 0x80, 0xBF
                    if not self.wants:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.wants, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.wants, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.wants, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.wants, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        cut, self.wants = self.wants > 0, 0
        return "�" if cut else ""


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """The text of a stream of ids, in parts as they are complete."""
    m = Utf8Machine()
    for i in ids:
        if got := m.feed(tokens[i]):
            yield got
    if got := m.end():
        yield got


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary; it keeps what it has learned from task to task. Where the machine has no such file, the one sent by ``_send`` is read."""
    if path not in _ENCODERS:
        here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        _ENCODERS[path] = Encoder(load_ranks(here))
    return _ENCODERS[path]


def _send(spark: SparkSession, path: str) -> None:
    """On a cluster the driver's vocabulary file goes to all workers, once."""
    sc = spark.sparkContext
    if not sc.master.startswith("local") and os.path.exists(path) and not any(os.path.basename(x) == os.path.basename(path) for x in sc.listFiles):
        sc.addFile(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: one row per row of ``docs`` with the ids of its text exactly as stored, without special tokens.

    Null and empty texts give an empty list; the strings of special tokens are ordinary text; a null key stays. No shuffle: a row's result
    depends on its text only. Other columns are not read.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    _send(docs.sparkSession, path)
    kept = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = StructType([StructField(key, kept.schema["_key"].dataType), StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            flat, ends, at = array("i"), array("i", [0]), 0
            for i in range(len(texts)):
                t = texts[i].as_py()
                if t:
                    enc.into(t, flat)
                ends.append(len(flat))
                if len(flat) > 2_000_000:
                    yield _lists(keys.slice(at, i + 1 - at), flat, ends, key)
                    flat, ends, at = array("i"), array("i", [0]), i + 1
            if at < len(texts):
                yield _lists(keys.slice(at), flat, ends, key)

    return kept.mapInArrow(run, schema)


def _lists(keys: pa.Array, flat: array, ends: array, key: str) -> pa.RecordBatch:
    ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
    return pa.RecordBatch.from_arrays([keys, ids], [key, "ids"])


def decoded(encoded: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """``(key, text)`` of rows ``(key, ids)``; a null list gives a null text."""
    _send(encoded.sparkSession, path)
    schema = encoded.select(F.col(key), F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).transducer.tokens
        for b in batches:
            texts = [None if x is None else "".join(decode(x, tokens)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, schema)
