"""SentencePiece encoding and decoding in batched numpy.

Words (a run of space marks and what follows it) of equal length advance together. Hashes of all
their substrings probe the sorted keys of the pieces once. For a unigram model a Viterbi pass then
keeps vectorised maxima and backpointers. A BPE model defines its result by the order of merges, of
which the best path by scores is no copy; for it the same table of substrings feeds lockstep merges:
in each round every word joins its best adjacent pair, ties to the left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.llm.memo import Memo, claim, words_held

_SPACE = "▁"
_BASE = np.uint64(0x100000001B3)
_UNIGRAM, _BPE = 1, 2
#: Kinds of pieces that cut texts before any other piece, and that stand for nothing.
_USER_DEFINED, _UNUSED = 4, 5
#: Fixed value: an unknown character of a unigram model scores this much below the worst piece.
_UNKNOWN_PENALTY = 10.0
#: Bytes that a word takes in a worker's memory.
WORD_BYTES = 450
#: Bytes of words that a worker keeps, where its container has room for them.
HELD = 400_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and varint or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def model_type(serialized: bytes) -> int:
    """1 unigram, 2 BPE, as the trainer part of a serialized model says (1 where it says nothing)."""
    for number, value in _fields(serialized):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), _UNIGRAM)
    return _UNIGRAM


def piece_kinds(serialized: bytes) -> set[int]:
    """Kinds of the pieces of a serialized model (1 where a piece says nothing)."""
    return {next((v for n, v in _fields(value) if n == 3), 1) for number, value in _fields(serialized) if number == 1}


class Codec:
    """Encoder and decoder of one model, which has no user-defined and no unused pieces."""

    def __init__(self, model: str | bytes, held: int = 200_000):
        if isinstance(model, str):
            with open(model, "rb") as file:
                model = file.read()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kind = model_type(model)
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are encoded")
        if piece_kinds(model) & {_USER_DEFINED, _UNUSED}:
            raise ValueError("models with user-defined or unused pieces are not encoded")
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.scores = np.array([lib.get_score(i) for i in range(size)], np.float32)
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.own = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.unknown = lib.unk_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.longest = max(map(len, self.own), default=1)
        self.least = float(min((self.scores[i] for i in self.own.values()), default=0.0)) - _UNKNOWN_PENALTY
        # Keys of all beginnings of pieces; those that are no piece themselves have the id -1.
        beginnings = {p[:k] for p in self.own for k in range(1, len(p) + 1)}
        keys = np.array([self._hash(p) for p in beginnings], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([self.own.get(p, -1) for p in beginnings], np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two beginnings of pieces have one hash")
        self.letters = np.zeros((size, self.longest), np.uint64)
        for piece, i in self.own.items():
            self.letters[i, : len(piece)] = [ord(c) for c in piece]
        # Words are independent where no piece holds a space mark after another character.
        self.separable = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.own)
        self.memo = Memo(held)
        blobs = [self._bytes_of(i) for i in range(size)]
        self.lengths = np.array([len(b) for b in blobs])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        value = 1
        for c in piece:
            value = ((value ^ ord(c)) * int(_BASE) + (value >> 29)) & (2**64 - 1)
        return value

    def _bytes_of(self, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.library.is_control(i):
            return b""
        return " ⁇ ".encode() if i == self.unknown else self.pieces[i].replace(_SPACE, " ").encode()

    def _table(self, codes: np.ndarray) -> np.ndarray:
        """Piece id of each substring: ``[word, start, length - 1]``, -1 where there is none."""
        words, length = codes.shape
        most = min(self.longest, length)
        out = np.full((words, length, most), -1, np.int64)
        # Substrings grow by a character at a time while they begin some piece.
        word, start = (x.ravel() for x in np.indices((words, length)))
        value = np.ones(len(word), np.uint64)
        for size in range(1, most + 1):
            value = (value ^ codes[word, start + size - 1]) * _BASE + (value >> np.uint64(29))
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            alive = self.keys[at] == value
            word, start, value, ids = word[alive], start[alive], value[alive], self.ids[at[alive]]
            # Other substrings of equal hash are told apart by the piece itself.
            hit = np.flatnonzero(ids >= 0)
            w, s, ids = word[hit], start[hit], ids[hit]
            same = (self.letters[ids, :size] == codes[w[:, None], s[:, None] + np.arange(size)]).all(1)
            out[w[same], s[same], size - 1] = ids[same]
            more = start + size < length
            word, start, value = word[more], start[more], value[more]
        return out

    def _viterbi(self, table: np.ndarray) -> np.ndarray:
        """Length of the piece that starts at each place of the best path, 0 elsewhere."""
        words, length, most = table.shape
        score = np.where(table >= 0, self.scores[table], -np.inf).astype(np.float64)
        score[:, :, 0] = np.where(table[:, :, 0] >= 0, score[:, :, 0], self.least)
        best = np.full((words, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((words, length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)
            total = best[:, end - sizes] + score[:, end - sizes, sizes - 1]
            k = total.argmax(1)
            best[:, end], back[:, end] = total[np.arange(words), k], sizes[k]
        cut, at, rows = np.zeros((words, length), np.int64), np.full(words, length), np.arange(words)
        while (at > 0).any():
            live = rows[at > 0]
            size = back[live, at[live]]
            at[live] -= size
            cut[live, at[live]] = size
        return cut

    def _merge(self, table: np.ndarray) -> np.ndarray:
        """Length of the symbol that starts at each place once no pair is left to merge, 0 elsewhere."""
        words, length, most = table.shape
        score = np.where(table >= 0, self.scores[table], -np.inf)
        size = np.ones((words, length), np.int64)
        before = np.tile(np.arange(-1, length - 1), (words, 1))
        pair = np.full((words, length), -np.inf, np.float32)
        if length > 1 and most > 1:
            pair[:, :-1] = score[:, :-1, 1]
        live = np.arange(words)
        while len(live):
            at = pair[live].argmax(1)
            some = pair[live, at] > -np.inf
            live, at = live[some], at[some]
            other = at + size[live, at]
            size[live, at] += size[live, other]
            size[live, other] = 0
            pair[live, other] = -np.inf
            after = at + size[live, at]
            inside = after < length
            before[live[inside], after[inside]] = at[inside]
            for start in (at, before[live, at]):
                good = start >= 0
                rows, start = live[good], start[good]
                second = start + size[rows, start]
                fits = second < length
                total = size[rows, start] + np.where(fits, size[rows, np.minimum(second, length - 1)], 0)
                fits &= total <= most
                pair[rows, start] = np.where(fits, score[rows, start, np.minimum(total, most) - 1], -np.inf)
        return size

    def _merge_long(self, word: str) -> list[str]:
        """The same merges of one long word by a heap of pairs."""
        text, after, before = list(word), [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b >= 0 and (i := self.own.get(text[a] + text[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, text[a] + text[b]))

        for a in range(len(text)):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if after[a] != b or text[a] + text[b] != joined or not text[a]:
                continue
            text[a], text[b] = joined, ""
            after[a], c = after[b], after[b]
            after[b] = -2
            if c >= 0:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [t for t in text if t]

    def _ids(self, symbols: list[str]) -> bytes:
        out: list[int] = []
        for s in symbols:
            if (i := self.own.get(s)) is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            elif not (out and out[-1] == self.unknown and self.kind == _UNIGRAM):
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode_words(self, words: list[str], longest: int = 128, best_path: bool = False) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes; ``best_path``: by Viterbi even for a BPE model."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for length, members in by_length.items():
            if not length:
                continue
            if length > longest and self.kind == _BPE and not best_path:
                for k in members:
                    out[k] = self._ids(self._merge_long(words[k]))
                continue
            step = max(1, 1_000_000 // (length * min(length, self.longest)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.uint64)
                table = self._table(codes)
                sizes = self._merge(table) if self.kind == _BPE and not best_path else self._viterbi(table)
                rows, starts = np.nonzero(sizes)
                ids = table[rows, starts, sizes[rows, starts] - 1]
                plain = np.bincount(rows[ids < 0], minlength=len(part)) == 0
                data, ends = ids.astype("<i4").tobytes(), 4 * np.cumsum(np.bincount(rows, minlength=len(part)))
                first = 0
                for k, good, end, word_sizes in zip(part, plain.tolist(), ends.tolist(), sizes):
                    if good:
                        out[k] = data[first:end]
                    else:
                        cuts = np.flatnonzero(word_sizes)
                        out[k] = self._ids([words[k][s : s + n] for s, n in zip(cuts.tolist(), word_sizes[cuts].tolist())])
                    first = end
        return out

    def _words(self, text: str) -> list[str]:
        normal = self.library.normalize(text)
        if not self.separable:
            return [normal] if normal else []
        if not normal.startswith(_SPACE) or _SPACE * 2 in normal or normal.endswith(_SPACE):
            return re.findall(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+", normal)
        return [_SPACE + w for w in normal[1:].split(_SPACE)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; a null text has none."""
        split = [self._words(t) if t else [] for t in texts]
        find = self.memo.learn(set().union(*split), self.encode_words)
        return [b"".join(map(find, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; invalid UTF-8 becomes replacement characters. The space put before a text goes."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        text = self.blob[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def codec_of(model: str, held: int) -> Codec:
    """One codec a worker process, so that its tasks share the words it has learnt."""
    return Codec(model, held)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, text, ids``: the library's ids of every row, without begin and end.

    ``decoded`` adds the text that the ids decode to, in the same pass: a decoder of its own would be
    another process beside each encoder.

    A null or empty text has an empty list. Ids of rows may be null or repeat; other columns are
    ignored; an empty table gives none. ``model`` is a path that every executor has.
    """
    held = words_held(docs.sparkSession, WORD_BYTES, HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, held)
        claim(codec.memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = codec.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                columns = [part.column(0), part.column(1), lists]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(f, "<i4")) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the column ``decoded``; null ids decode to null, an empty list to the empty text."""
    names = rows.columns
    at_ids = names.index(ids_col)
    held = words_held(rows.sparkSession, WORD_BYTES, HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model, held)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(at_ids)
                values, offsets, known = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
                texts = [codec.decode(values[a:b]) if k else None for a, b, k in zip(offsets[:-1], offsets[1:], known)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
