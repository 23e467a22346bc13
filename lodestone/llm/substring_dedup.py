"""Removal of repeated word windows with a count-min prefilter.

1. Equal texts form a class; of a class only the first document goes on (every window of the others
   also starts earlier).
2. Each task counts what it reads in a sketch of its own; the partial sketches, sparse, are cut into
   slices of cells and merged by slice. What is counted is a window's anchor: of the ``ANCHOR``-word
   runs inside the window the one with the least hash, once for each place that some window chooses.
   Equal windows have their anchors at equal offsets, so an anchor's count, and the more so the
   sketch's estimate of it, is never below the window's. There are some seven times fewer anchors
   than windows.
3. Only windows whose estimate is two or more go to the exact pass: grouped by a 128-bit hash, of
   each the first place in the order of documents. A task keeps the first place of each window that
   it meets, so a slice gets a window once from each task at most, however often it occurs.
4. First places return to their texts; every other place that was asked for is removed.

The sketch has ``CELLS`` cells for each byte of text, up to ``most_cells``, and one bit of a cell is
broadcast. Beyond that size it overestimates more windows, and the exact pass groups more; none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.memo import claim
from lodestone.llm.near_dedup import BROADCAST_IDS
from lodestone.llm.shingles import WordHashes
from lodestone.operators.skew import join_counted
from lodestone.session import materialise

#: Words of an anchor.
ANCHOR = 8
#: Cells for a byte of text: some 16 for an anchor.
CELLS = 0.4
#: Cells of a slice of the sketch, as a power of two.
_SLICE = 20
#: Anchors and windows that a task holds before it passes them on.
_HELD = 1_000_000
#: Bytes of text for each slice of the exact pass.
_EXACT = 8_000_000
#: Bytes of removed ranges that are broadcast at most.
_BROADCAST = 32_000_000

_ODD = np.uint64(0xD6E8FEB86659FD93)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)
#: Windows that are looked at together, so that places fit into 24 bits.
_BLOCK = 1 << 23


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _ODD
    values = (values ^ (values >> np.uint64(29))) * _ODD
    return values ^ (values >> np.uint64(32))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < count:
            step = self.up[-1:] * self.base, self.down[-1:] * self.inverse
            self.up, self.down = np.concatenate([self.up, self.up * step[0]]), np.concatenate([self.down, self.down * step[1]])
        return self.up[:count], self.down[:count]


class Windows:
    """Hashes of a text's windows and the places of their anchors."""

    def __init__(self, width: int):
        self.width, self.anchor = width, min(ANCHOR, width)
        self.words, self.powers = WordHashes(), [_Powers(b) for b in _BASES]

    def codes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def hashes(self, codes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """A hash of each run of ``size`` words."""
        up, down = self.powers[which].upto(len(codes) + 1)
        own = codes if not which else _mix(codes)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(own * up[:-1], out=sums[1:])
        return _mix((sums[size:] - sums[:-size]) * down[: len(codes) - size + 1])

    def anchors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct anchors, in order of place, and for each window which of them is its own."""
        runs, near = self.hashes(codes, self.anchor), self.width - self.anchor + 1
        count, places = len(codes) - self.width + 1, []
        for low in range(0, count, _BLOCK):
            least = runs[low : low + _BLOCK + near - 1]
            least = (least & ~_PLACE) | np.arange(len(least), dtype=np.uint64)
            done = 1
            while done < near:
                step = min(done, near - done)
                least = np.minimum(least[:-step], least[step:])
                done += step
            places.append((least & _PLACE).astype(np.int64) + low)
        place = np.concatenate(places)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        return runs[place[new]], np.cumsum(new) - 1


def _cells(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cells of each anchor, one in each half of ``2 ** bits`` cells."""
    row, shift = np.uint64(1 << (bits - 1)), np.uint64(64 - bits + 1)
    return [_mix(anchors + np.uint64(k)) >> shift | np.uint64(k) * row for k in range(2)]


def _partial_sketches(texts: DataFrame, width: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, count = Windows(width), [], 0
        claim(windows.words)

        def out() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate([c for a in held for c in _cells(a, bits)] or [np.empty(0, np.uint64)]), return_counts=True)
            slices, starts = np.unique(cells >> np.uint64(_SLICE), return_index=True)
            # Within a slice: twice the cell, one more where the count is above one; then differences.
            marked = ((cells & np.uint64((1 << _SLICE) - 1)) << np.uint64(1) | (counts > 1)).astype(np.uint32)
            blobs = [np.diff(part, prepend=np.uint32(0)).tobytes() for part in np.split(marked, starts[1:])] if len(cells) else []
            return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int64)), pa.array(blobs, pa.binary())], ["slice", "cells"])

        for batch in batches:
            for text in batch.column(0):
                codes = windows.codes(text.as_py())
                if len(codes) >= width:
                    held.append(windows.anchors(codes)[0])
                    count += len(held[-1])
                    if count >= _HELD:
                        yield out()
                        held, count = [], 0
        yield out()

    return texts.select("text").mapInArrow(run, "slice long, cells binary")


def _runs(batches: Iterator[pa.RecordBatch], schema: list[str]) -> Iterator[tuple]:
    """Rows of batches as Python values."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in schema))


def _sketch(texts: DataFrame, width: int, bits: int) -> DataFrame:
    """``slice, bits``: for each slice of the merged sketch which cells count two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["slice", "bits"])

        at, counts = None, None
        for slice_, blob in _runs(batches, ["slice", "cells"]):
            if slice_ != at:
                if at is not None:
                    yield out()
                at, counts = slice_, np.zeros(1 << min(_SLICE, bits), np.uint8)
            marked = np.cumsum(np.frombuffer(blob, np.uint32), dtype=np.uint32)
            cells = marked >> np.uint32(1)
            counts[cells] = np.minimum(counts[cells] + 1 + (marked & np.uint32(1)).astype(np.uint8), 2)
        if at is not None:
            yield out()

    return _partial_sketches(texts, width, bits).repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice long, bits binary")


_ASKED = "slice long, digest binary, asked binary, windows binary, starts binary, docs binary"
_HASH = np.dtype([("a", np.uint64), ("b", np.uint64)])
_DOC = np.dtype([("d", np.int64), ("high", np.uint64), ("low", np.uint64)])


def _firsts(windows: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of equal windows the one that comes first by document and start: indices in the order of windows."""
    order = np.lexsort((starts, docs["low"], docs["high"], docs["d"], windows["b"], windows["a"]))
    sorted_ = windows[order]
    return order[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])] if len(order) else order


def _asked(texts: DataFrame, width: int, bits: int, shared, slices: int) -> DataFrame:
    """Rows of two kinds: of a text the starts of windows estimated repeated (slice -1), and of a slice windows with their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, often = Windows(width), np.frombuffer(shared.value, np.uint8)
        claim(windows.words)
        held, seen, count = [], {}, 0

        def out() -> pa.RecordBatch:
            places = np.concatenate([h[0] for h in held]) if held else np.empty(0, _HASH)
            starts = np.concatenate([h[1] for h in held]) if held else np.empty(0, np.int32)
            docs = np.repeat(np.array([h[2] for h in held], _DOC), [len(h[0]) for h in held])
            first = _firsts(places, starts, docs)
            slice_ = places["a"][first] % np.uint64(slices)
            first = first[np.argsort(slice_, kind="stable")]
            found, at = np.unique(places["a"][first] % np.uint64(slices), return_index=True)
            rows = [(int(s), None, None, places[p].tobytes(), starts[p].tobytes(), docs[p].tobytes()) for s, p in zip(found, np.split(first, at[1:]))] if len(first) else []
            rows += [(-1, digest, asked, None, None, None) for digest, asked in seen.items()]
            kinds = [pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["slice", "digest", "asked", "windows", "starts", "docs"])

        for d, digest, text in _runs(batches, ["d", "digest", "text"]):
            if digest in seen:
                continue
            codes = windows.codes(text)
            if len(codes) < width:
                continue
            anchors, own = windows.anchors(codes)
            twice = np.ones(len(anchors), bool)
            for cells in _cells(anchors, bits):
                twice &= (often[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
            starts = np.flatnonzero(twice[own]).astype(np.int32)
            if not len(starts):
                continue
            hashes = np.empty(len(starts), _HASH)
            for k, name in enumerate("ab"):
                hashes[name] = windows.hashes(codes, width, k)[starts]
            held.append((hashes, starts, (d, int.from_bytes(digest[:8]), int.from_bytes(digest[8:]))))
            seen[digest] = np.diff(starts, prepend=np.int32(0)).tobytes()
            count += len(starts)
            if count >= _HELD:
                yield out()
                held, seen, count = [], {}, 0
        yield out()

    return texts.select("d", "digest", "text").mapInArrow(run, _ASKED)


def _first_places(asked: DataFrame) -> DataFrame:
    """``digest, firsts``: starts of a text's windows that are the first of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            windows, starts, docs = (np.concatenate([np.frombuffer(h[k], t) for h in held]) for k, t in enumerate((_HASH, np.int32, _DOC)))
            first = _firsts(windows, starts, docs)
            starts, docs = starts[first], docs[first]
            order = np.lexsort((starts, docs["low"], docs["high"]))
            starts, docs = starts[order], docs[order]
            at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            digests = [int(x["high"]).to_bytes(8) + int(x["low"]).to_bytes(8) for x in docs[at]]
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([p.tobytes() for p in np.split(starts, at[1:])], pa.binary())], ["digest", "firsts"])

        slice_, held = None, []
        for row in _runs(batches, ["slice", "windows", "starts", "docs"]):
            if row[0] != slice_:
                if held:
                    yield out()
                slice_, held = row[0], []
            held.append(row[1:])
        if held:
            yield out()

    return asked.where("slice >= 0").select("slice", "windows", "starts", "docs").repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "digest binary, firsts binary")


def _removed(asked: DataFrame, width: int) -> DataFrame:
    """``digest, ranges``: begins and ends of the words that go, of texts that lose any."""
    of_text = asked.where("slice < 0").groupBy("digest").agg(F.first("asked").alias("asked"))
    both = of_text.select("digest", "asked", F.lit(None).cast("binary").alias("firsts")).unionByName(_first_places(asked).select("digest", F.lit(None).cast("binary").alias("asked"), "firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch | None:
            gone = np.setdiff1d(starts, np.concatenate(firsts) if firsts else np.empty(0, np.int32))
            if not len(gone):
                return None
            cut = np.flatnonzero(np.diff(gone) > width)
            ranges = np.stack([gone[np.concatenate([[0], cut + 1])], gone[np.concatenate([cut, [len(gone) - 1]])] + width], 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([ranges.tobytes()], pa.binary())], ["digest", "ranges"])

        at, starts, firsts = None, None, []
        for digest, asked_, first in _runs(batches, ["digest", "asked", "firsts"]):
            if digest != at:
                if at is not None and (batch := out()) is not None:
                    yield batch
                at, starts, firsts = digest, np.empty(0, np.int32), []
            if asked_ is not None:
                starts = np.cumsum(np.frombuffer(asked_, np.int32), dtype=np.int32)
            if first is not None:
                firsts.append(np.frombuffer(first, np.int32))
        if at is not None and (batch := out()) is not None:
            yield batch

    return both.repartition("digest").sortWithinPartitions("digest").mapInArrow(run, "digest binary, ranges binary")


def _cut(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n_words, n_removed, kept_texts = [], [], []
                for d, text, first, ranges in _runs([part], ["d", "text", "first_d", "ranges"]):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    kept = words
                    if first is not None and d > first:
                        kept = [] if len(words) >= width else words
                    elif ranges is not None:
                        kept, done = [], 0
                        for low, high in np.frombuffer(ranges, np.int32).reshape(-1, 2).tolist():
                            kept += words[done:low]
                            done = high
                        kept += words[done:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    kept_texts.append(b" ".join(kept))
                shas = [hashlib.sha256(x).hexdigest() for x in kept_texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"
    return texts.select("doc_id", "d", "text", "first_d", "ranges").mapInArrow(run, schema)


def _known(texts: DataFrame, table: DataFrame, total: int, small: bool) -> DataFrame:
    """``texts`` with what ``table`` (``digest, n, ...``) has of their classes; in memory where that is small."""
    if small:
        return texts.join(F.broadcast(table.drop("n")), "digest", "left")
    return join_counted(texts, table, ["digest"], total, how="left").drop("n")


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", most_cells: int = 2**29) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of every row: its words without those that repeat.

    A word goes if a window of ``width`` words covers it that also starts earlier, in a smaller document
    or before in the same one. Words are maximal runs of characters other than space and 0x09-0x0D,
    unchanged; kept ones are joined by one space. Windows are judged on the input, not on what is left.
    A null text has no words, a text of fewer words than ``width`` loses none. A null id counts as the
    least long. Rows that share an id but not their text come in the order of the texts' MD5; equal rows
    have equal results. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = F.col(id_col).cast("long")
    texts = docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(2**63))).alias("d"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    classes = materialise(texts.groupBy("digest").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "classes")
    total, n_bytes, copied = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("bytes") / F.col("n")), F.lit(0.0)), F.count_if(F.col("last_d") > F.col("first_d"))).first()
    copies = classes.where("last_d > first_d").select("digest", "first_d", "n")
    firsts = _known(texts, copies, total, copied <= BROADCAST_IDS).where("first_d IS NULL OR d = first_d")
    if copied > BROADCAST_IDS:
        firsts = materialise(firsts, "firsts")
    bits = min(max(16, int(CELLS * n_bytes).bit_length()), most_cells.bit_length() - 1)
    merged = np.zeros((1 << bits) // 8, np.uint8)
    each = (1 << min(_SLICE, bits)) // 8
    for row in _sketch(firsts, width, bits).toLocalIterator():
        merged[row["slice"] * each : (row["slice"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(merged.tobytes())
    asked = materialise(_asked(firsts, width, bits, shared, max(1, int(n_bytes // _EXACT))), "asked")
    removed = materialise(_removed(asked, width), "removed")
    fates = materialise(classes.join(removed, "digest", "left").where("ranges IS NOT NULL OR last_d > first_d").select("digest", "first_d", "ranges", "n"), "fates")
    n_fates, fate_bytes = fates.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ranges")), F.lit(0))).first()
    placed = _known(texts, fates, total, n_fates <= BROADCAST_IDS and fate_bytes <= _BROADCAST)
    return _cut(placed, width).select("doc_id", "n_words", "n_removed", "kept_sha256", F.decode("kept", "UTF-8").alias("kept_text"))
