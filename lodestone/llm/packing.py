"""Best-fit packing of token sequences by a grouping genetic algorithm.

A solution is a partition of pieces into bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold their pieces a second time, and best-fits the
displaced pieces. Pieces are dealt into groups of a fixed size; each group is searched by several
islands, one task each, and between epochs every island receives the elite of its neighbour.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from lodestone.llm.memo import Memo, claim, words_held
from lodestone.session import materialise

_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
_END = (0).to_bytes(4, "little")
#: Bytes that a word takes in a worker's memory.
WORD_BYTES = 220
#: Marks that a word may end with.
_MARKS = (".", ",", ";", ":", "!", "?")


def _words(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").lower().replace(b"\n", b" ").decode("utf-8", "surrogatepass").split(" ")


def _drops_space(tokenizer: str) -> bool:
    """Whether a tokenizer lowers letters, makes any white space one space, and keeps only what is none, ends marked."""
    with open(tokenizer, encoding="utf-8") as file:
        data = json.load(file)
    steps = [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])]
    cuts = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kept = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
    return steps == ["NFC", "Replace", "Lowercase"] and kept and [c["type"] for c in cuts[1:]] == ["ByteLevel"] and data["model"].get("end_of_word_suffix") == "</w>"


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit bytes, by the ids of its space-separated words.

    That is for tokenizers that lower letters and whose words never cross white space, which is dropped
    before the merges: so A-Z may be lowered and line ends be spaces beforehand, and fewer words
    differ. Special tokens are cut out of the raw text first, as the library does. With any other
    tokenizer the library encodes the whole texts.
    """

    def __init__(self, tokenizer: str, held: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(tokenizer)
        self.by_words = _drops_space(tokenizer)
        added = {t.content: i for i, t in self.encoder.get_added_tokens_decoder().items()}
        self.special = {content: int(i).to_bytes(4, "little") for content, i in added.items()}
        #: What all special tokens begin with; a text without it holds none.
        self.mark = os.path.commonprefix(list(added))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memo = Memo(held)
        ids = self.encoder.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        for piece, i in ids.items():
            self.ends[i] = piece.endswith("</w>")
        #: Letters met so far beyond ASCII, and those of them within which a word ends.
        self.met: set[str] = set()
        self.parting: set[str] = set()

    def _ended(self, word: str) -> bytes | None:
        """Ids of a word that is one unit with one end, at its last token; else None."""
        ids = np.array(self.encoder.encode(word, add_special_tokens=False).ids, "<u4")
        return ids.tobytes() if np.flatnonzero(self.ends[ids]).tolist() == [len(ids) - 1] else None

    def _whole(self, words: list[str]) -> list[str]:
        """Words without letters that the tokenizer takes apart, such as those it writes as a letter and a mark."""
        beyond = "".join(w for w in words if not w.isascii())
        if not beyond:
            return words
        new = set(beyond) - self.met
        self.met |= new
        self.parting.update(c for c in new if c.isalpha() and self._ended(f"a{c}a") is None)
        return [w for w in words if w.isascii() or self.parting.isdisjoint(w)] if self.parting else words

    def _encode(self, new: list[str]) -> list[bytes]:
        """Ids of words: of letters alone, of letters and a mark by their parts, of others by place."""
        alone = [w for w in new if w.isalpha()]
        rest = set(new).difference(alone)
        letters = self._whole(alone)
        marked = self._whole([w for w in rest if w[-1:] in _MARKS and w[:-1].isalpha()])
        known = self.memo.peek
        own = list({w[:-1] for w in marked if known(w[:-1]) is None}.union(letters, _MARKS))
        found: dict[str, bytes] = {}
        for at in range(0, len(own), 500):
            # A word of letters is one unit, which ends with the one token that ends a word.
            part = own[at : at + 500]
            ids = np.array(self.encoder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                found.update((w, one) for w in part if (one := self._ended(w)) is not None)
                continue
            data = ids.tobytes()
            found.update(zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        for word in marked:
            base, mark = found.get(word[:-1]) or known(word[:-1]), found.get(word[-1])
            if base and mark:
                found[word] = base + mark
        others = [w for w in new if w not in found and w]
        for at in range(0, len(others), 500):
            # A token belongs to the word in which its characters start.
            part = others[at : at + 500]
            coded = self.encoder.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(word) + 1 for word in part])
            cuts = (4 * np.searchsorted(np.array([start for start, _ in coded.offsets], np.int64), ends)).tolist()
            data = np.array(coded.ids, "<u4").tobytes()
            found.update(zip(part, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
        found[""] = b""
        return list(map(found.__getitem__, new))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            coded = self.encoder.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in coded]
        split = []
        for text in texts:
            text = text or ""
            if self.cut is not None and self.mark in text:
                split.append([p if p in self.special else _words(p) for p in self.cut.split(text)])
            else:
                split.append([_words(text)])
        find = self.memo.learn(set().union(*(p for parts in split for p in parts if isinstance(p, list))), self._encode)
        return [b"".join(self.special[p] if isinstance(p, str) else b"".join(map(find, p)) for p in parts) for parts in split]


@lru_cache(1)
def word_ids(tokenizer: str, held: int) -> WordIds:
    """One encoder a worker process, so that its tasks share the words it has learnt."""
    return WordIds(tokenizer, held)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", held: int = 100_000_000) -> DataFrame:
    """The tokens of each row, then id 0, cut into pieces of ``capacity`` where they are longer."""

    most = words_held(docs.sparkSession, WORD_BYTES, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, most)
        claim(encode.memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = [[], [], [], [], [], []]
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encode(part.column(2).to_pylist())):
                    ids += _END
                    for k, cut in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[cut : cut + 4 * capacity]
                        for column, value in zip(columns, (doc, row, k, cut // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


class Bins:
    """A solution in the making: bin of each piece, and the bins by what they still hold."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = [-1] * len(sizes)
        self.members: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, members: list[int]) -> None:
        number = len(self.members)
        self.members.append(members)
        for x in members:
            self.bin_of[x] = number
        self.room.append(self.capacity - sum(self.sizes[x] for x in members))
        self._offer(number)

    def _offer(self, number: int) -> None:
        room = self.room[number]
        self.by_room[room].append(number)
        self.mask |= 1 << room

    def fit(self, items: list[int]) -> None:
        """Best fit, in the order given: the fullest bin that still takes the piece, else a new one."""
        sizes, by_room = self.sizes, self.by_room
        for x in items:
            size = sizes[x]
            fitting = self.mask >> size
            if not fitting:
                self.add([x])
                continue
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                self.mask ^= 1 << room
            self.members[number].append(x)
            self.bin_of[x] = number
            self.room[number] = room - size
            self._offer(number)


def fitness(bins: Bins) -> tuple[int, int]:
    """Fewer bins first; of equally many, those with the fuller bins (sum of squared fills)."""
    return -len(bins.members), sum((bins.capacity - r) ** 2 for r in bins.room)


def crossover(giver: Bins, taker: Bins, rng: np.random.Generator) -> Bins:
    sizes, capacity = giver.sizes, giver.capacity
    order = sorted(range(len(giver.members)), key=giver.room.__getitem__)
    well = order[: max(1, len(order) // 2)]
    injected = [giver.members[k] for k in rng.permutation(well)[: max(1, len(well) // 2)]]
    taken = {x for members in injected for x in members}
    hit = {taker.bin_of[x] for x in taken}
    # The emptiest bins are opened too, so that displaced pieces find more than their own gaps.
    hit.update(sorted(range(len(taker.members)), key=lambda k: -taker.room[k])[: 1 + len(taker.members) // 20])
    child = Bins(sizes, capacity)
    for members in injected:
        child.add(list(members))
    for k, members in enumerate(taker.members):
        if k not in hit:
            child.add(list(members))
    displaced = [x for k in hit for x in taker.members[k] if x not in taken]
    displaced.sort(key=lambda x: -sizes[x])
    child.fit(displaced)
    return child


def _from(assigned: np.ndarray, sizes: list[int], capacity: int) -> Bins:
    groups: dict[int, list[int]] = {}
    for x, k in enumerate(assigned.tolist()):
        groups.setdefault(k, []).append(x)
    bins = Bins(sizes, capacity)
    for members in groups.values():
        bins.add(members)
    return bins


def evolve(sizes: list[int], capacity: int, seeds: list[np.ndarray], seed: int, population: int = 4, generations: int = 8) -> np.ndarray:
    """Bin of each piece in the best solution found from ``seeds`` and best-fit starts."""
    rng = np.random.default_rng(seed)
    pool = [_from(s, sizes, capacity) for s in seeds]
    least = -(-sum(sizes) // capacity)
    weights = np.asarray(sizes, float)
    while len(pool) < population and not (pool and len(pool[0].members) == least):
        noise = rng.random(len(sizes)) * 0.15 * len(pool)
        start = Bins(sizes, capacity)
        start.fit(np.argsort(-weights * (1 - noise), kind="stable").tolist())
        pool.append(start)
    pool.sort(key=fitness, reverse=True)
    for _ in range(generations if len(pool) > 1 else 0):
        if len(pool[0].members) == least:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        children = [crossover(pool[a], pool[b], rng), crossover(pool[b], pool[a], rng)]
        pool = sorted([*pool, *children], key=fitness, reverse=True)[:population]
    return np.asarray(pool[0].bin_of, np.int64)


def _island(capacity: int, epoch: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["row", "piece"], kind="stable")
        seeds = [part[c].to_numpy(np.int64) for c in ("own", "elite") if part[c].notna().all()]
        bins = evolve(part["length"].tolist(), capacity, seeds, int(key[0]) * 1000 + int(key[1]) * 10 + epoch)
        return part[["row", "piece", "length", "group", "island"]].assign(bin=bins)

    return run


def pack(parts: DataFrame, capacity: int, group: int = 4096, islands: int = 2, epochs: int = 2) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: pieces packed into sequences of ``capacity``."""
    full = parts.where(F.col("length") == capacity)
    small = parts.where(F.col("length") < capacity)
    groups = max(1, -(-small.count() // group))
    items = small.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("group"))
    state = items.withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands))))).withColumns({"own": F.lit(None).cast("long"), "elite": F.lit(None).cast("long")})
    schema = "row long, piece int, length long, group long, island int, bin long"
    for epoch in range(epochs):
        found = materialise(state.groupBy("group", "island").applyInPandas(_island(capacity, epoch), schema), "island")
        if epoch == epochs - 1:
            break
        # Each island keeps its own elite and receives that of the one before it.
        moved = found.select("row", "piece", "length", "group", F.explode(F.array(F.struct("island", F.col("bin").alias("own"), F.lit(None).cast("long").alias("elite")), F.struct(((F.col("island") + 1) % islands).alias("island"), F.lit(None).cast("long").alias("own"), F.col("bin").alias("elite")))).alias("x"))
        state = moved.groupBy("row", "piece", "length", "group", F.col("x.island").alias("island")).agg(F.max("x.own").alias("own"), F.max("x.elite").alias("elite"))
    used = found.groupBy("group", "island").agg((F.max("bin") + 1).alias("bins")).groupBy("group").agg(F.min(F.struct("bins", "island")).alias("best"))
    best = found.join(used, "group").where(F.col("island") == F.col("best.island")).select("row", "piece", (F.col("group") * F.lit(2**24) + F.col("bin")).alias("sequence_id"))
    rest = small.join(best, ["row", "piece"])
    before = Window.partitionBy("sequence_id").orderBy("row", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # Full pieces fill a sequence alone; their numbers are negative, the others' are not.
    alone = full.withColumns({"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")})
    return alone.unionByName(rest)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", held: int = 100_000_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every row's tokens, packed.

    A null or empty text is the end id alone. Rows may repeat an id or have none; each row is packed.
    Only rows longer than ``capacity`` are cut. ``held`` bounds the bytes of the words that a worker
    remembers, which its container may bound further; it changes time and memory, never the result. Other columns are ignored; an empty table gives none.
    """
    parts = materialise(pieces(docs, tokenizer, capacity, id_col, text_col, held), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
