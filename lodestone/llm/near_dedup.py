"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts: set size, a 128-bit fingerprint of the shingle set, its band hashes and
   its signature. Equal sets form a class; only its smallest document goes on.
2. Classes that share a band are candidates. First each is paired with the smallest member of its
   buckets, a number of pairs linear in the classes. Signatures are compared batch by batch; a pair
   whose posterior probability of reaching the threshold falls below the miss probability is pruned.
   The full sets of the survivors decide. Their links give first components.
3. Buckets that still hold several components are compared within: pairs of one component are
   settled, all others go through the same batches, in tiles of fixed size. Of what survives in a
   tile, the likeliest pairs that would join its components are verified first.
4. With the components that these links give, the tiles are compared once more. What still survives
   falls into local groups, whose full sets decide, pair by pair until nothing is left to join; a
   group returns a spanning forest of its links.
5. The components of all links give the result.

Signatures, not texts, go through the pruning; texts leave their rows only for survivors. Joins on
buckets, classes and their smallest members know the number of rows of each key and join hot ones in
memory (``join_counted``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.llm import shingles as sh
from lodestone.llm.memo import claim
from lodestone.operators.components import connected_components
from lodestone.operators.skew import join_counted
from lodestone.session import materialise

BATCHES = (32, 64, 96, 128)
_FEATURES = "doc_id long, n_shingles long, n_chars long, digest binary, bands array<long>, sig binary"
_LINKS = "src long, dst long"
_CLASS = ["digest", "n_shingles"]
#: Members of one smallest member that are verified in one go.
FANOUT = 64
#: Ids of a broadcast set of documents at most; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 500_000


def _features(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, odd = sh.WordHashes(), sh.multipliers(max(bands * rows, BATCHES[-1]))
        claim(hashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, lengths, digests, banded, signed = [], [], [], [], []
                for text in part.column(1):
                    text = text.as_py()
                    found = sh.shingle_set(text, width, hashes)
                    sig = sh.signature(found, odd) if len(found) else odd[:0]
                    sizes.append(len(found))
                    lengths.append(len(text or ""))
                    digests.append(sh.digest(found))
                    banded.append(sh.band_hashes(sig, bands, rows) if len(found) else np.empty(0, np.int64))
                    signed.append(sig[: BATCHES[-1]].astype("<u2").tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in banded])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(banded)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(signed, pa.binary())],
                    ["doc_id", "n_shingles", "n_chars", "digest", "bands", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FEATURES)


class _Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.root[max(x, y)] = min(x, y)
        return True

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return up
            self.root = up


def _prune(a: np.ndarray, b: np.ndarray, least: list[int], first: int = 0, equal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tables of signatures may reach the threshold, batch by batch, and their matches so far."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32) if equal is None else equal
    for k in range(first, len(BATCHES)):
        low = BATCHES[k - 1] if k else 0
        equal = equal + (a[alive, low : BATCHES[k]] == b[alive, low : BATCHES[k]]).sum(1)
        keep = equal >= least[k]
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive, equal


def survivors(sigs: np.ndarray, sizes: np.ndarray, sides: np.ndarray, joined: np.ndarray, percent: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that the posterior bound leaves, with their matches, in portions.

    ``sides`` holds 0, or 1 for the members of a second block; of two blocks only cross pairs count.
    Pairs with the same ``joined`` are settled and left out.
    """
    count, two = len(sigs), sides.any()
    least = sh.least_matches(list(BATCHES), percent / 100, miss)
    order = np.argsort(sizes, kind="stable")
    step = max(1, 4_000_000 // max(1, count * BATCHES[0]))
    for at in range(0, count, step):
        rows = order[at : at + step]
        # Sorted by size, only those up to size * 100 / percent can reach the threshold.
        end = np.searchsorted(sizes[order], sizes[rows[-1]] * 100 / percent, side="right")
        others = order[at:end]
        same = (sigs[rows, None, : BATCHES[0]] == sigs[None, others, : BATCHES[0]]).sum(2, dtype=np.int16)
        x, y = np.nonzero(same >= least[0])
        keep = y > x
        if two:
            keep &= sides[rows[x]] != sides[others[y]]
        keep &= joined[rows[x]] != joined[others[y]]
        equal = same[x[keep], y[keep]].astype(np.int32)
        x, y = rows[x[keep]], others[y[keep]]
        for part in range(0, len(x), 100_000):
            i, j = x[part : part + 100_000], y[part : part + 100_000]
            alive, matches = _prune(sigs[i], sigs[j], least, 1, equal[part : part + 100_000])
            if len(alive):
                yield i[alive], j[alive], matches


def _reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = sh.common(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def spanning_links(sets: list[np.ndarray], sides: np.ndarray, joined: np.ndarray, percent: int, miss: float) -> list[tuple[int, int]]:
    """Links that connect whatever pairs with ``100 * |A & B| >= percent * |A | B|`` connect, beyond ``joined``."""
    odd, forest, links = sh.multipliers(BATCHES[-1]), _Forest(len(sets)), []
    sigs = np.stack([sh.signature(s, odd) for s in sets]).astype(np.uint16)
    _, first, back = np.unique(joined, return_index=True, return_inverse=True)
    for k, root in enumerate(first[back].tolist()):
        forest.join(k, root)
    for x, y, equal in survivors(sigs, np.array([len(s) for s in sets]), sides, joined, percent, miss):
        best = np.argsort(-equal, kind="stable")
        x, y = x[best], y[best]
        while len(x):
            roots = forest.flat()
            apart = roots[x] != roots[y]
            x, y = x[apart], y[apart]
            for i, j in zip(x[:500].tolist(), y[:500].tolist()):
                if forest.find(i) != forest.find(j) and _reaches(sets[i], sets[j], percent):
                    forest.join(i, j)
                    links.append((i, j))
            x, y = x[500:], y[500:]
    return links


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow each other with equal values in the first ``keys`` columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in range(keys))))
        start = 0
        for at in range(1, len(values) + 1):
            if at < len(values) and values[at] == values[start]:
                continue
            if key is not None and key != values[start]:
                yield key, pa.Table.from_batches(held)
                held = []
            key = values[start]
            held.append(batch.slice(start, at - start))
            start = at
    if held:
        yield key, pa.Table.from_batches(held)


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BATCHES[-1])


def _with_texts(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` with the texts of its ``rep``; few ids go to the texts, many meet them by a shuffle."""
    return (F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted).join(texts, "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 512, block_chars: int = 24_000_000) -> DataFrame:
    """Near-duplicate classes of texts: ``doc_id, n_shingles, component_id, kept``, a row per input row.

    Two documents are linked where ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct
    ``width``-word shingles; ``component_id`` is the smallest id reachable over links, itself included,
    and ``kept`` marks the document that has it. A pair at the threshold is missed by the bands with
    at most ``miss``, likewise by the posterior bound; links are confirmed on full sets.

    Null, empty and wordless texts have an empty set and stand alone. Rows of one id are one document
    for linking, and each stays a row. Rows with a null id keep it as ``component_id`` and are kept.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bands, rows = sh.banding(percent / 100, miss)
    feats = materialise(_features(docs, id_col, text_col, width, bands, rows), "features")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets = feats.where(linkable).select("doc_id", *_CLASS, "n_chars", "bands", "sig")
    grouped = sets.groupBy(*_CLASS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max("n_chars").alias("n_chars"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialise(grouped, "classes")
    total = sets.count()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    stars = _star_links(classes, texts, width, percent, miss)
    again = sets.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    own = join_counted(sets.select("doc_id", *_CLASS).join(again, "doc_id"), classes.select(*_CLASS, "rep", "n"), _CLASS, total)
    comps = connected_components(stars.unionByName(own.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))))
    comps = _joined(comps, _likely_links(classes, comps, texts, width, percent, miss, block))
    comps = _joined(comps, _all_links(classes, comps, texts, width, percent, miss, block, block_chars))
    named = classes.select(*_CLASS, "rep", "n").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*_CLASS, "n", F.coalesce("component", "rep").alias("component_id"))
    found = join_counted(feats.where(linkable).select("doc_id", *_CLASS), materialise(named, "named"), _CLASS, total).select("doc_id", "n_shingles", "component_id")
    alone = feats.where(~F.coalesce(linkable, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return comps
    return connected_components(links.unionByName(comps.select(F.col("node").alias("src"), F.col("component").alias("dst"))))


def _star_links(classes: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """Links of classes with the smallest member of a bucket of theirs."""
    banded = classes.select("rep", F.explode("bands").alias("h"))
    hubs = materialise(banded.groupBy("h").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("n")).where("hub <> last").select("h", "hub", "n"), "buckets")
    shared = hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stars = materialise(join_counted(banded, hubs, ["h"], shared).where("rep <> hub").select("rep", "hub").distinct(), "stars")
    sigs = classes.select("rep", "sig")
    fans = stars.groupBy("hub").agg(F.count("*").alias("n"))
    theirs = fans.join(sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    both = join_counted(stars, theirs, ["hub"], stars.count()).select("rep", "hub", "hub_sig").join(sigs, "rep").select("rep", "hub", "sig", "hub_sig")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = sh.least_matches(list(BATCHES), percent / 100, miss)
        for batch in batches:
            if batch.num_rows:
                alive, _ = _prune(_signatures(batch.column(2)), _signatures(batch.column(3)), least)
                yield batch.select(["rep", "hub"]).take(pa.array(alive))

    return _verified(both.mapInArrow(prune, "rep long, hub long").distinct(), texts, width, percent)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (``rep``, ``hub``) whose full sets reach the threshold, as links."""
    kept = materialise(pairs, "survivors")
    sizes = kept.groupBy("hub").agg(F.count("*").alias("n"))
    dealt = join_counted(kept, sizes, ["hub"], kept.count()).select("rep", "hub", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / FANOUT)).alias("part"))
    dealt = materialise(dealt, "dealt")
    members = dealt.select("hub", "part", F.lit(1).alias("member"), "rep")
    centres = dealt.select("hub", "part").distinct().select("hub", "part", F.lit(0).alias("member"), F.col("hub").alias("rep"))
    laid = _with_texts(members.unionByName(centres), texts).select("hub", "part", "member", "rep", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of a centre come first; of repeated ids any text may make the link.
        hashes, key, centre = sh.WordHashes(), None, []
        claim(hashes)
        for batch in batches:
            src, dst = [], []
            for hub, part, member, rep, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = sh.shingle_set(text, width, hashes)
                if (hub, part) != key:
                    key, centre = (hub, part), []
                if not member:
                    centre.append(found)
                elif len(found) and any(len(c) and _reaches(c, found, percent) for c in centre):
                    src.append(rep)
                    dst.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return materialise(laid.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(verify, _LINKS), "links")


def _tiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``block`` and ``n_blocks``, dealt to the tiles (``i``, ``j``) of their key: every pair of blocks meets in one."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other")
    i, j, upper = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("upper")
    rest = [c for c in rows.columns if c not in (*keys, "block", "n_blocks")]
    tiled = rows.select("*", other).select(*keys, i, j, upper, *rest)
    return tiled.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _mixed_tiles(classes: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """Members, with signatures, of the tiles of all buckets that hold several components."""
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    banded = materialise(named.select("rep", "comp", F.explode("bands").alias("h")), "banded")
    mixed = banded.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n")
    mixed = materialise(mixed, "mixed")
    shared = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = F.ceil(F.col("n") / block)
    members = join_counted(banded, mixed, ["h"], shared).select("h", "rep", "comp", blocks.alias("n_blocks"), F.pmod(F.xxhash64("rep"), blocks).alias("block"))
    rows = members.join(classes.select("rep", "n_shingles", "n_chars", "sig", "bands"), "rep")
    return _tiles(rows.select("h", "n_blocks", "block", "rep", "comp", "n_shingles", "n_chars", "sig", "bands"), ["h"])


def _compared(batches: Iterator[pa.RecordBatch], percent: int, miss: float) -> Iterator[tuple]:
    """Ids, components and lengths of each tile's members, and its surviving pairs, which count in the first bucket they share."""
    for (h, _, _), run in _runs(batches, 3):
        upper, rep, comp, size, chars = (run.column(k).to_numpy() for k in range(3, 8))
        own = run.column(9).combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        band = int((own[0] == h).argmax())
        kept = []
        for x, y, equal in survivors(_signatures(run.column(8)), size, upper, comp, percent, miss):
            first = (own[x] == own[y]).argmax(1) == band
            kept.append((x[first], y[first], equal[first]))
        if kept:
            yield rep, comp, chars, *(np.concatenate(c) for c in zip(*kept))


def _likely_links(classes: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int, miss: float, block: int) -> DataFrame:
    """Links among the likeliest pairs that would join the components of a tile."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, comp, _, x, y, equal in _compared(batches, percent, miss):
            _, label = np.unique(comp, return_inverse=True)
            forest, order, pairs = _Forest(len(label)), np.argsort(-equal, kind="stable"), []
            for a, b in zip(x[order].tolist(), y[order].tolist()):
                if forest.join(int(label[a]), int(label[b])):
                    pairs.append((max(rep[a], rep[b]), min(rep[a], rep[b])))
            low = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(low[:, 0]), pa.array(low[:, 1])], ["rep", "hub"])

    return _verified(_mixed_tiles(classes, comps, block).mapInArrow(likely, "rep long, hub long").distinct(), texts, width, percent)


def _all_links(classes: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int, miss: float, block: int, block_chars: int) -> DataFrame:
    """Links that join any components which still share a bucket."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, comp, chars, x, y, _ in _compared(batches, percent, miss):
            forest = _Forest(len(rep))
            for a, b in zip(x.tolist(), y.tolist()):
                forest.join(a, b)
            root = forest.flat()
            for r in np.unique(root[x]).tolist():
                own = np.flatnonzero(root == r)
                own = own[np.argsort(rep[own], kind="stable")]
                parts = max(1, -(-int(chars[own].sum()) // block_chars), -(-len(own) // block))
                key = xxhash.xxh3_128_digest(rep[own].tobytes())
                columns = [pa.array([key] * len(own), pa.binary()), pa.array([parts] * len(own), pa.int64()), pa.array(np.arange(len(own)) % parts, pa.int64()), pa.array(rep[own], pa.int64()), pa.array(comp[own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["group", "n_blocks", "block", "rep", "comp"])

    groups = materialise(_mixed_tiles(classes, comps, block).mapInArrow(local, "group binary, n_blocks long, block long, rep long, comp long").distinct(), "groups")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sh.WordHashes()
        claim(hashes)
        for _, run in _runs(batches, 3):
            found = [sh.shingle_set(t.as_py(), width, hashes) for t in run.column(6)]
            good = np.array([k for k, s in enumerate(found) if len(s)], np.int64)
            if len(good) > 1:
                upper, rep, comp = (run.column(k).to_numpy()[good] for k in range(3, 6))
                pairs = np.array(spanning_links([found[k] for k in good], upper, comp, percent, miss), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], ["src", "dst"])

    laid = _with_texts(groups, texts).select("group", "n_blocks", "block", "rep", "comp", "text")
    return materialise(_tiles(laid, ["group"]).mapInArrow(verify, _LINKS), "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; repeated rows of a kept id all stay."""
    gone = "_gone"
    while gone in map(str.lower, docs.columns):
        gone += "_"
    copies = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    own = docs[id_col].cast("long")
    # Rows without an id have no part in the join, where they would meet in one task.
    return docs.where(own.isNotNull()).join(copies, own == F.col(gone), "left_anti").unionByName(docs.where(own.isNull()))
