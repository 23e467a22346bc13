"""Merkle manifest of a dataset, in DataFrame functions only.

Every row becomes a leaf. The leaves of a source, in the order of their ids, are dealt into blocks of
``WIDTH ** 3`` neighbours, an ordered array each; ``sequence``, ``transform`` and ``slice`` collapse a
block's levels in place. The roots of the blocks are the leaves of the next round, until each source
has one node, its subroot; the subroots, in the order of their sources, go through the same rounds.
On the way back each node gets its path, the siblings to the left and right on every level above it.
From it come a leaf's proof and the root that a tampered leaf would give.

Rows are numbered without a window over a source: one exchange sorts them by ranges, and a row's
number is what stands before its part plus its place there. So a source may hold any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import materialise

#: Children of a node, and levels that a block collapses.
WIDTH, _DEEP = 16, 3
_BLOCK = WIDTH**_DEEP
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<left:string,right:string>>"


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return _sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _numbered(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``pos``, their number within ``key`` from 0 by ``order``, and ``n``, how many the key has."""
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "key", *order, "_tie").sortWithinPartitions("key", *order, "_tie").drop("_tie")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("key", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    return placed.join(counts, ["key", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _above(nodes: Column) -> Column:
    """The level above: of every ``WIDTH`` nodes the digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda k: _sha(F.array_join(F.slice(nodes, k * WIDTH + 1, F.lit(WIDTH)), "")))


def _blocks(nodes: DataFrame, extra: list[str], name: str) -> DataFrame:
    """``key, block, n, deep, l0 .. l3``: arrays of the nodes of each level of a block; levels beyond ``deep`` repeat it."""
    items = F.sort_array(F.collect_list(F.struct("pos", "node", *extra))).alias("items")
    blocks = nodes.groupBy("key", F.floor(F.col("pos") / _BLOCK).alias("block")).agg(F.max("n").alias("n"), items)
    deep = F.lit(_DEEP)
    for level in range(_DEEP - 1, -1, -1):
        deep = F.when(F.col("n") <= WIDTH**level, level).otherwise(deep)
    blocks = blocks.select("key", "block", "n", deep.alias("deep"), "items", F.transform("items", lambda x: x["node"]).alias("l0"))
    for level in range(_DEEP):
        blocks = blocks.withColumn(f"l{level + 1}", F.when(F.col("deep") > level, _above(F.col(f"l{level}"))).otherwise(F.col(f"l{level}")))
    return materialise(blocks, name)


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.select("key", F.col("block").alias("pos"), F.element_at(f"l{_DEEP}", 1).alias("node"), F.ceil(F.col("n") / _BLOCK).alias("n"))


def _sides(nodes: Column, at: Column) -> Column:
    """Siblings of node ``at`` (from 0) in its run, as one text to its left and one to its right."""
    first = F.floor(at / WIDTH).cast("int") * WIDTH
    left = F.slice(nodes, first + 1, at - first)
    right = F.slice(nodes, at + 2, first + WIDTH - 1 - at)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _way(at: Column, levels: range) -> Column:
    """Path from level ``levels.start`` of a block to its root, of the node ``at`` of that level."""
    if not levels:
        return F.array().cast(_PATH)
    steps = [F.when(F.col("deep") > k, _sides(F.col(f"l{k}"), F.floor(at / WIDTH ** (k - levels.start)).cast("int"))) for k in levels]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


@dataclass
class _Tree:
    """The rounds of blocks over some nodes, the lowest first, and the one node of each key."""

    rounds: list[DataFrame]
    tops: DataFrame


def _grown(nodes: DataFrame, extra: list[str], name: str) -> _Tree:
    rounds = []
    while True:
        rounds.append(_blocks(nodes, extra, name))
        nodes, extra = _roots(rounds[-1]), []
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return _Tree(rounds, nodes.select("key", "node"))


def _block_paths(tree: _Tree, tops: DataFrame, carried: list[str]) -> DataFrame:
    """``key, block, above`` of the lowest blocks: the path of their roots. ``tops`` has of each key the path of its one node and what is carried along."""
    paths = tops.select("key", F.lit(0).cast("long").alias("block"), "above", *carried)
    for blocks in reversed(tree.rounds[1:]):
        known = blocks.join(paths, ["key", "block"])
        each = known.select("key", "block", "deep", *(f"l{k}" for k in range(_DEEP)), "above", *carried, F.posexplode("l0").alias("at", "node"))
        paths = each.select("key", (F.col("block") * _BLOCK + F.col("at")).alias("block"), F.concat(_way(F.col("at"), range(_DEEP)), "above").alias("above"), *carried)
    return paths


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of ``fields``; digests are lowercase hex SHA-256 and enter others as that text.
    Leaves of a source ascend by id, null first, equal ids by leaf; while several nodes remain, every
    ``WIDTH`` neighbours (the last run: fewer, even one) become one. The last node is the subroot, a lone
    leaf itself. Subroots by source, null first and then bytewise, give the root in the same way.
    ``proof_sha256`` is the digest of all siblings on the way up, from left to right on each level; of
    nothing where there are none. A row is tampered where 5 divides the CRC-32 of its id in decimal: A-Z
    of its text become lower case (a null text stays; a null id is never tampered). ``folded_root`` is
    made from that leaf and the true siblings, ``verified`` says whether it equals the root. Equal rows
    are leaves of their own. Other columns are ignored; an empty table gives none.
    """
    spark, own = docs.sparkSession, F.col(id_col).cast("long")
    tampered = F.when(F.crc32(own.cast("string").cast("binary")) % 5 == 0, leaf_of(*(F.translate(F.col(c).cast("string"), _LETTERS, _LETTERS.lower()) if c == text_col else F.col(c) for c in fields)))
    leaf = leaf_of(*(F.col(c) for c in fields))
    source = F.col(source_col).cast("string")
    # Null first, then all others in the order of their bytes.
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    leaves = materialise(docs.select(key.alias("key"), own.alias("doc_id"), leaf.alias("node"), tampered.alias("tampered")), "leaves")
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tree = _grown(_numbered(leaves, ["doc_id", "node"], parts), ["doc_id", "tampered"], "blocks")
    tops = materialise(tree.tops, "subroots")
    sources = _grown(_numbered(tops.select(F.lit(0).alias("key"), F.col("key").alias("source"), "node"), ["source"], parts), ["source"], "sources")
    # The lowest blocks of sources; each of their leaves is a subroot.
    roots = sources.tops.select("key", F.array().cast(_PATH).alias("above"), F.col("node").alias("root"))
    found = sources.rounds[0].join(_block_paths(sources, roots, ["root"]), ["key", "block"])
    each = found.select("deep", *(f"l{k}" for k in range(_DEEP)), "above", "root", F.posexplode("items").alias("at", "item"))
    subroots = each.select(F.col("item.source").alias("key"), F.col("item.node").alias("subroot"), F.concat(_way(F.col("at"), range(_DEEP)), "above").alias("above"), "root")
    paths = _block_paths(tree, materialise(subroots, "subroots"), ["subroot", "root"])
    blocks = tree.rounds[0].join(paths, ["key", "block"])
    # A row a run of leaves: what is above is the same for all of them.
    run = F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / WIDTH).cast("int")))
    runs = blocks.select("deep", "items", *(f"l{k}" for k in range(1, _DEEP)), "above", "subroot", "root", run.alias("run"))
    own, above = F.slice("items", F.col("run") * WIDTH + 1, F.lit(WIDTH)), F.concat(_way(F.col("run"), range(1, _DEEP)), "above")
    runs = runs.select("deep", "subroot", "root", own.alias("own"), above.alias("above"))
    nodes = F.transform("own", lambda x: x["node"])
    single = runs.select("deep", "subroot", "root", "above", nodes.alias("nodes"), F.posexplode("own").alias("at", "item"))
    first = F.when(F.col("deep") > 0, F.array(_sides(F.col("nodes"), F.col("at")))).otherwise(F.array().cast(_PATH))
    single = single.select("item.*", "subroot", "root", F.concat(first, "above").alias("path"))
    proof = _sha(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""))
    folded = F.aggregate("path", F.coalesce("tampered", "node"), lambda node, x: _sha(F.concat(x["left"], node, x["right"])))
    proved = single.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
