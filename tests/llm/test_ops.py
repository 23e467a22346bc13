"""Each operator against a plain version, and on odd tables: nulls, empties, long texts, ties, repeats, clashing names."""

import itertools
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import embedding_dedup, hnsw, html_text, labelled, memo, near_dedup, packing, quality, queries, sentencepiece_codec, sharding, shingles, token_counts, top_k, toxicity

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
# Columns whose names the operators use themselves.
CLASH = "rep long, component string, row string, n_bytes int, block int, node string, score string, ids string, size int, label string, _k int, piece string"
CLASH_VALUES = (1, "x", "y", 2, 3, "n", "s", "i", 4, "l", 5, "p")
LONG = "lorem ipsum dolor sit amet " * 9000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again until night falls on the hill"),
    (2, "the quick brown fox jumps over the lazy dog again and again until night falls on the hill"),
    (3, "The QUICK brown fox jumps over the lazy dog again and again until night falls on the hill today"),
    (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "two words"), (9, LONG), (10, LONG + "end"),
    (11, "naïve café 日本 🙂🙂 <|endoftext|> don't I'll  \n\n x1234"), (11, "repeated id"), (None, "no id"), (None, None),
    (12, "a"), (12, "a"), (13, "ꟸ\x00\x1c end"), (14, "<|startoftext|>Hello<|endoftext|>"), (15, "x" * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in TEXTS], f"doc_id long, text string, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def similar(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def plain_set(text, width):
    words = tuple((text or "").encode().lower().split())
    return {words[k : k + width] for k in range(max(1, len(words) - width + 1))} if words else set()


def test_near_dedup_matches_brute_force(spark, odd, empty):
    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for copy in range(8):
            own = list(words)
            for at in rng.integers(0, 60, copy % 5):
                own[at] = f"e{rng.integers(0, 9999)}"
            rows.append((base * 10 + copy, " ".join(own)))
    for width, percent in ((3, 85), (5, 80)):
        sets = {i: plain_set(t, width) for i, t in rows}
        want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if similar(sets[a], sets[b], percent)])
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent, block=7).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
        assert len({*want.values()}) < len(rows)
    got = near_dedup.near_duplicates(odd, width=3, percent=85).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 1, 1, 4, 5, 6, 7, 7, 9, 10]
    assert by[4].n_shingles == 0 and by[7].n_shingles == 1 and by[None].component_id is None and by[None].kept
    extra = odd.withColumn("_gone", F.lit(0))
    kept = near_dedup.drop_near_duplicates(extra, width=3, percent=85)
    assert kept.columns == extra.columns and kept.count() == len(TEXTS) - 3
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_templates_hot_copies_and_repeated_ids(spark, monkeypatch):
    """Texts that share most words but not enough, chains of near copies, one text on many rows, ids with several texts."""
    monkeypatch.setattr(near_dedup, "FANOUT", 5)
    rng = np.random.default_rng(11)
    frame, rows = [f"t{k}" for k in range(70)], []
    for i in range(150):
        own = list(frame) + [f"o{x}" for x in rng.integers(0, 400, 12)]
        rows.append((1000 + i, " ".join(own)))
    chain = [f"c{k}" for k in range(120)]
    for i in range(60):
        chain[int(rng.integers(0, 120))] = f"n{i}"
        rows.append((2000 + int(rng.permutation(60)[0]) * 100 + i, " ".join(chain)))
    rows += [(3000 + i, "one very common text on many rows of the table") for i in range(400)]
    rows += [(3000, " ".join(frame)), (5, "one very common text on many rows of the table"), (5, rows[0][1]), (5, None), (None, rows[0][1])]
    sets: dict = {}
    for i, text in rows:
        if i is not None and plain_set(text, 3):
            sets.setdefault(i, []).append(plain_set(text, 3))
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if any(similar(x, y, 85) for x in sets[a] for y in sets[b])]
    want = components(sets, linked)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=3, percent=85, block=16, block_chars=4000).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles and r.doc_id is not None} == set(want.items())
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_survivors_of_two_blocks_and_settled_pairs():
    odd = shingles.multipliers(near_dedup.BATCHES[-1])
    base = np.random.default_rng(1).integers(0, 2**63, 9500, dtype=np.uint64)
    sets = [base[k : k + 400] for k in (0, 3, 6, 9000)]
    sigs, sizes, zero = np.stack([shingles.signature(s, odd) for s in sets]).astype(np.uint16), np.full(4, 400), np.zeros(4, int)
    pairs = lambda sides, joined: {tuple(sorted((int(a), int(b)))) for x, y, _ in near_dedup.survivors(sigs, sizes, sides, joined, 85, 1e-6) for a, b in zip(x, y)}
    assert pairs(zero, np.arange(4)) == {(0, 1), (0, 2), (1, 2)}
    assert pairs(np.array([0, 1, 0, 1]), np.arange(4)) == {(0, 1), (1, 2)}
    assert pairs(zero, np.array([0, 0, 2, 3])) == {(0, 2), (1, 2)}


def test_posterior_bounds_and_banding():
    assert shingles.banding(0.85, 1e-6) == (36, 7)
    bands, rows = shingles.banding(0.8, 1e-6)
    assert (1 - 0.8**rows) ** bands <= 1e-6
    least = shingles.least_matches([32, 128], 0.85, 1e-6)
    assert 0 < least[0] < 32 and least[0] / 32 < least[1] / 128 < 0.85


def counts_by_library(texts):
    tokenizer = Tokenizer.from_file(BYTE)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("head", [1, 1_000_000])
def test_token_counts_match_the_library(odd, empty, head):
    got = token_counts.token_counts(odd, BYTE, head=head).collect()
    want = sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(TEXTS, counts_by_library(t for _, t in TEXTS)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_tokenizers_of_another_kind():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Splitter(WORD)
    library = Tokenizer.from_file(BYTE)
    texts = [t for _, t in TEXTS]
    assert packing.WordIds(WORD).by_words and not packing.WordIds(BYTE).by_words
    assert packing.WordIds(BYTE)(texts) == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_sharding_is_even_and_gapless(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows = [(i, "hot copy of one text" if i % 3 == 0 else "t" * int(rng.integers(1, 90)) + str(i)) for i in range(3000)]
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=16, slots_per_task=50).toPandas()
    sizes = placed.groupby("_shard")["_size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 0.05 * sizes.mean()
    for _, part in placed.groupby("_shard"):
        assert sorted(part["_slot"]) == list(range(len(part)))
    assert placed["_size"].sum() == sum(len(t) + 1 for _, t in rows)
    got = sharding.shard(odd.withColumn("_slot", F.lit("old")).withColumn("_d", F.lit(1)).withColumn("_row", F.lit(2)), shards=4)
    assert got.columns == [*odd.columns, "_d", "_row", "_size", "_shard", "_slot"] and dict(got.dtypes)["_slot"] == "bigint"
    got = got.toPandas()
    assert len(got) == len(TEXTS) and sorted(got["text"].fillna("")) == sorted(t or "" for _, t in TEXTS)
    assert sharding.shard(empty, shards=4).count() == 0


def test_sharding_against_sorting(spark):
    """Boundaries against those of sorting all rows: each shard is a range, and no better boundary is out of tolerance."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 500)), "same" if k % 3 == 0 else "x" * int(rng.integers(0, 200)) + str(k % 400)) for k in range(2000)] + [(7, "same")] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = table.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("k"), (F.octet_length("text") + 1).alias("size"))
    placed = sharding.shard(table, shards=8, slots_per_task=100, bytes_per_task=20_000).join(keyed.select("doc_id", "text", "k").distinct(), ["doc_id", "text"]).toPandas()
    assert len(placed) == len(rows)
    order = placed.sort_values(["k", "doc_id", "text"], kind="stable")
    assert (np.diff(order["_shard"]) >= 0).all()
    # Rows of one key stay together; beyond such a run a shard is within the tolerance of its share.
    total, run = placed["_size"].sum(), placed.groupby(["k", "doc_id"])["_size"].sum().max()
    assert (placed.groupby("_shard")["_size"].sum() - total / 8).abs().max() <= 2 * (run + 0.002 * total / 8) + 1
    for _, part in placed.groupby("_shard"):
        assert sorted(part["_slot"]) == list(range(len(part)))
    split = placed[placed["text"] == "same"]["_shard"].nunique()
    assert split <= 1 + -(-placed[placed["text"] == "same"]["_size"].sum() // int(total / 8)) + 1


VECTORS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1),
           (9, [1.0, 0.0], None), (10, [float("inf"), 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [0.0, 1.0], 1), (13, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(*v, 5, "s") for v in VECTORS], "vec_id long, embedding array<float>, label int, rep int, shard string").repartition(3)


def test_embedding_duplicates(spark, vectors):
    got = {r.vec_id: r for r in embedding_dedup.embedding_duplicates(vectors).collect()}
    assert len(got) == 14
    assert [got[i].n_links for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None)] == [2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert got[3].component_id == 1 and not got[3].kept and got[4].kept and got[13].kept
    assert embedding_dedup.embedding_duplicates(vectors.limit(0)).count() == 0
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 16))
    for k in range(0, 600, 3):
        data[k + 1] = data[k] + rng.normal(size=16) * 0.05
    data[100:160] = data[100] + rng.normal(size=(60, 16)) * 0.03
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(data)]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2)
    np.fill_diagonal(close, False)
    got = embedding_dedup.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard_size=100).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(close.sum(1).tolist()))
    assert {r.vec_id: r.component_id for r in got} == components(range(600), [(a, b) for a, b in np.argwhere(close).tolist()])


def test_embedding_duplicates_with_repeats_and_one_common_vector(spark, tmp_path, monkeypatch):
    """Against the SQL: repeated rows, ids with several vectors, one very common vector, a huge component, a hot label."""
    monkeypatch.setattr(embedding_dedup, "_RESIDENT", 1)
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=6).tolist(), int(i % 5 == 0)) for i in range(200)]
    rows += [(300 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0], 0) for i in range(150)] + [(310, [1.0, 2.0, 0.01, 0.0, 0.0, 1.0], 0)] * 3
    rows += rows[3:9] + [(5, rows[40][1], 0), (700, rows[5][1], 0), (5, None, 0), (6, [0.0] * 6, 0), (7, rows[7][1], None), (900, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (901, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (902, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    table.toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = connection.execute("SELECT vec_id, n_links, component_id, kept FROM (" + queries.ORACLE_SQL["op4_embedding_dedup"] + ")").fetchall()
    # The SQL's cosine overflows for the huge components; these two are linked.
    want = [w if w[0] not in (900, 901) else (w[0], 1, 900, w[0] == 900) for w in want]
    got = embedding_dedup.embedding_duplicates(table.repartition(3), shard_size=40).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_shards_query_each_other_only_near_their_border(monkeypatch):
    """Of shards by pivots, few vectors query another shard, and every link between two shards is found."""
    rng = np.random.default_rng(23)
    data = rng.normal(size=(4000, 32))
    data[2000:] = data[:2000] + rng.normal(size=(2000, 32)) * rng.uniform(0.05, 0.25, size=(2000, 1))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    pivots = unit[rng.choice(4000, 20, replace=False)]
    part = pd.DataFrame({"class": np.arange(4000), "rep": np.arange(4000), "copies": 1, "vector": list(data)})
    home = (unit @ pivots.T).argmax(1)
    shards = []
    for k in range(20):
        row = embedding_dedup._build(("x", 32, 20, k, k), part[home == k]).iloc[0].to_dict()
        shards.append(embedding_dedup._Shard(k, row | {"pivot": pivots[k].tolist()}))
    asked, search = [], embedding_dedup.linked_pairs
    monkeypatch.setattr(embedding_dedup, "linked_pairs", lambda index, of, queries, *rest: asked.append(len(queries)) or search(index, of, queries, *rest))
    links = np.zeros(4000, np.int64)
    for a in range(20):
        for b in range(a + 1, 20):
            if (batch := embedding_dedup.link_shards(shards[a], shards[b], 0.98)) is not None:
                np.add.at(links, batch.column("class").to_numpy(), batch.column("n_links").to_numpy())
    want = ((unit @ unit.T >= 0.98) & (home[:, None] != home)).sum(1)
    assert want.sum() > 100 and links.tolist() == want.tolist()
    assert sum(asked) < 0.6 * 19 * 4000


def test_beams_widen_until_audits_pass():
    """Many links in one place, in an index far larger than a beam: audits meet links, and all are found."""
    rng = np.random.default_rng(22)
    data = rng.normal(size=(3000, 16))
    data[1000:1400] = data[1000] + rng.normal(size=(400, 16)) * 0.05
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    index = hnsw.Hnsw(unit)
    q, c, recall = hnsw.linked_pairs(index, unit, unit, 0.98, same=True)
    truth = {(int(a), int(b)) for a, b in np.argwhere(unit @ unit.T >= 0.98) if a != b}
    assert recall >= 0.999 and len(set(zip(q.tolist(), c.tolist())) & truth) >= 0.999 * len(truth)
    # Without a graph no walk gets anywhere: the audits see it, and beams grow to brute force.
    for links in index.links:
        links[:] = -1
    q, c, recall = hnsw.linked_pairs(index, unit, unit, 0.98, same=True)
    assert recall == 1.0 and set(zip(q.tolist(), c.tolist())) == truth


def test_graph_recall():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(1500, 24)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    graph = hnsw.Hnsw.load(hnsw.Hnsw(data).dump(), data)
    found, _ = graph.search(data[:200], 64)
    best = np.argsort(-(data[:200] @ data.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.tolist(), best.tolist())]) > 0.9


def test_top_k(spark, vectors):
    got = [tuple(r) for r in top_k.top_k(vectors, F.col("vec_id") % 3 == 0, k=2).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    # 9 has no label, which matters not; 12 has another length, 6 to 8 and 10 take no part.
    assert got == [(3, 1, 2, 131072), (3, 2, 1, 65536), (9, 1, 2, 131072), (9, 2, 1, 65536)]
    assert top_k.top_k(vectors, F.col("vec_id") == 11).count() == 0
    rng = np.random.default_rng(4)
    data = rng.integers(-2, 3, size=(300, 4)) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    codes = np.floor(256 * data).astype(int)
    want = [(q, r + 1, c, s) for q in range(0, 300, 7) for r, (s, c) in enumerate((-s, c) for s, c in sorted((-int(codes[q] @ codes[c]), c) for c in range(300) if c != q)[:5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k.top_k(table, F.col("vec_id") % 7 == 0, tile=32, branch=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == want
    assert top_k.top_k(table.limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert top_k.products(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_products_of_any_size_are_exact():
    rng = np.random.default_rng(12)
    whole = lambda a, b: [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(q, r)))) for r in b] for q in a]
    for top in (2.0**10, 2.0**27, 2.0**31, 2.0**45, 2.0**59, 2.0**62, 2.0**200):
        for dim in (1, 3, 64):
            a, b = (np.floor(rng.uniform(-1, 1, (9, dim)) * top ** rng.uniform(0, 1, (9, 1))) for _ in "ab")
            a[0], b[0] = 2.0**31, 2.0**32 / dim
            b[0] = np.floor(b[0])
            assert top_k.products(a, b).tolist() == whole(a, b)
    assert top_k.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_words_fit_the_container():
    """What a session gives Python bounds the words; without that the caller's wish holds."""

    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = self
            self.master, self.defaultParallelism = master, 8
            self.conf = {f"spark.executor.{k.replace('__', '.')}": v for k, v in conf.items()}

        def getConf(self):
            return self.conf

    held = lambda *a, **k: memo.words_held(Session(*a, **k), 100, 400_000_000)
    assert held("local[8]") == held("spark://a:1") == 4_000_000
    assert held("yarn", memory="4g", cores="4") == (4 * 2**30 // 10) // 8 // 100
    assert held("yarn", memory="1g", cores="4") == (384 << 20) // 8 // 100
    assert held("k8s://x", memory="8g", cores="2", memoryOverheadFactor="0.4") == min(400_000_000, int(8 * 2**30 * 0.4) // 4) // 100
    assert held("spark://a:1", pyspark__memory="512m", cores="4") == (512 << 20) // 8 // 100
    assert held("yarn", memoryOverhead="2048", cores="2", memory="64g") == 4_000_000
    assert held("yarn", memoryOverhead="1k", cores="2") == 10_000


def test_top_k_of_large_components_and_the_least_id(spark):
    """Components far beyond 64 bits, products that cancel, fractions and the least id, against Python integers."""
    least, far = -(2**63), [1e25, 2e25, 1e305, 1.7e308, -1e305, 3.5, -0.001, -1e-300, 2.0**52, 2.0**52 + 1, 2.0**44 + 1 / 256, 0.0]
    rng = random.Random(5)
    rows = [(least, [2.0, -1.0]), (1, [1e25, 2e25]), (2, [-2e25, 4e25]), (3, [1.0, 2.0]), (2**63 - 1, [-0.001, 0.5])]
    rows += [(10 + k, [rng.choice(far), rng.choice(far)]) for k in range(40)]
    code = lambda x: math.floor(Fraction(x) * 256)
    want = []
    for q, v in rows:
        scores = [(-max(least, min(2**63 - 1, sum(code(a) * code(b) for a, b in zip(v, w)))), i) for i, w in rows if i != q]
        want += [(q, at + 1, i, -score) for at, (score, i) in enumerate(sorted(scores)[:6])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = top_k.top_k(docs, F.lit(True), k=6, tile=8, branch=2).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_empty_vectors_and_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(top_k, "_RESIDENT", 1)
    rows = [(1, []), (2, []), (3, []), (3, [1.0]), (4, [2.0]), (5, [1e300, 1.0]), (6, [1.0, 2.0]), (7, [-1.0, 0.5])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=3, tile=1, branch=2).orderBy("query_id", "rank").collect()
    top = 2**63 - 1
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(1, 2, 0), (1, 3, 0), (2, 1, 0), (2, 3, 0), (3, 4, 131072), (3, 1, 0), (3, 2, 0), (4, 3, 131072), (5, 6, top), (5, 7, -top - 1), (6, 5, top), (6, 7, 0), (7, 6, 0), (7, 5, -top - 1)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(spark, n=400):
    rng = np.random.default_rng(8)
    words = ["river", "stone", "window", "garden", "letter", "morning", "silver", "travel", "number", "silent"]
    rows, marks = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 10, 80)]
        toxic, bad = i % 4 == 0, i % 5 == 1
        if toxic:
            text[int(rng.integers(0, 80))] = ["nasty", "vile", "rotten"][i % 3]
        rows.append((i, " !! ".join(text).upper() if bad else " ".join(text)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, marks), marks


def test_quality(spark, odd, empty):
    docs, labels, marks = corpus(spark)
    model = quality.train_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    held = [i for i, _, _ in marks if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q, _ in marks if got[i].held_out]) > 0.95
    scored = quality.score_quality(odd, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.keep_quality(odd, model).columns == odd.columns
    lone = quality.train_quality(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score_quality(docs, lone).collect()} == {1}
    none = quality.train_quality(empty, labels_of(spark, [(None, None, None), (1, 7, 7)]))
    assert {round(r.score, 3) for r in quality.score_quality(docs, none).collect()} == {0.5}


def test_toxicity(spark, odd, empty):
    docs, labels, marks = corpus(spark)
    model = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i].toxic == bool(t) for i, _, t in marks if got[i].held_out]) > 0.95
    assert all(r.toxic is not None for r in toxicity.score_toxicity(odd, model).collect())
    # What a fold's model is made of comes from the other folds alone.
    rng = np.random.default_rng(2)
    hashed = [rng.integers(0, 2**63, 30, dtype=np.uint64) for _ in range(40)]
    marks = np.arange(40) % 2 == 0
    for k in np.flatnonzero(marks):
        hashed[k][:2] = [11 if k < 20 else 22, 33]
    hashed = [np.unique(h) for h in hashed]
    view = toxicity._View(hashed, marks, np.arange(40) < 20, 100)
    assert 11 in view.terms and 33 in view.terms and 22 not in view.terms
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 320
    assert toxicity.score_toxicity(empty, model).count() == 0
    calm = toxicity.train_toxicity(docs, labels.where("toxic = 0"))
    assert toxicity.keep_clean(odd, calm).count() == len(TEXTS)


def test_linear_fit_separates():
    rows = [[k % 2, 2 + k % 5] for k in range(200)]
    x = labelled.Design.of(rows, 7)
    w = labelled.fit_linear(x, np.array([r[0] for r in rows], float))
    assert ((labelled.sigmoid(x.times(w)) > 0.5) == np.array([r[0] == 1 for r in rows])).all()


PAGE = """<title>no</title><style>.x, #y{display:none}</style><h1>Head <i>line</i></h1>text<p>one<p>two &amp; three &lt;
<div class="x a">gone</div><div id=y>gone</div><span hidden>gone</span><p style="DISPLAY : none">gone</p><ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>
<table><caption>Cap<tr><th>Name<th>N<tr><td>long cell<td>1<tr><td>x<td rowspan=2>22<tr><td>y</table>after<pre>
 keep  this
   too</pre><details><summary>Sum</summary>gone</details><br>end<template>gone</template><script>var a="</p>gone";</script> <a href=x>li</a>nk"""


def test_html_layout(spark):
    want = "Head line\n\ntext\n\none\n\ntwo & three <\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nCap\nName       N\nlong cell  1\nx          22\ny\n\nafter\n\n keep  this\n   too\n\nSum\nend link"
    got = html_text.render(PAGE)
    assert "gone" not in got
    assert [line for line in got.split("\n") if line] == [line for line in want.split("\n") if line]
    assert html_text.render("<ul><li>one</ul>text<p>x") == "- one\n\ntext\n\nx"
    rows = [(1, PAGE), (2, None), (3, ""), (3, "<"), (None, "<p>a"), (4, "<div>" * 5000 + "deep"), (5, "<!-- open"), (6, "<table><td>a<td>b"), (7, "a < b & c")]
    table = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")
    found = sorted((str(r.page_id), r.text) for r in html_text.extract_text(table).collect())
    assert found == sorted([("1", got), ("2", ""), ("3", ""), ("3", "<"), ("None", "a"), ("4", "deep"), ("5", ""), ("6", "a  b"), ("7", "a < b & c")])
    assert html_text.extract_text(table.limit(0)).count() == 0


def test_html_spans():
    for value, wide in (("3", 3), (" +2x", 2), ("0", 1), ("-4", 1), ("x", 1), ("1000", 1000), ("1001", 1000), ("99999999999999", 1000)):
        page = f'<table><tr><td>a<td>b<tr><td colspan="{value}">wide<td>after</table>'
        assert html_text._span(value, 1, 1000) == wide
        assert html_text.render(page) == ("a     b\nwide  after" if wide == 1 else "a     b\nwide     after" if wide == 2 else "a     b\nwide     after")
    assert [html_text._span(v, 0, 65534) for v in ("0", "65534", "65535", "1000", "")] == [0, 65534, 65534, 1000, 1]
    rows = "".join(f"<tr><td>{k}" for k in range(1500))
    got = html_text.render(f'<table><tr><td rowspan="1200">left<td>x{rows}</table>').split("\n")
    assert got[1199] == "      1198" and got[1200] == "1199"
    # Zero rows: all that are left.
    assert html_text.render(f'<table><tr><td rowspan="0">left<td>x{rows}</table>').split("\n")[1500] == "      1499"
    assert max(len(line) - len(line.lstrip()) for line in html_text.render("<ul><li>" * 400 + "deep").split("\n")) <= 80


def test_html_stray_quotes_comments_and_row_text():
    assert html_text.render("""<a href="x"">link</a> two</p><p class="k">three</p><p id="z">four</p>""") == "link two\n\nthree\n\nfour"
    assert html_text.render("<p title=it's>hello</p><p>world</p>") == "hello\n\nworld"
    assert html_text.render("""<p a="1"'b>x</p><p " c = '>' d = "</p>">y</p><p =e="f>g">z""") == "x\n\ny\n\nz"
    assert html_text.render("""<p class="a""hidden>shown</p><p hidden>not</p><p title= hidden>value</p>""") == "shown\n\nvalue"
    assert html_text.render("a<!-->b<!--->c<!-- > -->d<!--x--!>e<!---->f<!-- open") == "abcdef"
    assert html_text.render("<table><tr>loose <td>a<td>b<tr hidden>not<td>no</tr></table>") == "loose\na  b"
    broken = '<p x="' * 20000
    assert html_text.render(broken) == html_text.render("<" + broken[1:] + "'") == ""


def test_html_of_any_depth(spark):
    for open_ in ("<ul>", "<ol>", "<ul><li>", "<table>", "<table><tr><td>", "<blockquote>", "<dl><dd>", "<div>", "<b>", "<q>", "<details open>", "<pre>", "<ul><li><table><td><blockquote><p>"):
        assert html_text.render(open_ * 5000 + "deep").strip("“” \n").endswith("deep")
    rows = [(k, tag * 3000 + "deep") for k, tag in enumerate(("<ul>", "<ol><li>", "<table><td>", "<blockquote>"))]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(got) == 4 and all(r.text.endswith("deep") for r in got)
    assert html_text.render("<p>a<noscript>seen <b>too</b></noscript>") == "aseen too"


def random_page(rng, depth=0):
    """A random tree as HTML, with end tags left out where they are implied, and its visible words in order."""
    source, words = [], []
    for _ in range(int(rng.integers(1, 4))):
        word = f"w{rng.integers(0, 10**6)}"
        kind = rng.choice(["text", "p", "div", "ul", "table", "span", "hidden", "comment", "pre", "blockquote"]) if depth < 4 else "text"
        inner, own = random_page(rng, depth + 1) if kind in ("div", "span", "blockquote") else ("", [])
        if kind == "text":
            source.append(f" {word} ")
            words.append(word)
        elif kind == "p":
            source.append(f"<p>{word}<b>{word}b</b>" + rng.choice(["</p>", "<div></div>"]))
            words.append(word + word + "b")
        elif kind in ("div", "blockquote"):
            source.append(f"<{kind} class='c'>{inner}</{kind}>")
            words += own
        elif kind == "span":
            # Blocks inside a span end lines, not words, so blanks stand around it.
            source.append(f" <span>{inner}</span> ")
            words += own
        elif kind == "ul":
            end = rng.choice(["", "</li>"])
            source.append(f"<ul><li>{word}{end}<li>{word}x{end}</ul>")
            words += ["-", word, "-", word + "x"]
        elif kind == "table":
            end = rng.choice(["", "</td>"])
            source.append(f"<table><tr><td>{word}{end}<td>{word}y{end}<tr><td>{word}z</table>")
            words += [word, word + "y", word + "z"]
        elif kind == "hidden":
            source.append(rng.choice([f"<div hidden>{word}</div>", f"<i style='display: none'>{word}</i>", f"<script>{word}</script>", f"<em class='gone'>{word}</em>"]))
        elif kind == "comment":
            source.append(f"<!-- {word} -->")
        else:
            source.append(f"<pre>{word}\n  {word}q</pre>")
            words += [word, word + "q"]
    return "".join(source), words


def test_html_shows_the_visible_words_of_random_trees():
    rng = np.random.default_rng(14)
    for _ in range(400):
        source, words = random_page(rng)
        assert html_text.render("<style>.gone{display:none}</style>" + source).split() == words


def test_top_k_keeps_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += rows[1:40] + rows[50:51] + rows[1:20] + [(7, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table.toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    got = top_k.top_k(table, F.col("vec_id") % 50 == 0, tile=16, branch=2).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(connection.execute(queries.ORACLE_SQL["op5_top_k"]).fetchall())


def test_codec_matches_the_library(spark, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, PIECE), PIECE).collect()
    assert len(coded) == len(TEXTS)
    for row in coded:
        assert row.ids == (library.encode(row.text) if row.text else [])
        assert row.decoded == library.decode(row.ids)
    once = sentencepiece_codec.encode(odd, PIECE, decoded=True).collect()
    assert sorted((r.text or "", r.ids, r.decoded) for r in once) == sorted((r.text or "", r.ids, r.decoded) for r in coded)
    assert sentencepiece_codec.encode(empty, PIECE, decoded=True).count() == 0
    codec = sentencepiece_codec.Codec(PIECE)
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abeiothnrs▁é日"), int(n))) for n in rng.integers(1, 40, 500)]
    assert codec.encode_words(words) == codec.encode_words(words, longest=0)


def field(number, kind, payload):
    return bytes([number << 3 | kind]) + payload


def unigram_model(pieces):
    """A tiny unigram model written out by hand: unknown piece, then pieces with scores."""
    out = b""
    for piece, score, kind in [("<unk>", 0.0, 2), *((p, s, 1) for p, s in pieces)]:
        body = field(1, 2, bytes([len(piece.encode())]) + piece.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        out += field(1, 2, bytes([len(body)]) + body)
    trainer = field(3, 0, bytes([1]))
    return out + field(2, 2, bytes([len(trainer)]) + trainer)


def test_codec_refuses_pieces_that_it_would_get_wrong():
    body = field(1, 2, bytes([1]) + b"a") + field(2, 5, np.float32(0).tobytes()) + field(3, 0, bytes([4]))
    with pytest.raises(ValueError, match="user-defined"):
        sentencepiece_codec.Codec(unigram_model([("b", -1.0)]) + field(1, 2, bytes([len(body)]) + body))


def test_viterbi_is_the_best_path():
    pieces = [("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -4.5), ("ba", -5.2), ("aba", -6.9), ("▁a", -3.7), ("bb", -6.5), ("abab", -8.3)]
    codec = sentencepiece_codec.Codec(unigram_model(pieces))
    scores = dict(pieces)

    def best(word):
        ways = [(0.0, [])] + [(-1e9, [])] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 4), end):
                part = word[start:end]
                score = scores.get(part, -8.3 - 10 if len(part) == 1 else None)
                if score is not None and ways[start][0] + score > ways[end][0] + 1e-9:
                    ways[end] = (ways[start][0] + score, ways[start][1] + [part])
        return ways[-1][0]

    rng = np.random.default_rng(9)
    words = ["▁" + "".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 12, 200)]
    for word, ids in zip(words, codec.encode_words(words)):
        own = [codec.pieces[i] for i in np.frombuffer(ids, "<i4")]
        assert "".join(own) == word
        assert abs(sum(scores[p] for p in own) - best(word)) < 1e-4


def test_packing(spark, odd, empty):
    got = packing.pack_documents(odd, WORD, capacity=64).toPandas()
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for i, text in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, 64 * k, len(c), zlib.crc32(c.tobytes())) for k, c in ((k, ids[64 * k : 64 * k + 64]) for k in range(-(-len(ids) // 64)))]
    own = got.assign(doc_id=[str(None) if pd.isna(x) else str(int(x)) for x in got["doc_id"]])
    assert sorted(own[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == part["length"].cumsum().shift(fill_value=0).to_numpy()).all() and part["length"].sum() <= 64
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_of_letters_that_the_tokenizer_takes_apart():
    plain, ours = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha() and not ours._whole([c])]
    assert {"\u0130", "\u0958", "\u09dc", "\u0a33", "\ufb1d"} <= set(letters)
    words = [w for c in letters for w in (c, f"{c}.", f"x{c}y", f"{c}\u0915,", f"\u0915{c}!")]
    texts = ["plain words " + " ".join(words) + " end.", "\u0958\u0932\u092e and \u09aa\u09dc\u09be.", "\ufb1d", "again \ufb1d. \ufb1d, x"]
    for text, ids in zip(texts, ours(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_where_ends_of_words_do_not_match():
    plain, ours = Tokenizer.from_file(WORD), packing.WordIds(WORD)
    ours._whole = lambda words: words
    text = "some words \u0958 and \ufb1d. more, \u09dc\u09dc"
    assert np.frombuffer(ours([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_genetic_search_gains_where_best_fit_is_not_optimal(spark):
    """Triples that fill a sequence exactly; in falling order best fit pairs the large pieces wrongly."""
    rng = np.random.default_rng(3)
    sizes = []
    for _ in range(60):
        a, b = int(rng.integers(520, 800)), int(rng.integers(520, 800))
        sizes += [a, b, 2048 - a - b]
    best_fit = packing.Bins(sizes, 2048)
    best_fit.fit(np.argsort(-np.array(sizes), kind="stable").tolist())
    bins = packing.evolve(sizes, 2048, [], 1, generations=200)
    fills = np.bincount(bins, sizes)
    assert fills.max() <= 2048 and 60 <= len(fills) < len(best_fit.members)
    parts = spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing._PIECES)
    placed = packing.pack(parts, 2048).toPandas()
    assert sorted(placed["row"]) == list(range(len(sizes))) and placed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert placed["sequence_id"].nunique() <= len(best_fit.members)


def test_islands_pass_elites_on(spark):
    """What an island gets from its neighbour is never lost: the result is as good as the best island's."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(300, 1100, 500).tolist()
    lone = min(len(set(packing.evolve(sizes, 2048, [], seed).tolist())) for seed in (0, 10))
    parts = spark.createDataFrame([(k, k, 0, 0, int(n), 0) for k, n in enumerate(sizes)], packing._PIECES)
    assert packing.pack(parts, 2048, islands=3, epochs=3).select("sequence_id").distinct().count() <= lone


def test_genetic_search_is_no_worse_than_best_fit():
    rng = np.random.default_rng(7)
    sizes = rng.integers(200, 900, 400).tolist()
    best_fit = packing.Bins(sizes, 2048)
    best_fit.fit(np.argsort(-np.array(sizes), kind="stable").tolist())
    bins = packing.evolve(sizes, 2048, [], 1, generations=30)
    fills = np.bincount(bins, sizes)
    assert fills.max() <= 2048 and (bins >= 0).all()
    assert len(fills) <= len(best_fit.members)
