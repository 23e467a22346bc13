"""The pipeline against its stages done plainly, one after another, and on odd tables."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import near_dedup, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    harmful = {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).where("toxic").collect()}
    clean = docs.where(~F.col("doc_id").isin(list(harmful) or [-1]))
    model = quality.train_quality(clean, labels)
    good = {r.doc_id for r in quality.score_quality(clean, model).where("predicted = 1").collect()}
    kept = clean.where(F.col("doc_id").isin(list(good)))
    unique = {r.doc_id for r in near_dedup.near_duplicates(kept).where("kept").collect()}
    assert {r.doc_id for r in rows} == unique
    assert 0 < len(unique) < docs.count()


def test_every_stage_but_the_last_returns_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).select([F.lit(None).cast(t).alias(c) if c != "doc_id" else F.col(c) for c, t in docs.dtypes])
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, SF).columns == docs.columns, name
            stage(spark, table, SF).count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_all_stages_on_repeated_ids_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = {"rep": "x", "component_id": "y", "row": "z", "score": "s", "digest": "d", "_gone": "g", "hub": "h"}
    docs = docs.unionByName(docs.limit(20)).withColumns({k: F.lit(v) for k, v in names.items()}).withColumn("label", F.lit(3)).cache()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
    plain = lambda text: (lambda w: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set())(tuple((text or "").encode().lower().split()))
    rows = {r.doc_id: plain(r.text) for r in before.select("doc_id", "text").collect()}
    root = {i: i for i in rows}
    linked = [(a, b) for a in rows for b in rows if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b])]
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in rows if root[i] == i}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in kept.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, len(part), zlib.crc32(part.tobytes())) for k, part in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    assert sorted(packed[["doc_id", "piece", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["length"].sum() <= 2048 and (part["offset"] == part["length"].cumsum().shift(fill_value=0)).all()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
