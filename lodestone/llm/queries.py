"""The ``opN_`` queries over the corpus tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.embedding_dedup import embedding_duplicates
from lodestone.llm.html_text import extract_text
from lodestone.llm.manifest import manifest
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import score_quality, train_quality
from lodestone.llm.sentencepiece_codec import encode
from lodestone.llm.sharding import shard
from lodestone.llm.spelling import variants
from lodestone.llm.substring_dedup import remove_repeats
from lodestone.llm.token_counts import token_counts
from lodestone.llm.top_k import top_k
from lodestone.llm.toxicity import score_toxicity, train_toxicity
from lodestone.sources.tables import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents"), model, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nothing else has used these workers, so words may take more of their memory than in the pipeline.
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, held=400_000_000)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=20).drop("kept_text")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_counts, op3_sharding, op4_embedding_dedup, op5_top_k, op6_quality, op7_html_text, op8_toxicity, op9_sentencepiece, op10_packing, op11_substring_dedup, op12_spelling_variants, op13_merkle_manifest)}

#: CRC-32 of a list of bytes, a bit at a time; its polynomial is a fixed value.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform({0}, lambda x: [x, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _merkle_sql(levels: int) -> str:
    """Leaves, then ``levels`` levels of nodes with each node's siblings, over sources and over their subroots."""

    def grow(name: str, key: str) -> list[str]:
        out = []
        for k in range(levels):
            out.append(f"{name}{k + 1} AS (SELECT {key}, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node, CASE WHEN any_value(n) > 1 THEN (any_value(n) + 15) // 16 ELSE 1 END AS n FROM {name}{k} GROUP BY {key}, pos // 16)")
            sides = ", ".join(f"coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos {sign} a.pos), '') AS {side}" for sign, side in (("<", "l"), (">", "r")))
            out.append(f"{name}_sides{k} AS (SELECT a.{key} AS {key}, a.pos AS pos, any_value(a.n) > 1 AS grows, {sides} FROM {name}{k} a JOIN {name}{k} b ON a.{key} = b.{key} AND a.pos // 16 = b.pos // 16 GROUP BY a.{key}, a.pos)")
        return out

    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = _CRC32.format("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")
    tables = [
        f"raw AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS node, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad FROM documents)",
        "leaf0 AS (SELECT doc_id, key, node, bad, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM raw)",
        *grow("leaf", "key"),
        f"top0 AS (SELECT 0 AS one, key, node, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM leaf{levels})",
        *grow("top", "one"),
    ]
    joins = "".join(f" JOIN leaf_sides{k} a{k} ON a{k}.key = x.key AND a{k}.pos = x.pos // {16**k}" for k in range(levels)) + " JOIN top0 t ON t.key = x.key" + "".join(f" JOIN top_sides{k} b{k} ON b{k}.pos = t.pos // {16**k}" for k in range(levels))
    folded = "coalesce(x.bad, x.node)"
    proof = []
    for side in (*(f"a{k}" for k in range(levels)), *(f"b{k}" for k in range(levels))):
        proof.append(f"CASE WHEN {side}.grows THEN {side}.l || {side}.r ELSE '' END")
    steps, last = [], f"SELECT x.*, t.node AS subroot, r.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, {folded} AS f0, {', '.join(f'{p}{k}.grows AS {p}{k}g, {p}{k}.l AS {p}{k}l, {p}{k}.r AS {p}{k}r' for p in 'ab' for k in range(levels))} FROM leaf0 x{joins} JOIN top{levels} r ON TRUE"
    steps.append(f"fold0 AS ({last})")
    for k, side in enumerate((*(f"a{k}" for k in range(levels)), *(f"b{k}" for k in range(levels)))):
        steps.append(f"fold{k + 1} AS (SELECT *, CASE WHEN {side}g THEN sha256({side}l || f{k} || {side}r) ELSE f{k} END AS f{k + 1} FROM fold{k})")
    end = f"f{2 * levels}"
    return f"WITH {', '.join(tables + steps)} SELECT doc_id, node AS leaf, subroot, root, proof_sha256, {end} AS folded_root, {end} = root AS verified FROM fold{2 * levels}"


ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN sizes ON doc_id = a GROUP BY a
    """,
    "op4_embedding_dedup": """
        WITH RECURSIVE numbered AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        ), good AS (
            SELECT * FROM numbered
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
              AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.r AS r, a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
              ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), pairs AS (
            SELECT DISTINCT a, b FROM links WHERE a <> b
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM good
            UNION
            SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
        ), component AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), degree AS (
            SELECT r, count(*) AS n FROM links GROUP BY r
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, CASE WHEN n IS NULL THEN vec_id ELSE component_id END AS component_id, coalesce(vec_id = CASE WHEN n IS NULL THEN vec_id ELSE component_id END, TRUE) AS kept
        FROM numbered LEFT JOIN degree USING (r) LEFT JOIN component USING (vec_id)
    """,
    "op5_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS codes
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, coalesce(CAST(list_sum(list_transform(range(1, len(q.codes) + 1), lambda i: q.codes[i] * c.codes[i])) AS BIGINT), 0) AS score
            FROM good q JOIN good c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.codes) = len(c.codes)
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_substring_dedup": r"""
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS d, md5(coalesce(text, '')) AS digest,
              list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w
            FROM documents
        ), windows AS (
            SELECT r, d, digest, pos, array_to_string(w[pos : pos + 19], ' ') AS seq FROM (SELECT *, unnest(range(1, len(w) - 18)) AS pos FROM words WHERE len(w) >= 20)
        ), later AS (
            SELECT r, pos FROM (SELECT r, pos, rank() OVER (PARTITION BY seq ORDER BY d, digest, pos) AS place FROM windows) WHERE place > 1
        ), gone AS (
            SELECT DISTINCT r, pos + k AS pos FROM later, range(0, 20) AS g(k)
        ), cut AS (
            SELECT r, list(pos) AS ats FROM gone GROUP BY r
        ), kept AS (
            SELECT doc_id, len(w) AS n_words, coalesce(len(ats), 0) AS n_removed,
              CASE WHEN ats IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ats, x[2])), lambda x: x[1]) END AS rest
            FROM words LEFT JOIN cut USING (r)
        )
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
    """,
    "op12_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
        ), summed AS (
            SELECT run, n, doc_id, {_CRC32.format("flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(c) - 64] END))")} AS h FROM counted
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
              SELECT n, CASE WHEN coalesce(h % 199 = 0, FALSE) THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM summed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), shorter AS (
            SELECT word, n, pos, left(word, CAST(pos AS INTEGER)) || substr(word, CAST(pos AS INTEGER) + 2) AS less FROM (SELECT *, unnest(range(0, length(word))) AS pos FROM words)
        ), near AS (
            SELECT a.word AS word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.less = b.less AND a.pos = b.pos AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
            UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
        ), ways AS (
            SELECT word, word AS pos FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.pos WHERE f.form IS NOT NULL
        ), ends AS (
            SELECT ways.word, ways.pos AS root FROM ways JOIN forms f ON f.word = ways.pos WHERE f.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
    # Five levels hold 16^5 leaves a source, far more than the tables the SQL is for.
    "op13_merkle_manifest": _merkle_sql(5),
}
