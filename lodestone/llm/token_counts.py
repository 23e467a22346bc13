"""Token counts of byte-level BPE without materialising ids.

Pass 1 counts every pre-token of the corpus (map-side first, then by key) and encodes each distinct
one once: the table ``pre-token, total, n_tokens``. Pass 2 turns each text into pre-token
frequencies and joins them to that table: in memory those that are at least one in ``head`` of all
occurrences, of which there can't be more than ``head``; all others by an equi-join on the
pre-token. Sums give the counts. Every hot key is in the head, so none is in the shuffled join.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lodestone.session import materialise

#: Fixed value: the pre-token pattern of the byte-level tokenizers.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 150_000


def is_byte_level(tokenizer: str) -> bool:
    """Whether a tokenizer's file asks for what this module does: the pattern above, byte-level BPE, plain special tokens."""
    with open(tokenizer, encoding="utf-8") as file:
        data = json.load(file)
    before, model = data.get("pre_tokenizer") or {}, data["model"]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in data.get("added_tokens", []))
    return not data.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout") and plain


class Splitter:
    """Pre-tokens of a text; added special tokens are cut out first, each counts as one token."""

    def __init__(self, tokenizer: str):
        if not is_byte_level(tokenizer):
            raise ValueError("only byte-level BPE tokenizers without a normalizer are counted")
        loaded = Tokenizer.from_file(tokenizer)
        special = sorted((t.content for t in loaded.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.find(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1


def _totals(texts: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(tokenizer), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "total"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held.update(split(text.as_py() or "")[0])
                if len(held) >= HELD:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "piece string, total long").groupBy("piece").agg(F.sum("total").alias("total"))


def _encoded(pieces: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Tokenizer.from_file(tokenizer)
        for batch in batches:
            found = encode.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, found), pa.int64())], ["piece", "total", "n_tokens"])

    return pieces.mapInArrow(run, "piece string, total long, n_tokens long")


def _frequencies(docs: DataFrame, tokenizer: str, head) -> DataFrame:
    schema = "doc_id long, n_bytes long, known long, pieces array<string>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, tokens = Splitter(tokenizer), head.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n_bytes, known, pieces, counts = [], [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    found, total = split(text)
                    rest: dict[str, int] = {}
                    for piece, count in Counter(found).items():
                        if (n := tokens.get(piece)) is None:
                            rest[piece] = count
                        else:
                            total += n * count
                    n_bytes.append(len(text.encode()))
                    known.append(total)
                    pieces.append(list(rest))
                    counts.append(list(rest.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
                    ["doc_id", "n_bytes", "known", "pieces", "counts"],
                )

    return docs.mapInArrow(run, schema)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", head: int = 1_000_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row, as the tokenizer library counts its tokens.

    No begin, end or other added tokens; a special token's string inside a text counts as that one
    token, the library's default. A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or
    repeat; each row has its own result. Other columns are ignored; an empty table gives none. Files of
    tokenizers that split texts otherwise are refused.
    """
    Splitter(tokenizer)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = materialise(_encoded(_totals(texts.select("text"), tokenizer), tokenizer), "pieces")
    total = vocabulary.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    top = vocabulary.where(F.col("total") * head >= total).select("piece", "n_tokens").collect()
    shared = docs.sparkSession.sparkContext.broadcast({r.piece: r.n_tokens for r in top})
    rows = materialise(_frequencies(texts, tokenizer, shared).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rest = rows.select("row", F.explode(F.arrays_zip("pieces", "counts")).alias("p")).select("row", F.col("p.pieces").alias("piece"), F.col("p.counts").alias("n"))
    summed = rest.join(vocabulary.select("piece", "n_tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("more"))
    return rows.select("row", "doc_id", "n_bytes", "known").join(summed, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
