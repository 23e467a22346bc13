"""Spelling variants: words one edit apart, found by bands of letter parities.

A word's mask has a bit for each letter (of 64 classes) that tells whether its number is odd. Inserting
or deleting a letter flips one bit, replacing one flips two or none. The mask is split into three
bands. So near words agree in two bands, the third differing by at most two bits, or, of equal length, in one
band, each of the others differing by one bit and so in the parity of its bits. These are equi-joins on
the length, the bands and those parities. Inside the join the bits of the bands decide first, then
hashes of the words' halves (one edit leaves one half as it is), then the words. Buckets of bands are
counted; a row meets large ones in parts of a bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import materialise

#: Distinct words that a task holds before it passes their counts on.
_HELD = 150_000
#: Words of a part of a bucket.
_PART = 4000
#: Large buckets whose sizes are broadcast at most.
_BUCKETS = 100_000
#: Runs of letters; A-Z are in lower case before it is applied.
_LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Letters of the three bands: common and rare ones are mixed, so that keys spread.
_BANDS = ("enscuypxq", "tihlmgbjz", "aordwfvk")


def _variant(word: str, start: int, every: int) -> str:
    """``word``, or without one of its letters where ``every`` divides the checksum begun with ``start``."""
    value = zlib.crc32(word.encode(), start)
    if value % every:
        return word
    at = value % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """``word, n``: words of at least ``least`` letters over whole texts, deletions done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = Counter(_LETTERS.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                start = None if doc.as_py() is None else zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in found.items():
                    # What is shorter has no part, whether a letter goes or not.
                    if len(word) >= least and len(word := word if start is None else _variant(word, start, every)) >= least:
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
        yield out()

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mask(letters: str, word: Column) -> Column:
    """Parities of ``letters``, and of every other character that falls to this band, as bits of a number."""
    bits = [((F.char_length(word) - F.char_length(F.replace(word, F.lit(c)))) % 2).cast("long") * (1 << k) for k, c in enumerate(letters)]
    return sum(bits[1:], bits[0])


def _accents(word: Column, band: int) -> Column:
    """Parities of the letters from U+00C0 on that belong to ``band``, in four classes."""
    codes = [0xC0 + k for k in range(64) if k % 3 == band]
    out = F.lit(0).cast("long")
    for part in range(4):
        own = "".join(chr(c) for c in codes[part::4])
        others = F.translate(word, own, "")
        out = out + ((F.char_length(word) - F.char_length(others)) % 2).cast("long") * (1 << (part + 12))
    return out


def masked(words: DataFrame) -> DataFrame:
    """``words`` with their length, the three bands of their mask, the parities of these and hashes of halves.

    ``head`` and ``tail`` are the halves of a word, ``head1`` and ``tail1`` those of a word one shorter
    from which this one may come by an insertion.
    """
    word, size = F.col("word"), F.char_length("word")
    # Most words have no accents; the test spares them twelve passes.
    plain = word.rlike("^[a-z]*$")
    bands = {f"b{k}": _mask(_BANDS[k], word) + F.when(plain, F.lit(0).cast("long")).otherwise(_accents(word, k)) for k in range(3)}
    half, short = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    halves = {"head": F.left(word, half), "tail": F.right(word, size - half), "head1": F.left(word, short), "tail1": F.right(word, size - 1 - short)}
    out = words.withColumns({"len": size, **bands, **{name: F.xxhash64(part) for name, part in halves.items()}})
    return out.withColumns({f"p{k}": F.bit_count(f"b{k}") % 2 for k in range(3)})


def _apart(band: int) -> Column:
    """In how many bits a band of the two words differs."""
    return F.bit_count(F.col(f"x.b{band}").bitwiseXOR(F.col(f"y.b{band}")))


def _met(left: DataFrame, right: DataFrame, left_key: list[Column], right_key: list[Column], near: Column, part: int) -> DataFrame:
    """Pairs of near words whose keys are equal and of which ``near`` holds.

    A large bucket is met in parts: each of its rows has one part as the first word, all as the second.
    """
    names = [f"k{i}" for i in range(len(left_key))]
    left, right = (rows.withColumns(dict(zip(names, key))) for rows, key in ((left, left_key), (right, right_key)))
    sizes = left.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    sizes = materialise(sizes.select(*names, F.ceil(F.col("_n") / part).alias("_parts")), "buckets")
    sizes = F.broadcast(sizes) if sizes.count() <= _BUCKETS else sizes
    own = F.coalesce("_parts", F.lit(1).cast("long"))
    left = left.join(sizes, names, "left").withColumn("_part", F.pmod(F.xxhash64("word"), own))
    right = right.join(sizes, names, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), own - 1)))
    for name in (*names, "_part"):
        near = (F.col(f"x.{name}") == F.col(f"y.{name}")) & near
    pairs = left.alias("x").join(right.hint("shuffle_hash").alias("y"), near & (F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1))
    return pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb"))


def near_words(words: DataFrame, part: int = _PART) -> DataFrame:
    """``a, na, b, nb``: each pair of words one edit apart once."""
    known = materialise(masked(words), "masks")
    same = (F.col("x.word") < F.col("y.word")) & ((F.col("x.head") == F.col("y.head")) | (F.col("x.tail") == F.col("y.tail")))
    longer = (F.col("y.len") == F.col("x.len") + 1) & ((F.col("x.head") == F.col("y.head1")) | (F.col("x.tail") == F.col("y.tail1")))
    # As the second word, a word meets those of its own length and those one shorter.
    twice = known.withColumn("met", F.explode(F.array("len", F.col("len") - 1)))
    found = []
    for k in range(3):
        one, other = (i for i in range(3) if i != k)
        bands = [F.col(f"b{one}"), F.col(f"b{other}")]
        # Words that agree in all three bands are found with the first.
        replaced = (F.col("y.len") == F.col("x.len")) & ((_apart(k) == 2) if k else _apart(k).isin(0, 2)) & same
        found.append(_met(known.withColumn("met", F.col("len")), twice, [F.col("met"), *bands], [F.col("met"), *bands], replaced | ((_apart(k) == 1) & longer), part))
        flipped = [1 - F.col(f"p{one}"), 1 - F.col(f"p{other}")]
        found.append(_met(known, known, [F.col("len"), F.col(f"b{k}"), F.col(f"p{one}"), F.col(f"p{other}")], [F.col("len"), F.col(f"b{k}"), *flipped], (_apart(one) == 1) & (_apart(other) == 1) & same, part))
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, ratio: int = 5, every: int = 199, part: int = _PART) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``letters`` code points and ``least`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case. Where ``every`` divides the
    CRC-32 of ``<id>:<word>``, that document's word loses the code point at the checksum modulo its
    length; a row without an id loses none. Near words differ by exactly one inserted, deleted or replaced
    code point. A word's form is its near word of largest n (ties: the first in code-point order) if that
    n is at least ``ratio`` times its own; its root follows forms to the last. A null text has no words;
    repeated rows count again. Other columns are ignored; a table without words gives none.
    """
    words = materialise(word_counts(docs, id_col, text_col, letters, every).where(F.col("n") >= least), "words")
    pairs = materialise(near_words(words, part), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("top"))
    form = both.join(best.select("word", "top"), "word").where("near_n = top").groupBy("word").agg(F.min("near").alias("near"))
    known = words.join(best, "word", "left").join(form, "word", "left")
    good = F.col("top") >= ratio * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("top")).alias("form_n")), "forms")
    # Counts grow along forms, so ways end; each round doubles how far a step goes.
    steps = known.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        steps = materialise(steps, "steps")
        further = steps.join(steps.select(F.col("word").alias("to"), F.col("to").alias("next")), "to")
        if further.isEmpty():
            break
        steps = steps.join(further.select("word", "next"), "word", "left").select("word", F.coalesce("next", "to").alias("to"))
    return known.join(steps.withColumnRenamed("to", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
