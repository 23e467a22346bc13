"""Substring dedup, spelling variants and the manifest against plain versions, on odd tables too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import manifest as mf
from lodestone.llm import queries, spelling, substring_dedup
from test_ops import CLASH, CLASH_VALUES, TEXTS

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"p{k}" for k in range(30))
REPEATS = [
    (20, f"one {PASSAGE} two"), (21, f"three {PASSAGE} four {PASSAGE}"), (19, PASSAGE.rsplit(" ", 11)[0]),
    (22, "x " * 70), (23, " ".join(["y"] * 19)), (24, " ".join(["y"] * 20)), (25, " ".join(["y"] * 21)),
    (26, f"{PASSAGE}\x1c {PASSAGE}\n{PASSAGE}"), (21, f"same id, {PASSAGE} other text"), (None, f"no id {PASSAGE}"), (None, f"no id {PASSAGE}"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in TEXTS + REPEATS], f"doc_id long, text string, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {CLASH}")


def plain_removal(rows, width):
    split = [(-(2**63) if i is None else i, hashlib.md5((t or "").encode()).digest(), (t or "").encode().split(), i) for i, t in rows]
    first = {}
    for d, digest, words, _ in split:
        for at in range(len(words) - width + 1):
            key = tuple(words[at : at + width])
            first[key] = min(first.get(key, (d, digest, at)), (d, digest, at))
    out = []
    for d, digest, words, own in split:
        gone = set()
        for at in range(len(words) - width + 1):
            if first[tuple(words[at : at + width])] < (d, digest, at):
                gone.update(range(at, at + width))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((own, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def removal(docs, **options):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(docs, **options).collect()), key=repr)


def test_substring_dedup_matches_brute_force(spark, odd, empty):
    rows = TEXTS + REPEATS
    assert removal(odd) == plain_removal(rows, 20)
    for width in (1, 5, 8):
        assert removal(odd, width=width) == plain_removal(rows, width)
    assert removal(empty) == []


def test_substring_dedup_loses_nothing_to_a_full_sketch(spark, odd):
    """A sketch of few cells takes every window for repeated; the exact pass alone decides then."""
    assert removal(odd, most_cells=16) == plain_removal(TEXTS + REPEATS, 20)


def test_substring_dedup_without_broadcasts(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_IDS", -1)
    monkeypatch.setattr(substring_dedup, "_HELD", 40)
    assert removal(odd) == plain_removal(TEXTS + REPEATS, 20)


def test_anchors_never_underestimate():
    rng = random.Random(3)
    windows = substring_dedup.Windows(20)
    seen, anchors = Counter(), Counter()
    own = {}
    for _ in range(40):
        turn = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        words = [turn[k % len(turn)] for k in range(rng.randrange(20, 120))]
        codes = windows.codes(" ".join(words))
        found, which = windows.anchors(codes)
        anchors.update(found.tolist())
        for at, k in enumerate(which.tolist()):
            seen[key := tuple(words[at : at + 20])] += 1
            assert own.setdefault(key, int(found[k])) == int(found[k])
    assert all(anchors[own[w]] >= n for w, n in seen.items()) and max(seen.values()) > 1


def test_places_go_on_over_blocks(monkeypatch):
    windows = substring_dedup.Windows(20)
    codes = windows.codes(" ".join(str(k * k % 97) for k in range(300)))
    whole = windows.anchors(codes)
    monkeypatch.setattr(substring_dedup, "_BLOCK", 64)
    parts = windows.anchors(codes)
    assert all((a == b).all() for a, b in zip(whole, parts))


def plain_variants(rows, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]

    others = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(o, key=lambda v: (-words[v], v)) for w, o in others.items() if o}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(others[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items())


def spelt(docs, **options):
    return sorted(tuple(r) for r in spelling.variants(docs, **options).collect())


def wordy(seed, count=60):
    """Chains of variants, ties, accents in either case, words of one edit in every place."""
    rng = random.Random(seed)
    bases = ["spelling", "naïveté", "ÀÉÎõüß", "aaaaaaa", "étéétéé", "ÿÿÿÿÿÿ", "letters", "abcdef"]
    words = []
    for base in bases:
        for _ in range(25):
            w, at = list(base), rng.randrange(len(base))
            kind = rng.randrange(4)
            if kind == 0:
                w[at] = rng.choice("abzé÷")
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, rng.choice("abzéÉ"))
            words.append("".join(w))
    rows = []
    for k in range(count):
        rows.append((k, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(200))))
    return rows


def test_spelling_matches_brute_force(spark, odd, empty):
    rows = wordy(1) + [(None, "spelling " * 700 + "speling " * 30 + "spelng " * 6), (7, None), (8, ""), (9, "x" * 50_000), (9, "ab1cdefg-hijklmn")]
    docs = spark.createDataFrame([(i, t, *CLASH_VALUES) for i, t in rows], f"doc_id long, text string, {CLASH}").repartition(3)
    want = plain_variants(rows)
    assert spelt(docs) == want and any(r[3] for r in want) and max(r[2] for r in want) > 5
    # Buckets in parts of three words, and deletions all over.
    assert spelt(docs, part=3, every=2) == plain_variants(rows, every=2)
    assert spelt(odd) == plain_variants(TEXTS + REPEATS)
    assert spelt(empty) == []


def test_roots_follow_forms(spark):
    text = "spellingg " * 5 + "spelling " * 40 + "speling " * 300
    rows = [(None, text)]
    got = {r[0]: (r[3], r[5]) for r in spelt(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {"spellingg": ("spelling", "speling"), "spelling": ("speling", "speling"), "speling": (None, "speling")}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = at // 16 * 16
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    def leaf(row, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    by = {}
    for row in rows:
        bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        by.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, row[4] and row[4].translate(LOW)) if bad else None))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in by[s]]) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, upper in zip(sources, above):
        for (d, node, bad), path in zip(by[s], trees[s][1]):
            folded = bad or node
            for left, right in path + upper:
                folded = digest(left + folded + right)
            out.append((d, node, trees[s][0], root, digest("".join(a + b for a, b in path + upper)), folded, folded == root))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = "key string, node string, pos int, n int, above string, tampered string, block int"
VALUES = ("k", "n", 1, 2, "a", "t", 3)


def leaves_of(spark, rows):
    return spark.createDataFrame([(*r, *VALUES) for r in rows], f"{FIELDS}, {NAMES}").repartition(3)


def manifested(docs):
    return sorted((tuple(r) for r in mf.manifest(docs, parts=5).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 2, 300], [1] * 18])
def test_manifest_matches_a_plain_tree(spark, sizes):
    rows = [(k * 3, f"s{s}", "en", k, f"Text {k} of {s}: É") for s, size in enumerate(sizes) for k in range(size)]
    got = manifested(leaves_of(spark, rows))
    assert got == plain_manifest(rows)
    assert len({r[3] for r in got}) == 1


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of one level, so that each of three levels is a round of its own."""
    monkeypatch.setattr(mf, "_DEEP", 1)
    monkeypatch.setattr(mf, "_BLOCK", 16)
    rows = [(k, "big" if k % 3 else f"s{k % 40}", None, None, "A" * (k % 5)) for k in range(700)]
    assert manifested(leaves_of(spark, rows)) == plain_manifest(rows)


def test_manifest_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, None, "", 0, ""), (5, "", "x", 0, "Ab"), (5, "", "x", 0, "Ab"), (5, "", "x", 1, "Ab"), (-3, "é", None, -1, "É" * 3000), (7, "z", None, 2, None), (15, "z", "Q", 2, "ABC")]
    got = manifested(leaves_of(spark, rows))
    assert got == plain_manifest(rows)
    assert manifested(leaves_of(spark, []).limit(0)) == []
    assert all(r[6] for r in got if r[0] is None)


def test_manifest_runs_no_python_and_no_join_of_texts(spark):
    plan = mf.manifest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "documents" not in plan


def test_queries_keep_to_their_contracts(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    removed = queries.op11_substring_dedup(spark, SF)
    assert removed.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"] and removed.count() == n
    words = queries.op12_spelling_variants(spark, SF)
    assert words.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, words.select("word", "n", "n_near", "form", "form_n", "root").collect())) == plain_variants(rows)
    proved = queries.op13_merkle_manifest(spark, SF)
    assert proved.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert proved.count() == n and 0 < proved.where("NOT verified").count() < n // 3
    assert np.isin(proved.select(F.length("root").alias("n")).distinct().toPandas()["n"], [64]).all()
