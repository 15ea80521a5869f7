"""Phrase mining, substring deduplication and the Merkle manifest against
brute force, on texts with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, phrase_mining, substring_dedup, word_arrays
from tessera.llm.common import ship_package
from tessera.llm.phrase_trie import PhraseTrie

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n long, phrase string, anchor int, "
          "_key int, _id int, pos int, node string")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.fixture(scope="module")
def rows(spark):
    ship_package(spark)
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(
        "/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    noise = lambda k: " ".join(f"n{rng.randrange(10 ** 9)}" for _ in range(k))
    long = [f"w{rng.randrange(900)}" for _ in range(30_000)]
    made = [
        (2000, None, None, None), (2001, "", "en", "src0"), (2002, " \t\n\x0b", "xx", None), (None, "no id", "en", None),
        (None, "no id", "en", None), (2003, f"{noise(20)} {passage} {noise(5)}", "en", "src0"),
        (2004, f"{noise(3)}\n{passage.replace('p30 ', 'x30 ')}", "de", "src1"), (2005, passage, "de", "src1"),
        # a passage twice in one text, overlapping copies of one word, exactly 35 and 34 words
        (2006, f"{passage} {noise(2)} {passage}", "en", "a"), (2007, "ha " * 50, "en", "a"),
        (2008, " ".join(f"p{i}" for i in range(5, 40)), "en", "b"), (2009, " ".join(f"p{i}" for i in range(5, 39)), "en", "b"),
        (2010, " ".join(long), "en", "src0"), (2011, " ".join(long[:15_000] + ["cut"] + long[15_000:]), "en", "src0"),
        (2012, "日本語 🙂 The CAT. the cat, the cat! THE CAT?\nthe\x0ccat the\x1ccat É é", "fr", "b"),
        (2013, "a b\nc\n\nd", "en", "ü"), (2005, passage, "de", "src1"),
    ]
    return real + made


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(*r, None if r[1] is None else len(r[1]), 1, "x", 2, 3, 4, 5, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def best_phrases(rows, least, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if 100 * a >= 80 * found[p[i:i + k]]}
        own = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, total[lang], -score)
                for n, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"limit": 50, "chunk": 200}])
def test_phrases(docs, rows, bounds):
    got = phrase_mining.mine_phrases(docs, least=3, top=40, **bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == best_phrases(rows, 3, 40)


def test_phrases_of_nothing(none):
    assert phrase_mining.mine_phrases(none).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "a b", 2, 9 * 10 ** 15), ("en", "a", 1, 10 ** 16 + 1), ("en", "b", 1, 2 * 10 ** 16)],
        "lang string, phrase string, size int, n long")
    row = phrase_mining.best_cuts(counts).first()
    assert row.score == 2_000_000 * 9 * 10 ** 15 // (3 * 10 ** 16 + 1)


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_trie_counts_through_bursts_and_spills(words):
    rng = np.random.default_rng(words)
    trie, want, got, runs = PhraseTrie(words, burst=20, limit=200), Counter(), Counter(), 0

    def take(keep):
        nonlocal runs
        for columns, counts in trie.spill(keep, 30):
            runs += 1
            for key, n in zip(zip(*(c.tolist() for c in columns)), counts.tolist()):
                got[key] += n

    for _ in range(30):
        phrases = sorted({tuple(map(int, p)) for p in rng.integers(0, 9, (80, words))})
        counts = rng.integers(1, 5, len(phrases))
        trie.add([np.array(c) for c in zip(*phrases)], counts)
        want.update(dict(zip(phrases, counts.tolist())))
        if len(trie) >= 200:
            take(50)
            assert len(trie) <= 50
    take(0)
    assert got == want and len(trie) == 0 and runs > 0


def without_repeats(rows, window):
    seen, texts = Counter(), []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.append((i, words))
        seen.update(tuple(words[s:s + window]) for s in range(len(words) - window + 1))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(found):
    return sorted(map(tuple, found), key=lambda r: [(v is None, v) for v in r])


@pytest.mark.parametrize("window, k", [(35, 12), (35, 20), (4, 2)])
def test_substrings(docs, rows, window, k):
    got = substring_dedup.remove_repeats(docs, window=window, k=k)
    assert order(got.collect()) == order(without_repeats(rows, window))


def test_substrings_over_small_blocks(docs, rows, monkeypatch):
    """Long texts are cut into blocks and slices; windows across the cuts count."""
    texts = [r for r in rows if r[0] in (2003, 2005, 2006, 2010, 2011)]
    column = pa.array([t.encode() for _, t, *_ in texts], pa.binary())
    numbers, text = word_arrays.numbered_words(column, substring_dedup._SPACES)
    spans = list(substring_dedup.blocks(numbers, text, 35))
    monkeypatch.setattr(substring_dedup, "BLOCK", 1000)
    parts = list(substring_dedup.blocks(numbers, text, 35))
    assert len(parts) > len(spans)
    starts = sorted(s for lo, hi in parts for s in range(lo, hi - 34))
    assert starts == list(range(len(numbers) - 34))


def test_substrings_of_nothing(none):
    assert substring_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("size", [8, 64, 1 << 19])
def test_words_do_not_depend_on_slices(size, monkeypatch):
    texts = ["", " ", "one two\tone", "x" * 300 + " y", "é\x0b\x0c日本 \x85 \xa0a", "two"] * 3
    monkeypatch.setattr(word_arrays, "SLICE", size)
    column = pa.array([t.encode() for t in texts], pa.binary()).slice(1)
    breaks, names, owners = word_arrays.byte_class(word_arrays.SPACES), [], []
    numbers = []
    for first, _, data, offsets in word_arrays.slices(column, breaks, size):
        found = word_arrays.words_in(data, offsets, first, breaks)
        names += [bytes(data[a:b]).decode() for a, b in zip(found.starts, found.ends)]
        owners += found.text.tolist()
        numbers += found.numbers().tolist()
    want = [(i, w) for i, t in enumerate(texts[1:]) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert list(zip(owners, names)) == want
    assert len(set(numbers)) == len(set(names)) == len(set(zip(numbers, names)))


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return hashed(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes):
    """(root, path of every node) level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            start = p - p % 3
            run = nodes[start:start + 3]
            paths[i].append(("".join(run[:p - start]), "".join(run[p - start + 1:])))
        place = [p // 3 for p in place]
        nodes = [hashed(*nodes[s:s + 3]) for s in range(0, len(nodes), 3)]
    return nodes[0], paths


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for r, path in zip(groups[s], trees[s][1]):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            node = leaf(changed)
            for left, right in path + above:
                node = hashed(left, node, right)
            proof = hashed(*(a + b for a, b in path + above))
            out.append((r["doc_id"], leaf(r), trees[s][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(docs, levels):
    want = manifest([r.asDict() for r in docs.collect()])
    got = merkle.verify_tampering(docs, levels=levels)
    assert order(got.collect()) == order(want)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"t\n{i}", "en", "s", 3, *[None] * 7) for i in range(n)]
    one = spark.createDataFrame(rows, SCHEMA)
    assert order(merkle.verify_tampering(one, levels=2).collect()) == order(manifest([r.asDict() for r in one.collect()]))


def test_manifest_of_a_hot_source_is_numbered_in_parts(spark):
    """A third of all rows in one source, and one id in many rows."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.lit(1).cast("long").alias("n_chars"))
    assert order(merkle.verify_tampering(df, levels=3).collect()) == order(manifest([r.asDict() for r in df.collect()]))


def test_manifest_of_nothing(none):
    assert merkle.verify_tampering(none).collect() == []
