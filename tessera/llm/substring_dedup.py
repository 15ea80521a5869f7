"""Substring deduplication by seed and extend (operator 12).

**Seeds.**  Every stretch of ``window`` words holds ``window - k + 1`` runs of
k words; the run with the least hash (the leftmost of equal ones) is its
anchor.  The choice depends on the stretch alone, so equal stretches have the
same anchor at the same place.  Neighbouring stretches mostly share an anchor:
one seed stands for all windows of a text around one anchor, and its context
is the text from the first to the last of them.

**Extend.**  Seeds meet on their anchors.  A context that occurs twice is a
match extended to both ends of the seed: all its windows are repeated.  The
other seeds of an anchor are compared window by window, i.e. by every extension
of the anchor to the left and right that is as long as the threshold; one seed
stands for all with the same context, so no pairs are formed within a group.

**Maximal repeats.**  Repeated windows that overlap or touch are joined, per
text, to maximal spans of words.

A window is known by its anchor's hash and its own, 128 bits together.  Anchors
that occur once are dropped after a count that moves nothing but hashes.

Defined results: a null text is empty; texts shorter than the threshold keep
all words; repeated rows are repeats of each other, each gets a row; ids may
repeat or be null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import bitmap, perhaps
from tessera.llm.common import join_by_key, saved, whole_text
from tessera.llm.word_arrays import SPACES, byte_class, mixed, numbered_words, powers, slices, words_in

#: Words of a window, and words of an anchor.
WINDOW = 35
ANCHOR_WORDS = 12
#: Words that are hashed at a time.
BLOCK = 1 << 20
_PLACE = np.uint64(BLOCK - 1)
_BASE = 0x2545F4914F6CDD1D
_SPACES = byte_class(SPACES)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    return powers(np.uint64(_BASE), BLOCK + 1), powers(np.uint64(pow(_BASE, -1, 1 << 64)), BLOCK + 1)


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def block_seeds(numbers: np.ndarray, text: np.ndarray, window: int, k: int):
    """Seeds of one block of words, as arrays: (first, last) window start,
    anchor hash, context hash; and the window hashes of all starts."""
    n = len(numbers)
    up, down = _tables()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(numbers * up[:n], out=sums[1:])

    def hashed(lo, hi):
        return mixed((sums[hi] - sums[lo]) * down[lo])

    runs = mixed((sums[k:] - sums[:-k]) * down[:n - k + 1])
    keyed = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
    least = (sliding_least(keyed, window - k + 1) & _PLACE).astype(np.int64)
    starts = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), hashed
    at = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    i = np.flatnonzero(new)
    first, last, at = starts[i], starts[np.append(i[1:], len(starts)) - 1], at[i]
    shape = ((at - first) * window + (last - first)).astype(np.uint64)
    context = mixed(hashed(first, last + window) ^ mixed(shape + np.uint64(1)))
    return first, last, runs[at], context, hashed


def blocks(numbers: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of words of at most BLOCK words; every window is in exactly one."""
    at, n = 0, len(numbers)
    while n - at >= window:
        end = min(at + BLOCK, n)
        yield at, end
        if end == n:
            return
        at = end - window + 1


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def anchors_of(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, context) of every seed; ``texts`` has _text as binary."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, text = numbered_words(batch.column("_text"), _SPACES)
            for lo, hi in blocks(numbers, text, window):
                _, _, anchor, context, _ = block_seeds(numbers[lo:hi], text[lo:hi], window, k)
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(context)], ["anchor", "context"])

    return texts.select("_text").mapInArrow(rows, "anchor long, context long")


def shared_seeds(texts: DataFrame, shared: np.ndarray, mixed_up: np.ndarray, window: int, k: int) -> DataFrame:
    """Seeds whose anchor may occur twice: _key, first and last window start
    (in words of the text), anchor, context, and, where the anchor may have
    several contexts, the hashes of all windows."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((shared, mixed_up))  # two bitmaps of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, mixed_bits = held.value
        for batch in batches:
            numbers, text = numbered_words(batch.column("_text"), _SPACES)
            begin = np.searchsorted(text, np.arange(batch.num_rows))  # first word of each text
            for lo, hi in blocks(numbers, text, window):
                first, last, anchor, context, hashed = block_seeds(numbers[lo:hi], text[lo:hi], window, k)
                keep = np.flatnonzero(perhaps(shared_bits, anchor))
                first, last, anchor, context = first[keep], last[keep], anchor[keep], context[keep]
                own = text[lo + first]
                several = perhaps(mixed_bits, anchor)
                sizes = np.where(several, last - first + 1, 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                starts = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(first, sizes)
                windows = hashed(starts, starts + window)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(windows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(own)), pa.array(lo + first - begin[own]),
                     pa.array(lo + last - begin[own]), _signed(anchor), _signed(context), lists],
                    ["_key", "first", "last", "anchor", "context", "windows"])

    return texts.select("_key", "_text").mapInArrow(
        rows, "_key binary, first long, last long, anchor long, context long, windows array<long>")


def repeated_spans(texts: DataFrame, *, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """(_key, first, last): ranges of repeated windows, by their first words.

    ``texts`` has a row per occurrence of a text, _key (a digest of it) and
    _text as binary."""
    stats = saved(anchors_of(texts, window, k).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("several"))
        .filter("n > 1").select("anchor", "several"))
    seeds = saved(shared_seeds(texts, bitmap(stats, "anchor"), bitmap(stats.filter("several"), "anchor"), window, k))
    same = ["anchor", "context"]
    counts = saved(seeds.groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    whole = join_by_key(seeds.select("_key", "first", "last", *same), counts.filter("n > 1"), same, "n").select(
        "_key", "first", "last").distinct()

    # one seed for each context of the anchors that have several; what many rows have is one row here
    contexts = saved(seeds.filter(F.size("windows") > 0).groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("_key", "first", "windows")).alias("seed")))
    lone = saved(contexts.filter("n = 1").select("seed._key", "seed.first", "anchor", F.posexplode("seed.windows").alias(
        "step", "hash")).select("_key", (F.col("first") + F.col("step")).alias("first"), "anchor", "hash"))
    met = contexts.filter("n > 1").select("anchor", F.explode("seed.windows").alias("hash"))
    held = saved(lone.select("anchor", "hash").unionByName(met).groupBy("anchor", "hash")
                 .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    part = join_by_key(lone, held, ["anchor", "hash"], "n").select("_key", "first", F.col("first").alias("last"))
    return whole.unionByName(part)


def kept_words(docs: DataFrame, id_kind: str, window: int) -> DataFrame:
    """Apply spans to texts: (_id, n_words, n_removed, kept_sha256)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans = batch.column("_text"), batch.column("spans").to_pylist()
            total = np.zeros(batch.num_rows, dtype=np.int64)
            removed = np.zeros(batch.num_rows, dtype=np.int64)
            digests = [hashlib.sha256() for _ in range(batch.num_rows)]
            begun = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, data, offsets in slices(column, _SPACES):
                words = words_in(data, offsets, lo, _SPACES)
                keep = np.ones(len(words.starts), dtype=bool)
                border = np.searchsorted(words.text, np.arange(lo, hi + 1))
                for t in range(lo, hi):
                    a, b = border[t - lo], border[t - lo + 1]
                    for first, last in ((s["first"], s["last"]) for s in spans[t] or ()):
                        keep[max(a, a + first - total[t]):max(a, min(b, a + last + window - total[t]))] = False
                    total[t] += b - a
                # each kept word with a space in front
                starts, ends = words.starts[keep], words.ends[keep]
                sizes = ends - starts + 1
                place = np.cumsum(sizes)
                at = np.arange(int(place[-1]) if len(place) else 0) - np.repeat(place - sizes, sizes) + np.repeat(
                    starts - 1, sizes)
                out = data[at]
                out[place - sizes] = 0x20
                border_kept = np.searchsorted(words.text[keep], np.arange(lo, hi + 1))
                ends_out = np.concatenate([[0], place])[border_kept]
                view = memoryview(out.tobytes())
                for t in range(lo, hi):
                    a, b = ends_out[t - lo], ends_out[t - lo + 1]
                    if b > a:
                        digests[t].update(view[a if begun[t] else a + 1:b])
                        begun[t] = True
                    removed[t] += (border[t - lo + 1] - border[t - lo]) - (border_kept[t - lo + 1] - border_kept[t - lo])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(total), pa.array(removed),
                 pa.array([d.hexdigest() for d in digests], pa.string())],
                ["_id", "n_words", "n_removed", "kept_sha256"])

    return docs.select("_id", "_text", "spans").mapInArrow(
        rows, f"_id {id_kind}, n_words long, n_removed long, kept_sha256 string")


def maximal_spans(ranges: DataFrame, window: int) -> DataFrame:
    """(_key, spans): ranges of window starts of a text joined where their
    windows overlap or touch; spans are sorted."""
    gathered = ranges.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            out = []
            for spans in batch.column("s").to_pylist():
                own = []
                for s in spans:
                    if own and s["first"] <= own[-1]["last"] + window:
                        own[-1]["last"] = max(own[-1]["last"], s["last"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, kind)], ["_key", "spans"])

    return gathered.mapInArrow(joined, "_key binary, spans array<struct<first:long,last:long>>")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """One row per document: words, removed words and the digest of what stays."""
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_t")).select(
        "_id", F.unhex(F.md5("_t")).alias("_key"), F.col("_t").cast("binary").alias("_text"))
    spans = maximal_spans(repeated_spans(texts, window=window, k=k), window)
    keys = texts.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    marks = saved(keys.join(spans, "_key", "left"))
    return kept_words(join_by_key(texts, marks, "_key", "n"), texts.schema["_id"].dataType.simpleString(),
                      window).withColumnRenamed("_id", id_col)
