"""Phrase collocation mining by HAT-trie counting (operator 11).

Phrases of one to four words are counted exactly, per language:

* Each task counts the phrases of its texts in a HAT-trie over word ids
  (``phrase_trie``).  Whole subtrees are spilled as sorted runs; a run belongs
  to the prefix partition of its phrases (their first two words), in which runs
  of all tasks are merged by adding up equal phrases.
* Before phrases are counted as words, hashed phrases are counted in buckets:
  pairs of frequent words, then phrases of three and four words whose pairs are
  in frequent buckets.  Only phrases whose parts and whose own bucket are
  frequent go into the tries.  "Frequent" is asked of bitmaps of fixed size, so
  what they let through in vain costs time and never a result.  No phrase with
  ``least`` occurrences is lost, as its parts and its bucket have as many.

Scores compare a phrase with its two parts at every cut, all in exact decimal
arithmetic.  Parts are looked up by joins on the phrase; parts that many
phrases ask for are joined apart from the rest.

Word numbers inside a task are 64-bit hashes of a word; what is merged over all
tasks are the words themselves.

Defined results: a null text is empty, a null language is ``und``; repeated
rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bitmaps import bitmap, perhaps
from tessera.llm.common import join_by_key, saved, whole_text
from tessera.llm.phrase_trie import LIMIT, PhraseTrie
from tessera.llm.word_arrays import Words, byte_class, mixed, slices, words_in

#: Least occurrences of a candidate, words of the longest one, rows per language.
LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes when a longer one has this share of its occurrences, in per cent.
ABSORBED = 80
SCALE = 2_000_000
#: Words that are counted at a time, and rows of a run.
CHUNK = 1 << 19
RUN_ROWS = 1 << 16
#: Distinct words that a task remembers before it spills all.
WORD_TABLE = 250_000
#: Words and phrases that a task holds over all its languages.
TASK_ENTRIES = 700_000
PREFIXES = 1 << 12
#: Phrases are counted in this many buckets (less one, a mask) before they are counted themselves.
BUCKETS = np.uint64((1 << 36) - 1)
_SALTS = 64

# fixed values: piece breaks, word breaks within a piece
_PIECES = byte_class(b".,;:!?\n\x0b\x0c\r")
_BREAKS = byte_class(b".,;:!?\n\x0b\x0c\r \t")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def pair_numbers(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first ^ ((second << np.uint64(1)) | (second >> np.uint64(63))))


def phrase_numbers(hashes: np.ndarray) -> dict[int, np.ndarray]:
    """Numbers of the phrases of two to four words at every place."""
    pairs = pair_numbers(hashes[:-1], hashes[1:])
    return {2: pairs, 3: pair_numbers(~pairs[:-1], hashes[2:]), 4: pair_numbers(pairs[:-2], ~pairs[2:])}


def allowed_phrases(hashes: np.ndarray, apart: np.ndarray, words, pairs, longer) -> dict[int, np.ndarray]:
    """Of each place and size, whether a phrase that may be frequent begins
    there: it lies within a piece and passes the bitmaps given."""
    none = np.zeros(0, dtype=bool)
    run = np.ones(len(hashes), dtype=bool) if words is None else perhaps(words, hashes)
    out = {1: run}
    numbers = phrase_numbers(hashes) if pairs is not None or longer is not None else {}
    for size in range(2, LONGEST + 1):
        if len(hashes) < size:
            out[size] = none
            continue
        run = out[size - 1][:-1] & out[size - 1][1:] & ~apart[size - 1:]
        bits = pairs if size == 2 else longer
        if bits is not None:
            run = run & perhaps(bits, numbers[size])
        out[size] = run
    return out


class PhraseCounter:
    """Counts phrases of the given sizes of one language and yields runs.

    ``words``, ``pairs`` and ``longer`` are bitmaps that phrases must pass.
    Words are buffered and counted ``CHUNK`` at a time; the distinct phrases of
    a chunk go into the tries."""

    def __init__(self, sizes, bitmaps, seed: np.uint64, limit: int = LIMIT, chunk: int = CHUNK):
        self.sizes, self.bitmaps, self.seed = sizes, bitmaps, seed
        self.limit, self.chunk = limit, chunk
        self.tries = {size: PhraseTrie(size, limit=limit) for size in sizes}
        self.names: list[bytes] = []
        self.ids: dict[bytes, int] = {}
        self.buffer: list[tuple[np.ndarray, ...]] = []
        self.buffered = 0

    def held(self) -> int:
        return sum(map(len, self.tries.values())) + len(self.names)

    def add(self, found: Words, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take a slice; ``apart`` says of each word whether a piece begins
        with it."""
        hashes = found.numbers() ^ self.seed
        if not len(hashes):
            return
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = self.bitmaps[0]
        wanted = range(len(distinct)) if words is None else np.flatnonzero(perhaps(words, distinct)).tolist()
        data, ids, known = found.data.tobytes(), np.full(len(distinct), -1, dtype=np.int64), self.ids
        starts, ends = found.starts[at].tolist(), found.ends[at].tolist()
        for d in wanted:
            name = data[starts[d]:ends[d]]
            own = known.get(name)
            if own is None:
                own = known[name] = len(self.names)
                self.names.append(name)
            ids[d] = own
        # a slice ends with a piece, so no phrase runs on into the next one
        begins = []
        for size, run in allowed_phrases(hashes, apart, *self.bitmaps).items():
            if size in self.sizes:
                begins.append(np.zeros(len(hashes), dtype=bool))
                begins[-1][:len(run)] = run
        self.buffer.append((ids[which], *begins))
        self.buffered += len(hashes)
        if self.buffered >= self.chunk:
            yield from self.count()

    def count(self) -> Iterator[pa.RecordBatch]:
        """Count the buffered words' phrases."""
        if not self.buffer:
            return
        ids, *begins = (np.concatenate(x) for x in zip(*self.buffer))
        self.buffer, self.buffered = [], 0
        numbers = None
        for size, begin in zip(sorted(self.sizes), begins):
            where = np.flatnonzero(begin)
            if size <= 2:
                packed = ids[where] if size == 1 else (ids[where] << 32) | ids[where + 1]
            else:
                if numbers is None:
                    # pairs numbered in their order
                    numbers = np.unique((ids[:-1] << 32) | (ids[1:] & 0xFFFFFFFF), return_inverse=True)[1].astype(np.int64)
                packed = (numbers[where] << 32) | (ids[where + 2] if size == 3 else numbers[where + 2])
            _, first, counts = np.unique(packed, return_index=True, return_counts=True)
            first = where[first]
            self.tries[size].add([ids[first + k] for k in range(size)], counts)
            if len(self.tries[size]) >= self.limit:
                yield from self.runs(self.limit // 4)
        if len(self.names) > WORD_TABLE:
            yield from self.runs(0)

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as sorted runs: phrase, n."""
        names = pa.array(self.names, pa.binary())
        for size, trie in self.tries.items():
            for columns, counts in trie.spill(keep, RUN_ROWS):
                phrases = names.take(pa.array(columns[0]))
                if size > 1:
                    phrases = pc.binary_join_element_wise(
                        phrases, *[names.take(pa.array(c)) for c in columns[1:]], pa.scalar(b" "))
                order = pc.sort_indices(phrases)
                yield pa.RecordBatch.from_arrays(
                    [phrases.take(order).cast(pa.string()), pa.array(counts).take(order)], ["phrase", "n"])
        if not keep:
            self.names, self.ids = [], {}

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.count()
        yield from self.runs(0)


def _language_seed(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"), 7))


def phrase_runs(texts: DataFrame, sizes: tuple[int, ...], words: np.ndarray | None = None,
                pairs: np.ndarray | None = None, longer: np.ndarray | None = None, **bounds: int) -> DataFrame:
    """Sorted runs of all tasks: lang, phrase, n.

    ``texts`` has lang and _text as binary."""
    # bitmaps of fixed size
    held = texts.sparkSession.sparkContext.broadcast((words, pairs, longer))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, PhraseCounter] = {}

        def out(lang, runs):
            for run in runs:
                yield run.add_column(0, "lang", pa.array([lang], pa.string()).take(
                    pa.array(np.zeros(run.num_rows, dtype=np.int32))))

        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                counter = counters.get(lang)
                if counter is None:
                    counter = counters[lang] = PhraseCounter(sizes, held.value, _language_seed(lang), **bounds)
                for found, apart in _pieces(batch, lang):
                    yield from out(lang, counter.add(found, apart))
                # the limit holds for all languages of a task together
                while sum(c.held() for c in counters.values()) > TASK_ENTRIES:
                    largest = max(counters, key=lambda name: counters[name].held())
                    yield from out(largest, counters[largest].rest())
        for lang, counter in counters.items():
            yield from out(lang, counter.rest())

    return texts.select("lang", "_text").mapInArrow(
        rows, "lang string, phrase string, n long")


def _pieces(batch: pa.RecordBatch, lang: str) -> Iterator[tuple[Words, np.ndarray]]:
    """Folded slices of the texts of a language, and which words begin a piece:
    those with the start of a text or a piece break before them."""
    own = batch.column("_text").filter(pc.equal(batch.column("lang"), lang))
    for first, _, data, offsets in slices(own, _PIECES):
        data = _FOLD[data]
        found = words_in(data, offsets, first, _BREAKS)
        passed = np.cumsum(_PIECES[data], dtype=np.int32)
        apart = np.ones(len(found.starts), dtype=bool)
        if len(found.starts):
            level = passed[found.starts]
            apart[1:] = (level[1:] != level[:-1]) | (found.text[1:] != found.text[:-1])
        yield found, apart


def phrase_buckets(texts: DataFrame, sizes: tuple[int, ...], words: np.ndarray, pairs: np.ndarray | None = None,
                   chunk: int = CHUNK) -> DataFrame:
    """(bucket, n): occurrences of phrases that pass the bitmaps, by a bucket
    of the phrase's number."""
    held = texts.sparkSession.sparkContext.broadcast((words, pairs))  # of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def counted():
            buckets, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(counts)], ["bucket", "n"])

        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                seed = _language_seed(lang)
                for found, apart in _pieces(batch, lang):
                    hashes = found.numbers() ^ seed
                    begins, numbers = allowed_phrases(hashes, apart, *held.value, None), phrase_numbers(hashes)
                    for size in sizes:
                        if len(begins[size]):
                            waiting.append(numbers[size][begins[size]] & BUCKETS)
                            n += len(waiting[-1])
                    if n >= 4 * chunk:
                        yield counted()
                        waiting, n = [], 0
        if n:
            yield counted()

    return texts.select("lang", "_text").mapInArrow(rows, "bucket long, n long")


def word_numbers(words: DataFrame) -> DataFrame:
    """(number): the numbers of words (lang, phrase) as the counting tasks see them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                for found, _ in _pieces(batch, lang):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((found.numbers() ^ _language_seed(lang)).view(np.int64))], ["number"])

    return words.select("lang", F.col("phrase").cast("binary").alias("_text")).mapInArrow(rows, "number long")


def merged_runs(runs: DataFrame) -> DataFrame:
    """Merge runs per prefix partition: lang, phrase, n."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(PREFIXES * parts))
    return (runs.select(prefix.alias("prefix"), "lang", "phrase", "n").repartition(parts, "prefix")
            .groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix"))


def phrase_counts(texts: DataFrame, *, least: int = LEAST, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of up to four words (lang, phrase, size, n), and all
    words of each language (lang, n_all)."""
    words = saved(merged_runs(phrase_runs(texts, (1,), **bounds)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_all"))
    frequent = words.filter(F.col("n") >= least)
    word_bits = bitmap(word_numbers(frequent), "number")

    def frequent_buckets(*asked) -> np.ndarray:
        sums = phrase_buckets(texts, *asked).groupBy("bucket").agg(F.sum("n").alias("n"))
        return bitmap(sums.filter(F.col("n") >= least), "bucket")

    pair_bits = frequent_buckets((2,), word_bits)
    longer_bits = frequent_buckets((3, 4), word_bits, pair_bits)
    longer = saved(merged_runs(phrase_runs(texts, (2, 3, 4), word_bits, pair_bits, longer_bits, **bounds))
                   .filter(F.col("n") >= least))
    counts = frequent.unionByName(longer)
    return counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n"), totals


def _looked_up(asks: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Join by (lang, column); what many rows ask for is joined apart."""
    keys = ["lang", column]
    uses = asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
    known = saved(table.join(uses, keys))
    return join_by_key(asks, known, keys, "_asked").drop("_asked")


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def best_cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase of two words or
    more at its lowest-scoring cut, the first of equal ones."""
    phrases = saved(counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a")))
    cut = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("_left", F.expr("substring_index(phrase, ' ', k)")).withColumn(
        "_right", F.expr("substring_index(phrase, ' ', k - size)"))
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    cut = saved(_looked_up(cut, left, "_left"))
    cut = _looked_up(cut, right, "_right")
    score = F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_best")
    return cut.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "_best.l", "_best.r", "_best.score")


def inner_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): the greatest count of a longer phrase around it."""
    longer = counts.filter("size > 2")
    words = F.split("phrase", " ")
    inner = None
    for size in range(2, LONGEST):
        for start in range(LONGEST - size + 1):
            own = longer.filter((F.col("size") > size) & (F.col("size") >= start + size)).select(
                "lang", F.array_join(F.slice(words, start + 1, size), " ").alias("phrase"), "n")
            inner = own if inner is None else inner.unionByName(own)
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def mine_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 top: int = TOP, absorbed: int = ABSORBED, **bounds: int) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``bounds`` are the sizes of tries and chunks (see PhraseCounter); results
    do not depend on them."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        whole_text(text_col).cast("binary").alias("_text"))
    counts, totals = phrase_counts(texts, least=least, **bounds)
    counts = saved(counts)
    around = inner_phrases(counts)
    scored = best_cuts(counts).join(around, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * absorbed))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language, then the best of these
    shares = Window.partitionBy("lang", "_share").orderBy(*order)
    final = Window.partitionBy("lang").orderBy(*order)
    best = (scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
            .withColumn("_place", F.row_number().over(shares)).filter(F.col("_place") <= top)
            .withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= top))
    # one row per language
    return best.join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("n_all").alias("n"), F.col("score").cast("long").alias("score"))
