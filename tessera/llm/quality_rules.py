"""Quality rules with distribution divergence (operator 2).

Each document's character-class histogram and common-word histogram are
compared with the reference of its language by Jensen-Shannon distance.
References are sums over all documents of a language.  Documents below the
least lengths are not judged by distance, since short texts are far from any
reference by chance.

Defined results: a null text has no words and fails the base rules; documents
of a null or unlisted language are compared with the reference over all
documents; empty tables give empty results; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, settle, whole_text, words_of

# fixed values: common words by language
COMMON = {
    "de": ("der", "die", "und", "das", "von", "mit", "den", "ist", "des", "auf", "zu", "im"),
    "en": ("the", "of", "and", "to", "in", "a", "that", "is", "for", "was", "on", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "para", "con"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "que", "est", "pour", "du"),
    "it": ("di", "e", "il", "la", "che", "in", "un", "per", "del", "con", "non", "le"),
    "nl": ("de", "het", "van", "een", "en", "in", "is", "dat", "op", "te", "met", "voor"),
    "pt": ("de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "os"),
}
#: Words of the pooled reference, for null and unlisted languages.
POOLED = "*"
WORDS = {**COMMON, POOLED: tuple(sorted({w for ws in COMMON.values() for w in ws[:2]})[:12])}
#: Words of the longest list; shorter lists leave their last bins empty.
WORD_BINS = max(map(len, WORDS.values()))
CLASSES = ("plain", "upper", "digit", "space", "symbol", "wide")

# fixed values: the base rules
NOT_SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

#: Largest distances to the reference, and words needed to be judged by them.
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.27
CLASS_MIN_WORDS = 20
WORD_MIN_WORDS = 100


def with_repeats(df: DataFrame) -> DataFrame:
    """From ``_words``, add ``_repeats``: words inside 8-word windows that occur
    twice or more, first ones included.

    Window hashes are folded by doubling (1, 2, 4, 8 words).  Sorted (hash,
    position) pairs put equal windows side by side; each window with an equal
    neighbour adds the words that the one before it did not cover.  Every step
    is settled, since an array used twice in an expression is made twice."""
    def folded(step: int):
        return F.zip_with("_h", F.slice("_h", step + 1, F.greatest(F.size("_h") - step, F.lit(0))),
                          lambda a, b: F.xxhash64(a, b))

    df = settle(df, _h=F.transform("_words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = settle(df, _h=folded(step))
    # the last windows reach beyond the text
    df = settle(df, _h=F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.expr("array()").cast("array<struct<h:bigint,i:int>>")
    df = settle(df, _placed=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)
                .otherwise(none)).drop("_h")
    alone = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    n = F.greatest(F.size("_placed") - 1, F.lit(0))
    around = F.arrays_zip(F.col("_placed").alias("me"),
                          F.concat(alone, F.slice("_placed", 1, n)).alias("b"),
                          F.concat(F.slice("_placed", 2, n), alone).alias("a"))
    twice = F.filter(around, lambda z: F.coalesce(z["me"]["h"] == z["b"]["h"], F.lit(False))
                     | F.coalesce(z["me"]["h"] == z["a"]["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda z: z["me"]["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"),
                                (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")),
        lambda acc: acc["n"])
    return settle(df, _repeats=F.when(F.size("_placed") > 0, covered).otherwise(
        F.lit(0).cast("long"))).drop("_placed")


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of the base rules (and ``_words``, ``_text``)."""
    df = settle(df, _text=whole_text(text_col)).drop(text_col)
    df = settle(df, _words=words_of(F.col("_text")),
                _lines=F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = settle(df, n_words=F.size("_words").cast("long"),
                word_chars=F.length(F.array_join("_words", "")).cast("long"),
                n_symbols=F.length(F.regexp_replace("_text", NOT_SYMBOLS, "")).cast("long"),
                n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                ).drop("_lines")
    df = settle(df, _cc=class_counts("_text", F.col("word_chars"), F.col("n_symbols"))).drop("_text")
    return with_repeats(df).withColumnRenamed("_repeats", "n_repeat_words")


def class_counts(text: str, word_chars: Column, symbols: Column) -> Column:
    """Characters per class, in the order of ``CLASSES``; a character outside
    ASCII counts as its extra bytes in UTF-8, and ``plain`` is what is left."""
    n = F.length(text)
    wide = F.octet_length(text) - n
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    digit = F.length(F.regexp_replace(text, "[^0-9]+", ""))
    known = F.array(upper, digit, n - word_chars, symbols, wide)
    # each count appears once, so that none is computed twice
    return F.aggregate(known, F.array(n.cast("double")), lambda acc, x: F.concat(
        acc, F.array(x.cast("double"))), lambda acc: F.concat(
            F.array(F.greatest(acc[0] - acc[1] - acc[2] - acc[3] - acc[4] - acc[5], F.lit(0.0))),
            F.slice(acc, 2, len(CLASSES) - 1)))


def with_word_counts(df: DataFrame) -> DataFrame:
    """From ``_words`` and ``_lang``, add ``_wc``: occurrences of each common
    word of the language (``WORD_BINS`` of them), then of all other words."""
    vocabulary = F.lit(None).cast("array<string>")
    few = F.lit(None).cast("array<string>")
    for code, listed in WORDS.items():
        own = F.col("_lang") == code
        vocabulary = F.when(own, F.array(*[F.lit(w) for w in listed])).otherwise(vocabulary)
        few = F.when(own, F.filter("_words", _is_one_of(listed))).otherwise(few)
    df = settle(df, _few=few, _listed=vocabulary).drop("_words")
    # positions in the list turn the counts into sums of numbers
    at = F.zip_with("_few", F.array_repeat("_listed", F.size("_few")),
                    lambda w, listed: F.array_position(listed, w))
    df = settle(df, _few=at).drop("_listed")
    counts = [F.size(F.filter("_few", _is_one_of([k + 1]))).cast("double") for k in range(WORD_BINS)]
    others = (F.col("n_words") - F.size("_few")).cast("double")
    return settle(df, _wc=F.array(*counts, others)).drop("_few")


def _is_one_of(values):
    return lambda x: x.isin(*values)


def language_key(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit(POOLED))


def references(measured: DataFrame) -> DataFrame:
    """Histogram sums over all documents of a language: one row per listed
    language that occurs, and one for the others."""
    return measured.groupBy("_lang").agg(
        F.array(*[F.sum(F.col("_cc")[i]) for i in range(len(CLASSES))]).alias("_rc"),
        F.array(*[F.sum(F.col("_wc")[i]) for i in range(WORD_BINS + 1)]).alias("_rw"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.zip_with(counts, F.array_repeat(F.greatest(total, F.lit(1.0)), F.size(counts)),
                      lambda c, m: c / m)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    total = F.aggregate(terms, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """One row per document with base measures, distances and verdicts.

    Texts are read once; their measures and histograms are small rows, from
    which the references are summed and joined back (at most one row per
    listed language, hence the broadcast)."""
    df = base_measures(docs.select(F.col(id_col), F.col(text_col).alias("_raw"),
                                   language_key(F.col(lang_col)).alias("_lang")), "_raw")
    thin = saved(with_word_counts(df))
    df = thin.join(F.broadcast(references(thin)), "_lang")
    df = settle(df, _p=shares(F.col("_cc")), _q=shares(F.col("_rc")),
                _u=shares(F.col("_wc")), _v=shares(F.col("_rw")))
    df = settle(df, class_distance=distance(F.col("_p"), F.col("_q")),
                word_distance=distance(F.col("_u"), F.col("_v")))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    far = (((F.col("n_words") >= CLASS_MIN_WORDS) & (F.col("class_distance") > MAX_CLASS_DISTANCE))
           | ((F.col("n_words") >= WORD_MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)))
    return df.select(F.col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     failed.alias("base_failed"), (~failed & ~far).alias("kept"),
                     "class_distance", "word_distance")
