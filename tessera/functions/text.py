"""Text scalars as Spark Column expressions.

Everything here is a plain ``Column -> Column`` function that stays inside
whole-stage codegen, except Unicode NFKC normalization, which Spark has no
built-in for: it runs as an Arrow ``pandas_udf`` and only sees rows that hold
a non-ASCII character (ASCII text is NFKC-stable by definition).  The whole
cleaning chain (``cleaned``) is one such function over all rows: its passes
cost less there than as regular expressions over wide character classes.

Regular expressions are written with explicit classes so that the Java
engine and RE2 (used by the SQL oracle) agree character by character.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
#
# Whitespace as Python's str.isspace() / re "\s" see it:
#   TAB LF VT FF CR, U+001C..U+001F, SPACE, U+0085, U+00A0, U+1680,
#   U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Characters deleted by cleaning: NUL, U+200B..U+200F, U+202A..U+202E
INVISIBLE_CLASS = r"\x00\x{200B}-\x{200F}\x{202A}-\x{202E}"
# Punctuation counted by punctuation_density:  . , ! ? ; : — - " ' « » ( ) [ ] { } …
PUNCT_CLASS = r"""[.,!?;:\x{2014}\-"'\x{AB}\x{BB}()\[\]{}\x{2026}]"""
# Characters that are NOT special: digits, ASCII Latin letters, Cyrillic
# А-Я а-я Ё ё, whitespace
NOT_SPECIAL_CLASS = r"0-9A-Za-z\x{410}-\x{44F}\x{401}\x{451}" + WS_CLASS
# Word characters (Python "\w" on str): letters, numbers, underscore
WORD_CLASS = r"[\p{L}\p{N}_]+"
# Sentence end marks
SENTENCE_END = "[.!?]"
# Default cap on text length in code points
MAX_TEXT_LENGTH = 10000
# ---------------------------------------------------------------------------

#: The characters of WS_CLASS
WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000")
WS_RUN = f"[{WS_CLASS}]+"
EDGE_WS = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _make_nfkc():
    # Built inside a factory so the function is shipped to Python workers by
    # value (workers need not have this package installed).
    def nfkc_batch(texts: pd.Series) -> pd.Series:
        # NULL rows were pure ASCII (or NULL) and are kept as is by the
        # caller, so only non-ASCII rows cross into Python.
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # Nondeterministic so the optimizer evaluates it exactly once: a
    # deterministic UDF lets a later ``text <> ''`` filter be pushed below the
    # projection, which duplicates the whole cleaning chain and the Arrow
    # round trip.
    return F.pandas_udf(nfkc_batch, T.StringType()).asNondeterministic()


_nfkc = _make_nfkc()


def _make_cleaned():
    invisible = re.compile("[\0\u200b-\u200f\u202a-\u202e]")
    marks = ["\0", *map(chr, range(0x200B, 0x2010)), *map(chr, range(0x202A, 0x202F))]
    # whitespace other than the space; NFKC makes the rest of WS_CHARS spaces
    ascii_ws = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
    nfkc_ws = ascii_ws + "\x85\u1680\u2028\u2029"

    def clean(t):
        if t is None:
            return None
        ws = ascii_ws
        if not t.isascii():
            t = unicodedata.normalize("NFKC", t)
            # a search for each mark costs less than one pass of the expression
            if any(m in t for m in marks):
                t = invisible.sub("", t)
            ws = nfkc_ws
        elif "\0" in t:
            t = t.replace("\0", "")
        # as " ".join(t.split()), without a string for every word
        for c in ws:
            if c in t:
                t = t.replace(c, " ")
        while "  " in t:
            t = t.replace("  ", " ")
        return t.strip(" ")

    def clean_batch(texts: pa.Array) -> pa.Array:
        return pa.array(map(clean, texts.to_pylist()), pa.string(), size=len(texts))

    return F.arrow_udf(clean_batch, T.StringType()).asNondeterministic()


_cleaned = _make_cleaned()


def cleaned(col) -> Column:
    """T1 then T2 in one pass: NFKC, drop NUL and zero-width / bidi marks, runs
    of whitespace to one space, strip.  NULL stays NULL."""
    return _cleaned(_c(col))


def is_ascii(col) -> Column:
    return _c(col).rlike(r"^[\x00-\x7F]*$")


def nfkc(col) -> Column:
    c = _c(col)
    return F.coalesce(_nfkc(F.when(~is_ascii(c), c)), c)


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def safe_text(col) -> Column:
    """NULL -> '', cast to string, strip.  Only texts with whitespace at
    an end are stripped: that copies and indexes the whole text."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    return F.when(F.substring(c, 1, 1).isin(*WS_CHARS) | F.substring(c, -1, 1).isin(*WS_CHARS),
                  strip_ws(c)).otherwise(c)


def clean_text(col, *, unicode_normalize: bool = True) -> Column:
    """NFKC, drop NUL and zero-width / bidi marks, strip."""
    c = _c(col)
    if unicode_normalize:
        c = nfkc(c)
    return strip_ws(F.regexp_replace(c, f"[{INVISIBLE_CLASS}]", ""))


def normalize_whitespace(col) -> Column:
    """Runs of Unicode whitespace -> one space, strip."""
    return strip_ws(F.regexp_replace(_c(col), WS_RUN, " "))


def text_key(col) -> Column:
    """Dedupe / leakage key: strip, lower-case, collapse whitespace."""
    return F.regexp_replace(F.lower(strip_ws(_c(col))), WS_RUN, " ")


def key_hash(col, normalized: bool = False) -> Column:
    """Join key for text keys: md5 of the T3 key (texts reach 100k+ chars).
    ``normalized``: the text has no other whitespace than single spaces between
    words, so the T3 key is its lower-case form (no regex pass)."""
    return F.md5(F.lower(_c(col)) if normalized else text_key(col))


def truncate(col, max_length: int | None = None) -> Column:
    """T4: keep the first ``max_length`` code points; None keeps the whole text."""
    c = _c(col)
    if not max_length:
        return c
    return F.when(F.length(c) > max_length, F.substring(c, 1, max_length)).otherwise(c)


def sentences(col) -> Column:
    """T5: split after . ! ? followed by whitespace; strip; drop blanks; the
    whole text when nothing is left."""
    c = _c(col)
    parts = F.split(c, f"(?<={SENTENCE_END})[{WS_CLASS}]+")
    kept = F.filter(F.transform(parts, strip_ws), lambda s: s != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def tokens(col) -> Column:
    """Word tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_CLASS), F.lit(0))


def punctuation_count(col) -> Column:
    return F.regexp_count(_c(col), F.lit(PUNCT_CLASS))


def special_char_count(col) -> Column:
    """Characters that are not digit, ASCII Latin, Cyrillic or whitespace."""
    return F.regexp_count(_c(col), F.lit(f"[^{NOT_SPECIAL_CLASS}]"))


def punctuation_density(col) -> Column:
    """Punctuation / max(length, 1)."""
    c = _c(col)
    return punctuation_count(c) / F.greatest(F.length(c), F.lit(1))


def token_top_frequency(tok: Column) -> Column:
    """Count of the most frequent token / number of tokens (0 if none).

    One pass over the sorted array keeps (previous token, current run, best
    run), so a 20,000-word text costs a sort, not a quadratic scan.
    """
    init = F.struct(F.lit(None).cast("string").alias("prev"),
                    F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x == acc["prev"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), run.alias("run"),
                        F.greatest(acc["best"], run).alias("best"))

    best = F.aggregate(F.array_sort(tok), init, step)["best"]
    return F.when(F.size(tok) > 0, best / F.size(tok)).otherwise(F.lit(0.0))


def token_unique_ratio(tok: Column) -> Column:
    """Distinct tokens / tokens (0 if none)."""
    return F.when(F.size(tok) > 0,
                  F.size(F.array_distinct(tok)) / F.size(tok)).otherwise(F.lit(0.0))


def lexical_overlap(tok_a: Column, tok_b: Column) -> Column:
    """Jaccard of the two token sets; 0 without a pair or when both empty."""
    union = F.size(F.array_union(F.array_distinct(tok_a), F.array_distinct(tok_b)))
    inter = F.size(F.array_intersect(tok_a, tok_b))
    return F.when(tok_b.isNull() | (union == 0), F.lit(0.0)).otherwise(inter / union)


def domain_vocab_hits(col, vocabulary: list[str]) -> Column:
    """Number of vocabulary words occurring as substrings (case-folded)."""
    words = [w.lower() for w in vocabulary]
    if not words:
        return F.lit(0)
    low = F.lower(_c(col))
    return sum((F.when(F.instr(low, w) > 0, 1).otherwise(0) for w in words), F.lit(0))


def first_text(a, b) -> Column:
    """P5: the first non-empty (after strip) of two text columns."""
    sa, sb = safe_text(a), safe_text(b)
    return F.coalesce(F.nullif(sa, F.lit("")), sb)


def with_sentences(df, text_col: str = "text", out_col: str = "sentences", normalized: bool = False):
    """T5 as two projections: the split is materialized once and then read
    twice (an expression with lambdas is never shared by subexpression
    elimination, so ``sentences()`` evaluates its split twice).

    ``normalized``: the text is cleaned and has single spaces only (``cleaned``),
    so breaks are plain replacements by NUL, which such a text does not hold,
    and no sentence is blank or has whitespace around it."""
    c = F.col(text_col)
    if normalized:
        for mark in ".!?":
            c = F.replace(c, F.lit(mark + " "), F.lit(mark + "\0"))
        return df.withColumn(out_col, F.split(c, "\0"))
    parts = F.split(c, f"(?<={SENTENCE_END})[{WS_CLASS}]+")
    kept = df.withColumn("_kept", F.filter(F.transform(parts, strip_ws), lambda s: s != ""))
    return kept.withColumn(out_col, F.when(F.size("_kept") > 0, F.col("_kept"))
                           .otherwise(F.array(c))).drop("_kept")
