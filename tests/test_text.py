"""Text rules on hand-made rows (FIXTURES section 4)."""

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import prepare


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


def test_nfkc(spark):
    assert _one(spark, "ﬁne ①", tx.clean_text) == "fine 1"


def test_zero_width_and_nul(spark):
    assert _one(spark, "a​b\u0000c", tx.clean_text) == "abc"


def test_unicode_whitespace(spark):
    assert _one(spark, "a   b\u001cc", tx.normalize_whitespace) == "a b c"


def test_strip_is_unicode_aware(spark):
    assert _one(spark, "　 x  ", tx.strip_ws) == "x"


def _records(spark, texts):
    rows = [(f"r{i}", i, t, None, None, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "record_id string, ord long, text string, text_pair string, pair_id string, "
              "label double")


def test_key_equality_keeps_first(spark):
    df = _records(spark, [" Hello  World ", "hello world"])
    out = prepare.prepare_records(df).select("record_id", "text").collect()
    assert [(r.record_id, r.text) for r in out] == [("r0", "Hello World")]


def test_empty_after_cleaning_dropped(spark):
    assert prepare.prepare_records(_records(spark, ["​", "x"])).count() == 1


def test_truncation(spark):
    rows = _records(spark, ["a" * 10001, "a" * 10000 + "b"])
    whole = prepare.prepare_records(rows).collect()
    assert sorted(len(r.text) for r in whole) == [10001, 10001]
    out = prepare.prepare_records(rows, max_text_length=10000).collect()
    assert [(len(r.text), r.text_length) for r in out] == [(10000, 10000)]


def test_sentences(spark):
    got = _one(spark, "One. Two!  Three? four", tx.sentences)
    assert got == ["One.", "Two!", "Three?", "four"]
    assert _one(spark, "no break here", tx.sentences) == ["no break here"]


def test_tokens_unicode_words(spark):
    assert _one(spark, "Grüße, Мир_1 x!", tx.tokens) == ["grüße", "мир_1", "x"]


def test_half_even_rounding(spark):
    v = spark.range(1).select(F.bround(F.lit(2.5), 0).alias("a"), F.bround(F.lit(3.5), 0).alias("b")).first()
    assert (v.a, v.b) == (2.0, 4.0)


def test_top_frequency_and_unique_ratio(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a"],), ([],)], "t array<string>")
    rows = df.select(tx.token_top_frequency(F.col("t")).alias("top"),
                     tx.token_unique_ratio(F.col("t")).alias("u")).collect()
    assert abs(rows[0].top - 0.6) < 1e-12 and abs(rows[0].u - 0.6) < 1e-12
    assert rows[1].top == 0.0 and rows[1].u == 0.0


def test_cleaned_is_the_chain_of_its_steps(spark):
    odd = ["", " ", None, "a\u0000b", "​ ‎", "x​  y", "ﬁ  ① ", "\u0085a\u001cb　", "İ̇ ẞ",
           "é ‪c", "  q  ", "﻿z", "a​", "日　本", "tab\tnl\n"] + [
           f"a{chr(c)}b" for c in [*range(0x21), *range(0x7F, 0xB0), *range(0x1680, 0x1682), *range(0x2000, 0x2070), 0x3000]]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    got = df.select("i", "t", tx.cleaned("t").alias("c"), tx.normalize_whitespace(tx.clean_text("t")).alias("w"),
                    tx.strip_ws("t").alias("s")).collect()
    assert all(r.c == r.w for r in got)
    assert all(r.s == (None if r.t is None else r.t.strip()) for r in got)


def test_normalized_sentences_and_keys(spark):
    texts = ["", "Ab c. d? E! f", "a. . b.", "x.y z", "...", "! ? .", "ΟΔΟΣ. Σ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in tx.with_sentences(tx.with_sentences(df), out_col="n", normalized=True).select(
            "sentences", "n", tx.key_hash("text").alias("a"), tx.key_hash("text", True).alias("b")).collect():
        assert r.sentences == r.n and r.a == r.b


def test_cleaning_equals_split_and_join_for_every_character(spark):
    """NFKC, marks dropped, str.split() and " ".join(): every code point between
    words, at the ends and in runs of mixed whitespace."""
    import random
    import unicodedata
    marks = {0, *range(0x200B, 0x2010), *range(0x202A, 0x202F)}

    def expected(t):
        t = unicodedata.normalize("NFKC", t)
        return " ".join("".join(c for c in t if ord(c) not in marks).split())

    rng = random.Random(5)
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}" for c in chars[at:at + 1000]) for at in range(0, len(chars), 1000)]
    texts += [f"{w}{w} x{w} {w}y {w}" for w in white]
    texts += ["".join(rng.choice([*white, "\0", "​", "a", "é"]) for _ in range(rng.randrange(60)))
              for _ in range(300)] + ["", " ", " " * 5000 + "z" + "\n \t" * 3000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tx.cleaned("t").alias("o"))
    assert {r.n: r.o for r in df.collect()} == {
        n: None if t is None else expected(t) for n, t in enumerate(texts)}


def test_cleaning_makes_no_string_per_word():
    """A text of many words costs no list of them."""
    import tracemalloc

    import pyarrow as pa
    text = "abc def\n" * 250_000
    clean = tx._cleaned.func
    tracemalloc.start()
    out = clean(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [" ".join(text.split())]
    assert peak < 6 * len(text)
