"""Toxicity by Levenshtein automata over a lexicon trie (operator 3).

The lexicon is learned: for every word start of 3 to 12 letters the training
texts with and without the label are counted, and the starts that mark toxic
texts form a trie, with the frequent whole words that begin with them.  A word is run through the intersection of that trie with
the Levenshtein automaton: a state is the set of (trie node, edits so far)
that the letters read can have led to.  States are built when first needed and
remembered, so a word costs one lookup per letter and most words die after two
or three.  An entry matches a word that starts with it, or, for entries of
five letters or more, a whole word within one edit.

Each hit is scored in its context window: hits inside quotation marks or after
reporting words count as quotation, hits near words of address as abuse.  A
logistic model (Spark ML) over the summed scores gives the document's score.

Defined results: null and empty texts have no hits and get the model's base
score; without labelled training rows of both kinds every score is the share
of toxic training rows (0 if there is none); repeated rows each get a row; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, whole_text

#: Most labelled rows used for fitting, taken in hash order of the id.
TRAIN_ROWS = 20_000
#: Most lexicon entries.
LEXICON = 2_000
LEAST_TOXIC_TEXTS = 3
LEAST_PRECISION = 0.8
START_LETTERS, END_LETTERS = 3, 12
FUZZY_LETTERS = 5
CONTEXT_CHARS = 60
THRESHOLD = 0.3
FEATURES = ("abuse", "quoted", "fuzzy", "strongest", "density", "address")
#: Steps, states and nodes of states that an automaton holds.
STATES = 300_000
#: Words that an automaton remembers.
WORDS = 200_000
#: Rows taken from a batch at once.
ROWS = 500
#: Starts counted before they are handed on.
STARTS = 150_000

#: Marks a counted whole word; no letter or digit.
WORD_END = "$"

_WORD = re.compile(r"[^\W_]+")
# fixed values: marks of quotation, reporting words, words of address
_CLOSED_BY = {'"': '"”', "'": "'’", "‘": "’'", "‚": "‘’'", "«": "»", "»": "«", "„": "“”\"", "“": '”"'}
_SINGLE = "'‘’"
_REPORTING = frozenset("said says wrote writes called quote quoted quotes cited sagte schrieb zitat "
                       "dijo escribió cita dit écrit citation".split())
_ADDRESS = frozenset("you your youre du dich ihr sie euch tu te tú vos usted vous toi ton".split())
_MARK = re.compile("[\"'«»„“”‘’‚\n]")
#: A reporting word with a colon in the same sentence, up to the term.
_REPORTED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(_REPORTING))})(?!\w)[^.!?\n]*:[^.!?\n]*$")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Disjoint, sorted spans between paired quotation marks.  Marks pair by
    kind within a line, so that a lone mark changes nothing beyond it.  A mark
    between letters is an apostrophe; a single mark opens only before a letter
    that no letter precedes, and closes only where no letter follows."""
    spans: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in _MARK.finditer(text):
        mark, at = m.group(), m.start()
        if mark == "\n":
            opened.clear()
            continue
        before, after = text[at - 1:at].isalnum() if at else False, text[at + 1:at + 2].isalnum()
        single = mark in _SINGLE
        if single and before and after:
            continue
        kind = next((k for k in reversed(opened) if mark in _CLOSED_BY[k]), None)
        if kind is not None and not (single and after):
            spans.append((opened.pop(kind), at))
        elif mark in _CLOSED_BY and (not single or after and not before):
            opened[mark] = at
    joined: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def _places(text: str, word: str) -> Iterator[int]:
    """Where a text has the word; letters and digits are what ``_WORD`` takes."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (text[at - 1:at].isalnum() if at else False) and not text[end:end + 1].isalnum():
            yield at
        at = text.find(word, end)


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


class FuzzyLexicon:
    """Trie of entries with weights, read through a lazily built automaton.

    Trie nodes are numbers.  A state is the node that the letters read lead to
    without edits (-1 if none; the trie has one at most) and the set of nodes
    that they lead to with one edit."""

    def __init__(self, entries: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.weight, self.depth = [0.0], [0]
        for entry, weight in entries.items():
            node = 0
            for letter in entry:
                child = self.next[node].get(letter)
                if child is None:
                    child = self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.weight.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = child
            self.weight[node] = max(self.weight[node], weight)
        self._clear()
        self.hits: dict[str, tuple[float, float]] = {}
        self.misses: set[str] = set()

    def _clear(self) -> None:
        self.held = 0
        self.steps: list[dict[str, int]] = []
        self.numbers: dict[tuple[int, frozenset[int]], int] = {}
        self.states: list[tuple[int, frozenset[int], float, float]] = []
        self.start = self._number(0, set())

    def _number(self, exact: int, near: set[int]) -> int:
        """The state of these nodes and of those reached by leaving out a
        letter of an entry."""
        if exact >= 0:
            near.update(self.next[exact].values())
            # a node reached without edits covers the same node with one
            near.discard(exact)
        key = (exact, frozenset(near))
        got = self.numbers.get(key)
        if got is None:
            got = self.numbers[key] = len(self.states)
            weight, depth = self.weight, self.depth
            self.states.append((*key, weight[exact] if exact >= 0 else 0.0,
                                max((weight[n] for n in near if depth[n] >= FUZZY_LETTERS), default=0.0)))
            self.steps.append({})
            self.held += 1 + len(near)
        return got

    def _step(self, state: int, letter: str) -> int:
        exact, near = self.states[state][:2]
        children = self.next
        reached = {child for n in near if (child := children[n].get(letter)) is not None}
        to = -1
        if exact >= 0:
            to = children[exact].get(letter, -1)
            reached.add(exact)  # one letter too many
            reached.update(children[exact].values())  # one letter changed
        got = self._number(to, reached) if to >= 0 or reached else -1
        self.steps[state][letter] = got
        self.held += 1
        return got

    def match(self, word: str) -> tuple[float, float] | None:
        """(weight of entries that start the word, weight of entries within
        one edit of the whole word), or None."""
        found = self.hits.get(word)
        if found is None and word not in self.misses:
            if self.held > STATES:
                self._clear()
            if len(self.hits) + len(self.misses) > WORDS:
                self.hits.clear()
                self.misses.clear()
            found = self._read(word)
            if found is None:
                self.misses.add(word)
            else:
                self.hits[word] = found
        return found

    def _read(self, word: str) -> tuple[float, float] | None:
        state, exact, steps, states = self.start, 0.0, self.steps, self.states
        for letter in word:
            to = steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state < 0:
                break
            if states[state][2] > exact:
                exact = states[state][2]
        near = states[state][3] if state >= 0 and not exact else 0.0
        return (exact, near) if exact or near else None

    def features(self, text: str) -> list[float]:
        """Values of ``FEATURES`` for a text."""
        low = text.lower()
        words = _WORD.findall(low)
        match = self.match
        hit = {w: found for w in set(words).difference(self.misses) if (found := match(w))}
        if not hit:
            return [0.0] * len(FEATURES)
        abuse = quoted = fuzzy = strongest = address = 0.0
        spans = quoted_spans(low)
        found = sorted((at, w) for w in hit for at in _places(low, w))
        for start, word in found:
            exact, near = hit[word]
            end = start + len(word)
            left, right = low[max(0, start - CONTEXT_CHARS):start], low[end:end + CONTEXT_CHARS]
            span = bisect_right(spans, (start, 0)) - 1
            if span >= 0 and start < spans[span][1] or ":" in left and _REPORTED.search(left):
                quoted += exact + near / 2
            else:
                abuse += exact
                fuzzy += near
                strongest = max(strongest, exact)
            address += not (_ADDRESS.isdisjoint(_WORD.findall(left)) and _ADDRESS.isdisjoint(_WORD.findall(right)))
        hits = len(found)
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(fuzzy), strongest,
                math.sqrt(hits / len(words)), math.log1p(address)]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  limit: int) -> DataFrame:
    """(_id, _text, label) of at most ``limit`` labelled rows outside the
    held-out part."""
    ids = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
           .orderBy(F.xxhash64("_id"), "_id").limit(limit))
    # at most ``limit`` small rows
    return docs.select(F.col(id_col).alias("_i"), whole_text(text_col).alias("_text")).join(
        F.broadcast(ids), F.col("_i") == F.col("_id")).select("_id", "_text", "label")


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Word starts that mark toxic texts, with smoothed log-odds as weights, and
    the whole words under them that do, with the weight of their start: they add
    nothing to a word as it is spelled, but misspelled ones are near to them."""
    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for rows in _slices(batches):
            for text, label in zip(rows["_text"].to_pylist(), rows["label"].to_pylist(), strict=True):
                words = set(_WORD.findall(text.lower()))
                counts[int(label > 0)].update({w[:k] for w in words for k in range(
                    START_LETTERS, min(len(w), END_LETTERS) + 1)})
                counts[int(label > 0)].update(w + WORD_END for w in words if len(w) >= FUZZY_LETTERS)
                if len(counts[0]) + len(counts[1]) > STARTS:
                    yield _flat(counts)
                    counts = (Counter(), Counter())
        yield _flat(counts)

    sums = (train.mapInArrow(starts, "start string, toxic long, clean long")
            .groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1 = sum(v for k, v in n.items() if k > 0)
    n0 = sum(v for k, v in n.items() if k <= 0)
    weight = (F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1)))
    marks = saved(sums.withColumn("weight", weight)
                  .filter((F.col("toxic") >= LEAST_TOXIC_TEXTS)
                          & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean")))))
    whole, most = F.col("start").endswith(WORD_END), (F.col("toxic").desc(), "start")
    rows = marks.filter(~whole).orderBy(*most).limit(8 * LEXICON).collect()
    found = {r["start"]: (r["toxic"], r["weight"]) for r in rows}
    # of starts that mark the same texts the longest says most
    longer = Counter()
    for s, (toxic, _) in found.items():
        longer[s[:-1]] = max(longer[s[:-1]], toxic)
    closed = {s: v for s, v in found.items() if longer[s] < 0.95 * v[0]}
    out: dict[str, float] = {}
    for s in sorted(closed, key=lambda s: (len(s), s)):
        if not any(s[:k] in out for k in range(START_LETTERS, len(s))):
            out[s] = closed[s][1]
    best = sorted(out, key=lambda s: (-closed[s][0], s))[:LEXICON]
    lexicon = {s: out[s] for s in best}
    forms = {}
    for r in marks.filter(whole).orderBy(*most).limit(8 * LEXICON).collect():
        word = r["start"][:-len(WORD_END)]
        stem = next((word[:k] for k in range(START_LETTERS, len(word)) if word[:k] in lexicon), None)
        if stem is not None:
            forms[word] = lexicon[stem]
    return lexicon | forms


def _flat(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    starts = sorted(counts[0].keys() | counts[1].keys())
    return pa.record_batch([pa.array(starts, pa.string()), pa.array([counts[1][s] for s in starts], pa.int64()),
                            pa.array([counts[0][s] for s in starts], pa.int64())], ["start", "toxic", "clean"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that few texts are held as strings."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def with_features(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """Features of ``_text``, with the columns ``keep``."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FuzzyLexicon(lexicon)
        for some in _slices(batches):
            values = np.array([known.features(t) for t in some["_text"].to_pylist()], dtype=np.float64)
            yield pa.record_batch([*(some[k] for k in keep), *(pa.array(v) for v in values.T.copy())],
                                  [*keep, *FEATURES])

    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep]
    return rows.select(*keep, "_text").mapInArrow(
        measured, ", ".join([*fields, *(f"{n} double" for n in FEATURES)]))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    coefficients: list[float]
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for name, c in zip(FEATURES, self.coefficients, strict=True):
            z = z + F.lit(c) * F.col(name)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", limit: int = TRAIN_ROWS) -> ToxicityModel:
    # its rows come from every part of the input; few parts are left for the passes of the fit
    train = saved(training_rows(docs, labels, id_col, text_col, label_col, limit).hint("rebalance"))
    base = train.agg(F.avg((F.col("label") > 0).cast("double")), F.count(F.lit(1))).first()
    share = base[0] or 0.0
    if share in (0.0, 1.0):
        odds = (share * base[1] + 0.01) / ((1 - share) * base[1] + 0.99)
        return ToxicityModel({}, [0.0] * len(FEATURES), math.log(odds))
    lexicon = learn_lexicon(train)
    data = with_features(train.withColumn("y", (F.col("label") > 0).cast("double")), lexicon, ["y"])
    data = saved(data.select("y", F.array(*FEATURES).alias("x"))).select("y", array_to_vector("x").alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-3, maxIter=100).fit(data)
    return ToxicityModel(lexicon, [float(c) for c in model.coefficients], float(model.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the features, per row."""
    slim = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = with_features(slim, model.lexicon, ["_id"]).withColumnRenamed("_id", id_col)
    return rows.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
                       model.score().alias("score"),
                       (model.score() >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, that the model does not reject."""
    rejects = F.arrow_udf(_feature_batches(model), "double")
    return docs.withColumn("_toxic_score", rejects(whole_text(text_col))).filter(
        F.col("_toxic_score") < THRESHOLD).drop("_toxic_score")


def _feature_batches(model: ToxicityModel):
    lexicon, coefficients, intercept = model.lexicon, model.coefficients, model.intercept

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = FuzzyLexicon(lexicon)
        for batch in batches:
            z = [intercept + sum(c * v for c, v in zip(coefficients, known.features(t), strict=True))
                 for at in range(0, len(batch), ROWS) for t in batch.slice(at, ROWS).to_pylist()]
            yield pa.array([1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x)))) for x in z], pa.float64())

    return scores
