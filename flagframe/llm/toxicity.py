"""Operator 2: toxicity by Levenshtein automata over a learned lexicon, weighed in context.

The lexicon is learned from labelled rows: words and word beginnings that are far more frequent in
toxic than in clean texts, with their log odds as weights. All its words of five letters or more form a trie
(one edit, two from nine letters on; shorter words are matched exactly).
The Levenshtein automata of all these are run as one per direction, over the trie of the terms and that of the
reversed terms, as one half of a term holds few of its edits: a state is the set of (trie node, edits
made) that a word's letters can reach, and states are made when first met, so a word
costs a lookup per letter and most words end after a few. Words joined by signs or digits are
looked up one by one as well. A window
of words around each hit is searched for reporting words, and quotation marks are paired over the whole text;
hits beside such words or inside quotations are counted apart from abuse. A logistic model over these counts gives the score.

Fitting uses at most ``fit_rows`` labelled rows with distinct texts, chosen by a hash of the id: one half
for the lexicon, the other half for the logistic model, so that the latter sees the
lexicon on texts it was not made from. The lexicon holds every word of its half above the least support and weight, so
``fit_rows`` bounds it as well. Scoring reads every whole text, very long ones included.

Columns of ``docs`` and ``labels`` beside those named are not read, whatever their names.

Defined cases: a null text scores as an empty one; without training rows of both kinds the score
is the share of toxic ones (0 if there are none); of several labels of a document
the largest counts; null labels count as missing; a null doc_id hashes as the empty string.
"""

from __future__ import annotations

import bisect
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagframe.llm.batches import bounded, lean
from flagframe.session import staged

FIT_ROWS = 12_000
LEAST_SUPPORT = 4
LEAST_WEIGHT = 2.0
STEMS = (4, 5)
WINDOW = 4
CACHED_WORDS = 150_000
CACHED_PAIRS = 2_000_000  # of all states of an automaton, which then starts anew
STATE_PAIRS = 100  # what a state takes besides, in pairs
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = "\"'`.,;:!?()[]{}<>|*_~-«»„“”‚‘’…¡¿"
MARK_KINDS = {'"': 0, "«": 1, "»": 1, "„": 2, "“": 2, "”": 2}
MARKS = frozenset(MARK_KINDS)
REPORTING = frozenset("said says wrote called quote quoted quotes word term insult disait dit appelé sagte nannte wort dijo llamó palabra".split())
FEATURES = 8
KINDS = ("exact", "stem", "fuzzy")
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


# --- matching ----------------------------------------------------------------------------------


class Trie:
    """The Levenshtein automata of terms read in one direction, intersected with their trie and determinised as needed.

    ``terms`` maps the letters in reading order to (term, edits, edits before the bound, bound): on the first ``bound`` letters
    fewer edits may be made than in all. A node that several terms share allows what the most tolerant of them does.
    """

    def __init__(self, terms: dict[str, tuple[str, int, int, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, int] | None] = [None]
        self.allowed = [0]
        for letters, (term, edits, early, bound) in terms.items():
            node = 0
            for depth, letter in enumerate(("", *letters)):
                if letter and letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][letter] if letter else node
                self.allowed[node] = max(self.allowed[node], early if depth <= bound else edits)
            self.term[node] = (term, edits)
        # a state is a set of 3 * node + edits made, kept as sorted 32-bit numbers
        self._begin()

    def _begin(self) -> None:
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.pairs = 0
        self.start = self._state(self._closed({0}))

    def _closed(self, pairs: set[int]) -> set[int]:
        todo = list(pairs)
        while todo:  # letters of the term that the word lacks
            node, made = divmod(todo.pop(), 3)
            for child in self.children[node].values():
                pair = 3 * child + made + 1
                if made < self.allowed[child] and pair not in pairs:
                    pairs.add(pair)
                    todo.append(pair)
        return pairs

    def _state(self, pairs: set[int]) -> int:
        if not pairs:
            return -1
        key = array("I", sorted(pairs)).tobytes()
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.pairs += len(pairs) + STATE_PAIRS
            self.moves.append({})
            ends = ((pair % 3, self.term[pair // 3]) for pair in pairs)
            self.ends.append(min(((made, end[0]) for made, end in ends if end and made <= end[1]), default=None))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        after = set()
        for pair in array("I", self.sets[state]):
            node, made = divmod(pair, 3)
            below = self.children[node]
            if letter in below:
                after.add(3 * below[letter] + made)
            for child in below.values():
                if made < self.allowed[child]:
                    after.add(3 * child + made + 1)
            if made < self.allowed[node]:
                after.add(3 * node + made + 1)
        target = self.moves[state][letter] = self._state(self._closed(after))
        return target

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that this direction reaches."""
        if self.pairs > CACHED_PAIRS:
            self._begin()
        state = self.start
        for letter in word:
            state = self.moves[state].get(letter) if letter in self.moves[state] else self._move(state, letter)
            if state < 0:
                return None
        return self.ends[state]


class Automaton:
    """The Levenshtein automata of a list of terms over two tries, one read from each end.

    Of a term's edits either not all lie in its first half, or its second half is free of them. The
    first kind is found from the front, where the first half takes one edit less than the whole, the second from
    the back, where the second half takes none. So few nodes near a trie's root are ever in a state,
    and the two directions together find what unrestricted automata do.
    """

    def __init__(self, terms: list[str]):
        front, back = {}, {}
        for term in terms:
            edits, half = self.edits(term), len(term) // 2
            front[term] = (term, edits, max(0, edits - 1), half)
            if edits:
                back[term[::-1]] = (term, edits, 0, len(term) - half - 1)
        self.front, self.back = Trie(front), Trie(back)

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def match(self, word: str) -> str | None:
        """The term nearest to ``word`` within the edits that its length allows."""
        found = [end for end in (self.front.match(word), self.back.match(word[::-1])) if end]
        return min(found)[1] if found else None


def quotations(words: list[str]) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """(opening, closing) marks, each as (word, letter), of the quotations in a text, in order and without overlaps.

    A mark before a word's letters opens, one after them closes; the others do what their form says.
    Kinds of marks are paired apart; a mark that opens again stands for the one before,
    which was not closed.
    """
    found, opened = [], {}
    for i, word in enumerate(words):
        if MARKS.isdisjoint(word):
            continue
        core = [j for j, c in enumerate(word) if c.isalnum()]
        for j, mark in enumerate(word):
            if mark not in MARKS:
                continue
            kind = MARK_KINDS[mark]
            if core and (j < core[0] or j > core[-1]):
                opens = j < core[0]
            elif mark == '"':
                opens = kind not in opened
            elif mark == "“":
                opens = kind not in opened or words[opened[kind][0]][opened[kind][1]] != "„"
            else:
                opens = mark in "«„"
            if opens:
                opened[kind] = (i, j)
            elif kind in opened:
                found.append((opened.pop(kind), (i, j)))
    merged: list = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


class Scorer:
    """Features and scores of texts; ``weights`` None means features only."""

    def __init__(self, lexicon: dict[str, float], weights: list[float] | None = None, constant: float = 0.0):
        self.lexicon, self.weights, self.constant = lexicon, weights, constant
        self._ready = False

    def _prepare(self) -> None:
        self.automaton = Automaton(sorted(w for w in self.lexicon if w[0] != "^" and Automaton.edits(w)))
        self.known: dict[str, tuple | None] = {}
        self._ready = True

    def forget(self) -> None:
        """Drop what was gathered for matching; it is gathered anew when needed."""
        self.automaton, self.known, self._ready = None, {}, False

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "constant": self.constant, "_ready": False}

    def classify(self, word: str) -> tuple[str, float, str] | None:
        """(kind, weight, term) of a lower-case word, kinds: exact, stem, fuzzy."""
        for one in dict.fromkeys((word, word.translate(LEET).strip(EDGES))):
            if one in self.lexicon:
                return "exact", self.lexicon[one], one
        for size in STEMS:
            stem = "^" + word[:size]
            if len(word) > size and stem in self.lexicon:
                return "stem", self.lexicon[stem], stem
        term = self.automaton.match(word) if len(word) >= 4 else None
        return ("fuzzy", self.lexicon[term], term) if term else None

    def hits(self, token: str) -> tuple[tuple[int, str, float, str], ...] | None:
        """(place, kind, weight, term) of the hits in a lower-case token, in order.

        A token with signs or digits inside is looked up as a whole, and so are its runs of letters, read as they
        are and after LEET. Of readings that overlap the surer kind counts, then the longer.
        """
        core = token.strip(EDGES)
        start = len(token) - len(token.lstrip(EDGES))
        if core.isalpha() or not core:
            hit = self.classify(core)
            return ((start, *hit),) if hit else None
        pieces = {(0, len(core)): core}
        for reading in (core.translate(LEET), core):
            pieces |= {m.span(): m.group() for m in LETTERS.finditer(reading)}
        found = [(KINDS.index(hit[0]), a - b, a, b, hit) for (a, b), piece in pieces.items() if (hit := self.classify(piece))]
        kept: list = []
        for _, _, a, b, hit in sorted(found):
            if all(b <= c or d <= a for c, d, _ in kept):
                kept.append((a, b, hit))
        return tuple((start + a, *hit) for a, _, hit in sorted(kept)) or None

    def features(self, text: str | None) -> np.ndarray:
        if not self._ready:
            self._prepare()
        words = (text or "").lower().split()
        distinct = set(words)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        for token in distinct.difference(self.known):
            self.known[token] = self.hits(token)
        hits = {w for w in distinct if self.known[w]}
        out = np.zeros(FEATURES)
        if not hits:
            return out
        abuse, quoted, terms, stems, fuzzy = [], 0.0, set(), [], 0.0
        spoken = quotations(words) if not MARKS.isdisjoint(text) else []
        for i, token in enumerate(words):
            if token not in hits:
                continue
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            reported = any(w.strip(EDGES) in REPORTING for w in near)
            for at, kind, weight, term in self.known[token]:
                before = bisect.bisect(spoken, ((i, at), (i, at))) - 1
                if reported or (before >= 0 and (i, at) < spoken[before][1]):
                    quoted += weight
                elif kind == "exact":
                    abuse.append(weight)
                    terms.add(term)
                elif kind == "stem":
                    stems.append(weight)
                else:
                    fuzzy += weight
        out[:] = (
            max(abuse, default=0.0), math.log1p(sum(abuse)), math.log1p(len(terms)), math.log1p(quoted),
            max(stems, default=0.0), math.log1p(sum(stems)), math.log1p(fuzzy), math.log1p(100 * (len(abuse) + len(stems)) / len(words)),
        )
        return out

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        z = float(self.features(text) @ np.array(self.weights)) + self.constant
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


# --- fitting -----------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """Text, toxic and half of at most about ``fit_rows`` labelled rows outside the held-out fold."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IS NOT NULL").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, fit_rows / max(1, marks.count()))
    spot = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    # written first: their measured size decides that they are broadcast and no text is shuffled for them
    marks = staged(marks.where((spot < int(share * (1 << 20))) & ~held_out(F.col("_id"))), "toxicity-marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(marks, F.col("doc_id") == F.col("_id")).where("text IS NOT NULL")
    return staged(
        rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("half", F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))), "toxicity-fit"
    )


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and word beginnings (marked ^) whose log odds for toxic texts are high."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]
    entries = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("term"))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    weight = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (clean + 1))
    found = (
        entries.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        .where(F.col("bad") >= max(LEAST_SUPPORT, toxic // 500)).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    )
    return {r["term"]: r["weight"] for r in found.select("term", "weight").collect()}  # words of half of fit_rows texts at most


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    rows = training_rows(bounded(docs), labels, fit_rows)
    lexicon = learn_lexicon(rows.where("half = 0"))
    plain = Scorer(lexicon)

    def featured(batches):
        for batch in batches:
            values = [plain.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(values, pa.list_(pa.float64())), "toxic": batch.column(1)})

    seen = rows.where("half = 1").select("text", "toxic").mapInArrow(lean(featured), "x array<double>, toxic int").collect()  # fit_rows at most
    y = np.array([r["toxic"] for r in seen], float)
    if len(set(y)) < 2:
        return Scorer(lexicon, None, float(y.mean()) if len(y) else 0.0)
    w = fit_logistic(np.array([r["x"] for r in seen]), y)
    return Scorer(lexicon, w[:-1].tolist(), float(w[-1]))


def _scored(scorer: Scorer):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], schema=schema)
        scorer.forget()

    return run


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(lean(_scored(fit(docs, labels, fit_rows))), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    scorer, place = fit(docs, labels, fit_rows), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))
        scorer.forget()

    return docs.mapInArrow(lean(run), docs.schema)
