"""Operator 4: language identification of mixed text by Viterbi over per-word scores.

Each word's script, told by letter ranges, narrows its candidate languages to those
that were seen to use the script. Candidates score by the log probabilities of the word's letter n-grams, learned
from labelled texts; the n-grams of many new words are looked up at once, as numbers in sorted arrays. Viterbi with a penalty for each switch then labels spans of words;
the language with the most letters is the text's, and its share of the letters the score. The spans are
returned as well, each from its first word's start to its last word's end (``language_spans``).

A path that never switches is best if no stretch of words gains more than the penalty in
another language, and none at an end of the text more than half of it. That is checked with running sums over
a text's words, and only texts where a stretch does gain more take the step-by-step way.

Fitting uses at most about ``fit_rows`` labelled texts, chosen by a hash of the id; prediction reads
every whole text. Defined cases: ``und``, score 0 and no spans for a null text or one without letters, and
where nothing could be learned; ties between languages go to the first in order of code points.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagframe.llm.batches import lean
from flagframe.llm.toxicity import held_out

FIT_ROWS = 8_000
GRAMS = 20_000
SIZES = (1, 2, 3)
PENALTY = 12.0
LEAST_SHARE = 0.005
CACHED_WORDS = 600_000
TEXTS_AT_ONCE = 256
NO_CANDIDATE = -1e3
WORDS = re.compile(r"[^\W\d_]+")  # besides letters, numbers that are no decimal digits
LETTERS = regex.compile(r"\p{L}+")

# (first code point, script): a range reaches to the next entry; letters before U+0370 are Latin.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
)
STARTS = [r[0] for r in RANGES]


def script(word: str) -> str:
    return RANGES[bisect.bisect_right(STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


class Model:
    """Log probabilities of n-grams per language, and the languages of each script."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]], penalty: float = PENALTY):
        self.langs, self.penalty = sorted(counts), penalty
        self.rows: dict[str, int] = {}
        for lang in self.langs:
            for gram in counts[lang]:
                self.rows.setdefault(gram, len(self.rows) + 1)
        table = np.zeros((len(self.rows) + 1, len(self.langs)))
        for j, lang in enumerate(self.langs):
            for gram, n in counts[lang].items():
                table[self.rows[gram], j] = n
        total = table.sum(0) + 0.5 * len(table)
        self.table = np.log((table + 0.5) / total) / len(SIZES)
        letters = {lang: max(1, sum(scripts.get(lang, {}).values())) for lang in self.langs}
        self.masks = {}
        for name in {s for one in scripts.values() for s in one}:
            uses = np.array([scripts.get(lang, {}).get(name, 0) >= LEAST_SHARE * letters[lang] for lang in self.langs])
            self.masks[name] = np.where(uses, 0.0, NO_CANDIDATE) if uses.any() else np.zeros(len(self.langs))
        # n-grams as numbers with a digit per letter, sorted, with their rows
        self.letters = np.unique(np.array([ord(c) for gram in self.rows for c in gram], np.int64))
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in SIZES:
            own = [gram for gram in self.rows if len(gram) == size]
            keys = self._keys(self._digits("".join(own)), size)[::size] if own else np.empty(0, np.int64)
            order = np.argsort(keys)
            self.keys[size] = keys[order], np.array([self.rows[gram] for gram in own], np.int64)[order]
        self._start()

    def _digits(self, text: str) -> np.ndarray:
        """A number from 1 for every letter of some n-gram, 0 for others."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(self.letters):
            return np.zeros(len(codes), np.int64)
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[place] == codes, place + 1, 0)

    def _keys(self, digits: np.ndarray, size: int) -> np.ndarray:
        """The n-gram that begins at each place as one number; the last places run into zeros."""
        base, key = len(self.letters) + 1, np.zeros(len(digits), np.int64)
        padded = np.concatenate([digits, np.zeros(size, np.int64)])
        for i in range(size):
            key = key * base + padded[i : i + len(digits)]
        return key

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)), np.float32)
        self.lengths = np.zeros(1 << 12)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores", "lengths")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def learn(self, words: list[str]) -> None:
        base, stop = len(self.known), len(self.known) + len(words)
        while stop > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        digits = self._digits("".join([f"^{w}$" for w in words]))
        ends = np.cumsum(lengths + 2)
        left = np.repeat(ends, lengths + 2) - np.arange(len(digits))  # letters from each place to the end of its word
        total = np.zeros((len(digits), len(self.langs)))
        for size in SIZES:
            keys, rows = self.keys[size]
            own = self._keys(digits, size)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                row = np.where(keys[place] == own, rows[place], 0)
            else:
                row = np.zeros(len(own), np.int64)
            total += np.where((left >= size)[:, None], self.table[row], 0.0)
        sums = np.add.reduceat(total, ends - lengths - 2)
        none = np.zeros(len(self.langs))
        self.scores[base:stop] = sums + np.array([self.masks.get(script(w), none) for w in words])
        self.lengths[base:stop] = lengths
        self.known.update(zip(words, range(base, stop)))

    def predict_all(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters, spans) of each text; new words are scored for many texts at once."""
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[start : start + TEXTS_AT_ONCE]
            lower = [(text or "").lower() for text in some]
            split = [WORDS.findall(low) for low in lower]
            distinct = set().union(*split)
            if len(self.known) > CACHED_WORDS:
                self._start()
            new = distinct.difference(self.known)
            if odd := {w for w in new if not w.isalpha()}:
                split = [w if odd.isdisjoint(w) else LETTERS.findall(low) for w, low in zip(split, lower)]
                new = set().union(*split).difference(self.known)
            if new and self.langs:
                self.learn(list(new))
            for words, low, text in zip(split, lower, some):
                yield self._label(words, low, text) if words and self.langs else ("und", 0.0, [])

    def _label(self, words: list[str], low: str, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        path = viterbi(self.scores[at].astype(np.float64), self.penalty)
        if isinstance(path, int):
            best, share = path, 1.0
        else:
            letters = np.bincount(path, self.lengths[at], len(self.langs))
            best = int(letters.argmax())
            share = float(letters[best] / letters.sum())
        spans = [(a, b, self.langs[lang]) for a, b, lang in stretches(path, words, low, text)]
        return self.langs[best], share, spans


def stretches(path: np.ndarray | int, words: list[str], low: str, text: str) -> list[tuple[int, int, int]]:
    """(start, end, language) of each stretch of ``path``, from its first word's start to its last word's end in ``text``."""
    if isinstance(path, int):
        found = [(low.index(words[0]), low.rindex(words[-1]) + len(words[-1]), path)]
    else:
        starts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()]
        at, end = [], 0
        for word in words:
            begin = low.index(word, end)
            end = begin + len(word)
            at.append((begin, end))
        found = [(at[i][0], at[j - 1][1], int(path[i])) for i, j in zip(starts, [*starts[1:], len(words)])]
    if len(low) == len(text):
        return found
    # some letters are two in lower case
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[a], origin[b - 1] + 1, lang) for a, b, lang in found]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray | int:
    """The path (a language per word) with the largest sum of scores less ``penalty`` per switch; one number if it never switches."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gains = np.cumsum(scores - scores[:, [best]], 0)
    low = np.minimum(np.minimum.accumulate(gains, 0), 0)
    # half a switch is paid on either side: a stretch at one end of the text pays one half, others pay two
    if max(gains.max(), (gains[-1] - gains).max()) <= penalty / 2 and (n == 1 or (gains[1:] - low[:-1]).max() <= penalty):
        return best
    rows = scores.tolist()
    value, back = rows[0], []
    for row in rows[1:]:
        top = max(value)
        switched = top - penalty
        if min(value) < switched:
            lead = value.index(top)
            back.append([lead if v < switched else j for j, v in enumerate(value)])
            value = [(switched if v < switched else v) + s for v, s in zip(value, row)]
        else:
            back.append(None)  # every language stays
            value = [v + s for v, s in zip(value, row)]
    now = value.index(max(value))
    path = [now]
    for step in reversed(back):
        if step is not None:
            now = step[now]
        path.append(now)
    path.reverse()
    return np.array(path)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams (kind g) and of letters by script (kind s) per language, summed per task."""
    words: dict[str, Counter] = {}
    letters: Counter = Counter()
    found: dict[str, Counter] = {}

    def spell() -> None:
        for lang, seen in words.items():
            own = found.setdefault(lang, Counter())
            for word, n in seen.items():
                letters[lang, script(word)] += n * len(word)
                for gram in grams(word):
                    own[gram] += n
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, words.values())) > CACHED_WORDS:
            spell()
    spell()
    rows = [(lang, "s", item, n) for (lang, item), n in letters.items()]
    rows += [(lang, "g", item, n) for lang, own in found.items() for item, n in own.items()]
    for at in range(0, len(rows) or 1, 1 << 16):
        columns = list(zip(*rows[at : at + (1 << 16)])) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "kind", "item", "n"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    share = min(1.0, fit_rows / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = some.select("lang", "text").mapInArrow(lean(_counted), "lang string, kind string, item string, n long")
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= GRAMS)
    found: dict[str, dict[str, dict[str, int]]] = {"g": {}, "s": {}}
    for r in top.collect():  # GRAMS rows per language at most
        found[r["kind"]].setdefault(r["lang"], {})[r["item"]] = r["n"]
    return Model(found["g"], found["s"], penalty)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def language_spans(docs: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    """Per document: doc_id, lang_pred, score and spans, the stretches of one language in order (code points, ends exclusive)."""
    model = fit(docs, fit_rows, penalty)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.predict_all(batch.column(1).to_pylist()))
            spans = [[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        model._start()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = PENALTY) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, spans."""
    predicted = language_spans(docs, fit_rows, penalty)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
