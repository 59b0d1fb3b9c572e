"""Token ids of whole texts with a public tokenizer, cached by word.

The tokenizer splits at white space and drops it, so the ids of a text are those of its
words in order. It also lowers the case, so A-Z are lowered before words are told apart. Arrow splits some texts
at a time and finds their distinct words, and numpy lays the words' ids out again, so that Python meets a word once for
all its places. A word of letters with closing punctuation is its letters' ids and the punctuation's, told apart before
anything is looked up, and other words of ASCII are their pieces'. Words are looked up in a bounded cache of
their coded ids; a full one keeps the words that were met again.
Unknown words of letters reach the tokenizer joined to one text: each makes one
piece, and every piece ends with a token that ends a word, which shows where the words' ids
end. Where they are lowered and normalised as they stand, the tokenizer's model meets them without its normaliser and
its expressions, which take as long as the model. Other unknown words are coded one by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress, count, pairwise, repeat
from operator import not_
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CACHED_WORDS = 250_000  # beyond it words are learned anew
CHARS_AT_ONCE = 500_000
SCAN_BOUNDS = 800_000, 2_000_000  # the same where a job is a narrow scan, whose workers hold little else
CLOSING = punctuation.encode()
PIECES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")  # the tokenizer's, of lowered ASCII without white space
BARE_STOP = 0x500  # letters below it are checked against the tokenizer when it is loaded
# what the model calls the bytes of letters beyond ASCII: those that do not print have other names
BYTE_LETTERS = np.arange(256, dtype="<u2")
BYTE_LETTERS[128:161] += 162
BYTE_LETTERS[173] = 323
OTHER, LETTERS, BARE = range(3)


def _kind(word: bytes) -> int:
    """Whether the tokenizer sees letters only (normalised and lowered, some are not), and whether it leaves them as they are."""
    if word.isascii():
        return BARE if word.isalpha() else OTHER
    text = word.decode()
    low = text.lower()
    if not (low.isalpha() and is_normalized("NFC", text)):
        return OTHER
    return BARE if low == text and ord(max(text)) < BARE_STOP else LETTERS


# A letter below BARE_STOP joins no other to one letter and is lowered alone, so words of such letters are left as they are.
BARE_WORD = f"^[a-z{''.join(c for c in map(chr, range(128, BARE_STOP)) if _kind(c.encode()) == BARE)}]+$"


def _laid_out(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` of the given ``sizes`` in another order, with repeats; and where each of them ends."""
    starts, taken = np.cumsum(sizes) - sizes, sizes[order]
    ends = np.cumsum(taken)
    return ids[np.arange(taken.sum()) + np.repeat(starts[order] - ends + taken, taken)], ends


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes. One per Python worker."""

    def __init__(self, path: str | None = None, cached_words: int = CACHED_WORDS, chars_at_once: int = CHARS_AT_ONCE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.cached_words, self.chars_at_once = cached_words, chars_at_once
        # a word's row tells where its ids lie and whether it was met again; row 0 is of no word and has no ids
        self.known: dict[bytes, int] = {}
        self.ids, self.sizes, self.again = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, bool)
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        every = [f"a{chr(c)}b".encode() for c in range(97, BARE_STOP)]
        every = [word for word in every if _kind(word) == BARE]
        self.is_bare = np.array_equal(self._joined(every, BARE), self._joined(every, LETTERS))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Rows of distinct words."""
        if len(self.known) > self.cached_words:
            self._forget()
        rows = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        if len(self.known) > self.cached_words // 2:
            self.again[rows] = True
        new = np.flatnonzero(rows == 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self.learn(unknown)
            rows[new] = list(map(self.known.__getitem__, unknown))
        return rows

    def _forget(self) -> None:
        """Keep the words that were met again, or none if they are many."""
        self.again[0] = False
        if np.count_nonzero(self.again) > self.cached_words // 2:
            self.again[:] = False
        words = list(compress(self.known, map(self.again.tolist().__getitem__, self.known.values())))
        rows = np.array([0, *map(self.known.__getitem__, words)])
        self.ids, _ = _laid_out(self.ids, self.sizes, rows)
        self.sizes, self.again = self.sizes[rows], np.zeros(len(rows), bool)
        self.known = dict(zip(words, count(1)))

    def _keep(self, words: Iterable[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, count(len(self.sizes))))
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.again = np.append(self.again, np.zeros(len(sizes), bool))

    def learn(self, new: list[bytes]) -> None:
        known, cut, letters, other = self.known, [], set(), set()
        is_bare = pc.match_substring_regex(pa.array(new, pa.large_binary()).cast(pa.large_string()), BARE_WORD).to_pylist()
        bare = set(compress(new, is_bare))
        for coded in compress(new, map(not_, is_bare)):
            core = coded.rstrip(CLOSING)
            kind = _kind(core)
            if kind != OTHER:
                if core not in known:
                    (bare if kind == BARE else letters).add(core)
                if len(core) < len(coded):
                    cut.append((coded, [core, coded[len(core) :]]))
            elif coded.isascii() and len(parts := PIECES.findall(coded)) > 1 and not any(token in coded for token in self.added):
                cut.append((coded, parts))
            else:
                other.add(coded)
        for part in set().union(*[parts for _, parts in cut]).difference(known, bare, letters):
            (bare if part.isalpha() else other).add(part)
        for some, kind in (bare, BARE), (letters, LETTERS):
            if some and not self._learn_joined(list(some), kind):
                other |= some
        coded = [one.ids for one in self.tokenizer.encode_batch_fast([word.decode() for word in other], add_special_tokens=False)]
        self._keep(other, np.array(list(chain.from_iterable(coded)), "<u4"), np.array(list(map(len, coded)), np.int64))
        rows = np.array([known[part] for _, parts in cut for part in parts], np.int64)
        ids, ends = _laid_out(self.ids, self.sizes, rows)
        last = np.cumsum([len(parts) for _, parts in cut], dtype=np.int64) - 1
        self._keep([word for word, _ in cut], ids, np.diff(ends[last], prepend=0))

    def _joined(self, words: list[bytes], kind: int) -> np.ndarray:
        joined = b" ".join(words)
        if kind == BARE:
            tokenizer, text = self.bare, BYTE_LETTERS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le")
        else:
            tokenizer, text = self.tokenizer, joined.decode()
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_joined(self, words: list[bytes], kind: int) -> bool:
        """Code words of letters in one go; False if they do not make one piece each."""
        ids = self._joined(words, kind if self.is_bare else LETTERS)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            return False
        self._keep(words, ids[: stops[-1]], np.diff(stops, prepend=0))
        return True

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids per text. Texts of ``chars_at_once`` characters together look up what is new to them at once."""
        start, chars = 0, 0
        for stop, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars < self.chars_at_once and stop < len(texts):
                continue
            yield from self._encode(texts[start:stop])
            start, chars = stop, 0

    def _encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([text or "" for text in texts], pa.large_string())))
        places = split.values.dictionary_encode()
        ids, sizes = self._ids_of(places.dictionary)
        ids, ends = _laid_out(ids, sizes, places.indices.to_numpy())
        data, stops = ids.tobytes(), 4 * np.append(0, ends)[split.offsets.to_numpy()]
        for start, stop in pairwise(stops.tolist()):
            yield data[start:stop]

    def _ids_of(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
        cores = pc.ascii_rtrim(words, punctuation)
        bare = pc.match_substring_regex(cores, BARE_WORD).to_numpy(zero_copy_only=False)
        ends = np.where(bare, starts[:-1] + pc.binary_length(cores).to_numpy(), starts[1:])
        # the same bytes as letters, closing, letters, closing ...; words that are not split close with nothing, as the first row does
        cuts = np.concatenate([starts[:1], np.column_stack([starts[:-1], ends]).ravel(), starts[-1:]])
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), words.buffers()[2]).dictionary_encode()
        distinct = parts.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        rows = np.append(0, self.look_up(distinct[1:]))
        ids, part_ends = _laid_out(self.ids, self.sizes, rows[parts.indices.to_numpy()[1:]])
        return ids, np.diff(part_ends[1::2], prepend=0)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


_WORKER: dict[str | None, WordTokenizer] = {}


def worker_tokenizer(path: str | None = None, cached_words: int = CACHED_WORDS, chars_at_once: int = CHARS_AT_ONCE) -> WordTokenizer:
    """The tokenizer of this Python worker, loaded once and kept for its next tasks, which may set other bounds."""
    if path not in _WORKER:
        _WORKER[path] = WordTokenizer(path)
    _WORKER[path].cached_words, _WORKER[path].chars_at_once = cached_words, chars_at_once
    return _WORKER[path]
