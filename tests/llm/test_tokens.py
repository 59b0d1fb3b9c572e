import random

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from flagframe.llm.tokens import BARE_STOP, CACHED_WORDS, CHARS_AT_ONCE, WordTokenizer, worker_tokenizer

CODED = WordTokenizer()
SMALL = WordTokenizer(cached_words=6, chars_at_once=15)


def direct(text):
    return np.array(CODED.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_documents_as_coded_directly(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text, ids in zip(texts, CODED.encode_all(texts)):
        assert ids == direct(text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aZéÉßİΣσςK' .,;:!?-½²5١あ́\t\n  ǅ")), max_size=30))
def test_any_text(text):
    assert CODED.encode(text) == direct(text)


def test_words_with_closings_known_before_or_not():
    words = ["Alpha", "alpha.", "ALPHA?!", "beta,", "don't", "x1.", "...", "?", "é.", "É;"]
    for seed in range(20):
        rng, fresh = random.Random(seed), WordTokenizer()
        texts = [" ".join(rng.choices(words, k=4)) for _ in range(8)]
        assert [fresh.encode(t) for t in texts] == [direct(t) for t in texts]


class Counting:
    """A tokenizer that keeps what it is asked."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_whole_tokenizer_meets_only_what_its_model_cannot():
    fresh = WordTokenizer()
    fresh.tokenizer = Counting(fresh.tokenizer)
    text = "word Word, été! word### don't 10.0.0.1 x<|endoftext|> Ünder"
    assert fresh.encode(text) == direct(text)
    assert sorted(fresh.tokenizer.asked) == sorted([",", "!", "###", "'t", ".", "0", "1", "x<|endoftext|>", "Ünder"])


def test_a_full_cache_keeps_words_met_again():
    fresh = WordTokenizer(cached_words=8)
    fresh.encode("a b c d e f g")
    fresh.encode("a b h i")
    fresh.encode("j")
    assert set(fresh.known) == {b"a", b"b", b"j"} and fresh.encode("a c j") == direct("a c j")
    fresh.encode("k l m n o p q r s")  # more than half met again: nothing is kept
    fresh.encode("k l m n o p q r s")
    fresh.encode("t")
    assert set(fresh.known) == {b"t"}


def test_bounds_of_a_worker_are_its_last_tasks():
    assert worker_tokenizer(None, 9, 10).cached_words == 9
    assert (worker_tokenizer().cached_words, worker_tokenizer().chars_at_once) == (CACHED_WORDS, CHARS_AT_ONCE)


def test_letters_are_known_once_whatever_closes_them():
    fresh = WordTokenizer()
    text = "alpha, Alpha alpha. (alpha) été! été?! été"
    assert fresh.encode(text) == direct(text)
    assert {word for word in fresh.known if word > b"a"} == {b"alpha", "été".encode()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(list("abCé.,!1' \n")), max_size=12), max_size=8))
def test_small_caches_and_batches(texts):
    assert list(SMALL.encode_all(texts)) == [direct(text or "") for text in texts]


def test_every_letter_that_meets_the_model_alone():
    for letter in map(chr, range(97, BARE_STOP)):
        text = f"a{letter}b, {letter}{letter}. {letter}"
        assert CODED.encode(text) == direct(text)
