"""Toxicity, language and personal data: held-out accuracy, exact parts and edges."""

import random

import numpy as np
import pytest
from brute import base_spans

from flagframe.llm import language, pii, toxicity

# --- toxicity ---------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert len(found) > 300 and all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.98


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_the_edit_distance():
    rng, terms = random.Random(3), ["stupid", "moron", "worthless", "idiot", "disgusting", "pathetic"]
    automaton = toxicity.Automaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "s", "t", "o"])
        word = "".join(word)
        near = {t for t in terms if edit_distance(word, t) <= automaton.edits(t)}
        assert (automaton.match(word) in near) if near else automaton.match(word) is None


def test_both_directions_find_the_nearest_of_alike_terms():
    rng = random.Random(5)
    for _ in range(25):
        terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(1, 12))})
        automaton = toxicity.Automaton(terms)
        for _ in range(150):
            word = list(rng.choice(terms))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "c", "d"])
            word = "".join(word)
            near = [(d, t) for t in terms if (d := edit_distance(word, t)) <= automaton.edits(t)]
            assert automaton.match(word) == (min(near)[1] if near else None)


def test_every_long_word_may_be_misspelt(monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 12))) for _ in range(600)})
    scorer = toxicity.Scorer({w: 2.0 + i / 1000 for i, w in enumerate(words)})
    assert all(scorer.features(f"so {w}x")[6] > 0 for w in words)
    assert not scorer.features("abc zzzzzzz").any()
    monkeypatch.setattr(toxicity, "CACHED_PAIRS", 1000)
    anew = toxicity.Scorer(scorer.lexicon)
    assert all((anew.features(f"so {w}x") == scorer.features(f"so {w}x")).all() for w in words[::20])


def test_quotation_counts_apart():
    scorer = toxicity.Scorer({"stupid": 3.0, "^vequ": 2.0})
    plain, quoted, misspelt, leet, stem = (scorer.features(t) for t in ("you are stupid now", 'he wrote "stupid" there', "so stupidd", "so stup1d", "a vequta"))
    assert plain[0] == 3.0 and plain[3] == 0 and quoted[0] == 0 and quoted[3] > 0
    assert misspelt[6] > 0 and leet[0] == 3.0 and stem[4] == 2.0 and not scorer.features(None).any() and not scorer.features("").any()


def test_quotations_of_several_words():
    scorer = toxicity.Scorer({"stupid": 3.0, "fool": 3.0})
    for text in (
        'the sign read "you stupid fool" in red', "„du stupid fool da“ in rot", "« un stupid fool ici » en rouge", "»so stupid fool hier«, ja",
        "“a stupid fool”, it had", '" stupid fool "', '5" tall, a "very, very long line with a stupid and at last a fool of no use at all". End', '("stupid"), "fool".',
        "“he had «so stupid» of a fool” then",
    ):
        out = scorer.features(text)
        assert out[0] == 0 and out[3] == pytest.approx(np.log1p(6)), text
    for text in ('you "stupid fool', 'stupid fool" you', '"he" stupid fool "you"', "»so« stupid fool »du«", "stupid fool"):
        out = scorer.features(text)
        assert out[0] == 3 and out[3] == 0, text


def test_joined_words():
    scorer = toxicity.Scorer({"idiot": 3.0, "^vequ": 2.0})
    for text in ("you/idiot", "well...idiot", "so-called-idiot", "word—idiot—word", "him,idiot", "you/1diot", "him!idiot", "x/id1ot!", "7idiot7"):
        out = scorer.features(text)
        assert out[0] == 3 and out[1] == pytest.approx(np.log1p(3)) and out[6] == 0, text
    both = scorer.features("idiot/idiot,vequta")
    assert both[1] == pytest.approx(np.log1p(6)) and both[4] == 2
    assert scorer.features("you/idiott")[6] > 0 and not scorer.features("you/and—we, 10-20 a.b").any()
    assert scorer.features('he,"idiot",she')[3] > 0


def test_toxicity_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    docs = docs_of([(1, "idiot"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 60_000)])
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(docs_of([]), labels.limit(0)).count() == 0
    one_kind = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in one_kind} == {0.0}


# --- language ---------------------------------------------------------------------------------------


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 150 and np.mean([r.lang_pred == r.lang for r in found]) > 0.97


def full_viterbi(scores, penalty):
    best = [(s, (i,)) for i, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v - penalty * (p[-1] != i) + s, (*p, i)) for v, p in best), key=lambda x: x[0]) for i, s in enumerate(row)]
    return max(v for v, _ in best)


def best_path(scores, penalty):
    """Viterbi's path as an array; one language for all words comes as its number."""
    path = language.viterbi(scores, penalty)
    return np.full(len(scores), path) if isinstance(path, int) else path


def test_viterbi_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(300):
        scores = rng.normal(size=(rng.integers(1, 12), 3)) * rng.choice([0.3, 2])
        path = best_path(scores, 1.5)
        value = scores[np.arange(len(path)), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(full_viterbi(scores.tolist(), 1.5))


def test_viterbi_finds_two_halves_beside_the_best_whole():
    assert language.viterbi(np.array([[0.0, -30, -10], [-30, 0, -10]]), 12.0).tolist() == [0, 1]
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = rng.integers(1, 5, 2)
        scores = np.where(np.repeat([[1, 0, 0], [0, 1, 0]], n, 0), 0.0, -3.0) - [0, 0, -2] + rng.normal(size=(n.sum(), 3)) * 0.5
        path = best_path(scores, 4.0)
        assert scores[np.arange(len(path)), path].sum() - 4 * (path[1:] != path[:-1]).sum() == pytest.approx(full_viterbi(scores.tolist(), 4.0))


def test_words_score_as_their_grams():
    rng = random.Random(8)
    counts = {lang: {"".join(rng.choices("abñж^$", k=rng.randint(1, 3))): rng.randint(1, 9) for _ in range(60)} for lang in ("x", "y")}
    model = language.Model(counts, {"x": {"Latin": 5}, "y": {"Latin": 5, "Cyrillic": 5}})
    words = list({"".join(rng.choices("abñжz漢", k=rng.randint(1, 9))) for _ in range(200)})
    model.learn(words)
    for word in words:
        row = sum(model.table[model.rows.get(gram, 0)] for gram in language.grams(word)) + model.masks.get(language.script(word), 0.0)
        assert model.scores[model.known[word]] == pytest.approx(row, rel=1e-5)
        assert model.lengths[model.known[word]] == len(word)


def test_numbers_are_no_letters(docs_of):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100, "½ ²", None), (101, "① Ⅷ 12", None), (102, "½cat² the", None), (103, "dog " * 30_000, None)]
    found = {r.doc_id: (r.lang_pred, r.score, [tuple(s) for s in r.spans]) for r in language.languages(docs_of(rows)).collect()}
    assert found[100] == found[101] == ("und", 0.0, [])
    assert found[102] == ("en", 1.0, [(1, 9, "en")]) and found[103] == ("en", 1.0, [(0, 119_999, "en")])


def test_language_spans(docs_of):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "привет как дела", "ru") for i in range(30)]
    rows += [(200, "1. the cat and the dog, привет как дела! the dog and the cat.", None), (201, "İ the İİ cat (привет как дела)", None), (202, "12", None), (203, None, None)]
    found = {r.doc_id: r for r in language.languages(docs_of(rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    cut = {k: [(s.lang, text[k][s.start : s.end]) for s in r.spans] for k, r in found.items()}
    assert cut[200] == [("en", "the cat and the dog"), ("ru", "привет как дела"), ("en", "the dog and the cat")] and found[200].lang_pred == "en"
    assert cut[201] == [("en", "İ the İİ cat"), ("ru", "привет как дела")] and cut[0] == [("en", "the cat and the dog")]
    assert found[202].spans == found[203].spans == []


def test_language_edges(docs_of):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "привет как дела", "ru") for i in range(30)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !!", "en"), (203, "привет", None), (204, "the dog", None), (204, "the dog", None), (None, "cat", "en")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs_of(rows)).collect()}
    assert found[200] == found[201] == found[202] == ("und", 0.0)
    assert found[203][0] == "ru" and found[204][0] == "en"
    assert language.languages(docs_of([])).count() == 0
    assert language.languages(docs_of([(1, "word", None)])).first().lang_pred == "und"


# --- personal data ------------------------------------------------------------------------------------


def test_base_spans_match_plain_patterns():
    rng = random.Random(11)
    parts = ["a@b.c", "x.y@h-1.com", "@", ".", "1.2.3.4", "300.1.1.1", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "+", " ", "-", "7", "a", "1.2.3.4.5.6.7.8", "é", "()"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        order = lambda spans: sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert order(pii.base_spans(text)) == order(base_spans(text)), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@") == []


def test_gradients():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger(hidden=3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x = rng.integers(97, 103, (6, 2))
    y = np.array([[0, 1, 2, 0, 3, 4], [1, 2, 2, 0, 0, 0]]).T
    _, grads = tagger.loss(x, y)
    for name in ("trans", "out", "rec_f", "rec_b", "in_f", "bias"):
        flat = tagger.p[name].ravel()
        for i in rng.choice(np.flatnonzero(np.abs(grads[name].ravel()) > 1e-3), 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = tagger.loss(x, y)[0]
            flat[i] = old - 1e-3
            down = tagger.loss(x, y)[0]
            flat[i] = old
            assert grads[name].ravel()[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_model_adds_other_notations(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/documents.parquet")
    tagger = pii.fit(docs)
    hidden = ["call (988) 555-2485 the end of it all", "write to bosbt.42 at mail8.example.com as they were", "so 4041.8949.7460.8795 it was"]
    found = pii.added_spans(tagger, hidden, [pii.base_spans(t) for t in hidden])
    assert sum(bool(f) for f in found) >= 2
    rows = pii.personal_data(docs, fit_windows=300).select("n_email", "n_ip", "n_card", "n_phone", "n_added").collect()
    base = sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    assert base > 200 and sum(r.n_added for r in rows) < 0.2 * base


def test_model_adds_emails_without_digits(spark, sf_dir):
    tagger = pii.fit(spark.read.parquet(f"{sf_dir.replace('0.01', '0.1')}/documents.parquet"))
    hidden = [f"{'the of and ' * 12}write to {mail} as they were" for mail in ("anna.smith at example dot com", "anna.smith(at)mail.example.com", "anna.s [at] mail[.]example[.]com")]
    found = pii.added_spans(tagger, hidden, [[] for _ in hidden])
    assert sum(any(k == "email" and "at" in t[a:b] and b - a > 12 for k, a, b in f) for t, f in zip(hidden, found)) == 3, found


def test_model_reads_as_if_over_whole_texts():
    """Spans of decoding all windows of a text, of any length and far from the mark."""
    rng, pieces = np.random.default_rng(4), ["a", " at ", "7", "@", "word", " ", ".", "(at)", "12.3.4.5"]
    ended = 0
    for seed in range(6):
        tagger = pii.Tagger(seed)
        tagger.p["out"] *= 8
        tagger.p["bias"][0] += 1.5
        texts = ["".join(rng.choice(pieces, rng.integers(1, 300))) for _ in range(8)] + ["", "@", "x" * 48, "at " * 32]
        for text, got in zip(texts, pii.added_spans(tagger, texts, [[] for _ in texts])):
            n, e, weight = len(text), np.zeros((len(text), pii.LABELS)), np.zeros((len(text), 1))
            for s in range(0, max(1, n - pii.STRIDE), pii.STRIDE) if n else ():
                x = np.full((pii.WINDOW, 1), ord(" "))
                piece = pii.codes(text[s : s + pii.WINDOW])
                x[: len(piece), 0] = piece
                centre = (1.0 + np.minimum(np.arange(pii.WINDOW), np.arange(pii.WINDOW)[::-1]))[: len(piece), None]
                e[s : s + len(piece)] += tagger.emissions(x)[: len(piece), 0] * centre
                weight[s : s + len(piece)] += centre
            path = tagger.decode((e / weight)[:, None], np.array([n]))[:, 0] if n else np.zeros(0, int)
            spans = []
            for kind, a, b in pii._spans_of(path, 0):
                a, b = a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())
                if pii.plausible(kind, text[a:b]):
                    spans.append((kind, a, b))
            assert got == spans
            ended += len(spans)
    assert ended > 20


def test_personal_data_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "mail a@b.cd"), (3, "mail a@b.cd"), (None, "1.2.3.4"), (5, "9" * 50_000)]
    found = {r.doc_id: r for r in pii.personal_data(docs_of(rows)).collect()}
    assert found[1].spans == found[2].spans == "" and found[3].n_email == 1 and found[None].n_ip == 1
    assert pii.personal_data(docs_of([])).count() == 0
