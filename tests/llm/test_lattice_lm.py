import math
import zlib
from collections import Counter

import pytest

import fixtures
from tallywatch.llm import lattice_lm
from tallywatch.llm.queries import VOCABULARIES

MODEL = f"{VOCABULARIES}/piece_bpe_32k.model"
WEIGHTS = {b" ": math.log(0.2), b" a": math.log(0.1), b"a": math.log(0.3), b"b": math.log(0.1), b"ab": math.log(0.2), b"aba": math.log(0.1)}


def all_ways(text):
    if not text:
        return [[]]
    return [[text[:k], *rest] for k in range(1, len(text) + 1) if text[:k] in WEIGHTS for rest in all_ways(text[k:])]


@pytest.mark.parametrize("word", [b"a", b"abab", b"ababa", b"bbaba"])
def test_all_segmentations_count(word):
    ways = [math.exp(sum(WEIGHTS[p] for p in way)) for way in all_ways(b" " + word)]
    lattice = lattice_lm.Lattice(WEIGHTS)
    assert lattice.log_prob(word) == pytest.approx(math.log(sum(ways)))
    want = Counter()
    for way, weight in zip(all_ways(b" " + word), ways, strict=True):
        for piece in way:
            want[piece] += 3 * weight / sum(ways)
    got = {}
    lattice.add_expected(word, 3, got)
    assert got == pytest.approx(dict(want))


def test_both_recursions_agree():
    lattice, short, long = lattice_lm.Lattice(lattice_lm.pieces_of(MODEL)), {}, {}
    for word in (b"the", b"blelyandthere", "naïveté".encode(), b"x" * 22):
        lattice._add_short(b" " + word, 2, short)
        lattice._add_long(b" " + word, 2, long)
    assert short == pytest.approx(long)


def test_vocabulary_weights_sum_to_one():
    weights = lattice_lm.pieces_of(MODEL)
    assert math.fsum(map(math.exp, weights.values())) == pytest.approx(1)
    assert all(bytes([b]) in weights for b in range(256))
    assert lattice_lm.Lattice(weights).log_prob("日本".encode()) > -200


@pytest.mark.parametrize("frequent", [100_000, 3, 0])
def test_scores_of_a_table(spark, frequent):
    rows = fixtures.EDGE_ROWS + [(20 + i, f"The number {i} and the word w{i % 5}") for i in range(30)]
    got = lattice_lm.score_documents(fixtures.table(spark, rows), MODEL, frequent_words=frequent).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    train = Counter(w for i, t in rows if not held[i] for w in fixtures.plain_words(t))
    ends = sum(not held[i] for i, _ in rows)
    total, distinct = sum(train.values()) + ends, len(train) + 1
    texts = dict(rows)
    for r in got:
        words = fixtures.plain_words(texts[r.doc_id])
        base = math.fsum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words) + math.log10((ends + 1) / (total + distinct + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words) + 1, total)
        assert r.n_known == sum(train[w] > 0 for w in words) + 1
        assert r.base_score == pytest.approx(base) and -1e7 < r.score < 0


def test_learning_helps_and_edges(spark):
    rows = [(i, "zqxv zqxv jwkq " * 20) for i in range(40)]
    held = [r for r in lattice_lm.score_documents(fixtures.table(spark, rows), MODEL).collect() if r.held_out]
    untaught = lattice_lm.Lattice(lattice_lm.pieces_of(MODEL))
    plain = 20 * (2 * untaught.log_prob(b"zqxv") + untaught.log_prob(b"jwkq")) / math.log(10)
    assert held and all(r.score > plain for r in held)
    assert lattice_lm.score_documents(fixtures.empty(spark), MODEL).count() == 0
