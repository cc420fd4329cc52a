import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import fixtures
from tallywatch.llm import packing, token_store
from tallywatch.llm.queries import VOCABULARIES
from tallywatch.llm.tokens import encoder

WORD, BYTE = f"{VOCABULARIES}/word_bpe_49k.json", f"{VOCABULARIES}/byte_bpe_50k.json"
LETTERS = [*"abcdeABZ  \n\n'.,!?|$%0129éñßÄçñ²µªº\"()-=+@ ", "'s", " the", " don't"]


def library(path, text, end_id):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_same_ids_as_the_library(path):
    rng, one = random.Random(5), encoder(path)
    odd = [*LETTERS, "œ", "\t", "\r", "\xa0", "日", "́", "\x1c", "İ", "<|endoftext|>"]
    for k in range(1500):
        text = "".join(rng.choice(LETTERS if k % 2 else odd) for _ in range(rng.randint(0, 30)))
        assert one.encode(text) == one.encode_whole(text), repr(text)


def test_codes_are_optimal_and_limited():
    assert token_store.code_lengths({}) == {}
    assert token_store.code_lengths({7: 3}) == {7: 1}
    # Without a binding limit: the lengths of a Huffman tree by hand.
    assert token_store.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}) == {1: 3, 2: 3, 3: 2, 4: 1}
    lengths = token_store.code_lengths({i: 2 ** i for i in range(30)}, limit=8)
    assert max(lengths.values()) == 8 and sum(2.0 ** -n for n in lengths.values()) <= 1
    codes, bits, _ = token_store.canonical(lengths)
    words = [f"{int(c):0{int(b)}b}" for c, b in zip(codes, bits, strict=True)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_round_trip_of_a_block(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 3000
    counts = {int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)} or {0: 1}
    codes, bits, table = token_store.canonical(token_store.code_lengths(counts))
    data, marks = token_store.pack(ids, codes, bits)
    assert (token_store.unpack(data, marks, n, table, bits) == ids).all()


@pytest.mark.parametrize("n", [65_536, 65_537, 70_000, 300_000])
def test_more_ids_than_sixteen_bits_hold(n):
    ids = np.random.default_rng(n).permutation(np.r_[np.arange(n), np.zeros(1000, np.int64), np.arange(500)])
    lengths = token_store.code_lengths(dict(enumerate(np.bincount(ids).tolist())))
    assert len(lengths) == n and sum(2.0 ** -b for b in lengths.values()) <= 1
    codes, bits, table = token_store.canonical(lengths)
    data, marks = token_store.pack(ids, codes, bits)
    assert (token_store.unpack(data, marks, len(ids), table, bits) == ids).all()


def test_store_reads_back_every_document(spark):
    rows = fixtures.EDGE_ROWS + [(100 - i, f"document number {i} " * (i % 40)) for i in range(60)]
    got = token_store.store_digest(fixtures.table(spark, rows), WORD, 2, block_tokens=500).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, text in order:
        ids = library(WORD, text, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.store_digest(fixtures.empty(spark), WORD, 2).count() == 0


def brute_cost(at, price, width):
    best = [0.0]
    for j in range(1, len(at)):
        options = [best[i] + (0 if (d := at[j] - at[i]) & (d - 1) == 0 and d >= packing.SMALLEST else width - d)
                   for i in range(j) if at[j] - at[i] <= width]
        best.append(min(options) + price[j])
    return best[-1]


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        at = sorted({0, *(rng.randint(1, 700) for _ in range(40)), *range(100, 701, 100)})
        price = [0, *(rng.choice((4, 12, 68)) for _ in at[1:])]
        cuts = packing.plan_cuts(at, price, 128)
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        cost = sum(price[at.index(b)] + (0 if (d := b - a) & (d - 1) == 0 and d >= packing.SMALLEST else 128 - d) for a, b in zip(cuts, cuts[1:], strict=False))
        assert cost == brute_cost(at, price, 128)


@pytest.mark.parametrize("horizon", [1 << 18, 3000])
def test_packing_covers_everything_once(spark, horizon):
    rows = fixtures.EDGE_ROWS + [(10 + i, f"Sentence {i} of some length. " * (i * 7 % 90)) for i in range(120)]
    docs = fixtures.table(spark, rows)
    pieces = packing.pack_documents(docs, BYTE, 1, horizon=horizon)
    got, ids = pieces.collect(), {i: library(BYTE, text, 1) for i, text in rows}
    parts, sequences = {}, {}
    for p in got:
        parts.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    for i, found in parts.items():
        once = sorted(found) if i != 5 else sorted(found)[::2]  # id 5 comes twice
        assert [s for s, _ in once] == [sum(n for _, n in once[:k]) for k in range(len(once))] and sum(n for _, n in once) == len(ids[i])
    assert set(parts) == set(ids)
    for found in sequences.values():
        found.sort()
        assert [s for s, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 2048
    total = packing.padding(pieces).first()
    assert total.tokens == sum(len(ids[i]) for i, _ in rows) and total.padding < 0.03 * total.tokens + 4 * 2048
    assert packing.pack_documents(fixtures.empty(spark), BYTE, 1).count() == 0
