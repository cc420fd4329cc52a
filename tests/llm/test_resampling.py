import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import fixtures
from tallywatch.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest=1):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, seed=2024, buckets=10_000, longest=1):
    bucket = lambda f: zlib.crc32(f) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t, longest)[1])
    t = Counter(bucket(f) for _, x in target for f in plain_features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        words, features = plain_features(text, longest)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[0])) for r in rows), key=str)


def stretches(words):
    text = b" ".join(words)
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(text + b" " * 9, np.uint8), np.cumsum(size + 1) - size - 1, size


def test_hashes_of_every_length():
    rng = random.Random(1)
    words = [bytes(rng.randrange(0x61, 0x7B) for _ in range(n)) for n in range(1, 70)] * 2
    assert resampling.hashes(*stretches(words)).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


@pytest.mark.parametrize("collide", [False, True])
def test_table_keeps_equal_bytes_together_and_others_apart(collide):
    rng = random.Random(2)
    words = [b"w" * rng.randint(1, 20) + str(rng.randint(0, 40)).encode() for _ in range(3000)]
    text, start, size = stretches(words)
    keys = np.full(len(words), 7, np.uint64) if collide else None
    table = resampling.Interned(text, start, size, keys)
    slots = {}
    for word, slot in zip(words, table.slot.tolist(), strict=True):
        assert slots.setdefault(word, slot) == slot
    assert len(set(slots.values())) == len(slots)
    assert {w: int(table.count[s]) for w, s in slots.items()} == Counter(words)
    buckets = table.buckets(text, start, size, 97)
    assert all(buckets[s] == zlib.crc32(w) % 97 for w, s in slots.items())


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "ß-Straße", "x1", "don't", "日本", "l" * 40]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest, monkeypatch):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.choice([0, 5, 19, 20, 25, 60]))) for i in range(300)] + [
        (400, None), (401, ""), (402, "no-BREAK\x00here" * 30), (403, fixtures.LONG), (None, prose(rng, 30))]
    target = [(i, prose(rng, 12)) for i in range(40)] + [(99, None)]
    monkeypatch.setattr(resampling, "SLICE", 700)  # in this process only: the workers keep theirs
    items = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(fixtures.table(spark, docs), items, percent=10, seed=2024, longest=longest).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, longest=longest)
    assert sum(r["rank"] is not None for r in got) > 10


def test_slices_do_not_change_the_features():
    import pyarrow as pa

    rng = random.Random(7)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(50)] + ["", "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]).slice(3)
    seen = []
    for size in (64, 1 << 22):
        old, resampling.SLICE = resampling.SLICE, size
        try:
            (out,) = resampling._counted(1000, 2, [batch])
        finally:
            resampling.SLICE = old
        seen.append(out.to_pydict())
    assert seen[0] == seen[1]
    assert sum(seen[0]["n"]) == sum(len(plain_features(t, 2)[1]) for t in texts[3:])


def test_ties_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs, target = [(5, text)] * 30 + [(6, text)] * 10, []
    items = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(fixtures.table(spark, docs), items, percent=10, seed=2024).collect()
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3, 4]
    assert len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(fixtures.empty(spark), items, percent=10, seed=1).count() == 0
