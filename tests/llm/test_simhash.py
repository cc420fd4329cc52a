import random

import xxhash

import fixtures
from tallywatch.llm import simhash
from tallywatch.llm.graph import components


def brute_print(text, words=3):
    found = fixtures.plain_words(text)
    shingles = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [t or "" for _, t in fixtures.EDGE_ROWS]:
        assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(11)
    prints = set()
    for _ in range(60):
        one = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(one)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                one ^= 1 << b
    prints |= {0, (1 << 64) - 1, 7, 1 << 63}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    rows = spark.createDataFrame([(p,) for p in signed], "print long")
    links = [tuple(r) for r in simhash.links(rows).collect()]
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert all(near(a, b) <= 3 for a, b in links)
    pairs = [(a, b) for a in signed for b in signed if a < b and near(a, b) <= 3]
    assert pairs and fixtures.plain_components(signed, links) == fixtures.plain_components(signed, pairs)


def test_groups_of_a_table(spark):
    rows = fixtures.EDGE_ROWS + [(30, "THE quick brown fox jumps over the lazy dog again and again"), (40, "other words here now")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(fixtures.table(spark, rows)).collect()), key=str)
    prints = {i: brute_print(t) for i, t in rows if i is not None}
    roots = fixtures.plain_components(prints, [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = sorted(((i, f"{brute_print(t):016x}", roots.get(i)) for i, t in rows), key=str)
    assert got == want
    assert simhash.near_groups(fixtures.empty(spark)).count() == 0


def test_no_table_as_long_as_the_fingerprints_is_broadcast(spark):
    """Files of fingerprints are small, so by their size alone all variants, or all rows, would be sent to each worker."""
    near = simhash.with_neighbour(spark.createDataFrame([(p,) for p in (1, 3, 1 << 40, -1)], "print long"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.print for r in near.collect()) == [1, 3, 1 << 40]
    groups = simhash.near_groups(fixtures.table(spark, [(1, "a b c"), (2, "A b c"), (3, "other words here")]))
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BuildLeft" not in plan
    assert sorted((r.doc_id, r.component_id) for r in groups.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(3, 3), (9, 8), (8, 9), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if None not in (a, b) and a != b]
    assert got == fixtures.plain_components({n for e in real for n in e}, real)


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = [" ".join([*words[:200], f"new{i}", *words[201:]]) for i in range(6)]
    rows = [(10, " ".join(words)), *((20 + i, t) for i, t in enumerate(near)), (11, "other words here"), (21, "no copy under an id that goes"),
            (None, " ".join(words)), (30, " "), (31, None)]
    prints = [(i, t, brute_print(t or "")) for i, t in rows]
    ids = {p: min(i for i, _, q in prints if q == p and i is not None) for _, _, p in prints}
    roots = fixtures.plain_components(set(ids), [(a, b) for a in ids for b in ids if (a ^ b).bit_count() <= 3])
    least = {r: min(ids[p] for p in ids if roots[p] == r) for r in roots.values()}
    want = [(i, t) for i, t, p in prints if i is None or i == least[roots[p]]]
    assert len(want) < len(rows) - 3 and (21, rows[8][1]) in want
    docs = fixtures.table(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert simhash.keep_one(fixtures.empty(spark)).count() == 0
