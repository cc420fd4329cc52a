import random

import pytest

import fixtures
from tallywatch.llm import decontam


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id long, text string, doc_id string")


def brute(docs, items):
    found = set()
    for item_id, text in items:
        size = min(5, len(fixtures.plain_words(text)))
        wanted = fixtures.plain_shingles(text, size) if size else set()
        for doc_id, other in docs:
            words = fixtures.plain_words(other)
            own = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
            if wanted and len(wanted & own) >= 0.8 * len(wanted):
                found.add((doc_id, item_id, len(wanted & own), len(wanted)))
    return found


@pytest.mark.parametrize("block_items", [20_000, 4])
def test_same_as_brute_force(spark, block_items):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((3, 5, 6, 9, 17, 33, 60))))) for i in range(14)] + [(90, ""), (91, None), (92, "one")]
    docs = list(fixtures.EDGE_ROWS)
    for i in range(60):
        body = rng.choices(words, k=rng.choice((0, 20, 400, 3000)))
        item = fixtures.plain_words(items[rng.randrange(14)][1])
        cut = len(item) - rng.choice((0, 0, 1, len(item) // 3))
        at = rng.randint(0, len(body))
        docs.append((100 + i, " ".join(body[:at] + [w.upper() for w in item[:cut]] + body[at:])))
    docs += [(300, "ONE"), (301, "not here")]
    got = decontam.find_contaminated(fixtures.table(spark, docs), items_table(spark, items), block_items=block_items).collect()
    assert {tuple(r)[:4] for r in got} == brute(docs, items)
    assert all(r.containment == r.shared / r.item_shingles for r in got)


def test_edges(spark):
    docs, some = fixtures.edge(spark), items_table(spark, [(1, "quick brown fox jumps over the lazy")])
    assert sorted(r.doc_id for r in decontam.find_contaminated(docs, some).collect()) == [1, 7]
    kept = decontam.drop_contaminated(docs, some)
    assert kept.columns == docs.columns and kept.count() == len(fixtures.EDGE_ROWS) - 2
    assert decontam.find_contaminated(fixtures.empty(spark), some).count() == 0
    assert decontam.find_contaminated(docs, items_table(spark, [(1, "x")]).limit(0)).count() == 0
