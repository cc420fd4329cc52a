import hashlib
import re

import pytest

import fixtures
from tallywatch.llm.exact_dedup import exact_groups, keep_one


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((i, text or ""))
    out = []
    for norm, members in groups.items():
        top = (1 << 63) - 1
        keep = min(members, key=lambda m: (-len(m[1]), top if m[0] is None else m[0]))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_chars", [32, 1])
def test_same_as_brute_force(spark, hash_chars):
    rows = fixtures.EDGE_ROWS + [(20 + i, f"text {i % 9}" + " " * (i % 4)) for i in range(60)]
    got = exact_groups(fixtures.table(spark, rows), hash_chars=hash_chars).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_groups_are_not_broadcast(spark):
    plan = exact_groups(fixtures.edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_keep_one_keeps_columns(spark):
    docs = fixtures.table(spark, [(1, "a b"), (2, "ab  "), (3, "c"), (3, "ab"), (None, "c")])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "ab  "), (3, "c")]
    assert keep_one(fixtures.empty(spark)).count() == exact_groups(fixtures.empty(spark)).count() == 0
