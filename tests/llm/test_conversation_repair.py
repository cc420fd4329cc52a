import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

import fixtures
from tallywatch.llm import conversation_repair as repair

GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_audit(rows):
    """Least (cost, audit, roles) by trying all edits; ``rows``: (initial, truncated, must go)."""
    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ""))
        if inserted < 3:
            for x in "ua":
                if (state, x) in GRAMMAR:
                    options.append(add(best(i, GRAMMAR[state, x], inserted + 1), 3, "I", x))
        if i < len(rows):
            initial, cut, gone = rows[i]
            options.append(add(best(i + 1, state, 0), 4, "D", ""))
            if not gone:
                if (state, initial) in GRAMMAR:
                    options.append(add(best(i + 1, GRAMMAR[state, initial], 0), 3 * cut, "K", initial))
                for x in "ua":
                    if (state, x) in GRAMMAR:
                        options.append(add(best(i + 1, GRAMMAR[state, x], 0), 3 * cut + 3, "R", x))
        return min((o for o in options if o), default=None)

    def add(rest, cost, edit, role):
        return rest and (rest[0] + cost, edit + rest[1], role + rest[2])

    for i in reversed(range(len(rows))):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def brute(conversations):
    out = []
    owners = []
    for row in conversations:
        if row[0] not in owners:
            owners.append(row[0])
    for conv in owners:
        rows = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault == "truncated", fault in ("blank", "duplicate")))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, roles = brute_audit(tuple(symbols))
        assert re.fullmatch("(s?(ua)+)?", roles)
        names, kept, i = iter(roles), [], 0
        for edit in audit:
            if edit != "D":
                new = {"u": "user", "a": "assistant", "s": "system"}[next(names)]
                kept.append((rows[i][1] if edit == "K" else new) + ":" + ("" if edit == "I" else rows[i][2]))
            i += edit != "I"
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(spark, rows):
    got = repair.repair_digest(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_parser_against_all_edits():
    rng = random.Random(5)
    for _ in range(400):
        rows = tuple((rng.choice("suaaauu?"), rng.random() < .2, rng.random() < .15) for _ in range(rng.randint(0, 12)))
        codes = bytes(repair.INITIALS.find(i) % 4 | (repair.CUT if cut and not gone else 0) | (repair.GONE if gone else 0) for i, cut, gone in rows)
        want = brute_audit(tuple((i, cut and not gone, gone) for i, cut, gone in rows))
        # In one piece, and in pieces cut anywhere and summed up without knowing what came before.
        for cuts in ([], sorted(rng.sample(range(len(rows) + 1), min(len(rows), 3)))):
            parts = [codes[a:b] for a, b in itertools.pairwise([0, *cuts, len(codes)])]
            cost, around, inserted = repair.chain([repair.summed(p, i > 0) for i, p in enumerate(parts)])
            audit = "".join(repair.audit_of(p, *a) for p, a in zip(parts, around, strict=True)) + "I" * inserted
            assert (cost, audit) == want[:2]


def conversations(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "why", "Well then?", "", " \n", None, f"t{rng.randint(0, 2)}. "])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows


def test_against_brute_force(spark):
    rows = conversations(random.Random(9), 120) + [(None, 0, "user", "Without an id."), (None, 1, "assistant", "Yes.")]
    assert digest(spark, rows) == brute(rows)


def test_conversation_over_many_tasks(spark):
    """One conversation with nearly all rows, cut into ranges, and one row repeated a thousand times."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Own {t}.", f"cut {t}"])) for t in range(300)]
    rows += [(8, 0, "user", "Again.")] * 1000 + [(9, t, "assistant", "x.") for t in range(3)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = digest(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r for r in got if r[0] != 8] == [r for r in brute([r for r in rows if r[0] != 8])]
    audit = next(r for r in got if r[0] == 8)[7]
    assert audit.count("D") in (999, 1000, 1999, 2000)


def test_dropped_empty_and_clashing(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert digest(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert digest(spark, []) == []
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Yes."), ("user", fixtures.LONG)])]
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.select("*", *(F.lit("z").alias(c) for c in ("conv", "known", "at", "mark", "audit", "n", "part", "dotted.name")))
    assert repair.repair_digest(clash).collect() == repair.repair_digest(plain).collect()


def test_repaired_rows_follow_the_grammar(spark):
    rows = conversations(random.Random(2), 60)
    fixed = repair.repair(repair.turns(spark.createDataFrame(rows, SCHEMA)))
    roles = {}
    for r in sorted(fixed.rows.collect(), key=lambda r: (r.conv, r.position)):
        roles[r.conv] = roles.get(r.conv, "") + r.role[0]
    assert roles and all(re.fullmatch("s?(ua)+", x) for x in roles.values())
