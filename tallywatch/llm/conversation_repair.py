"""Cheapest repair of conversations to a role grammar, by generalised LR parsing with edits.

A row is read as the initial of its role. The parser holds all parses at once in a graph-structured stack: shifts and
reductions come from the LR table of the grammar, and beside keeping a row it may delete it, give it another role, or
insert a row before it. Parses with equal stack tops accept the same endings, so of these only the least
(cost, audit) goes on. The audit is the string of edits, so a cost follows from its audit, and no audit of a row's
parses is the beginning of another with the same cost: the order of two audits never changes later.

That makes repair associative. A conversation is sorted together with all others and cut by Spark's ranges; the piece
in a task is summed up as the least (cost, audit order) from each stack top to each other. Pieces of a conversation
are chained by their sums, and then each piece writes its audit by itself. So a conversation as long as a third of the
table is parsed by many tasks; only its output, one audit string and one hash, is made in one, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache, partial
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallywatch.llm.common import ident, materialize, on_workers

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Roles that an insertion or a change of role may give.
GIVEN = "ua"
#: ``(s?(ua)+)?`` as rules of a left-recursive grammar.
RULES = (("Start", ("Chat",)), ("Chat", ()), ("Chat", ("Turns",)), ("Chat", ("s", "Turns")),
         ("Turns", ("u", "a")), ("Turns", ("Turns", "u", "a")))
END = "$"

# A row's code: its initial, whether its text is cut off, whether it must go.
INITIALS, CUT, GONE = "sua", 4, 8


class Table(NamedTuple):
    goto: dict[tuple[int, str], int]
    reduce: dict[tuple[int, str], int]


@cache
def lr_table() -> Table:
    """SLR table of ``RULES``: item sets and their transitions, and reductions on the symbols that may follow a rule."""
    heads = {head for head, _ in RULES}

    def closure(items: frozenset) -> frozenset:
        found = set(items)
        while True:
            wanted = {RULES[r][1][dot] for r, dot in found if dot < len(RULES[r][1])} & heads
            more = {(r, 0) for r, (head, _) in enumerate(RULES) if head in wanted} - found
            if not more:
                return frozenset(found)
            found |= more

    empty = {head for head, body in RULES if not body}
    first, follow = {h: set() for h in heads}, {h: set() for h in heads}
    follow["Start"] = {END}
    for _ in range(len(RULES) ** 2):  # more than enough rounds for the sets to settle
        for head, body in RULES:
            after = set(follow[head])
            for symbol in reversed(body):
                begins = first.get(symbol, {symbol})
                if symbol in heads:
                    follow[symbol] |= after
                after = begins | after if symbol in empty else set(begins)
            first[head] |= first.get(body[0], {body[0]}) if body else set()

    states, goto, reduce = [closure(frozenset({(0, 0)}))], {}, {}
    for number, items in enumerate(states):  # grows while it is read
        for symbol in sorted({RULES[r][1][dot] for r, dot in items if dot < len(RULES[r][1])}):
            moved = closure(frozenset((r, dot + 1) for r, dot in items if RULES[r][1][dot:dot + 1] == (symbol,)))
            if moved not in states:
                states.append(moved)
            goto[number, symbol] = states.index(moved)
        for r, dot in items:
            if dot == len(RULES[r][1]):
                reduce |= {(number, symbol): r for symbol in follow[RULES[r][0]]}
    return Table(goto, reduce)


# A stack is a node (state, the node below it); nodes are shared.
BOTTOM = (0, None)


def _reduced(node: tuple, ahead: str) -> tuple:
    table = lr_table()
    while (rule := table.reduce.get((node[0], ahead))):
        head, body = RULES[rule]
        for _ in body:
            node = node[1]
        node = (table.goto[node[0], head], node)
    return node


@cache
def shift(node: tuple, symbol: str) -> tuple | None:
    """The stack after ``symbol``, or none if it does not fit."""
    node = _reduced(node, symbol)
    state = lr_table().goto.get((node[0], symbol))
    return None if state is None else (state, node)


@cache
def accepts(node: tuple) -> bool:
    node = _reduced(node, END)
    return lr_table().reduce.get((node[0], END)) == 0


@cache
def tops() -> dict[int, tuple]:
    """A stack for each stack top that can occur between rows."""
    found, new = {BOTTOM[0]: BOTTOM}, [BOTTOM]
    while new:
        new = [n for node in new for s in INITIALS if (n := shift(node, s)) and n[0] not in found and not found.update({n[0]: n})]
    return found


@cache
def with_inserts(node: tuple) -> tuple[tuple[int, tuple], ...]:
    """All stacks reached by inserting rows, with the least number of rows each."""
    found, level, n = {node[0]: (0, node)}, [node], 0
    while level:
        n += 1
        level = [m for one in level for s in GIVEN if (m := shift(one, s)) and m[0] not in found and not found.update({m[0]: (n, m)})]
    return tuple(found.values())


class Cell(NamedTuple):
    """The least parse from one stack top (``entry``) to a stack; ``rank`` orders the audits of all cells."""
    entry: int
    node: tuple
    cost: int
    rank: int


@lru_cache(maxsize=1 << 16)
def advance(cells: tuple[Cell, ...], code: int) -> tuple[int, tuple[Cell, ...], tuple[tuple[int, str], ...]]:
    """One row: what all costs rose by, the cells after it, and for each the cell it came from and the edits.

    Insertions come before the row that needs them; before a deleted row they never help, as the deletion may come
    first and ``D`` sorts before ``I``.
    """
    best: dict[tuple[int, int], tuple] = {}

    def offer(i: int, node: tuple | None, cost: int, edits: str) -> None:
        if node is not None:
            cell = cells[i]
            found = (cell.cost + cost, cell.rank, edits, i, node)
            key = (cell.entry, node[0])
            if key not in best or found[:4] < best[key][:4]:
                best[key] = found

    kept = TRUNCATED if code & CUT else 0
    for i, cell in enumerate(cells):
        offer(i, cell.node, DELETE, "D")
        if not code & GONE:
            for n, node in with_inserts(cell.node):
                cost, edits = kept + n * INSERT, "I" * n
                if code & 3 < len(INITIALS):
                    offer(i, shift(node, INITIALS[code & 3]), cost, edits + "K")
                for symbol in GIVEN:
                    offer(i, shift(node, symbol), cost + REROLE, edits + "R")
    ranks = {audit: rank for rank, audit in enumerate(sorted({found[1:3] for found in best.values()}))}
    least = min(found[0] for found in best.values())
    order = sorted(best.items())
    return (least,
            tuple(Cell(entry, node, cost - least, ranks[rank, edits]) for (entry, _), (cost, rank, edits, _, node) in order),
            tuple((i, edits) for _, (_, _, edits, i, _) in order))


def starting(any_top: bool) -> tuple[Cell, ...]:
    """Cells before the first row: from the empty stack, or from every stack top."""
    return tuple(Cell(top, node, 0, 0) for top, node in sorted(tops().items()) if any_top or node is BOTTOM)


def summed(codes: bytes, any_top: bool) -> list[tuple[int, int, int, int]]:
    """``entry, top, cost, rank`` of a piece."""
    cells, total = starting(any_top), 0
    for code in codes:
        rose, cells, _ = advance(cells, code)
        total += rose
    return [(c.entry, c.node[0], total + c.cost, c.rank) for c in cells]


def audit_of(codes: bytes, entry: int, top: int) -> str:
    """The audit of the least parse of a piece between two stack tops."""
    cells = (Cell(entry, tops()[entry], 0, 0),)
    back = []
    for code in codes:
        _, cells, came = advance(cells, code)
        back.append(came)
    at = next(i for i, c in enumerate(cells) if c.node[0] == top)
    edits = []
    for came in reversed(back):
        at, edit = came[at]
        edits.append(edit)
    return "".join(reversed(edits))


def chain(pieces: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Least cost of a conversation, the stack tops around each piece, and the rows inserted at the end."""
    now, back = {BOTTOM[0]: (0, 0)}, []
    for piece in pieces:
        best = {}
        for entry, top, cost, rank in piece:
            if entry in now:
                found = (now[entry][0] + cost, now[entry][1], rank, entry)
                best[top] = min(best.get(top, found), found)
        ranks = {audit: i for i, audit in enumerate(sorted({found[1:3] for found in best.values()}))}
        now = {top: (cost, ranks[before, rank]) for top, (cost, before, rank, _) in best.items()}
        back.append({top: found[3] for top, found in best.items()})
    cost, _, inserted, top = min(
        (cost + n * INSERT, rank, n, top) for top, (cost, rank) in now.items()
        for n, node in with_inserts(tops()[top]) if accepts(node))
    around = []
    for came in reversed(back):
        around.append((came[top], top))
        top = came[top]
    return cost, around[::-1], inserted


_PIECE = ("part long, codes binary, blank long, duplicate long, truncated long, illegal long, head int, tail int, "
          "turns long, first_turn long, last_turn long, cells array<array<bigint>>")
# What a conversation has as a whole; the row of its last piece holds it, the others hold zeros.
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_AROUND = "part long, entry int, top int, inserted int, " + ", ".join(f"{f} long" for f in _FACTS)
_AUDIT = "part long, audit string, " + ", ".join(f"{f} long" for f in _FACTS)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, code, blank, cut, late, n, known, at) to pieces. The first conversation of a task may have begun in another."""
    part, out = TaskContext.get().partitionId(), []
    conv, codes, first, tally, illegal, head, last = None, bytearray(), True, [0, 0, 0], 0, 0, None
    turns, first_turn, last_turn = 0, None, None

    def close() -> None:
        if codes:
            out.append((conv, part, bytes(codes), *tally, illegal, head, last, turns, first_turn, last_turn, summed(codes, first)))

    for batch in batches:
        for owner, initial, blank, cut, late, n, known, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not codes or owner != conv:
                close()
                first, conv = first and not codes, owner
                codes, tally, illegal, head, last = bytearray(), [0, 0, 0], 0, initial, None
                turns, first_turn, last_turn = 0, None, None
            gone = blank or late
            codes.append(initial | (CUT if cut and not gone else 0) | (GONE if gone else 0))
            codes.extend(bytes([initial | GONE]) * (n - 1))
            tally[0] += n if blank else 0
            tally[1] += 0 if blank else n - 1 + late
            tally[2] += int(cut and not gone)
            illegal += (n - 1) + (last is not None and not _legal(last, initial))
            last = initial
            if known and at != last_turn:
                first_turn = at if first_turn is None else first_turn
                turns, last_turn = turns + 1, at
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    close()
    if out:
        yield _batch(out, schema)


def _legal(one: int, other: int) -> bool:
    return (one, other) in ((0, 1), (1, 2), (2, 1))


def _chains(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces without their codes, sorted, to the stack tops around each, and the facts of the conversation."""
    out, conv, held = [], None, []

    def close() -> None:
        if not held:
            return
        cost, around, inserted = chain([[tuple(c) for c in p["cells"]] for p in held])
        pairs = list(pairwise(held))
        known = [p for p in held if p["turns"]]
        # Pieces may share the turn at which they were cut.
        turns = sum(p["turns"] for p in known) - sum(a["last_turn"] == b["first_turn"] for a, b in pairwise(known))
        gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
        illegal = sum(p["illegal"] for p in held) + sum(not _legal(a["tail"], b["head"]) for a, b in pairs)
        facts = (gaps, *(sum(p[f] for p in held) for f in ("blank", "duplicate", "truncated")), illegal, cost)
        for i, (piece, (entry, top)) in enumerate(zip(held, around, strict=True)):
            last = i == len(held) - 1
            out.append((conv, piece["part"], entry, top, inserted if last else 0, *(facts if last else (0,) * len(facts))))

    for batch in batches:
        for piece in batch.to_pylist():
            if piece["conv"] != conv:
                close()
                conv, held = piece["conv"], []
            held.append(piece)
        if len(out) >= 10_000:
            yield _batch(out, schema)
            out = []
    close()
    if out:
        yield _batch(out, schema)


def _audits(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (conv, part, codes, entry, top, inserted, facts) to their audits."""
    for batch in batches:
        rows = [(conv, part, audit_of(codes, entry, top) + "I" * inserted, *facts)
                for conv, part, codes, entry, top, inserted, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, schema)


def _apply(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of a conversation, then its rows in order (conv, audit, role, text), to the repaired rows."""
    out, conv, started = [], None, False
    audit: list[str] = []
    at, place, node = 0, 0, BOTTOM

    def given(symbol: str, text: str) -> None:
        nonlocal node, place
        node = shift(node, symbol)
        out.append((conv, place, ROLES[symbol], text))
        place += 1

    def due() -> str:
        return next(s for s in GIVEN if shift(node, s))

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            given(due(), "")

    for batch in batches:
        for owner, edits, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or owner != conv:
                inserts()
                started, conv, audit, at, place, node = True, owner, "", 0, 0, BOTTOM
            if edits is not None:
                audit += edits
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                node = shift(node, role[0])
                out.append((conv, place, role, text))
                place += 1
            elif edit == "R":
                given(due(), text)
        if len(out) >= 5000:
            yield _batch(out, schema)
            out.clear()
    inserts()
    if out:
        yield _batch(out, schema)


def _hashes(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order to one hash per conversation, kept while the rows stream by."""
    out, conv, digest = [], None, None
    for batch in batches:
        for owner, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or owner != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, line = owner, hashlib.sha256(), f"{role}:{text}"
            else:
                line = f"\n{role}:{text}"
            digest.update(line.encode("utf-8", "surrogatepass"))
    if digest is not None:
        out.append((conv, digest.hexdigest()))
    if out:
        yield _batch(out, schema)


def _mapped(df: DataFrame, run, ddl: str) -> DataFrame:
    schema = StructType([df.schema["conv"], *StructType.fromDDL(ddl)])
    return df.mapInArrow(partial(run, to_arrow_schema(schema)), schema)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text`` of a table; a null role or text is one space. Other columns are ignored."""
    blank = F.lit(" ")
    return conversations.select(ident(conv_col).alias("conv"), ident(turn_col).cast("long").alias("turn"),
                                F.coalesce(ident(role_col), blank).alias("role"), F.coalesce(ident(text_col), blank).alias("text"))


#: Order of rows in a conversation: by turn, nulls first; rows of one turn by role and content hash, equal rows side by side.
_ORDER = ("conv", "known", "at", "role", "mark")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select("conv", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"), "role",
                       F.unhex(F.sha2(F.col("text"), 256)).alias("mark"), "text")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


class Repair(NamedTuple):
    conversations: DataFrame
    rows: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair all conversations of ``turns``.

    ``conversations``: one row each with ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit``; ``rows``: the repaired
    rows ``conv, position, role, text``, sorted inside each task.

    A row without a visible character is blank, a row whose role and text came earlier is a duplicate, a row that
    does not end in a sentence mark is truncated. Rows of one turn are taken by role, then by content hash. A role
    that begins with no letter of the grammar, or is empty, can only be deleted or replaced. A null conversation id is
    a conversation of its own; no rows give no conversations; the longest texts pass through as a stream.
    """
    on_workers(rows.sparkSession)
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    marked = _marked(rows)
    # Equal rows become one with a count, and from here on texts are left behind.
    slim = marked.groupBy(*_ORDER).agg(
        F.count(F.lit(1)).alias("n"), F.max(~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.max(~last.isin(".", "!", "?")).alias("cut"))
    slim = materialize(slim, "repair-rows")
    again = slim.filter(~F.col("blank")).groupBy("conv", "role", "mark").agg(
        F.min(F.struct("known", "at")).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first")
    late = F.coalesce(F.struct("known", "at") > F.col("first"), F.lit(False))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    coded = slim.join(again, same, "left").select(*_ORDER, _initial(F.col("role")).alias("initial"), "blank", "cut", late.alias("late"), "n")
    ordered = coded.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    pieces = materialize(_mapped(ordered.select("conv", "initial", "blank", "cut", "late", "n", "known", "at"), _pieces, _PIECE), "repair-pieces")

    by_conv = pieces.drop("codes").repartition("conv").sortWithinPartitions("conv", "part")
    around = _mapped(by_conv, _chains, _AROUND).withColumnRenamed("conv", "c").withColumnRenamed("part", "p")
    joined = pieces.select("conv", "part", "codes").join(around, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    audits = materialize(_mapped(joined.select("conv", "part", "codes", "entry", "top", "inserted", *_FACTS), _audits, _AUDIT), "repair-audits")
    summary = audits.groupBy("conv").agg(*(F.sum(f).alias(f) for f in _FACTS), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    nothing = F.lit(None)
    edits = audits.select("conv", nothing.cast("boolean").alias("known"), F.col("part").alias("at"), nothing.cast("string").alias("role"),
                          nothing.cast("binary").alias("mark"), "audit", nothing.cast("string").alias("text"))
    stream = edits.unionByName(marked.withColumn("audit", nothing.cast("string"))).repartition("conv").sortWithinPartitions(*_ORDER)
    repaired = _mapped(stream.select("conv", "audit", "role", "text"), _apply, "position long, role string, text string")
    return Repair(summary, repaired)


def hashes(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` over the lines ``role:text`` of ``Repair.rows``."""
    return _mapped(repaired, _hashes, "repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``turns`` with known faults, by a checksum of conversation and turn: the test bed of the repair."""
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("_kind", F.crc32(key) % 20).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1).cast("int")))
    return hit.select("conv", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      copies.alias("_copy")).drop("_copy")


def repair_digest(conversations: DataFrame, **columns) -> DataFrame:
    """Every conversation id of the table, what the repair of its damaged rows found and did, and the hash of the result."""
    rows = turns(conversations, **columns)
    fixed = repair(damage(rows))
    digest = hashes(fixed.rows).withColumnRenamed("conv", "h")
    found = fixed.conversations.withColumnRenamed("conv", "f")
    out = rows.select("conv").distinct().join(found, F.col("conv").eqNullSafe(F.col("f")), "left")
    out = out.join(digest, F.col("conv").eqNullSafe(F.col("h")), "left")
    zero = [F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in _FACTS]
    return out.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
