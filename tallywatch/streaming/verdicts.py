"""Verdicts of rules along a stream: counts per question kept in state, every step of event time judged once.

The state of a rule holds the present count of each of its questions, and the changes still to come when logs leave
its windows. As the watermark moves on, the changes up to it are played through in order, so the verdict of every
step is found, whatever rows came in which micro-batch.

Rules of one scope are dealt into a fixed number of parts. The counts of a facet go to each part that asks for it, not to
each rule, and rules that ask and judge alike share one state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywatch.operators.rules import ALL_ROWS

# Rules of one spec and pause whose runs are handed on together.
BUNCH = 32


class Sweep:
    """One rule's counts and verdict. Times are microseconds after the first step.

    ``spec``: JSON of the rule's asks and conditions (``rule_specs``); ``saved``: what ``save`` gave before.
    """

    def __init__(self, spec: str, grain_us: int, step_us: int, saved: bytes | None = None) -> None:
        rule = json.loads(spec)
        self._grain, self._step = grain_us, step_us
        self._conds, self._asks = rule["conds"], rule["asks"]
        self._facets = [
            {f"level:{v}" for v in a["levels"]} if a.get("levels") is not None
            else {f"word:{a['keyword']}"} if a.get("keyword") is not None else {ALL_ROWS} for a in self._asks]
        held = np.frombuffer(saved, np.int64) if saved else np.zeros(2 + len(self._asks), np.int64)
        self.next, self.met = int(held[0]), bool(held[1])
        self._counts = held[2:2 + len(self._asks)]
        self._changes = held[2 + len(self._asks):].reshape(3, -1)  # steps, asks, differences

    def save(self) -> bytes:
        return np.r_[self.next, int(self.met), self._counts, self._changes.ravel()].astype(np.int64).tobytes()

    def next_change(self) -> int | None:
        return int(self._changes[0].min()) if self._changes.shape[1] else None

    def feed(self, cells: dict[str, np.ndarray]) -> None:
        """Per facet its rows ``base, after, n``: counts per grain, ``after`` being 1 for rows beyond its first moment."""
        changes = [self._changes]
        for i, (facets, ask) in enumerate(zip(self._facets, self._asks, strict=True)):
            for facet in facets & cells.keys():
                base, after, n = cells[facet]
                enter = np.maximum(-(-(base + after) * self._grain // self._step), 0)
                leave = (base * self._grain + ask["window_us"]) // self._step
                ok = enter <= leave
                which = np.full(int(ok.sum()), i)
                changes += [np.stack([enter[ok], which, n[ok]]), np.stack([leave[ok] + 1, which, -n[ok]])]
        self._changes = np.concatenate(changes, axis=1)

    def advance(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps not judged yet, up to ``upto``, at which a count may change, and the verdicts from each on."""
        if upto < self.next:
            return np.empty(0, np.int64), np.empty(0, bool)
        due = self._changes[0] <= upto
        at, ask, d = self._changes[:, due]
        at = np.maximum(at, self.next)
        steps = np.unique(np.r_[self.next, at])
        counts = np.zeros(len(steps) * len(self._asks), np.int64)
        np.add.at(counts, np.searchsorted(steps, at) * len(self._asks) + ask, d)
        counts = self._counts + counts.reshape(len(steps), len(self._asks)).cumsum(axis=0)
        verdicts = np.ones(len(steps), bool)
        for cond in self._conds:
            verdicts &= self._judge(cond, counts)
        self._counts, self._changes, self.next = counts[-1], self._changes[:, ~due], upto + 1
        return steps, verdicts

    def _judge(self, cond: dict, counts: np.ndarray) -> np.ndarray:
        of_role = {"hit": [], "total": []}
        words = {}
        for i, a in enumerate(self._asks):
            if a["pos"] == cond["pos"]:
                of_role[a["role"]].append(i)
                words[a.get("keyword")] = i
        hits, total = (counts[:, of_role[r]].sum(axis=1) for r in ("hit", "total"))
        kind, threshold = cond["type"], cond.get("threshold")
        no = np.zeros(len(counts), bool)
        if kind == "error_count":
            return no if threshold is None else hits >= threshold
        if kind == "error_rate":
            return no if threshold is None else (total > 0) & (hits / np.maximum(total, 1) >= threshold)
        if kind == "log_level":
            return hits > 0
        if kind == "no_logs":
            return total == 0
        if kind == "keyword_match":
            matched = sum(((counts[:, words[w]] > 0).astype(int) for w in cond["spelt"]), np.zeros(len(counts), int))
            return matched == cond["n_keywords"] if cond["match_all"] else matched > 0
        return no


def by_facet(cells: pd.DataFrame) -> dict[str, np.ndarray]:
    """Rows ``facet, base, after, n`` as one array ``(base, after, n)`` per facet."""
    codes, facets = pd.factorize(cells["facet"])
    values = np.stack([cells[c].to_numpy(np.int64) for c in ("base", "after", "n")])
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(facets)))
    return dict(zip(facets, np.split(values[:, order], ends, axis=1)[:-1], strict=True))


def bunches(rules: list) -> list[tuple[str, int]]:
    """Rules ``[rule_id, pause]`` as bunches of one pause: their ids as JSON, and the pause."""
    of_pause: dict[int, list] = {}
    for rule, pause in rules:
        of_pause.setdefault(pause, []).append(rule)
    return [(json.dumps(ids[i:i + BUNCH]), pause) for pause, ids in of_pause.items() for i in range(0, len(ids), BUNCH)]


class Verdicts(StatefulProcessor):
    """State per part of a scope: its rules by spec, from the initial state, and one sweep per spec.

    Gives the steps at which a verdict changes (``rule_id, step, met``), or with ``runs`` all runs of met steps, cut where
    the watermark stood, per bunch of rules (``rules, step, last, pause``, ``rules`` being their ids as JSON). A timer wakes the part for changes without new rows.
    """

    def __init__(self, since_us: int, grain_us: int, step_us: int, runs: bool) -> None:
        self._since, self._grain, self._step, self._runs = since_us, grain_us, step_us, runs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # Rules of a spec, as JSON ``[[rule_id, pause], ..]``; the sweep of a spec; and the timer of the part.
        self._rules = handle.getMapState("rules", "spec string", "rules string")
        self._held = handle.getMapState("held", "spec string", "data binary")
        self._timer = handle.getValueState("timer", "at long")

    def _when(self, step: int) -> int:
        """The watermark (milliseconds) at which every row up to this step is there."""
        return -(-(self._since + step * self._step + self._grain) // 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for spec, rules in initialState.groupby("spec"):
            self._rules.updateValue((spec,), (json.dumps([[r, int(p)] for r, p in zip(rules["rule_id"], rules["pause"], strict=True)]),))
            self._held.updateValue((spec,), (Sweep(spec, self._grain, self._step).save(),))
        self._wake_at(0)

    def _wake_at(self, step: int | None) -> None:
        before = self._timer.get()[0] if self._timer.exists() else -1
        timer = -1 if step is None else self._when(step)
        if timer != before:
            if before >= 0:
                self._handle.deleteTimer(before)
            if timer >= 0:
                self._handle.registerTimer(timer)
            self._timer.update((timer,))

    def _play(self, cells: dict[str, np.ndarray], watermark: int) -> Iterator[pd.DataFrame]:
        upto = (watermark * 1000 - self._grain - self._since) // self._step if watermark > 0 else -1
        # A part without specs has only rules that were not there when the stream began.
        wakes = []
        for (spec,) in list(self._rules.keys()):
            sweep = Sweep(spec, self._grain, self._step, bytes(self._held.getValue((spec,))[0]))
            sweep.feed(cells)
            met, begun = sweep.met, sweep.next > 0
            steps, verdicts = sweep.advance(upto)
            if len(steps):
                sweep.met = bool(verdicts[-1])
            wakes.append(sweep.next if sweep.next == 0 or (self._runs and sweep.met) else sweep.next_change())
            self._held.updateValue((spec,), (sweep.save(),))
            if len(steps):
                rows = self._met_runs(steps, verdicts, upto) if self._runs else self._turns(steps, verdicts, met, begun)
                if len(rows):
                    yield self._told(json.loads(self._rules.getValue((spec,))[0]), rows)
        self._wake_at(min((w for w in wakes if w is not None), default=None))

    @staticmethod
    def _met_runs(steps: np.ndarray, verdicts: np.ndarray, upto: int) -> pd.DataFrame:
        """Runs as long as the verdict stays, up to ``upto``."""
        turns = np.flatnonzero(np.diff(verdicts, prepend=~verdicts[:1]))
        ends = np.r_[steps[turns[1:]] - 1, upto]
        return pd.DataFrame({"step": steps[turns], "last": ends})[verdicts[turns]]

    @staticmethod
    def _turns(steps: np.ndarray, verdicts: np.ndarray, met: bool, begun: bool) -> pd.DataFrame:
        turn = verdicts != np.r_[met, verdicts[:-1]]
        turn[0] |= not begun  # the first verdict is told even if it is no
        return pd.DataFrame({"step": steps[turn], "met": verdicts[turn]})

    def _told(self, rules: list, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows for each of the rules, or bunches of them."""
        heads = bunches(rules) if self._runs else rules
        out = rows.iloc[np.tile(np.arange(len(rows)), len(heads))].reset_index(drop=True)
        out.insert(0, "rules" if self._runs else "rule_id", np.repeat(np.array([r for r, _ in heads], dtype=object), len(rows)))
        if self._runs:
            out["pause"] = np.repeat(np.array([p for _, p in heads], dtype=np.int64), len(rows))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._play(by_facet(pd.concat(rows)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._timer.exists() and self._timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._play({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Remembers from which step on a bunch of rules may trigger again; runs of met steps in, triggers out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._free = handle.getValueState("free", "step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free = self._free.get()[0] if self._free.exists() else 0
        kept = []
        for run in pd.concat(rows).sort_values("step").itertuples(index=False):
            steps = np.arange(max(run.step, free), run.last + 1, run.pause)
            if len(steps):
                kept.append(steps)
                free = int(steps[-1]) + run.pause
        self._free.update((free,))
        yield pd.DataFrame({"rules": key[0], "step": np.concatenate(kept) if kept else np.empty(0, np.int64)})

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """State per source: its newest log. Tells when a source has been without a log for longer than the limit.

    A timer tells it when no further row comes. Once told, the source is forgotten until its next log, so only
    sources that are heard of are kept.
    """

    def __init__(self, since_us: int, limit_us: int, pane_us: int) -> None:
        self._since, self._limit, self._pane = since_us, limit_us, pane_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # The time watched from, whether a log was seen at it, and the timer.
        self._last = handle.getValueState("last", "us long, seen boolean, timer long")

    def _watch(self, us: int, seen: bool, before: int | None) -> None:
        # By then the pane of any log inside the limit has closed.
        timer = -(-(us + self._limit + self._pane) // 1000)
        if before is not None and before != timer:
            self._handle.deleteTimer(before)
        if before != timer:
            self._handle.registerTimer(timer)
        self._last.update((us, seen, timer))

    def _told(self, key, rows: list[tuple[int, bool]]) -> pd.DataFrame:
        return pd.DataFrame({
            "source_id": pd.Series([key[0]] * len(rows), dtype="object"),
            "last_us": pd.Series([us if seen else None for us, seen in rows], dtype="Int64"),
            "as_us": pd.Series([us + self._limit for us, _ in rows], dtype="int64")})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._watch(self._since, False, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get() if self._last.exists() else None
        us, seen, timer = last or (None, False, None)
        told = []
        for pane in pd.concat(rows).sort_values("first_us").itertuples(index=False):
            if us is not None and pane.first_us - us > self._limit:
                told.append((us, seen))
            us, seen = pane.last_us, True
        self._watch(us, seen, timer)
        yield self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._last.exists():
            us, seen, timer = self._last.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self._last.clear()
                yield self._told(key, [(us, seen)])

    def close(self) -> None:
        pass
