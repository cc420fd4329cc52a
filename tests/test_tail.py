"""Files that grow, rotate and arrive late, read by position."""

import gzip
import os
import random

import pytest

from tallywatch.sources import tail
from tallywatch.streaming import jobs


@pytest.fixture()
def pull(spark, tmp_path):
    """Pull the folder ``logs`` and give the lines that are new, sorted."""
    os.mkdir(tmp_path / "logs")
    seen = set()

    def run():
        rows = jobs.pull_lines(spark, str(tmp_path / "logs"), str(tmp_path / "pull")).collect()
        assert not seen & {r.line_id for r in rows} and len({r.line_id for r in rows}) == len(rows)
        seen.update(r.line_id for r in rows)
        return sorted(r.line for r in rows)

    run.logs = tmp_path / "logs"
    return run


def add(path, text):
    with open(path, "a", encoding="utf-8") as file:
        file.write(text)


def test_late_and_same_time_lines_come_once(pull):
    add(pull.logs / "a.log", "10:05 one\n10:05 two\n")
    assert pull() == ["10:05 one", "10:05 two"]
    assert pull() == []
    add(pull.logs / "a.log", "10:05 three\n09:00 late\n10:05 two\n")
    assert pull() == ["09:00 late", "10:05 three", "10:05 two"]
    add(pull.logs / "b.log", "08:00 another file\n")
    assert pull() == ["08:00 another file"]
    assert pull() == []


def test_a_line_waits_for_its_end(pull):
    add(pull.logs / "a.log", "whole\nhal")
    assert pull() == ["whole"]
    add(pull.logs / "a.log", "f\r\n\nnext")
    assert pull() == ["", "half"]
    add(pull.logs / ".hidden", "x\n")
    assert pull() == []


def test_renamed_and_truncated_files(pull):
    log, old, older = (pull.logs / name for name in ("app.log", "app.log.1", "app.log.2"))
    add(log, "start of the first\n1\n")
    assert pull() == ["1", "start of the first"]
    add(log, "2\n")
    os.rename(log, old)
    add(log, "start of the second\n")
    assert pull() == ["2", "start of the second"]
    add(log, "3\n")
    os.rename(old, older)
    os.rename(log, old)
    add(log, "start of the third, which is longer than what was read of the other\n4\n")
    assert pull() == ["3", "4", "start of the third, which is longer than what was read of the other"]
    add(log, "5\n")
    (pull.logs / "app.log.3").write_bytes(log.read_bytes())  # copied, then cut
    log.write_text("")
    assert pull() == ["5"]
    add(log, "after the cut\n")
    assert pull() == ["after the cut"]
    os.remove(older)
    assert pull() == []


def test_stretches_meet_without_gaps_or_doubles(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab é日") for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(400)] + ["end"]
    path = tmp_path / "big.log"
    path.write_text("\n".join(lines), encoding="utf-8")
    for chunk, block in ((7, 5), (64, 1000), (301, 64), (1 << 20, 1 << 20)):
        monkeypatch.setattr(tail, "CHUNK", chunk)
        monkeypatch.setattr(tail, "BLOCK", block)
        reader = tail.TailReader(str(path))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["line"] for r in sorted(rows, key=lambda r: r["at"])] == lines
        assert [len("\n".join(lines[:i]).encode()) + (i > 0) for i in range(len(lines))] == sorted(r["at"] for r in rows)


def test_batch_reads_everything_with_stable_ids(spark, tmp_path):
    def ids():
        return {(r.line, r.line_id) for r in spark.read.format("tailed_lines").load(str(tmp_path)).collect()}

    spark.dataSource.register(tail.TailedLines)
    assert ids() == set()
    add(tmp_path / "m.log", "same\nsame\nno end")
    first = ids()
    assert sorted(line for line, _ in first) == ["no end", "same", "same"]
    add(tmp_path / "a.log", "other\n")
    (tmp_path / "z.log.gz").write_bytes(gzip.compress(b"packed\nlast"))
    assert first < ids() and sorted(line for line, _ in ids() - first) == ["last", "other", "packed"]
