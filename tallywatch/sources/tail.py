"""Text files read by position: a data source for files that grow and rotate.

An offset of the stream is a picture of the folder: per file the position after its last whole line, and its first
bytes. A file is told by these bytes, so one that was renamed goes on where it was left, and a new one under an old
name begins at its start. Nothing depends on the time in a line, so late lines and lines of one time are read like
any other. Files are opened through the ``pyarrow`` file systems, by executors too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: First bytes that tell a file; bytes a task reads; bytes read at once.
HEAD = 128
CHUNK = 64 << 20
BLOCK = 4 << 20
PACKED = (".gz", ".bz2", ".zst", ".lz4")
SCHEMA = "file string, at long, line string, line_id string"


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in ``[begin, stop)``. A null ``stop``: a packed file as a whole."""

    file: str
    begin: int
    stop: int | None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _last_line_end(file, size: int) -> int:
    """The position after the last newline."""
    while size:
        begin = max(0, size - (64 << 10))
        file.seek(begin)
        at = file.read(size - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        size = begin
    return 0


def picture(path: str, whole_lines: bool = True) -> dict[str, list]:
    """Per plain file below ``path``: the position after its last (whole) line, and its first bytes up to there."""
    system, root = _open(path)
    found = {}
    for name in _names(system, root):
        if not name.endswith(PACKED):
            with system.open_input_file(name) as file:
                end = _last_line_end(file, file.size()) if whole_lines else file.size()
                file.seek(0)
                found[name] = [end, file.read(min(HEAD, end)).hex()]
    return found


def _names(system: fs.FileSystem, root: str) -> list[str]:
    """Files below a folder, or the file itself; names that begin with a dot or a line are left out."""
    if system.get_file_info(root).is_file:
        return [root]
    every = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    plain = (i.path for i in every if i.is_file)
    return sorted(p for p in plain if not any(part[0] in "._" for part in p[len(root):].split("/") if part))


def _continues(before: list, now: list) -> bool:
    return bool(before[1]) and now[0] >= before[0] and now[1].startswith(before[1])


def stretches(before: dict[str, list], now: dict[str, list]) -> list[Stretch]:
    """What is new between two pictures, in pieces of ``CHUNK`` bytes."""
    begin = {name: before[name][0] for name in now if name in before and _continues(before[name], now[name])}
    lost = {name: entry for name, entry in before.items() if name not in begin}
    for name in now:
        if name not in begin:
            # Renamed, if it begins like a file that is no longer under its own name.
            same = max((old for old in lost if _continues(lost[old], now[name])), key=lambda old: lost[old][0], default=None)
            begin[name] = lost.pop(same)[0] if same else 0
    return [Stretch(name, a, min(a + CHUNK, end))
            for name, (end, _) in now.items() for a in range(begin[name], end, CHUNK)]


def _lines(file, begin: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """Positions and lines that begin in the stretch; one that begins before it is another stretch's."""
    at, rest, skip = begin, b"", begin > 0
    if skip:
        file.seek(begin - 1)
        at = begin - 1
    while block := file.read(BLOCK):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if not skip:
                if stop is not None and at >= stop:
                    return
                yield at, part
            skip, at = False, at + len(part) + 1
        if stop is not None and at >= stop:
            return
    if rest and not skip and (stop is None or at < stop):
        yield at, rest


class _Reading:
    def __init__(self, path: str) -> None:
        self._path = path

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self._path)
        source = system.open_input_stream(partition.file) if partition.stop is None else system.open_input_file(partition.file)
        names = ["file", "at", "line", "line_id"]
        with source as file:
            rows, size = [], 0
            for at, line in _lines(file, partition.begin, partition.stop):
                key = hashlib.md5(f"{partition.file}\n{at}\n".encode() + line, usedforsecurity=False).hexdigest()
                rows.append((partition.file, at, line.removesuffix(b"\r").decode("utf-8", "replace"), key))
                size += len(line)
                if len(rows) >= 10_000 or size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


class TailReader(_Reading, DataSourceReader):
    """All lines there are, packed files included, each of which is one task."""

    def partitions(self) -> list[Stretch]:
        system, root = _open(self._path)
        packed = [Stretch(name, 0, None) for name in _names(system, root) if name.endswith(PACKED)]
        return stretches({}, picture(self._path, whole_lines=False)) + packed or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.file else iter(())


class TailStreamReader(_Reading, DataSourceStreamReader):
    """The lines completed since the offset before. Packed files, which do not grow, are left out."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return picture(self._path)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(start, end)


class TailedLines(DataSource):
    """Format ``tailed_lines``: ``file, at, line, line_id`` of the text files below a path.

    ``at`` is the byte position of the line; ``line_id`` comes from file, position and line, so it stays when the
    file grows or others are added. A new file under an old name repeats an id only where it repeats line and position.
    """

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader(self.options["path"])

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader(self.options["path"])
