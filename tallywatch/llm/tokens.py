"""Token ids of whole texts by the ``tokenizers`` library, with the ids of frequent pre-tokens kept per worker.

A byte-pair model merges inside pre-tokens only, so a text's ids are its pre-tokens' ids in a row. Texts of
printable Latin-1 are cut by the vocabulary's own pattern, and a pre-token the worker has not met goes through the
library's model; every other text goes whole through the library. Pre-tokens are fewer than words, as a word with
and without a comma shares one.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
# The two pre-token patterns of the public vocabularies, for printable Latin-1.
_BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+"
#: Pre-tokens whose ids a worker keeps: some 120 MB. The others are encoded at every occurrence.
CACHED_PIECES = 600_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _usual(text: str) -> bool:
    """Printable Latin-1 and line ends only."""
    if not text.replace("\n", "").isprintable():
        return False
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
    return True


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Ids(dict):
    """Ids (little-endian unsigned 32-bit) by pre-token; at most ``CACHED_PIECES`` are kept."""

    def __init__(self, make) -> None:
        super().__init__()
        self._make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self._make(piece)
        if len(self) < CACHED_PIECES and len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as bytes, little-endian unsigned 32-bit.

    Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        kind = self._kind(spec)
        self._cut = re.compile({"byte": _BYTE_PATTERN, "word": _WORD_PATTERN}.get(kind, "")).findall
        self._ids = _Ids(self._model_ids).__getitem__
        self._lower = kind == "word"
        self.encode = self.encode_whole if kind == "other" else self._encode_pieces

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        splits = [x.get("type") for x in pre.get("pretokenizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]:
            return "word"
        return "other"

    def encode_whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model_ids(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self._letters)
        return _packed([t.id for t in self._model.tokenize(mapped)])

    def _encode_pieces(self, text: str) -> bytes:
        if not _usual(text):
            return self.encode_whole(text)
        return b"".join(map(self._ids, self._cut(text.lower() if self._lower else text)))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
