"""Token ids of whole texts, word by word through a cache.

The tokenizer file ``word_bpe_49k.json`` drops white space and never joins
characters across it, so a text's ids are the ids of its pieces between ASCII
white space, in order.  Arrow splits many texts at once and numbers their different
pieces; each of these is looked up once a call, and encoded once per Python worker.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CACHE_PIECES = 850_000  # pieces a Python worker keeps; beyond it starts over
_TEXTS = 1024  # texts split at once

def _byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others for 256, 257, ... in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()

_MARKS = frozenset((b".", b","))
_ASCII_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")

_encoders: dict[str, PieceEncoder] = {}


def default_path() -> str:
    """The 49k word-BPE file of the public tokenizer collection on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _split(texts: list[bytes | None]) -> tuple[list[int], pa.DictionaryArray]:
    """Where the pieces of each text begin, and where the last ends; and all pieces.

    A text with white space at an end, and one without pieces, has an empty piece there.
    """
    # Any bytes pass as a string here: the kernel looks for ASCII white space only.
    whole = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
    parts = pc.ascii_split_whitespace(whole)
    return parts.offsets.to_pylist(), parts.values.view(pa.large_binary()).dictionary_encode()


class _Numbers(dict):
    """Numbers pieces as they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = place = len(self)
        return place


class PieceEncoder:
    """Encodes texts; keeps the ids of pieces seen as slices of one flat array."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._start_over()

    def _start_over(self) -> None:
        self._number = _Numbers()
        self._stems: dict[str, bytes] = {}  # lower-case letters -> ids, two bytes each
        self._ids = np.empty(0, np.uint16)
        self._begin = np.empty(0, np.int64)  # by number of the piece
        self._size = np.empty(0, np.int64)

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of a UTF-8 text as unsigned 32-bit numbers; null counts as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        for first in range(0, len(texts), _TEXTS):
            if len(self._number) > _CACHE_PIECES:
                self._start_over()
            starts, pieces = _split(texts[first : first + _TEXTS])
            different = pieces.dictionary.to_numpy(zero_copy_only=False)  # objects, quicker than a list
            numbers = np.fromiter(map(self._number.__getitem__, different), np.int64, len(different))
            self._learn()
            places = numbers[pieces.indices.to_numpy()]
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                yield self._gather(places[start:end])

    def _gather(self, places: np.ndarray) -> np.ndarray:
        size = self._size[places]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        # Id i of the text lies (i - start of its piece) behind the piece's first id.
        shift = np.repeat(self._begin[places] - (ends - size), size)
        return self._ids[shift + np.arange(total)].astype(np.uint32)

    def _learn(self) -> None:
        new = self._number.new
        stems, found = self._stems, []
        for piece in new:
            # ASCII letters, with one full stop or comma at most, are most of all.
            letters = piece[:-1] if piece[-1:] in _MARKS else piece
            if not letters.isalpha():
                found.append(self._piece(piece.decode("utf-8", "replace")))
                continue
            stem = letters.lower().decode()
            ids = stems.get(stem)
            if ids is None:
                ids = stems[stem] = self._word(stem)
            found.append(ids if letters is piece else ids + self._mark(piece[-1:].decode()))
        new.clear()
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        begin = len(self._ids) + np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), np.uint16)
        self._ids = np.concatenate([self._ids, ids])
        self._begin = np.concatenate([self._begin, begin])
        self._size = np.concatenate([self._size, size])

    def _word(self, word: str) -> bytes:
        return array("H", [t.id for t in self._tokenizer.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        # Letters, with one full stop or comma at most, in Latin-1, where lower case and
        # normal form are character by character: one word of the model, and the mark.
        letters = piece[:-1] if piece[-1] in ".," else piece
        if not letters.isalpha() or (not letters.isascii() and max(letters) > "\xff"):
            if not piece.isascii() or "'" in piece or "<|" in piece:
                return self._encoded(piece)
            # The file's pattern for ASCII without contractions and special tokens.
            parts = _ASCII_PARTS.findall(piece.lower())
            return b"".join([self._piece(p) if p.isalpha() else self._mark(p) for p in parts])
        stem = letters.lower()
        ids = self._stems.get(stem)
        if ids is None:
            word = stem if stem.isascii() else "".join(map(_BYTE_NAMES.__getitem__, stem.encode()))
            ids = self._stems[stem] = self._word(word)
        return ids if letters is piece else ids + self._mark(piece[-1])

    def _mark(self, mark: str) -> bytes:
        if mark not in self._stems:
            self._stems[mark] = self._encoded(mark)
        return self._stems[mark]

    def _encoded(self, text: str) -> bytes:
        return array("H", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
