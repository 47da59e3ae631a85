"""Whole-text encoding with the ``tokenizers`` library, remembering the ids of pieces already seen.

A pre-tokenizer that never joins a space to what stands before it always breaks in front of a single space that a
visible character follows.  What follows such a break is encoded without regard to what precedes it, so the ids of a
text are the ids of its pieces one after the other.  Both tokenizers used here are of that kind, and the tests compare
with plain encoding.  Pieces are encoded by the library, many in one call; frequent ones come from memory.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import slices

#: A space with a visible Latin or ASCII character behind it is a break; other spaces stay inside their piece.
_BREAK = re.compile(" (?=[!-~¡-¬®-ȳ])")
#: Such pieces begin behind a break, and a line end behind them is a word of its own.
_SAFE = re.compile("[!-~¡-¬®-ȳ](?:[^\\s\0]*[!-~¡-¬®-ȳ])?").fullmatch
#: Signs behind letters or digits, up to the end of a piece, are words of their own.  Letters whose lower-case form ends in a combining mark,
#: as that of U+0130 does, are none of them: the mark joins what follows; nor is an apostrophe a sign, which may begin a contraction.
_SIGNED = re.compile("(.*[0-9A-Za-zÀ-ÖØ-öø-įıĲ-ɏ])([!-&(-/:-@\\[-`{-~]+)").fullmatch
#: Pieces of such letters alone are one word for either pre-tokenizer.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+").fullmatch
#: Of these the ones that are also safe wherever they stand.
_PLAIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ȳ]+").fullmatch
#: Byte-level models name a byte by the character with its number if that is printable, else by those from 256 on.
_BYTE_NAMES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_LOADED: dict[str, "PieceEncoder"] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


class _Unsafe(Exception):
    """A text holds a piece that must be seen with its neighbours."""


class _Known(dict):
    """Ids of pieces; a missing one is encoded and, while there is room, remembered."""

    def __init__(self, encode, most: int, longest: int, signs: dict[str, bytes] | None = None, special: tuple[str, ...] = ()):
        self.encode, self.most, self.longest, self.signs, self.special = encode, most, longest, signs, special

    def __missing__(self, piece: str) -> bytes:
        if _PLAIN_WORD(piece):  # the most by far
            ids = self.encode(piece)
            if len(self) < self.most and len(piece) <= self.longest:
                self[piece] = ids
            return ids
        if not _SAFE(piece):
            raise _Unsafe
        room = len(self) < self.most and len(piece) <= self.longest
        signed = _SIGNED(piece) if self.signs is not None else None
        if signed and not any(x in piece for x in self.special):
            word, signs = signed.groups()
            room = room and word in self  # a new word is remembered once
            ids = self[word] + self.signs[signs]
        else:
            ids = self.encode(piece)
        if room:
            self[piece] = ids
        return ids


class PieceEncoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``self.dtype``."""

    def __init__(self, path: str, most_pieces: int = 500_000, longest: int = 40):
        self.tokenizer = load(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        config = self.tokenizer.to_str().split('"model"')[0]
        self.lower, self.prefix = '"Lowercase"' in config, "" if '"invert":true' in config else "\u0120"
        self.direct = True
        samples = ["the", "Étrangère", "Größe", "niño", "Zzyzx", "internationalisation"]
        self.direct = all(self._encode(p, self.prefix, " ") == self._plain(" " + p) and self._encode(p, "", "") == self._plain(p) for p in samples)
        signs = _Known(self._plain, most_pieces // 100, longest)
        special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.inside = _Known(lambda p: self._encode(p, self.prefix, " "), most_pieces, longest, signs, special)
        self.heads = _Known(lambda p: self._encode(p, "", ""), most_pieces // 10, longest, signs, special)
        self.line_end = self._plain("\n")

    @classmethod
    def of(cls, path: str, most_pieces: int = 500_000) -> "PieceEncoder":
        """One for each Python worker and file; it remembers as many pieces as was asked for last."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        _LOADED[path].inside.most = most_pieces
        return _LOADED[path]

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, piece: str, prefix: str, space: str) -> bytes:
        """Words of letters go to the model at once, which skips the pre-tokenizer (only if that gave the same ids for samples)."""
        if self.direct and _WORD(piece):
            w = piece.lower() if self.lower else piece
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(_BYTE_NAMES)
            return array(self.code, [t.id for t in self.tokenizer.model.tokenize(prefix + w)]).tobytes()
        return self._plain(space + piece)

    def _by_pieces(self, text: str) -> bytes:
        inside, heads, end = self.inside.__getitem__, self.heads.__getitem__, self.line_end
        got = []
        for line in text.split("\n"):
            parts = line.split(" ")
            got.append(heads(parts[0]))
            got.extend(map(inside, parts[1:]))
            got.append(end)
        got.pop()
        return b"".join(got)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            try:
                out.append(self._by_pieces(text))
            except _Unsafe:
                parts = _BREAK.split(text)
                out.append(self._plain(parts[0]) + b"".join([self._encode(p, self.prefix, " ") for p in parts[1:]]))
        return out


def forget() -> None:
    """Give a worker's remembered pieces back: for the first lines of stages that come after encoding."""
    _LOADED.clear()


def batches(texts: list[str], most_chars: int = 4_000_000):
    """Slices of ``texts`` of a bounded number of characters each (a longer text alone makes one)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_rows(path: str, text_column: str, keep: list[str], end_id: int | None, most_pieces: int = 500_000):
    """For mapInArrow: the kept columns, ``n_tokens`` and ``ids`` of every text (null: empty), an end id appended if given."""

    def run(stream):
        import pyarrow as pa

        encoder = PieceEncoder.of(path, most_pieces)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in slices(stream):
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            for a, b in batches(texts):
                ids = [x + end for x in encoder.encode(texts[a:b])]
                columns = [batch.column(c).slice(a, b - a) for c in keep]
                counts = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(ids, pa.binary())], [*keep, "n_tokens", "ids"])

    return run
