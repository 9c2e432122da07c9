"""A SentencePiece vocabulary file read as a table of pieces; shared by encoding and counting."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

#: The mark that stands for a space inside pieces.
MARK = "▁"
NORMAL, BYTE = 1, 6

DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(model: str = DEFAULT_MODEL) -> str:
    """A path as given, or the place of a public tokenizer's file of that name on this machine."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else number()
            yield tag >> 3, raw[at : at + size]
            at += size


class Pieces:
    """Scores and ids of the pieces, and what follows from them about where no piece can cross."""

    def __init__(self, model: str = DEFAULT_MODEL):
        with open(model_path(model), "rb") as f:
            messages = list(_fields(f.read()))
        self.names: list[str] = []
        self.normal: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        for kind, value in messages:
            if kind != 1:
                continue
            piece = dict(_fields(value))
            name, index = piece[1].decode(), len(self.names)
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            if piece.get(3, NORMAL) == NORMAL:
                self.normal[name] = (index, score)
            elif piece[3] == BYTE:
                self.bytes[int(name[3:5], 16)] = index
            self.names.append(name)
        normaliser = dict(next((_fields(v) for k, v in messages if k == 3), ()))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or len(self.bytes) != 256:
            raise ValueError("only models with identity normalisation, a leading mark and byte fallback are read")
        self.longest = max(map(len, self.normal))
        self.real_low = min(s for _, s in self.normal.values() if s > -1e8)
        # A boundary that no piece crosses may be cut before anything is merged or scored.
        crossed = any(MARK in name.lstrip(MARK) for name in self.normal)
        lone = "" if any("\n" in name for name in self.normal) else "\n"
        if crossed:
            self._cut = re.compile(f"[^{lone}]+|{lone}" if lone else r"(?s).+")
        else:
            self._cut = re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + (f"|{lone}" if lone else ""))

    @cached_property
    def tree(self) -> dict:
        """Pieces by their characters: ``character: (score of the piece that ends here or None, what may follow)``."""
        root: dict = {}
        for name, (_, score) in self.normal.items():
            node = root
            for c in name[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[name[-1]] = (score, node[name[-1]][1] if name[-1] in node else {})
        return root

    def segments(self, marked: str) -> list[str]:
        """Parts of a text (spaces as marks) that are tokenised apart from each other."""
        return self._cut.findall(marked)


@lru_cache(maxsize=4)
def pieces(model: str = DEFAULT_MODEL) -> Pieces:
    """The vocabulary, read once per process."""
    return Pieces(model)
