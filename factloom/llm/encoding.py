"""Encoding with the tokenizers library, unit by unit.

Neither tokenizer has a piece that crosses from a visible character to a space or newline, or from a Latin
letter to one of ``. , ! ? ; :``, whatever stands around. So a text's ids are those of its units, and a unit
that recurs is encoded once per worker. A text with characters for which that is not certain is encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

#: A task remembers about this many units, in two generations; the older goes when the newer is full. Units with their
#: spaces belong to jobs that hold more besides.
MEMO_SIZE = {False: 250_000, True: 100_000}
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Visible ASCII, Latin letters (but not the one that lower-cases to two characters), space and newline: after any of the visible ones, a space or newline starts a new piece.
_CERTAIN = re.compile(rf"[ \n!-~{_LATIN}]*")
_SPACED = re.compile(rf"[ \n]*[{_LATIN}]+(?=[.,!?;:])|[ \n]*[^ \n]+|[ \n]+")
#: Units that both tokenizers' first steps leave whole (and lower-casing as they are), so that the merges alone are left to do.
_PLAIN = {True: re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"), False: re.compile(r"[a-zß-öø-ÿ]+")}
_MARKED = re.compile(rf"([{_LATIN}]+)([.,!?;:].*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, str]:
    """The characters that stand for bytes in the vocabulary: visible ones for themselves, the others from 256 up in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in visible else next(others)) for b in range(256)}


def _packed(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class _Memo(dict):
    """Ids by unit, made when they are first asked for, in two generations."""

    def __init__(self, learn, size: int):
        self.learn, self.size, self.older = learn, size, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        if (got := self.older.get(unit)) is None:
            got = self.learn(unit)
        self[unit] = got
        return got


class UnitEncoder:
    def __init__(self, path: str, spaces: bool):
        """``spaces``: the tokenizer keeps white space and case; else it drops the one and lowers the other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = _SPACED.findall if spaces else lambda text: text.lower().split()
        self.spaces = spaces
        self.plain, self.symbols, self.merge = _PLAIN[spaces].fullmatch, _byte_symbols(), self.tokenizer.model.tokenize
        self.memo = _Memo(self._learn, MEMO_SIZE[spaces])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, unit: str) -> bytes:
        if self.plain(unit):
            return _packed([piece.id for piece in self.merge(unit.encode().decode("latin-1").translate(self.symbols))])
        if not self.spaces and (parts := _MARKED.fullmatch(unit)):
            return self.memo[parts[1]] + self.memo[parts[2]]
        return self._whole(unit)

    def forget(self) -> None:
        """What one task has met helps the next but little, and an idle worker should hold little."""
        self.memo.clear()
        self.memo.older = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        of = self.memo.__getitem__
        return [b"".join(map(of, self.units(t))) if _CERTAIN.fullmatch(t) else self._whole(t) for t in texts]


@lru_cache(maxsize=2)
def unit_encoder(path: str, spaces: bool) -> UnitEncoder:
    """One encoder for each worker process, for the tasks that it runs one after another."""
    return UnitEncoder(path, spaces)
