"""Where public vocabularies lie, and what several operators need of them. Paths are parameters everywhere."""

from __future__ import annotations

import re
import unicodedata
import weakref
from functools import lru_cache

#: Characters for which Python's tables and those of the tokenizers library agree; other texts take the library's own path.
SAFE = re.compile("[\n\t\r -~¡-¬®-ſ]*")


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(33, 0x180) if unicodedata.category(chr(c))[0] == kind)


#: Letters and numbers among the safe characters, for character classes.
LETTERS, NUMBERS = _class("L"), _class("N")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Memo(dict):
    """A dict that computes what it lacks; when half full, it starts anew but takes over what is asked for again. Long keys are not kept."""

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}
        _MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if 2 * len(self) >= self.most:
                self.old = self.copy()
                super().clear()
            self[key] = value
        return value

    def clear(self):
        super().clear()
        self.old = {}


_MEMOS: list = []


def only(module: str) -> None:
    """Empty what other modules keep: a Python worker serves one operator after another."""
    for m in (r() for r in _MEMOS):
        if m is not None and m.make.__module__ != module:
            m.clear()
    for f in _KEPT:
        if f.__module__ != module:
            f.cache_clear()


_KEPT: list = []


def kept(f):
    """f with its last results kept, until another operator runs in the worker."""
    out = lru_cache(2)(f)
    _KEPT.append(out)
    return out
