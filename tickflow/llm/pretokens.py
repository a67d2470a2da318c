"""Pre-tokens as a tokenizer's own library splits them.

The ``regex`` module knows later Unicode versions than the tokenizers' libraries,
so some code points are letters or numbers to it alone.  Each library is asked
once, on the driver, for its members of the two classes; texts with a code point
on which the two differ are split by a pattern that lists the difference.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

CLASSES = (r"\p{L}", r"\p{N}")


def _by_tiktoken(name: str, every: str) -> set[str]:
    import tiktoken

    library = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(library.decode(library.encode_ordinary(every)))


def _by_tokenizers(name: str, every: str) -> set[str]:
    from tokenizers import Regex, pre_tokenizers

    rest = pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(every)
    return set(every).difference(*[part for part, _ in rest])


LIBRARIES = {"tiktoken": _by_tiktoken, "tokenizers": _by_tokenizers}


def _ranges(points: np.ndarray) -> str:
    """The inside of a character class that holds the ascending code points ``points``."""
    cuts = np.flatnonzero(np.diff(points) != 1) + 1
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in np.split(points, cuts) if len(run))


@lru_cache(maxsize=4)
def matched_patterns(pattern: str, library: str) -> tuple[str, str, str]:
    """(pattern, pattern with the library's own classes, the code points on which they differ)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    plain = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    exact, unsure = plain, set()
    for name in CLASSES:
        theirs, ours = LIBRARIES[library](name, every), set(regex.findall(name, every))
        less, more = (_ranges(np.array(sorted(map(ord, part)), np.int64)) for part in (ours - theirs, theirs - ours))
        inside = f"[[{name}--[{less}]]" if less else f"[{name}"
        exact = exact.replace(name, inside + (f"||[{more}]" if more else "") + "]")
        unsure |= ours ^ theirs
    return plain, exact, _ranges(np.array(sorted(map(ord, unsure)), np.int64))


class Kept(dict):
    """Ids, as bytes, of the short words met lately: two generations of up to ``most`` words, of which the older one goes whole.

    ``encode`` gives the ids of each of many words.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int, longest: int):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        """A long word, which is not kept."""
        return self.encode([word])[0]

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of words end to end; words that are not known are encoded at once."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for word in set().union(*texts).difference(self):
            if word in old:
                self[word] = old[word]
            elif len(word) <= self.longest:
                new.append(word)
        self.update(zip(new, self.encode(new), strict=True))
        return [b"".join(map(self.__getitem__, words)) for words in texts]


class Splitter:
    """``words(text)``: the matches of a pattern, end to end the text where the pattern matches all of it."""

    def __init__(self, plain: str, exact: str, unsure: str):
        self.plain, self.exact = regex.compile(plain).findall, regex.compile(exact, regex.V1).findall
        self.unsure = re.compile(f"[{unsure}]").search if unsure else None
        #: The least first byte, in UTF-8, of a code point on which the patterns differ: few texts need to be searched.
        self.least = min(chr(int(x, 16)).encode()[0] for x in re.findall(r"\\U([0-9a-f]{8})", unsure)) if unsure else 256

    def words(self, text: str) -> list[str]:
        if self.unsure is None or text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < self.least or not self.unsure(text):
            return self.plain(text)
        return self.exact(text)
