"""The normaliser of a SentencePiece model as a transducer from text to text.

Two machines run one after the other, without a text in between:

* rewriting has a trie of the model's character rewrites; at every position the longest one applies, and a character without one
  stays as it is. User-defined symbols are rewrites to themselves that go before all others;
* spacing writes a space as the mark U+2581. Where the model removes extra white space it has three states: nothing
  written yet, inside a word, after a word. A space is then written with the next character that is none, so spaces in front,
  at the end and after another space go.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

MARK = "▁"


def rewrites_of(charsmap: bytes) -> dict[str, str]:
    """The rewrites in a model file's table: a double-array trie of UTF-8 bytes, then the results, each ended by a zero byte."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64)
    results = charsmap[4 + size :]
    labels = units & 0x800000FF
    offsets = (units >> 10) << ((units & 0x200) >> 6)
    every = np.arange(1, 256)
    found: dict[str, str] = {}
    todo = [(b"", int(offsets[0]))]
    while todo:
        key, base = todo.pop()
        at = base ^ every
        inside = at < len(units)
        for c in every[inside][labels[at[inside]] == every[inside]].tolist():
            place, longer = base ^ c, key + bytes([c])
            below = place ^ int(offsets[place])
            if units[place] >> 8 & 1:
                start = int(units[below] & 0x7FFFFFFF)
                found[longer.decode()] = results[start : results.index(b"\0", start)].decode()
            todo.append((longer, below))
    return found


@dataclass
class Normaliser:
    """rewrites: of strings; kept: strings that no rewrite touches; prefix: a mark goes in front; shorten: extra white space goes."""

    rewrites: dict[str, str] = field(default_factory=dict)
    kept: frozenset[str] = frozenset()
    prefix: bool = True
    shorten: bool = False

    def __post_init__(self) -> None:
        self.plain = not self.rewrites and not self.shorten
        # The tries as sets of proper prefixes: a string that is in none of them cannot be continued.
        self._open = {s[:n] for s in self.rewrites for n in range(1, len(s))}
        self._kept_open = {s[:n] for s in self.kept for n in range(1, len(s))}
        self._first = {s[0] for s in self.rewrites if s} | {s[0] for s in self.kept if s}

    @staticmethod
    def _longest(text: str, at: int, words, unfinished) -> int:
        end, best = at + 1, 0
        while end <= len(text):
            part = text[at:end]
            if part in words:
                best = end
            if part not in unfinished:
                break
            end += 1
        return best

    def rewritten(self, text: str) -> str:
        if not self.rewrites:
            return text
        out, at, first = [], 0, self._first
        while at < len(text):
            if text[at] not in first:
                out.append(text[at])
                at += 1
            elif end := self._longest(text, at, self.kept, self._kept_open):
                out.append(text[at:end])
                at = end
            elif end := self._longest(text, at, self.rewrites, self._open):
                out.append(self.rewrites[text[at:end]])
                at = end
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    def __call__(self, text: str) -> str:
        """What is written for a text; nothing for an empty one."""
        if self.plain:
            return (MARK if text and self.prefix else "") + text.replace(" ", MARK)
        written = self.rewritten(text)
        if not self.shorten:
            return (MARK if text and self.prefix else "") + written.replace(" ", MARK)
        # Splitting at spaces gives the words between which the third state writes one mark.
        words = MARK.join(w for w in written.split(" ") if w)
        return ((MARK if words and self.prefix else "") + words).rstrip(MARK)
