"""Exact byte-level BPE of texts of any length, on one worker.

Three observations make it fast and exact:

* A pre-token always ends where a single space stands between two other characters, so a text can be looked up word by
  word in a bounded store of encoded words, and the ids of a batch are gathered at once.
* Some places in a text are ends of pre-tokens whatever stands around them (:func:`safe_cut`); long texts are cut there.
* Within one giant pre-token no such place exists.  Its parts are encoded apart, and around each join a growing window
  is encoded again until the pairs of tokens at both of its ends are what the encoder makes of the two tokens alone
  (:func:`join`).  A token sequence whose neighbouring pairs all have that property is the encoding of the whole.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern belonging to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters with the Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The store of encoded words starts anew, between two batches, when it holds more than so many ids.
STORED_IDS = 4_000_000

_runs = re.compile(f"([{SPACE}]{{2,}})")
_pre = regex.compile(PATTERN)
_is_space = regex.compile(f"[{SPACE}]").match


class _Words(dict):
    """Word -> its number in the store of encoded words, filled on demand."""

    def __init__(self, add, prefix: str):
        super().__init__()
        self.add, self.prefix = add, prefix

    def __missing__(self, word: str) -> int:
        unit = self[word] = self.add(self.prefix + word)
        return unit


class Bpe:
    """An encoder for one vocabulary file."""

    def __init__(self, vocab: str):
        with open(vocab, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in ranks.items()}
        self._enc = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self._enc.encode_ordinary
        self.raw = self._enc._encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self._flat, self._sizes = array("i"), array("i")
        self._first, self._later = _Words(self._add, ""), _Words(self._add, " ")

    def _add(self, text: str) -> int:
        ids = self.encode(text)
        self._flat.extend(ids)
        self._sizes.append(len(ids))
        return len(self._sizes) - 1

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text begins (with the end: one more than texts).

        No special tokens; a null or empty text has no ids."""
        if len(self._flat) > STORED_IDS:
            self._forget()
        units: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                self._units(text, units)
            ends.append(len(units))
        unit = np.array(units, np.int64)
        sizes = np.frombuffer(self._sizes, np.int32) if self._sizes else np.zeros(1, np.int32)
        flat = np.frombuffer(self._flat, np.int32) if self._flat else np.zeros(1, np.int32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n = sizes[unit]
        offsets = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        ids = flat[np.repeat(starts[unit] - offsets[:-1], n) + np.arange(offsets[-1])]
        return ids, offsets[ends]

    def ids(self, text: str | None) -> list[int]:
        """The ids of one text."""
        return self.batch([text])[0].tolist()

    def _units(self, text: str, out: list[int]) -> None:
        """Append the units of a text: words with the space before them, and runs of white space."""
        parts = _runs.split(text)
        if parts[0]:
            self._part(parts[0], False, out)
        for k in range(1, len(parts), 2):
            run, part = parts[k], parts[k + 1]
            if not part:  # white space at the end of the text is one pre-token
                out.append(self._first[run])
                return
            out.append(self._first[run[:-1]])
            if run[-1] == " ":
                self._part(part, True, out)
            else:
                out.append(self._first[run[-1]])
                self._part(part, False, out)

    def _part(self, part: str, spaced: bool, out: list[int]) -> None:
        """Units of a part in which each white space stands alone; ``spaced``: a space belongs before it."""
        first, later = self._first, self._later
        newline = None
        for line in part.split("\n"):
            if newline is None:
                newline = first["\n"]
            else:
                out.append(newline)
            if line:
                words = line.split(" ")
                head = words[0]
                alone = not words[-1]  # a space at the end of the text
                if head:
                    out.append((later if spaced else first)[head])
                out.extend(map(later.__getitem__, words[1:-1] if alone else words[1:]))
                if alone:
                    out.append(first[" "])
            spaced = False

    # -- giant pre-tokens ------------------------------------------------------------------------------------------

    def segment(self, text: str, open_left: bool, open_right: bool) -> tuple[list[int], int, int]:
        """Ids of a segment, and how many of them belong to the pre-token cut at its left and right end."""
        if not (open_left or open_right):
            return self.ids(text), 0, 0
        head = _pre.match(text).group() if open_left else ""
        if head == text:
            ids = self.raw(text)
            return ids, len(ids) if open_left else 0, len(ids) if open_right else 0
        tail = ""
        if open_right:
            start = len(head)
            for at in range(len(text) - 1, start, -1):
                if safe_cut(text, at):
                    start = at
                    break
            tail = _pre.findall(text[start:])[-1]
        left = self.raw(head) if head else []
        return left + self.ids(text[len(head) :]), len(left), len(self.raw(tail)) if tail else 0

    def _pair_holds(self, a: int, b: int) -> bool:
        return self.raw(self.tokens[a] + self.tokens[b]) == [a, b]

    def join(self, a: tuple[list[int], int, int], b: tuple[list[int], int, int]) -> tuple[list[int], int, int]:
        """The encoding of two segments cut within one pre-token."""
        (left, left_head, left_tail), (right, right_head, right_tail) = a, b
        back, ahead = min(4, left_tail), min(4, right_head)
        while True:
            window = self.raw(b"".join(self.tokens[t] for t in left[len(left) - back :] + right[:ahead]))
            left_ok = back == left_tail or self._pair_holds(left[-back - 1], window[0])
            right_ok = ahead == right_head or self._pair_holds(window[-1], right[ahead])
            if left_ok and right_ok:
                break
            back = back if left_ok else min(2 * back, left_tail)
            ahead = ahead if right_ok else min(2 * ahead, right_head)
        ids = left[: len(left) - back] + window + right[ahead:]
        through = left_tail - back + len(window) + right_head - ahead
        whole_left, whole_right = left_tail == len(left), right_head == len(right)
        head = (through if whole_left else left_head) if left_head else 0
        tail = (through if whole_right else right_tail) if right_tail else 0
        return ids, head, tail

    def concat(self, parts: list[tuple[list[int], int, int]]) -> list[int]:
        """Concatenate the segments of one text as a tree, mending each join that was cut within a pre-token."""
        while len(parts) > 1:
            merged = []
            for k in range(0, len(parts) - 1, 2):
                a, b = parts[k], parts[k + 1]
                merged.append(self.join(a, b) if a[2] and b[1] else (a[0] + b[0], a[1], b[2]))
            parts = merged + parts[len(merged) * 2 :]
        return parts[0][0] if parts else []


@lru_cache(maxsize=4)
def encoder(vocab: str = DEFAULT_VOCAB) -> Bpe:
    """The encoder of a vocabulary file, once a worker."""
    return Bpe(vocab)


def kind(c: str) -> str:
    """The class that the pre-token pattern sees in a character: L, N, W (white space) or O."""
    if _is_space(c):
        return "W"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "O"


def safe_cut(text: str, at: int) -> bool:
    """Whether a pre-token ends at ``at`` (0 < at < len) whatever stands around these two characters."""
    before, after = kind(text[at - 1]), kind(text[at])
    return before != after and before != "W" and not (text[at - 1] == "'" and after == "L")


def segments(text: str, size: int) -> list[tuple[str, bool, bool]]:
    """Cut a text into pieces of at most ``size`` (at least 64) characters: (piece, cut within a pre-token on its left,
    on its right).  The last safe place in the second half of a piece is taken, else the middle of its longest run."""
    out, start, open_left = [], 0, False
    while len(text) - start > size:
        low, high = start + size // 2, start + size
        cut = next((at for at in range(high, low, -1) if safe_cut(text, at)), None)
        forced = cut is None
        if forced:
            best, run = (0, 0), low
            for at in range(low + 1, high + 1):
                if at == high or kind(text[at]) != kind(text[run]):
                    best, run = max(best, (at - run, -run)), at
            cut = -best[1] + best[0] // 2
        out.append((text[start:cut], open_left, forced))
        start, open_left = cut, forced
    out.append((text[start:], open_left, False))
    return out
