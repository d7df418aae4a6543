"""Count-only Viterbi segmentation over a unigram vocabulary; kept by the Python worker between tasks."""

from __future__ import annotations

import re

import ahocorasick

SPACE = "▁"
MOST_KEPT = 1_000_000  # segments remembered by one worker, each of at most 48 characters
_made: dict[str, Segmenter] = {}


class _Counts(dict):
    """Piece counts of segments, by need."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, segment: str) -> int:
        n = self.count(segment)
        if len(segment) <= 48:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[segment] = n
        return n


class Segmenter:
    """pieces: (text, score) of the ordinary pieces. Unknown characters score the lowest piece's score less 10 and
    count as their UTF-8 bytes (byte fallback).

    Where no piece holds a pair of adjacent characters, every best path has a boundary between them, so the text is
    cut there and the cuts are counted alone: after a word before a mark, after a mark before a word, and before
    spaces. Texts that hold one of the pairs that contradict this are cut before spaces only if no piece forbids it."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.auto = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self.auto.add_word(text, (len(text), float(score)))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        kind = lambda c: 2 if c == SPACE else int(bool(re.match(r"\w", c)))
        pairs = {t[i : i + 2] for t, _ in pieces for i in range(len(t) - 1)}
        self.whole = any(a != SPACE and b == SPACE for a, b in pairs)
        self.joined = [p for p in pairs if kind(p[0]) != kind(p[1]) and SPACE not in p]
        if any(kind(a) != kind(b) for a, b in self.joined) and len(self.joined) > 100:
            self.joined = [""]
        self.fine = re.compile(rf"{SPACE}*\w+|{SPACE}*[^\w{SPACE}]+|{SPACE}+")
        self.coarse = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known = _Counts(self.count)

    def count(self, text: str) -> int:
        """Pieces of the best path. Of equal scores, the path whose last piece is longest wins at every position, as
        when starts are tried from left to right and only a higher score replaces what is there."""
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        at, high, best, single = 0, None, 0, False
        unknown = self.unknown

        def close() -> None:
            nonlocal at, high, best, single
            if not single and (high is None or score[at] + unknown > high):
                high, best = score[at] + unknown, pieces[at] + len(text[at].encode("utf-8", "surrogatepass"))
            at += 1
            score[at], pieces[at] = high, best
            high, best, single = None, 0, False

        for end, (size, own) in self.auto.iter(text):
            while at < end:
                close()
            start = end + 1 - size
            s = score[start] + own
            if high is None or s > high:
                high, best = s, pieces[start] + 1
            single |= size == 1
        while at < n:
            close()
        return pieces[n]

    def tokens(self, text: str) -> int:
        """Pieces of a whole text, with one space before it."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.whole:
            return self.count(text)
        cut = self.coarse if any(p in text for p in self.joined) else self.fine
        return sum(map(self.known.__getitem__, cut.findall(text)))


def segmenter(digest: str, pieces) -> Segmenter:
    if digest not in _made:
        _made[digest] = Segmenter(pieces())
    return _made[digest]
