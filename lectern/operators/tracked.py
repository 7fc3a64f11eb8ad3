"""Rewriting of a text in steps, with where every rewritten part comes from.

A part is rewritten once at most: a later match that meets a rewritten part, or that holds a deleted one inside, is rejected. Matches of
one step are held against the parts of earlier steps only. A match that is replaced by itself leaves the part free.

Edge cases (tests/test_tracked.py): an empty text has no parts; empty matches are no matches; positions are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: start, stop, what stands in the text for the match, and a note on it; without a note the match is replaced by what stands for it.
Match = tuple[int, int, str, object]


class Notes(dict):
    """Numbers of notes, from 0 in the order in which they are first asked for; texts may share them."""

    def __init__(self):
        super().__init__()
        self.by_text: dict[Callable, _NumberOfText] = {}

    def __missing__(self, note) -> int:
        self[note] = number = len(self)
        return number

    def of_texts(self, note: Callable[[str], object]) -> dict[str, int]:
        """Numbers of note(text), by text."""
        if note not in self.by_text:
            self.by_text[note] = _NumberOfText(self, note)
        return self.by_text[note]


class _NumberOfText(dict):
    def __init__(self, notes: Notes, note: Callable[[str], object]):
        super().__init__()
        self.notes, self.note = notes, note

    def __missing__(self, text: str) -> int:
        self[text] = number = self.notes[self.note(text)]
        return number


class Tracked:
    def __init__(self, text: str, notes: Notes | None = None):
        self.text = text
        #: Rewritten parts in order: where they stand in the text, and where they come from.
        self.start = self.stop = self.source_start = self.source_stop = np.zeros(0, np.int64)
        #: The number of each part's note.
        self.numbers = np.zeros(0, np.int64)
        self.notes = Notes() if notes is None else notes

    def to_source(self, positions):
        """Positions of free characters in the source."""
        k = np.searchsorted(self.stop, positions, "right") - 1
        return np.where(k >= 0, self.source_stop[k] + positions - self.stop[k], positions) if len(self.stop) else positions

    def free(self, start, stop):
        """Which ranges hold no rewritten part: the first part that stops behind a range's start must not start before its end."""
        k = np.searchsorted(self.stop, start, "right")
        beyond = np.append(self.start, np.iinfo(np.int64).max)
        return beyond[k] >= stop

    def rewrite(self, matches: Iterable[Match]) -> None:
        """Apply disjoint matches, in order, of the text as it stands."""
        found = [m for m in matches if m[0] < m[1] and (m[3] is not None or self.text[m[0] : m[1]] != m[2])]
        if not found:
            return
        start, stop = (np.array([m[k] for m in found], np.int64) for k in (0, 1))
        ok = self.free(start, stop)
        if not ok.any():
            return
        found = [m for m, yes in zip(found, ok.tolist()) if yes]
        numbers = np.array([self.notes[m[2] if m[3] is None else m[3]] for m in found], np.int64)
        parts, done = [], 0
        for a, z, stand, _ in found:
            parts += (self.text[done:a], stand)
            done = z
        self._insert(start[ok], stop[ok], np.array([len(m[2]) for m in found], np.int64), numbers, "".join(parts) + self.text[done:])

    def _insert(self, start, stop, size, numbers, text: str) -> None:
        """Add free parts, in order, that have `size` characters each in the new text."""
        moved = np.concatenate(([0], np.cumsum(size - (stop - start))))
        source_start, source_stop = self.to_source(start), self.to_source(stop - 1) + 1
        new_start = start + moved[:-1]
        if len(self.start):
            old = moved[np.searchsorted(stop, self.start, "right")]
            order = np.argsort(np.concatenate((self.source_start, source_start)), kind="stable")
            joined = lambda a, b: np.concatenate((a, b))[order]
        else:
            old, joined = 0, lambda a, b: b
        self.start, self.stop = joined(self.start + old, new_start), joined(self.stop + old, new_start + size)
        self.source_start, self.source_stop = joined(self.source_start, source_start), joined(self.source_stop, source_stop)
        self.numbers, self.text = joined(self.numbers, numbers), text

    def sub_texts(self, pattern, stand: str, note: Callable[[str], object]) -> None:
        """Let `stand` stand for every match of a pattern whose one group is its whole match; note(text) of a match gives its note.

        As sub() with a stand-in and a note, but all at once, for patterns that match much of a text.
        """
        pieces = pattern.split(self.text)
        if len(pieces) == 1:
            return
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        start, stop, words = ends[:-1:2], ends[1::2], pieces[1::2]
        ok = self.free(start, stop)
        if not ok.all():
            yes = ok.tolist()
            pieces[1::2] = [stand if y else w for w, y in zip(words, yes)]
            start, stop, words = start[ok], stop[ok], [w for w, y in zip(words, yes) if y]
        else:
            pieces[1::2] = [stand] * len(words)
        if words:
            numbers = np.fromiter(map(self.notes.of_texts(note).__getitem__, words), np.int64, len(words))
            self._insert(start, stop, np.full(len(words), len(stand), np.int64), numbers, "".join(pieces))

    def sub(self, pattern, change: Callable) -> None:
        """Rewrite the matches of a compiled pattern; change(match) gives a text, or None to leave the match, or (stand-in, note)."""
        out = []
        for m in pattern.finditer(self.text):
            new = change(m)
            if new is not None:
                out.append((m.start(), m.end(), *((new, None) if isinstance(new, str) else new)))
        self.rewrite(out)

    def replace(self, old: str, new: str) -> None:
        """Rewrite every occurrence of a literal; an empty one has none."""
        at, out = self.text.find(old) if old else -1, []
        while at >= 0:
            out.append((at, at + len(old), new, None))
            at = self.text.find(old, at + len(old))
        self.rewrite(out)

    def parts(self) -> list[tuple[int, int, object]]:
        """(source start, source stop, note) of the rewritten parts in order; the note of a literal part is its new text."""
        notes = list(self.notes)
        return [(a, z, notes[k]) for a, z, k in zip(self.source_start.tolist(), self.source_stop.tolist(), self.numbers.tolist())]

    def char_map(self) -> list[tuple[int, int]]:
        """The source range of every character of the text: its own place where it is free, else that of its part."""
        out, done = [], 0
        for a, z, s, e in zip(self.start.tolist(), self.stop.tolist(), self.source_start.tolist(), self.source_stop.tolist()):
            out += [(s - a + i, s - a + i + 1) for i in range(done, a)] + [(s, e)] * (z - a)
            done = z
        last = int(self.source_stop[-1]) - done if len(self.stop) else 0
        return out + [(last + i, last + i + 1) for i in range(done, len(self.text))]
