"""An automaton over surrogates that reads a text once, in pieces.

Its states are the beginnings of surrogates in their tolerant form. The state reached at the end of a piece says from
where on a surrogate may still grow, so exactly that much is held back, and nothing where no surrogate has begun.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

from incognita.functions.text import HYPHENS, NOISE, ZERO_WIDTH

_NOISE = set(NOISE + ZERO_WIDTH)
_FOLDED = {h: "-" for h in HYPHENS} | {chr(c): chr(c + 32) for c in range(65, 91)}


def _folded(char: str) -> str:
    """What a character is to a tolerant comparison: nothing, a blank, or itself in lower case."""
    return "" if char in _NOISE else " " if char.isspace() else _FOLDED.get(char, char)


class _Forms(dict):
    """What each character is to a tolerant comparison, worked out when it is met first."""

    def __missing__(self, char: str) -> str:
        self[char] = form = _folded(char)
        return form


_FORMS = _Forms()


class Matcher:
    """Surrogates of one stream, and how they are found in a text."""

    def __init__(self, pairs: list[tuple[str, str]]):
        """pairs: (surrogate, original). Longer surrogates take their places first, then by name."""
        self.pairs = sorted(dict(pairs).items(), key=lambda p: (-len(p[0]), p[0]))
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.ends, self.fall = [0], [[]], [0]
        self.edges: list[tuple[str, str]] = []
        for rank, (surrogate, _) in enumerate(self.pairs):
            core = surrogate.strip("".join(_NOISE))
            self.edges.append((surrogate[: surrogate.find(core)], surrogate[surrogate.find(core) + len(core) :]) if core else ("", ""))
            state, blank, size = 0, False, 0
            for form in filter(None, map(_folded, core)):
                if form == " " and blank:
                    continue
                blank, size = form == " ", size + 1
                if form not in self.next[state]:
                    self.next[state][form] = len(self.next)
                    self.next.append({})
                    self.depth.append(size)
                    self.ends.append([])
                    self.fall.append(0)
                state = self.next[state][form]
            if state:
                self.ends[state].append((size, rank))
        self._link()

    def _link(self) -> None:
        """Where a state goes on if its next character doesn't fit: the longest other beginning that it ends with."""
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for form, child in self.next[state].items():
                self.fall[child] = self._step(self.fall[state], form)
                self.ends[child] = self.ends[child] + self.ends[self.fall[child]]
                queue.append(child)

    def _step(self, state: int, form: str) -> int:
        while state and form not in self.next[state]:
            state = self.fall[state]
        return self.next[state].get(form, 0)

    def scan(self, text: str, after_blank: bool = False) -> tuple[list[tuple[int, int, int]], int]:
        """Matches as (rank, start, end), and the place from which on one may still grow. ``after_blank``: the text goes on
        behind white space."""
        state, places, found = 0, [], []
        blank = after_blank
        forms, steps, ends = _FORMS, self.next, self.ends
        for place, char in enumerate(text):
            form = forms[char]
            if not form or (form == " " and blank):
                continue
            blank = form == " "
            places.append(place)
            after = steps[state].get(form)
            state = after if after is not None else self._step(state, form) if state else 0
            for size, rank in ends[state]:
                lead, tail = self.edges[rank]
                start, end = places[-size], place + 1
                start -= len(lead) if lead and text.endswith(lead, 0, start) else 0
                end += len(tail) if tail and text.startswith(tail, end) else 0
                found.append((rank, start, end))
        grows = places[-self.depth[state]] if state else len(text)
        while grows and text[grows - 1] in _NOISE:
            grows -= 1  # marks before it may belong to it
        return found, grows

    def put_back(self, text: str, found: list[tuple[int, int, int]]) -> str:
        """The text with originals in the places of matches, which take them in the order of ranks."""
        starts: list[int] = []
        taken: list[tuple[int, int, int]] = []
        for rank, start, end in sorted(found):
            at = bisect_left(starts, start)
            if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                starts.insert(at, start)
                taken.insert(at, (start, end, rank))
        out, done = [], 0
        for start, end, rank in taken:
            out += [text[done:start], self.pairs[rank][1]]
            done = end
        return "".join([*out, text[done:]])

    def restore(self, text: str) -> str:
        return self.put_back(text, self.scan(text)[0])


class Held:
    """The part of a stream's text that isn't given out yet."""

    def __init__(self, matcher: Matcher, text: str = "", after_blank: bool = False):
        self.matcher, self.text, self.after_blank = matcher, text, after_blank

    def push(self, piece: str) -> str:
        """What can be given out once this piece has come: all before the first match that may still grow, or that
        overlaps one that may."""
        self.text += piece
        found, cut = self.matcher.scan(self.text, self.after_blank)
        late = len(self.text)
        for rank, start, end in sorted(found, key=lambda m: -m[2]):
            # A match at the very end waits for a mark that may belong to it.
            if start < cut and (end > cut or (end == late and self.matcher.edges[rank][1])):
                cut = start
        return self._give(cut, [m for m in found if m[2] <= cut])

    def flush(self) -> str:
        return self._give(len(self.text), self.matcher.scan(self.text, self.after_blank)[0])

    def _give(self, cut: int, found: list[tuple[int, int, int]]) -> str:
        given, self.text = self.text[:cut], self.text[cut:]
        real = given.rstrip("".join(_NOISE))
        self.after_blank = real[-1].isspace() if real else self.after_blank
        return self.matcher.put_back(given, found)
