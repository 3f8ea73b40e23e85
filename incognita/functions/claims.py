"""Which of several overlapping spans of a text stand."""

from __future__ import annotations

from bisect import bisect_left


def claims(spans: list[tuple]) -> list[tuple]:
    """The spans (rank, start, end, ...) that overlap no span before them in the order of ranks, by place.

    A sweep over the places finds islands, runs of spans that overlap one another; ranks are compared inside an island only, and there by
    bisection, so that many spans cost little more than their sorting.
    """
    taken: list[tuple] = []
    island: list[tuple] = []
    reach = 0
    for span in sorted(spans, key=lambda s: (s[1], s[2])):
        if island and span[1] >= reach:
            taken += _settled(island)
            island = []
        reach = max(reach, span[2]) if island else span[2]
        island.append(span)
    return taken + _settled(island)


def _settled(island: list[tuple]) -> list[tuple]:
    if len(island) < 2:
        return island
    starts: list[int] = []
    kept: list[tuple] = []
    for span in sorted(island, key=lambda s: s[:3]):
        at = bisect_left(starts, span[1])
        if (not at or kept[at - 1][2] <= span[1]) and (at == len(kept) or span[2] <= kept[at][1]):
            starts.insert(at, span[1])
            kept.insert(at, span)
    return kept
