"""Maximal scoring segments of a list of scores, in time that follows its length."""

from __future__ import annotations


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first, behind last, score) of all maximal scoring segments (Ruzzo and Tompa), by place.

    Each kept segment points to the last one before it whose total in front is smaller, so that looking for the segment
    to join with leaps over those that cannot be it, and every leap is made once.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, the one to look at next
    total = 0.0
    for i, s in enumerate(scores):
        low, total = total, total + s
        if s <= 0:
            continue
        start, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            start, _, low, _, before = found[j]
            del found[j:]
            j = before
        found.append((start, i + 1, low, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in found]
