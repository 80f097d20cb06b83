"""Suffix arrays by linear grouping, without recursion.

First phase: suffixes are put into groups by their Lyndon prefix, the longest Lyndon word they start with.
Groups begin as one per character and are taken in descending order. Every suffix of the group in hand
points at its previous smaller suffix, the nearest one before it in a lower group; suffixes that are pointed
at from the group move behind their fellows, further the more pointers they get. Second phase: the groups
are read from the smallest on; each suffix put in place puts the suffix before it, and the chain of that
one's pointers, at the next free place of their groups.
"""

from __future__ import annotations

from collections import Counter

from clickstack.llm.base import ship_by_value


class Group:
    """``members`` may still list suffixes that have left; ``size`` counts those that have not."""

    __slots__ = ("members", "size", "after", "before", "start")

    def __init__(self, members: list[int]):
        self.members, self.size, self.after, self.before, self.start = members, len(members), None, None, 0


def lyndon_groups(text: list[int]) -> tuple[Group, list[Group], list[int]]:
    """The lowest group (linked to the higher ones), the group of each suffix, its previous smaller suffix."""
    n = len(text)
    by_char: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_char.setdefault(c, []).append(i)
    home: list[Group] = [None] * n  # type: ignore[list-item]
    lowest = highest = None
    for c in sorted(by_char):
        group = Group(by_char[c])
        group.before = highest
        if highest is None:
            lowest = group
        else:
            highest.after = group
        highest = group
        for i in group.members:
            home[i] = group
    previous = [-1] * n
    # hop[i]: where the search goes on from a suffix that was already dealt with; i itself before that.
    hop = list(range(n))
    group = highest
    while group is not None:
        members = group.members
        if group.size < len(members):
            members = group.members = [m for m in members if home[m] is group]
        if len(members) == 1:
            s = members[0]
            j = s - 1
            while j >= 0 and hop[j] != j:
                j = hop[j]
            previous[s] = hop[s] = j
            if j >= 0:
                old = home[j]
                if old.size > 1:
                    old.size -= 1
                    _behind(old, [j], home)
            group = group.before
            continue
        # Members ascend, so their previous smaller suffixes do too.
        pointed = []
        for s in members:
            j = s - 1
            if j >= 0 and hop[j] != j:
                trail = []
                while j >= 0 and hop[j] != j:
                    trail.append(j)
                    j = hop[j]
                for t in trail:
                    hop[t] = j
            previous[s] = hop[s] = j
            if j >= 0:
                pointed.append(j)
        counts = Counter(pointed)
        if len(counts) == len(pointed):
            _step_back(pointed, home)
        else:
            _split(counts, home)
        group = group.before
    return lowest, home, previous


def _behind(old: Group, moved: list[int], home: list[Group]) -> None:
    new = Group(moved)
    new.before, new.after = old, old.after
    if old.after is not None:
        old.after.before = new
    old.after = new
    for m in moved:
        home[m] = new


def _step_back(pointed: list[int], home: list[Group]) -> None:
    """Suffixes with one pointer each, ascending, leave their groups."""
    moved: dict[Group, list[int]] = {}
    for j in pointed:
        old = home[j]
        if old in moved:
            moved[old].append(j)
        else:
            moved[old] = [j]
    for old, leaving in moved.items():
        if len(leaving) < old.size:
            old.size -= len(leaving)
            _behind(old, leaving, home)
        else:
            old.members = leaving


def _split(counts: dict[int, int], home: list[Group]) -> None:
    """Pointed-at suffixes leave their group: those with most pointers first, so that they end up furthest behind."""
    levels: dict[int, dict[int, list[int]]] = {}
    groups: dict[int, Group] = {}
    for j, c in counts.items():
        old = home[j]
        groups[id(old)] = old
        levels.setdefault(c, {}).setdefault(id(old), []).append(j)
    leaving: dict[int, int] = {}
    for level in levels.values():
        for key, moved in level.items():
            leaving[key] = leaving.get(key, 0) + len(moved)
    for key, n in leaving.items():
        old = groups[key]
        if n < old.size:
            old.size -= n
            leaving[key] = 0
    for c in sorted(levels, reverse=True):
        for key, moved in levels[c].items():
            old = groups[key]
            if leaving[key]:  # the whole group leaves: its place goes to the last to be moved
                leaving[key] -= len(moved)
                if not leaving[key]:
                    old.members, old.size = sorted(moved), len(moved)
                    continue
            _behind(old, sorted(moved), home)


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order. Its last item must be the only least one."""
    n = len(text)
    if n == 0:
        return []
    lowest, home, previous = lyndon_groups(text)
    at, group = 0, lowest
    while group is not None:
        group.start = at
        at += group.size
        group = group.after
    order = [0] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    home[n - 1].start += 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            group = home[s]
            order[group.start] = s
            group.start += 1
            s = previous[s]
    return order


ship_by_value(__name__)
