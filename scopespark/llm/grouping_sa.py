"""Linear suffix sorting by grouping (after Baier, 2016).

Phase 1 handles groups of suffixes from the highest down.  Each suffix of the group points to the
nearest smaller group before it; the suffixes pointed at move into new groups right behind their old
ones, ordered by how often they were pointed at.  In the end a group holds the suffixes with one
Lyndon prefix.  Phase 2 walks the suffix array from the left and lets each suffix place its
predecessor chain at the front of the respective group.  Nothing is renamed recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Suffix array of a string that ends with its unique smallest symbol."""
    n = len(text)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    # a group is named by its first slot: size[g] and members[g] belong to it, group[i] is the one of suffix i
    group, size, members, at = [0] * n, [0] * n, [None] * n, 0
    for c in sorted(places):
        own = places[c]
        size[at], members[at] = len(own), set(own)
        for i in own:
            group[i] = at
        at += len(own)
    jump = list(range(-1, n - 1))  # nearest suffix before that may be of a smaller group
    high = n
    while high > 0:
        g = high - 1
        while not size[g]:
            g -= 1
        high, own = g, members[g]
        if len(own) == 1:  # one pointer, one move
            (i,) = own
            j = jump[i]
            while j >= 0 and group[j] >= g:
                j = jump[j]
            jump[i] = j
            if j >= 0 and size[h := group[j]] > 1:
                size[h] -= 1
                new = h + size[h]
                size[new], members[new], group[j] = 1, {j}, new
                members[h].remove(j)
            continue
        points: dict[int, int] = {}
        for i in own:
            j = jump[i]
            while j >= 0 and group[j] >= g:
                j = jump[j]
            jump[i] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in points.items():
            moves.setdefault((group[j], -k), []).append(j)
        # most pointed at first: these go to the end of their group's slots
        for key in sorted(moves, key=_times) if len(moves) > 1 else moves:
            h, moved = key[0], moves[key]
            left = size[h] - len(moved)
            if left:  # else the whole group stands where it would move to
                new = h + left
                size[h], size[new], members[new] = left, len(moved), set(moved)
                members[h].difference_update(moved)
                for j in moved:
                    group[j] = new
    # phase 2: jump holds the pointers of phase 1, front the next free slot of each group
    sa, placed, front = [-1] * n, bytearray(n), list(range(n))
    sa[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = jump[j]
    return sa


def _times(move: tuple[int, int]) -> int:
    return move[1]
