"""Cheapest repair of a conversation's roles: bidirectional Dijkstra over the lattice of edits.

A node is (rows read, state). States stand for the initials so far: 0 nothing, 1 after the system row,
2 after user, 3 after assistant; ends are 0 and 3, so what is left reads ``(s?(ua)+)?``. A row's code is
its role's initial (s, u, a, x for any other), a capital if its text is truncated, or - if it must go.
In any state just one of user and assistant may follow, so an audit tells the whole repair.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

#: What may follow in each state beside the system row, and where each letter leads.
NEXT = "uuau"
TO = {"s": 1, "u": 2, "a": 3}
#: The price of each edit.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = (0, 3)


def _moves(code: str, state: int) -> list[tuple[int, str, int]]:
    """(price, edit, next state) of what may be done with the next row."""
    if code == "-":
        return [(DELETE, "D", state)]
    worn = TRUNCATED if code.isupper() else 0
    out = [(DELETE, "D", state), (REROLE + worn, "R", TO[NEXT[state]])]
    role = code.lower()
    if role == NEXT[state] or (role == "s" and state == 0):
        out.append((worn, "K", TO[role]))
    return out


class _Side:
    """One of the two searches: a heap by (cost, rows gone, audit), so that of equal costs a node's
    least audit comes out first: edits that cost nothing always go on by a row."""

    def __init__(self, starts: list[tuple[int, int]]):
        self.heap = [(0, 0, "", *x) for x in starts]
        self.settled: dict[tuple[int, int], tuple[int, str]] = {}

    def top(self) -> float:
        while self.heap and self.heap[0][3:] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")


def cheapest(codes: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, ASCII-least audit of that cost) of getting from ``start`` before the first row to one of
    ``ends`` after the last, or None if there is no way.

    Both searches go on until their heaps' tops together cost more than the best way found; by then every
    way of the least cost has an edge from a node settled forwards to one settled backwards. Two audits of
    one cost between the same nodes are never each other's prefix, so the least one of the whole is made
    of least ones of its halves.
    """
    n = len(codes)
    ahead, back = _Side([(0, start)]), _Side([(n, q) for q in ends])
    best, crossings = float("inf"), []
    forward: dict[tuple[int, int], list] = {}
    reverse: dict[int, list[list[tuple[int, str, int]]]] = {}

    def out(i: int, q: int) -> list[tuple[int, str, int, int]]:
        if (i, q) not in forward:
            forward[i, q] = [(INSERT, "I", i, TO[NEXT[q]])] + ([(w, e, i + 1, to) for w, e, to in _moves(codes[i], q)] if i < n else [])
        return forward[i, q]

    def into(i: int, q: int) -> list[tuple[int, str, int, int]]:
        if i not in reverse:
            reverse[i] = [[] for _ in range(4)]
            for j in (i - 1, i):
                if j >= 0:
                    for p in range(4):
                        for w, e, at, to in out(j, p):
                            if at == i:
                                reverse[i][to].append((w, e, j, p))
        return reverse[i][q]

    while min(ahead.top(), back.top()) < float("inf") and ahead.top() + back.top() <= best:
        side, other, forwards = (ahead, back, True) if ahead.top() <= back.top() else (back, ahead, False)
        cost, gone, audit, i, q = heapq.heappop(side.heap)
        side.settled[i, q] = (cost, audit)
        if (i, q) in other.settled:
            c, rest = other.settled[i, q]
            best = min(best, cost + c)
            crossings.append((cost + c, audit + rest if forwards else rest + audit))
        for w, e, j, p in out(i, q) if forwards else into(i, q):
            if (j, p) in other.settled:
                c, rest = other.settled[j, p]
                best = min(best, cost + w + c)
                crossings.append((cost + w + c, audit + e + rest if forwards else rest + e + audit))
            if (j, p) not in side.settled:
                heapq.heappush(side.heap, (cost + w, gone + abs(j - i), audit + e if forwards else e + audit, j, p))
    return min(crossings, default=None)


@lru_cache(100_000)
def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; deleting all rows is always a way."""
    return cheapest(codes, 0, ENDS)


def transfers(codes: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of every way through a stretch of a conversation."""
    found = [(p, q, cheapest(codes, p, (q,))) for p in range(4) for q in range(4)]
    return [(p, q, *x) for p, q, x in found if x]


def join(left: list[tuple[int, int, int, str]], right: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The transfers of two stretches in a row: an associative min-plus product."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for p, m, c, a in left:
        for k, q, d, b in right:
            if k == m and ((p, q) not in best or (c + d, a + b) < best[p, q]):
                best[p, q] = (c + d, a + b)
    return [(p, q, *x) for (p, q), x in best.items()]


def steps(codes: str, audit: str) -> list[str]:
    """For each row, the initials inserted before it and then K, D, U or A (rerole to user, assistant);
    one more for what is inserted at the end."""
    out, before, state, i = [], "", 0, 0
    for e in audit:
        if e == "I":
            before += NEXT[state]
            state = TO[NEXT[state]]
            continue
        code, i = codes[i].lower(), i + 1
        if e == "R":
            out.append(before + NEXT[state].upper())
            state = TO[NEXT[state]]
        else:
            out.append(before + e)
            state = state if e == "D" else TO[code]
        before = ""
    return [*out, before]
