"""The paths of pieces over a text, as max-plus transfer between chunk boundaries.

A state at a boundary is the piece that covers or ends at it: how many characters of the next chunk
it takes, and the piece itself. A chunk's transfer matrix gives, for each state at its start and
each at its end, the weight of the best path between them. Matrices combine by max and plus, which
is associative.

For a unigram model a path weighs the sum of its piece scores. For a BPE model a path weighs 0 if
each piece and each two neighbours are what the merges make of their own characters, and does not
exist otherwise; such a path is the merges' result for the whole text, and there is one only.
"""

from __future__ import annotations

State = tuple[int, str]
Matrix = dict[State, dict[State, float]]
SPACE = "▁"


class Lattice:
    def __init__(self, pieces: dict[str, float], bpe: bool):
        self.pieces, self.bpe = pieces, bpe
        self.longest = max(map(len, pieces), default=1)
        #: No piece crosses from another character to a space mark, so paths meet at each word's start.
        self.words = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self._alone: dict[str, bool] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def merges(self, text: str) -> list[str]:
        """What BPE makes of a short string: the best-scored pair is merged first, the leftmost of equals."""
        parts, score = list(text), self.pieces.get
        pairs = [score(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, i = None, -1
            for k, v in enumerate(pairs):
                if v is not None and (best is None or v > best):
                    best, i = v, k
            if i < 0:
                return parts
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1])
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i])

    def fits(self, last: str, piece: str) -> bool:
        """Whether a piece, after ``last`` if that is not empty, is what the merges make."""
        if not self.bpe:
            return True
        if (ok := self._alone.get(piece)) is None:
            ok = self._alone[piece] = self.merges(piece) == [piece]
        if not ok or not last:
            return ok
        if (ok := self._pairs.get((last, piece))) is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            ok = self._pairs[last, piece] = self.merges(last + piece) == [last, piece]
        return ok

    def _weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.pieces.get(piece, self.unknown)

    def paths(self, text: str, start: int, last: str, stop: int) -> dict[int, tuple[float, int, str]]:
        """For each end that pieces beginning before ``stop`` can reach: best weight, start of the
        last piece, that piece."""
        best: dict[int, tuple[float, int, str]] = {start: (0.0, -1, last)}
        for at in range(start, stop):
            if at not in best:
                continue
            total, _, before = best[at]
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                piece = text[at:end]
                if (end == at + 1 or piece in self.pieces) and self.fits(before, piece):
                    w = total + self._weight(piece)
                    if end not in best or w > best[end][0]:
                        best[end] = (w, at, piece)
        return best

    def trace(self, best: dict[int, tuple[float, int, str]], end: int) -> list[str]:
        out = []
        while best[end][1] >= 0:
            _, at, piece = best[end]
            out.append(piece)
            end = at
        return out[::-1]

    def state(self, ahead: int, piece: str) -> State:
        return ahead, piece if self.bpe else ""

    def entries(self, behind: str, text: str) -> list[State]:
        """The states that a chunk may begin in; ``behind`` is the text before it."""
        out = {}
        for back in range(1, min(len(behind), self.longest) + 1):
            for ahead in range(0, min(len(text), self.longest - back) + 1):
                piece = behind[len(behind) - back :] + text[:ahead]
                if len(piece) == 1 or piece in self.pieces:
                    out[self.state(ahead, piece)] = None
        return list(out)

    def cuts(self, behind: str, text: str, size: int) -> tuple[int, int] | None:
        """Where the first and the last word of a chunk begin."""
        if not self.words:
            return None
        begins = lambda i: text[i] == SPACE and (text[i - 1] if i else behind[-1:]) not in ("", SPACE)
        first = next((i for i in range(size) if begins(i)), None)
        return None if first is None else (first, next(i for i in range(size - 1, -1, -1) if begins(i)))

    def transfer(self, behind: str, text: str, size: int, weigh) -> Matrix:
        """The matrix of the chunk ``text[:size]``; what follows is the text ahead. ``weigh`` gives the
        weight of whole words."""
        starts = self.entries(behind, text) if behind else [(0, "")]
        cut = self.cuts(behind, text, size)
        exits = lambda best: {self.state(e - size, p): w for e, (w, at, p) in best.items() if e >= size and 0 <= at < size}
        out: Matrix = {}
        if cut is None:
            for s in starts:
                if s[0] >= size:
                    out[s] = {(s[0] - size, s[1]): 0.0}
                else:
                    out[s] = exits(self.paths(text, s[0], s[1], size))
            return out
        tail = exits(self.paths(text, cut[1], "", size))
        middle = weigh(text[cut[0] : cut[1]])
        for s in starts:
            if s[0] <= cut[0]:
                head = self.paths(text[: cut[0]], s[0], s[1], cut[0])
                if cut[0] in head:
                    out[s] = {e: head[cut[0]][0] + middle + w for e, w in tail.items()}
        return out

    def backtrace(self, behind: str, text: str, size: int, entry: State, exit_: State, encode) -> list:
        """The pieces of a chunk from one state to another; whole words by ``encode``."""
        if entry[0] >= size:
            return []
        cut = self.cuts(behind, text, size)

        def ends_at(best: dict, at: int) -> list[str]:
            return self.trace(best, at)

        if cut is None:
            return [ends_at(self.paths(text, *entry, size), size + exit_[0])]
        head = self.paths(text[: cut[0]], *entry, cut[0])
        return [ends_at(head, cut[0]), encode(text[cut[0] : cut[1]]), ends_at(self.paths(text, cut[1], "", size), size + exit_[0])]


def product(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for s, row in x.items():
        best: dict[State, float] = {}
        for mid, w in row.items():
            for e, v in y.get(mid, {}).items():
                if e not in best or w + v > best[e]:
                    best[e] = w + v
        if best:
            out[s] = best
    return out


def best_states(matrices: list[Matrix], start: State, end: State) -> list[State]:
    """The states before, between and after the matrices on the best path from start to end."""
    reach: list[dict[State, tuple[float, State | None]]] = [{start: (0.0, None)}]
    for m in matrices:
        new: dict[State, tuple[float, State | None]] = {}
        for s, (w, _) in reach[-1].items():
            for e, v in m.get(s, {}).items():
                if e not in new or w + v > new[e][0]:
                    new[e] = (w + v, s)
        reach.append(new)
    states = [end]
    for step in reversed(reach[1:]):
        states.append(step[states[-1]][1])
    return states[::-1]
