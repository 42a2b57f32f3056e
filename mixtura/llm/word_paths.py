"""Best paths over many words at once, for models whose paths meet at each word's start.

A word's transfer matrix has then one entry, so the scan over a text's words only joins their best
paths. Words of one length are rows of a matrix of characters, and each step of the scan handles all
rows: from every place, pieces grow by one character along a trie. For a BPE model each beginning of
a word has exactly one path of pieces whose neighbours are consistent, so one piece is kept for each
place. What the model says of two neighbours is asked of the lattice once and remembered.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from mixtura.llm.lattice import Lattice

#: Words beyond this length take the lattice's own way, one by one.
LONGEST = 64


class Table:
    """Whole numbers with values, looked up many at once: keys of one bucket lie side by side."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        place = self._bucket(keys)
        order = np.argsort(place, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=1 << self.BITS))])

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        place = self._bucket(keys)
        at, end = self.first[place], self.first[place + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = self.values[here[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class WordPaths:
    def __init__(self, lattice: Lattice, ids: dict[str, int], bytes_of):
        self.lattice, self.bytes_of = lattice, bytes_of
        self.texts = {i: p for p, i in ids.items()}
        self.size = max(self.texts, default=0) + 2
        #: Stands for a character outside the vocabulary, which goes with any neighbour.
        self.other = self.size - 1
        chars = sorted({c for p in ids for c in p})
        self.codes = np.zeros(0x110000, dtype=np.int64)  # 0: outside the vocabulary
        self.codes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        # The trie: a node for each beginning of a piece, edges by (node, character).
        nodes: dict[str, int] = {"": 0}
        for p in ids:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.width = len(chars) + 1
        edges = {nodes[p[:-1]] * self.width + int(self.codes[ord(p[-1])]): n for p, n in nodes.items() if p}
        self.edges = Table(np.array(list(edges), dtype=np.int64), np.array(list(edges.values()), dtype=np.int64))
        self.roots = np.full(self.width, -1, dtype=np.int64)
        self.inner = np.zeros(len(nodes), dtype=bool)
        for edge, end in edges.items():
            self.inner[edge // self.width] = True
            if edge < self.width:
                self.roots[edge] = end
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        for p, i in ids.items():
            if lattice.fits("", p):
                self.piece[nodes[p]] = i
        none = np.zeros(0, dtype=np.int64)
        self.known, self.recent = Table(none, none), (none, none)

    def _fits(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each two neighbours are consistent; a negative ``last`` is a word's start."""
        pair = last * self.size + piece
        free = (last < 0) | (last == self.other)
        ok = np.where(free, 1, -1)
        asked = np.flatnonzero(~free)
        ok[asked] = self.known.find(pair[asked])
        keys, told = self.recent
        new = np.flatnonzero(ok == -1)
        if len(new) and len(keys):
            at = np.minimum(np.searchsorted(keys, pair[new]), len(keys) - 1)
            hit = keys[at] == pair[new]
            ok[new[hit]] = told[at[hit]]
            new = new[~hit]
        if len(new):
            fresh, at = np.unique(pair[new], return_inverse=True)
            answers = np.array([self.lattice.fits(self.texts[p // self.size], self.texts[p % self.size]) for p in fresh.tolist()], dtype=np.int64)
            ok[new] = answers[at]
            keys, told = np.concatenate([keys, fresh]), np.concatenate([told, answers])
            order = np.argsort(keys)
            self.recent = keys[order], told[order]
            if len(keys) > 1000 + len(self.known.keys) // 8:
                self.known = Table(np.concatenate([self.known.keys, keys]), np.concatenate([self.known.values, told]))
                self.recent = keys[:0], told[:0]
        return ok == 1

    def _of_length(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From rows of character codes: the pieces of all rows in order, and their number in each."""
        n, length = chars.shape
        last = np.full((length + 1, n), -2, dtype=np.int64)  # -2: no path ends here
        last[0] = -1
        begin = np.zeros((length + 1, n), dtype=np.int64)
        for at in range(length):
            row = np.flatnonzero(last[at] != -2)
            outside = chars[row, at] == 0
            last[at + 1, row[outside]], begin[at + 1, row[outside]] = self.other, at
            row = row[~outside]
            node = np.zeros(len(row), dtype=np.int64)
            for k in range(at, min(length, at + self.lattice.longest)):
                # One outside has no edge.
                node = self.roots[chars[row, k]] if k == at else self.edges.find(node * self.width + chars[row, k])
                on = np.flatnonzero(node >= 0)
                if not len(on):
                    break
                row, node = row[on], node[on]
                piece = self.piece[node]
                # A beginning of a word that has its path can have no other.
                is_piece = np.flatnonzero((piece >= 0) & (last[k + 1, row] == -2))
                if len(is_piece):
                    is_piece = is_piece[self._fits(last[at, row[is_piece]], piece[is_piece])]
                    last[k + 1, row[is_piece]], begin[k + 1, row[is_piece]] = piece[is_piece], at
                # Only nodes that go on are followed.
                more = np.flatnonzero(self.inner[node])
                row, node = row[more], node[more]
        rows, pieces = [], []
        row, at = np.arange(n), np.full(n, length)
        while len(row):
            rows.append(row)
            pieces.append(last[at, row])
            at = begin[at, row]
            row, at = row[at > 0], at[at > 0]
        rows, pieces = np.concatenate(rows)[::-1], np.concatenate(pieces)[::-1]
        order = np.argsort(rows, kind="stable")
        return pieces[order], np.bincount(rows, minlength=n)

    def paths(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of the best path of each word that this way can take."""
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if 0 < len(w) <= LONGEST:
                by_length[len(w)].append(w)
        out: dict[str, bytes] = {}
        for length, own in by_length.items():
            chars = self.codes[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, length)]
            pieces, counts = self._of_length(chars)
            ends = np.cumsum(counts)
            outside = (chars == 0).any(axis=1)
            for i, (s, e) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                out[own[i]] = self._spelled(own[i], pieces[s:e].tolist()) if outside[i] else pieces[s:e].astype("<u4").tobytes()
        return out

    def _spelled(self, word: str, pieces: list[int]) -> bytes:
        """The ids of a path, those of its characters outside the vocabulary as bytes."""
        ids, at = [], 0
        for p in pieces:
            ids += self.bytes_of(word[at]) if p == self.other else [p]
            at += 1 if p == self.other else len(self.texts[p])
        return np.array(ids, dtype="<u4").tobytes()
