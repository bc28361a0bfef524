"""A balanced-parentheses tree with range min-max excess blocks.

A tree in depth-first order is a bit sequence: 1 opens a node, 0 closes it.
The *excess* of a position is the number of open nodes after it. The bits
are cut into blocks; each block keeps its excess at the start and its lowest
excess, and a min-tree over the blocks finds the first later block that sinks
to a wanted excess. So ``find_close`` reads two blocks and a path of the
tree. ``leaves_before`` is a rank over the pairs "10". All queries take
arrays of positions.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64
_LOT = 8192


class Parens:
    def __init__(self, bits: np.ndarray, leaf: np.ndarray | None = None):
        """``bits``: 0/1 of even length, balanced. ``leaf``: by node, whether its pair "10" counts as a leaf."""
        n = len(bits)
        self.n, self.blocks = n, max(1, -(-n // _BLOCK))
        padded = np.ones(self.blocks * _BLOCK, np.int8)           # padding only rises, so it is never a close
        padded[:n] = 2 * bits.astype(np.int8) - 1
        self.steps = padded.reshape(self.blocks, _BLOCK)
        inside = np.cumsum(self.steps, axis=1, dtype=np.int32)
        self.start = np.concatenate(([0], np.cumsum(inside[:, -1], dtype=np.int64)))[:-1]
        low = self.start + inside.min(axis=1)
        size = 1 << max(0, self.blocks - 1).bit_length()
        self.tree = np.full(2 * size, np.iinfo(np.int64).max)     # the min-tree: node i over 2i and 2i + 1
        self.tree[size:size + self.blocks] = low
        level = size
        while level > 1:
            half = level // 2
            self.tree[half:level] = np.minimum(self.tree[level:2 * level:2], self.tree[level + 1:2 * level:2])
            level = half
        self.size = size
        self.opens = np.flatnonzero(bits == 1)                    # select: the place of every node, in preorder
        pair = np.zeros(n + 1, np.int64)
        if n:
            first = (bits[:-1] == 1) & (bits[1:] == 0)
            if leaf is not None:
                first &= leaf[np.cumsum(bits == 1)[:-1] - 1]
            pair[1:n] = first
        self.pairs = np.cumsum(pair)

    def _first_at(self, block: np.ndarray, after: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """In each block, the first offset beyond ``after`` with an excess of at most ``wanted`` (-1: none)."""
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), _LOT):
            b = block[a:a + _LOT]
            excess = self.start[b][:, None] + np.cumsum(self.steps[b], axis=1, dtype=np.int32)
            hit = (excess <= wanted[a:a + _LOT, None]) & (np.arange(_BLOCK) > after[a:a + _LOT, None])
            out[a:a + _LOT] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        return out

    def excess(self, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), _LOT):
            b, off = at[a:a + _LOT] // _BLOCK, at[a:a + _LOT] % _BLOCK
            inside = np.cumsum(self.steps[b], axis=1, dtype=np.int32)
            out[a:a + _LOT] = self.start[b] + inside[np.arange(len(b)), off]
        return out

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing place of each opening place."""
        wanted, block = self.excess(at) - 1, at // _BLOCK
        found = self._first_at(block, at % _BLOCK, wanted)
        out = block * _BLOCK + found
        left = np.flatnonzero(found < 0)
        if len(left):
            node, want = self.size + block[left], wanted[left]
            up = np.ones(len(left), bool)
            while up.any():                                       # climb until a right neighbour sinks low enough
                i = np.flatnonzero(up)
                right = node[i] % 2 == 0
                done = right & (self.tree[np.minimum(node[i] + 1, len(self.tree) - 1)] <= want[i])
                node[i] = np.where(done, node[i] + 1, node[i] // 2)
                up[i[done]] = False
            while (down := node < self.size).any():               # and down to its first such block
                i = np.flatnonzero(down)
                child = 2 * node[i]
                node[i] = np.where(self.tree[child] <= want[i], child, child + 1)
            block = node - self.size
            out[left] = block * _BLOCK + self._first_at(block, np.full(len(left), -1), want)
        return out

    def leaves_before(self, at: np.ndarray) -> np.ndarray:
        """How many leaf pairs open before each place."""
        return self.pairs[at]


class RangeMin:
    """Minima of ranges [a, b) by a table of power-of-two windows."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a).astype(float))[1] - 1                # floor of log2
        out = np.empty(len(a), self.levels[0].dtype)
        for level in np.unique(k):
            m = k == level
            row = self.levels[level]
            out[m] = np.minimum(row[a[m]], row[b[m] - 2 ** level])
        return out
