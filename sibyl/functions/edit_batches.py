"""Tree edit distance as array programs over many pairs of trees at once.

Pairs of about one size form a block. Within a block, tables of all pairs are filled row by row together: a row of a forest table takes a few
array operations, as runs of insertions are running minima. Trees of a block need not be of one shape; what differs is looked up by
index. A block's tables have at most CELLS cells, or those of a single pair, which are the product of its trees' nodes.
"""

from __future__ import annotations

import numpy as np

#: Cells of a block's table, 8 bytes each; two tables stand at a time.
CELLS = 1 << 21
# Parts of speech whose alignment costs more if asked for, and names of the kinds of edits.
STOP_TAGS = frozenset({"DT", "IN", "TO", "CC", "PRP", "PRP$", "."})
KINDS = ("del", "delLeaf", "ins", "insLeaf", "align", "renPos", "renRel", "renPosRel")


class _Side:
    """One tree of each pair, in postorder and padded: sizes, the first leaf under each node, node numbers, label codes, and starts and ends of the forests to be tabled."""

    def __init__(self, trees: list, codes: list[dict]):
        self.sizes = np.array([len(t) for t in trees], dtype=np.int64)
        width = max(1, int(self.sizes.max(initial=0)))
        self.leaf, self.node = np.zeros((2, len(trees), width), dtype=np.int64)
        self.labels = np.full((3, len(trees), width), -1, dtype=np.int64)
        self.stops = np.zeros((len(trees), width), dtype=bool)
        forests = []
        for p, tree in enumerate(trees):
            order, leaf = _postorder([n["parent"] for n in tree])
            self.node[p, : len(order)], self.leaf[p, : len(order)] = order, leaf
            for x, i in enumerate(order):
                for part, name in enumerate(("lemma", "pos", "rel")):
                    value = tree[i][name] or ""
                    self.labels[part, p, x] = codes[part].setdefault(value, len(codes[part]))
                self.stops[p, x] = tree[i]["pos"] in STOP_TAGS
            last = {start: x for x, start in enumerate(leaf)}
            forests.append([(start, x) for start, x in sorted(last.items(), key=lambda e: e[1]) if start] + [(0, len(leaf) - 1)] * bool(leaf))
        self.counts = np.array([len(f) for f in forests], dtype=np.int64)
        self.forests = np.zeros((len(trees), max(1, int(self.counts.max(initial=0))), 2), dtype=np.int64)
        for p, f in enumerate(forests):
            self.forests[p, : len(f)] = np.array(f, dtype=np.int64).reshape(-1, 2)


def _postorder(parents: list[int]) -> tuple[list[int], list[int]]:
    """Node numbers in postorder, children by number, and the place of the first leaf under each. Nodes that no root reaches raise an error."""
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        children.setdefault(p, []).append(i)
    order, leaf, place = [], [], {}
    stack = [(r, False) for r in reversed(children.get(-1, []))]
    while stack:
        i, done = stack.pop()
        kids = children.get(i, [])
        if done or not kids:
            leaf.append(leaf[place[kids[0]]] if kids else len(order))
            place[i] = len(order)
            order.append(i)
        else:
            stack.append((i, True))
            stack += [(k, False) for k in reversed(kids)]
    if len(order) != len(parents):
        raise ValueError("a tree has a cycle, or a parent that it does not hold")
    return order, leaf


class Pairs:
    """Pairs of trees, each a list of nodes with lemma, pos, rel and parent. Several roots make a forest, which is compared as such; a tree without nodes is allowed.

    Deleting and inserting cost `cost`; nodes of one lemma can be renamed, for 1 for each of part of speech and relation that differs
    (2.5 if stop_words is set and both are stop words); others never.
    """

    def __init__(self, first: list, second: list, cost: float = 3.0, stop_words: bool = False):
        self.first, self.second, self.cost, self.stop_words = first, second, cost, stop_words
        self._sizes = np.array([(len(a), len(b)) for a, b in zip(first, second, strict=True)], dtype=np.int64).reshape(-1, 2)

    def nodes(self) -> np.ndarray:
        return self._sizes.sum(axis=1)

    def distances(self) -> np.ndarray:
        out = np.zeros(len(self.first))
        for which, block in self._blocks():
            out[which] = block.fill()
        return out

    def scripts(self) -> list[list[dict]]:
        """The edits of each pair, by place in the first tree, then in the second."""
        out: list[list[dict]] = [[] for _ in self.first]
        for which, block in self._blocks():
            block.fill()
            for p, edit in block.edits():
                out[which[p]].append(edit)
        return out

    def _blocks(self):
        """(numbers of pairs, block), pairs of like size together."""
        order = np.lexsort((self._sizes[:, 1], self._sizes[:, 0]))
        start = 0
        while start < len(order):
            stop, wide, high = start, 0, 0
            while stop < len(order):
                w, h = max(wide, self._sizes[order[stop], 0] + 1), max(high, self._sizes[order[stop], 1] + 1)
                if stop > start and (stop - start + 1) * w * h > CELLS:
                    break
                stop, wide, high = stop + 1, w, h
            which = order[start:stop]
            codes: list[dict] = [{}, {}, {}]
            yield which, _Block(_Side([self.first[i] for i in which], codes), _Side([self.second[i] for i in which], codes), self.cost, self.stop_words)
            start = stop


class _Block:
    def __init__(self, a: _Side, b: _Side, cost: float, stop_words: bool):
        self.a, self.b, self.cost, self.stop_words = a, b, cost, stop_words
        self.trees = np.zeros((len(a.sizes), a.leaf.shape[1], b.leaf.shape[1]))

    def fill(self) -> np.ndarray:
        """Distances of all pairs; distances of their subtrees stay in `trees`."""
        out = self.cost * (self.a.sizes + self.b.sizes).astype(float)
        for i in range(self.a.forests.shape[1]):
            for j in range(self.b.forests.shape[1]):
                p = np.flatnonzero((self.a.counts > i) & (self.b.counts > j))
                if len(p):
                    (a0, x), (b0, y) = self.a.forests[p, i].T, self.b.forests[p, j].T
                    table = self._table(p, a0, x, b0, y, keep=True)
                    end = np.flatnonzero((self.a.counts[p] == i + 1) & (self.b.counts[p] == j + 1))
                    out[p[end]] = table[end, self.a.sizes[p[end]], self.b.sizes[p[end]]]
        return out

    def _renamed(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Costs of renaming nodes x to nodes y (as many rows as pairs) of pairs p."""
        lemma, pos, rel = (self.a.labels[k, p, x][:, None] != self.b.labels[k, p[:, None], y] for k in range(3))
        out = pos.astype(float) + rel
        if self.stop_words:
            out = np.where(self.a.stops[p, x][:, None] & self.b.stops[p[:, None], y], 2.5, out)
        return np.where(lemma, np.inf, out)

    def _table(self, p: np.ndarray, a0: np.ndarray, x: np.ndarray, b0: np.ndarray, y: np.ndarray, keep: bool = False) -> np.ndarray:
        """Distances of all beginnings of forests a0..x and b0..y of pairs p. keep: whole subtrees among them are noted."""
        high, wide = x - a0 + 1, y - b0 + 1
        rows, columns = int(high.max(initial=0)), int(wide.max(initial=0))
        steps = self.cost * np.arange(columns + 1)
        table = np.empty((len(p), rows + 1, columns + 1))
        table[:, :, 0] = self.cost * np.arange(rows + 1)
        table[:, 0, :] = steps
        if not columns:
            return table
        each = np.arange(len(p))[:, None]
        ys = np.minimum(b0[:, None] + np.arange(columns), self.b.leaf.shape[1] - 1)
        back = np.clip(self.b.leaf[p[:, None], ys] - b0[:, None], 0, columns)
        inside = np.arange(columns) < wide[:, None]
        for u in range(1, rows + 1):
            xs = np.minimum(a0 + u - 1, self.a.leaf.shape[1] - 1)
            up = np.clip(self.a.leaf[p, xs] - a0, 0, u - 1)
            whole = (up == 0)[:, None] & (back == 0)
            before = table[:, u - 1]
            joined = table[each, up[:, None], back] + self.trees[p[:, None], xs[:, None], ys]
            best = np.minimum(before[:, 1:] + self.cost, np.where(whole, before[:, :-1] + self._renamed(p, xs, ys), joined))
            row = np.concatenate([table[:, u, :1], best], axis=1) - steps
            table[:, u] = np.minimum.accumulate(row, axis=1) + steps
            if keep:
                k, v = np.nonzero(whole & inside & (u <= high)[:, None])
                self.trees[p[k], xs[k], ys[k, v]] = table[k, u, v + 1]
        return table

    def edits(self):
        """(pair, edit) of all pairs, by pair and place. All pairs walk back through their tables together; subtrees that are met on the way are walked in the next round, in tables made anew."""
        p = np.arange(len(self.a.sizes))
        zero = np.zeros(len(p), dtype=np.int64)
        todo = (p, zero, self.a.sizes - 1, zero, self.b.sizes - 1)
        found = []
        while len(todo[0]):
            parts = self._parts(todo)
            later = []
            for part in parts:
                later.append(self._walk(part, found))
            todo = tuple(np.concatenate(c) for c in zip(*later, strict=True))
        if not found:
            return
        p, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        tops = _tops(self.a, p[y < 0], x[y < 0]), _tops(self.b, p[x < 0], y[x < 0])
        for k in np.lexsort((y, x, p)):
            yield int(p[k]), self._edit(int(p[k]), int(x[k]), int(y[k]), tops)

    def _parts(self, todo: tuple):
        """Walks in lots whose tables have at most CELLS cells, like sizes together."""
        p, a0, x, b0, y = todo
        high, wide = x - a0 + 2, y - b0 + 2
        order = np.lexsort((wide, high))
        out, lot, w, h = [], [], 0, 0
        for k in order:
            w, h = max(w, wide[k]), max(h, high[k])
            if lot and (len(lot) + 1) * w * h > CELLS:
                out.append(lot)
                lot, w, h = [], wide[k], high[k]
            lot.append(k)
        return [tuple(c[np.array(lot)] for c in todo) for lot in [*out, lot]]

    def _walk(self, todo: tuple, found: list) -> tuple:
        p, a0, x, b0, y = todo
        table = self._table(p, a0, x, b0, y)
        u, v = x - a0 + 1, y - b0 + 1
        later = []
        k = np.flatnonzero((u > 0) | (v > 0))
        while len(k):
            here = table[k, u[k], v[k]] - self.cost
            deleted = (u[k] > 0) & np.isclose(table[k, np.maximum(u[k] - 1, 0), v[k]], here)
            inserted = ~deleted & (v[k] > 0) & np.isclose(table[k, u[k], np.maximum(v[k] - 1, 0)], here)
            d, i, r = k[deleted], k[inserted], k[~deleted & ~inserted]
            found.append((p[d], a0[d] + u[d] - 1, np.full(len(d), -1)))
            found.append((p[i], np.full(len(i), -1), b0[i] + v[i] - 1))
            u[d] -= 1
            v[i] -= 1
            xs, ys = a0[r] + u[r] - 1, b0[r] + v[r] - 1
            la, lb = self.a.leaf[p[r], xs], self.b.leaf[p[r], ys]
            same = (la == a0[r]) & (lb == b0[r])
            found.append((p[r[same]], xs[same], ys[same]))
            later.append((p[r[~same]], la[~same], xs[~same], lb[~same], ys[~same]))
            u[r], v[r] = la - a0[r], lb - b0[r]
            u[r[same]] = xs[same] - a0[r[same]]
            v[r[same]] = ys[same] - b0[r[same]]
            k = k[(u[k] > 0) | (v[k] > 0)]
        empty = (np.zeros(0, dtype=np.int64),) * 5
        return tuple(np.concatenate(c) for c in zip(empty, *later, strict=True))

    def _edit(self, p: int, x: int, y: int, tops: tuple[np.ndarray, np.ndarray]) -> dict:
        a, b = self.a, self.b
        top, first = False, -1
        if y < 0:
            kind, name = "DEL", "delLeaf" if a.leaf[p, x] == x else "del"
            top, first = bool(tops[0][p, x]), int(a.leaf[p, x])
        elif x < 0:
            kind, name = "INS", "insLeaf" if b.leaf[p, y] == y else "ins"
            top, first = bool(tops[1][p, y]), int(b.leaf[p, y])
        else:
            pos, rel = (a.labels[k, p, x] != b.labels[k, p, y] for k in (1, 2))
            kind, name = "REN", ("renPosRel" if rel else "renPos") if pos else ("renRel" if rel else "align")
        words = int(a.node[p, x]) if x >= 0 else -1, int(b.node[p, y]) if y >= 0 else -1
        return {"type": kind, "a": x, "b": y, "word_a": words[0], "word_b": words[1], "kind": name, "subtree": top, "first": first}


def _tops(side: _Side, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Nodes whose whole subtree, of two nodes or more, is among the given ones, without those inside a larger such subtree."""
    given = np.zeros(side.leaf.shape, dtype=np.int64)
    given[p, x] = 1
    total = np.concatenate([np.zeros((len(given), 1), dtype=np.int64), np.cumsum(given, axis=1)], axis=1)
    places = np.arange(given.shape[1])
    size = places - side.leaf + 1
    rows = np.arange(len(given))[:, None]
    whole = (total[:, 1:] - total[rows, side.leaf] == size) & (size > 1) & (places < side.sizes[:, None])
    least = np.where(whole, side.leaf, given.shape[1])
    above = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]
    return whole & (np.concatenate([above[:, 1:], np.full((len(given), 1), given.shape[1])], axis=1) > places)
