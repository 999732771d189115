"""Minimum-cost pairing of rows by the number of fields in which they differ."""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Iterator, MutableSequence, Sequence

import numpy as np

Codes = Sequence[tuple]
#: How many numbers of a stored column are in memory at once.
BLOCK = 1_000_000


class _Flow:
    """A network with whole capacities and costs; arc ``a`` and its reverse ``a ^ 1`` lie side by side."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def numbers(self, n: int, fill: int) -> MutableSequence[int]:
        return [fill] * n

    def arc(self, u: int, v: int, cap: int, cost: int) -> None:
        for a, b, c, w in ((u, v, cap, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(w)

    def run(self, source: int, sink: int) -> None:
        """The greatest flow of least cost.

        Primal-dual: shortest distances under potentials, then blocking flows
        over the arcs of no reduced cost. Costs are small whole numbers, so
        that few distances occur.
        """
        n, to, cap, cost = len(self.out), self.to, self.cap, self.cost
        price = self.numbers(n, 0)
        while True:
            dist = self.numbers(n, -1)
            dist[source] = 0
            # nodes by the distance at which they were reached; those reached again at a smaller one are passed over
            reached = {0: array("q", [source])}
            while reached:
                d = min(reached)
                if 0 <= dist[sink] < d:
                    break
                now = reached[d]
                for u in now:
                    if dist[u] != d:
                        continue
                    for a in self.out[u]:
                        if cap[a]:
                            v = to[a]
                            e = d + cost[a] + price[u] - price[v]
                            if dist[v] < 0 or e < dist[v]:
                                dist[v] = e
                                reached.setdefault(e, array("q")).append(v)
                del reached[d]
            far = dist[sink]
            if far < 0:
                return
            for u in range(n):
                price[u] += far if dist[u] < 0 else min(dist[u], far)
            while self._block(source, sink, price):
                pass

    def pairs(self, nl: int, nr: int) -> Iterator[tuple[int, int, int]]:
        """What flows from the left rows, the first nodes, to the right ones, the next."""
        out, to, cap, source = self.out, self.to, self.cap, nl + nr
        for i in range(nl):
            for a in out[i]:
                if not a & 1 and to[a] < source and cap[a ^ 1]:
                    yield i, to[a] - nl, cap[a ^ 1]
        for node in range(source + 2, len(out)):
            # what passes through is taken apart: any of its ways in goes with any of its ways out
            into = ((to[a], cap[a]) for a in out[node] if a & 1 and cap[a])
            have = 0
            for a in out[node]:
                n = 0 if a & 1 else cap[a ^ 1]
                while n:
                    if not have:
                        i, have = next(into)
                    take = min(n, have)
                    yield i, to[a] - nl, take
                    n, have = n - take, have - take

    def _block(self, source: int, sink: int, price: Sequence[int]) -> bool:
        out, to, cap, cost = self.out, self.to, self.cap, self.cost
        level, queue = self.numbers(len(out), -1), self.numbers(len(out), 0)
        level[source], queue[0], first, last = 0, source, 0, 1
        while first < last and level[sink] < 0:
            u = queue[first]
            first += 1
            for a in out[u]:
                v = to[a]
                if cap[a] and level[v] < 0 and cost[a] + price[u] == price[v]:
                    level[v] = level[u] + 1
                    queue[last] = v
                    last += 1
        if level[sink] < 0:
            return False
        at, path, u = self.numbers(len(out), 0), [], source
        while True:
            if u == sink:
                push = min(cap[a] for a in path)
                for a in path:
                    cap[a] -= push
                    cap[a ^ 1] += push
                cut = next(i for i, a in enumerate(path) if not cap[a])
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs = out[u]
            while at[u] < len(arcs):
                a = arcs[at[u]]
                if cap[a] and level[to[a]] == level[u] + 1 and cost[a] + price[u] == price[to[a]]:
                    path.append(a)
                    u = to[a]
                    break
                at[u] += 1
            else:
                if u == source:
                    return True
                a = path.pop()
                u = to[a ^ 1]
                at[u] += 1


def cheapest_transport(left: Codes, left_n: Sequence[int], right: Codes, right_n: Sequence[int]) -> list[tuple[int, int, int]]:
    """``(row, row, how many)``: pairs of distinct rows with multiplicities that cover the smaller side at least cost.

    A pair costs the number of fields in which its rows differ. Rows are
    joined by way of the combinations of values they agree in: a path through
    a combination of k fields costs all fields but k, so that the least path
    between two rows costs what they differ in, and the network has at most
    2^fields arcs for a row. Where there are few rows each pair has its arc.
    """
    if not left or not right:
        return []
    fields, nl, nr = len(left[0]), len(left), len(right)
    arcs, source, sink = [], nl + nr, nl + nr + 1
    nodes = sink + 1
    if nl * nr <= (nl + nr) * (2**fields - 1):
        arcs = [(i, nl + j, sum(x != y for x, y in zip(a, b, strict=True))) for i, a in enumerate(left) for j, b in enumerate(right)]
    else:
        # in the order of StoredTransport, so that either takes the same of several pairings of one cost
        for some in range(2**fields - 1):
            agreed, have = [f for f in range(fields) if some >> f & 1], {}
            for side, rows in enumerate((left, right)):
                for i, row in enumerate(rows):
                    have.setdefault(tuple(row[f] for f in agreed), ([], []))[side].append(i)
            for l, r in have.values():
                if l and r:
                    arcs += [(i, nodes, fields - len(agreed)) for i in l] + [(nodes, nl + j, 0) for j in r]
                    nodes += 1
    flow, most = _Flow(nodes), min(sum(left_n), sum(right_n))
    for u, v, c in arcs:
        flow.arc(u, v, most, c)
    for i, m in enumerate(left_n):
        flow.arc(source, i, m, 0)
    for j, m in enumerate(right_n):
        flow.arc(nl + j, sink, m, 0)
    flow.run(source, sink)
    return list(flow.pairs(nl, nr))


def _scratch() -> object:
    """A file without a name, where Spark keeps the worker's other files."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


class _Column:
    """Whole numbers in a file: appended in blocks, then read in place."""

    def __init__(self) -> None:
        self.file, self.n = _scratch(), 0

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, np.int64).tobytes())
        self.n += len(values)

    def array(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, np.int64, "r+", shape=(self.n,)) if self.n else np.zeros(0, np.int64)


def _filled(n: int, fill: int) -> np.ndarray:
    at = np.memmap(_scratch(), np.int64, "w+", shape=(n,))
    if fill:
        at.fill(fill)
    return at


def _blocks(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + BLOCK)) for i in range(0, n, BLOCK))


class _Slices:
    """The arcs of each node, one node's after another's."""

    def __init__(self, start: np.ndarray, arcs: np.ndarray) -> None:
        self.start, self.arcs = memoryview(start), memoryview(arcs)

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, u: int) -> Sequence[int]:
        return self.arcs[self.start[u] : self.start[u + 1]]


class StoredTransport(_Flow):
    """:func:`cheapest_transport` for a network of any size: it lies in files, of which the system keeps in memory what fits.

    Rows, and what joins them, are given in blocks: the rows of either side in
    order of their numbers; pairs with their costs, or combinations of values
    with the rows that have them, those of a combination one after another.
    """

    def __init__(self) -> None:
        self.rows = [(_Column(), _Column()) for _ in "lr"]
        self.joined, self.members = [_Column() for _ in "lrc"], [_Column() for _ in "gsrc"]

    def numbers(self, n: int, fill: int) -> MutableSequence[int]:
        return memoryview(_filled(n, fill))

    def add_rows(self, side: np.ndarray, row: np.ndarray, n: np.ndarray) -> None:
        for s, (rows, many) in enumerate(self.rows):
            rows.add(row[side == s])
            many.add(n[side == s])

    def add_pairs(self, left: np.ndarray, right: np.ndarray, cost: np.ndarray) -> None:
        for column, values in zip(self.joined, (left, right, cost), strict=True):
            column.add(values)

    def add_members(self, group: np.ndarray, side: np.ndarray, row: np.ndarray, cost: np.ndarray) -> None:
        for column, values in zip(self.members, (group, side, row, cost), strict=True):
            column.add(values)

    def _build(self) -> None:
        (left, left_n), (right, right_n) = ([c.array() for c in columns] for columns in self.rows)
        nl, nr = self.sizes = len(left), len(right)
        base, most = nl + nr + 2, min(int(left_n.sum()), int(right_n.sum()))
        to, cap, cost = (_Column() for _ in range(3))

        def arcs(u: np.ndarray, v: np.ndarray, most: object, price: object) -> None:
            none = np.zeros(len(u), np.int64)
            for column, there, back in ((to, v, u), (cap, none + most, none), (cost, none + price, none - price)):
                column.add(np.column_stack([there, back]).ravel())

        l, r, c = (x.array() for x in self.joined)
        for b in _blocks(len(l)):
            arcs(np.searchsorted(left, l[b]), nl + np.searchsorted(right, r[b]), most, c[b])
        group, side, row, c = (x.array() for x in self.members)
        groups = int(group[-1]) + 1 if len(group) else 0
        if groups:
            # a combination that one side only has joins nothing
            has = [_filled(groups, 0) for _ in "lr"]
            for b in _blocks(len(group)):
                for s in (0, 1):
                    has[s][group[b][side[b] == s]] = 1
            node, n = _filled(groups, 0), 0
            for b in _blocks(groups):
                both = has[0][b] & has[1][b]
                node[b] = np.where(both, n + np.cumsum(both) - 1, -1)
                n += int(both.sum())
            for b in _blocks(len(group)):
                at, lies = node[group[b]], side[b] == 0
                x, y = (at >= 0) & lies, (at >= 0) & ~lies
                arcs(np.searchsorted(left, row[b][x]), base + at[x], most, c[b][x])
                arcs(base + at[y], nl + np.searchsorted(right, row[b][y]), most, 0)
            nodes = base + n
        else:
            nodes = base
        for b in _blocks(nl):
            i = np.arange(b.start, b.stop)
            arcs(np.full(len(i), base - 2), i, left_n[b], 0)
        for b in _blocks(nr):
            j = nl + np.arange(b.start, b.stop)
            arcs(j, np.full(len(j), base - 1), right_n[b], 0)
        ends = to.array()
        # the arcs from each node, in the order in which they were made
        start = _filled(nodes + 1, 0)
        for b in _blocks(len(ends)):
            np.add.at(start, ends[b] + 1, 1)
        for b in _blocks(nodes):
            start[b.start + 1 : b.stop + 1] = start[b.start] + np.cumsum(start[b.start + 1 : b.stop + 1])
        free, order = _filled(nodes, 0), _filled(len(ends), 0)
        free[:] = start[:-1]
        for b in _blocks(len(ends)):
            arc = np.arange(b.start, b.stop)
            tail = ends[arc ^ 1]
            by = np.argsort(tail, kind="stable")
            own, first, many = np.unique(tail[by], return_index=True, return_counts=True)
            order[np.repeat(free[own], many) + np.arange(len(by)) - np.repeat(first, many)] = arc[by]
            free[own] += many
        self.left, self.right = memoryview(left), memoryview(right)
        self.out, self.to, self.cap, self.cost = _Slices(start, order), *(memoryview(x) for x in (ends, cap.array(), cost.array()))

    def solve(self) -> Iterator[tuple[int, int, int]]:
        """``(left row, right row, how many)``, covering the smaller side at least cost."""
        if not self.rows[0][0].n or not self.rows[1][0].n:
            return
        self._build()
        nl, nr = self.sizes
        self.run(nl + nr, nl + nr + 1)
        for i, j, n in self.pairs(nl, nr):
            yield self.left[i], self.right[j], n
