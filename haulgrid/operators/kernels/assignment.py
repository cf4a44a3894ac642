"""Balanced assignment: transportation flow, branch and bound, heuristics, matching."""

from __future__ import annotations

import heapq
import time

import numpy as np

FAR = 1e12


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.hypot(points[:, None, 0] - centers[None, :, 0], points[:, None, 1] - centers[None, :, 1])


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return distances(points, centers).argmin(1)


def _paths(flow: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest ways to pass load between districts: all pairs over 'move a unit from a to b'."""
    n, k = cost.shape
    step = np.full((k, k), np.inf)
    mover = np.zeros((k, k), int)
    for a in range(k):
        has = np.flatnonzero(flow[:, a] > 1e-9)
        if len(has):
            gap = cost[has] - cost[has, a][:, None]
            best = gap.argmin(0)
            step[a], mover[a] = gap[best, np.arange(k)], has[best]
    np.fill_diagonal(step, 0.0)
    dist, nxt = step.copy(), np.tile(np.arange(k), (k, 1))
    for via in range(k):
        new = dist[:, via][:, None] + dist[via][None, :]
        better = new < dist - 1e-9
        dist[better] = new[better]
        nxt[better] = np.broadcast_to(nxt[:, via][:, None], (k, k))[better]
    return dist, nxt, mover


class _Tree:
    """Dual network simplex of a transport problem: units and districts are nodes, and a root takes
    each district's load over an arc of bounds [lo, hi].

    A spanning tree carries the flow; the arc of a node is the one to its parent. The first tree puts
    each unit at its cheapest district, which is the optimum without bounds; a pivot takes the arc
    farthest out of its bounds out of the tree and lets the arc of least reduced cost over the cut
    in, so the tree stays optimal for the bounds met so far. A pivot costs a walk over one side of
    the tree and one pass over the arcs of the cut. Costs are shifted by parts in 1e11, which
    breaks ties: without ties no tree comes back.
    """

    def __init__(self, cost: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        n, k = cost.shape
        self.n, self.k, self.root = n, k, n + k
        real = cost < FAR / 2
        most = float(np.abs(cost[real]).max()) if real.any() else 1.0
        self.shift = most * 1e-11
        self.cost = np.where(real, cost + self.shift * np.random.default_rng(n).random((n, k)), np.inf)
        first = self.cost.argmin(1)
        self.price = np.r_[self.cost[np.arange(n), first], np.zeros(k)]
        self.parent = [*(n + first).tolist(), *[self.root] * k]
        self.children = [set() for _ in range(n + k + 1)]
        for node, up in enumerate(self.parent):
            self.children[up].add(node)
        self.lo, self.hi = lo, hi
        self.least, self.most = np.r_[np.zeros(n), lo], np.r_[np.full(n, np.inf), hi]
        self.flow = np.r_[w.astype(float), np.bincount(first, weights=w, minlength=k)]
        # districts whose arc to the root is out of the tree, with their load at hi or lo
        self.loose, self.at_top = np.zeros(k, bool), np.zeros(k, bool)
        self.tol = 1e-11 * max(1.0, float(w.sum()))

    def solve(self, max_steps: int) -> bool:
        """Whether all bounds could be met."""
        if not np.isfinite(self.price).all():
            return False
        for _ in range(max_steps):
            off = np.maximum(self.least - self.flow, self.flow - self.most)
            out = int(off.argmax())
            if off[out] <= self.tol:
                return True
            if not self._pivot(out, float(off[out])):
                return False
        return False

    def grow(self, cost: np.ndarray) -> None:
        """More districts, of columns of finite costs: each hangs on the unit that it draws most and
        takes its load at a bound, so the tree is still optimal for its loads."""
        n, old, m = self.n, self.root, cost.shape[1]
        cost = cost + self.shift * np.random.default_rng([n, self.k]).random((n, m))
        self.k, self.root = self.k + m, old + m
        self.parent = [self.root if up == old else up for up in self.parent]
        draw = self.price[:n, None] - cost
        on = draw.argmax(0)
        price = draw[on, np.arange(m)]
        self.children[old:old] = [set() for _ in range(m)]
        self.parent.extend(on.tolist())
        for j, i in enumerate(on.tolist()):
            self.children[i].add(old + j)
        self.cost, self.price = np.hstack([self.cost, cost]), np.r_[self.price, price]
        self.loose, self.at_top = np.r_[self.loose, np.ones(m, bool)], np.r_[self.at_top, price >= 0]

    def load(self, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Other demands and bounds for the same costs: the tree stays, its flows and prices are made anew."""
        n, k, root, parent = self.n, self.k, self.root, self.parent
        order = [root]
        for node in order:
            order.extend(self.children[node])
        net = [*w.tolist(), *np.where(self.loose, -np.where(self.at_top, hi, lo), 0.0).tolist()]
        flow, price = [0.0] * (n + k), [0.0] * (n + k)
        for node in order[:0:-1]:
            up = parent[node]
            flow[node] = net[node] if node < n or up == root else -net[node]
            if up != root:
                net[up] += net[node]
        for node in order[1:]:
            up = parent[node]
            if up != root:
                price[node] = price[up] + self.cost[node, up - n] if node < n else price[up] - self.cost[up, node - n]
        held = np.array(parent[n:]) == root
        self.lo, self.hi, self.flow, self.price = lo, hi, np.array(flow), np.array(price)
        self.least, self.most = np.r_[np.zeros(n), np.where(held, lo, 0.0)], np.r_[np.full(n, np.inf), np.where(held, hi, np.inf)]
        self.tol = 1e-11 * max(1.0, float(w.sum()))

    def _up(self, node: int) -> bool:
        """Whether flow on the node's arc runs to its parent."""
        return node < self.n or self.parent[node] == self.root

    def _pivot(self, out: int, amount: float) -> bool:
        n, root, parent, children, flow, price = self.n, self.root, self.parent, self.children, self.flow, self.price
        side = [out]
        for node in side:
            side.extend(children[node])
        inside = np.zeros(self.n + self.k, bool)
        inside[side] = True
        # more has to leave this side over other arcs, or less
        more = self._up(out) == bool(flow[out] > self.most[out])
        rows, cols = (inside[:n] == more).nonzero()[0], (inside[n:] != more).nonzero()[0]
        least, ends = np.inf, (0, root)
        if len(rows) and len(cols):
            gap = self.cost[rows[:, None], cols]
            gap -= price[rows, None]
            gap += price[n + cols]
            at = int(gap.argmin())
            least, ends = float(gap.flat[at]), (int(rows[at // len(cols)]), n + int(cols[at % len(cols)]))
        out_of_tree = (inside[n:] & self.loose & (self.at_top != more)).nonzero()[0]
        if len(out_of_tree):
            bound = np.abs(price[n + out_of_tree])
            at = int(bound.argmin())
            if bound[at] < least:
                least, ends = float(bound[at]), (n + int(out_of_tree[at]), root)
        if not least < np.inf:
            return False
        price[inside] += least if more else -least
        near, far = ends if (ends[1] == root or inside[ends[0]]) else ends[::-1]
        # round the cycle that the new arc closes: up this side's path and the other's to where they meet
        sign, top = -amount if more else amount, parent[out]
        path = [near]
        while path[-1] != out:
            path.append(parent[path[-1]])
        for node in path:
            flow[node] += sign if node < n or parent[node] == root else -sign
        climb, at = {}, top
        while True:
            climb[at] = len(climb)
            if at == root:
                break
            at = parent[at]
        at = far
        while at not in climb:
            flow[at] -= sign if at < n or parent[at] == root else -sign
            at = parent[at]
        for node, place in climb.items():
            if place >= climb[at]:
                break
            flow[node] += sign if node < n or parent[node] == root else -sign
        # hang this side below its end of the new arc
        if top == root:
            self.loose[out - n], self.at_top[out - n] = True, more
        loads = [flow[node] for node in path]
        children[top].discard(out)
        for low, high, load in zip(path[:-1], path[1:], loads[:-1], strict=True):
            children[high].discard(low)
            children[low].add(high)
            parent[high], flow[high] = low, load
            self.least[high], self.most[high] = 0.0, np.inf
        parent[near] = far
        children[far].add(near)
        if far == root:
            j = near - n
            self.loose[j] = False
            flow[near] = self.hi[j] - amount if self.at_top[j] else self.lo[j] + amount
            self.least[near], self.most[near] = self.lo[j], self.hi[j]
        else:
            flow[near] = amount
            self.least[near], self.most[near] = 0.0, np.inf
        return True

    def flows(self) -> np.ndarray:
        out = np.zeros((self.n, self.k))
        for node, up in enumerate(self.parent):
            if up != self.root:
                i, j = (node, up - self.n) if node < self.n else (up, node - self.n)
                out[i, j] = max(float(self.flow[node]), 0.0)
        return out


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row among the different ones, in the order they come, and where each comes first."""
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in rows], int)
    return kind, np.unique(kind, return_index=True)[1]


class Memory:
    """The last tree of a caller that solves one transport after another. Where most columns of costs
    come again (the same places, other demands or numbers of districts), the next solution starts
    from it; without ties there is one optimum, so it is the one found from the start."""

    def __init__(self):
        self.tree, self.at = None, {}

    def solve(self, cost: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, max_steps: int) -> tuple[np.ndarray, bool]:
        """Flows over the columns of ``cost``, and whether all bounds could be met."""
        names = [c.tobytes() for c in np.ascontiguousarray(cost.T)]
        new = [g for g, name in enumerate(names) if name not in self.at]
        if self.tree is not None and 4 * len(new) <= len(names) and len(self.at) + len(new) <= 2 * len(names):
            tree = self.tree
            if new:
                self.at |= {names[g]: tree.k + j for j, g in enumerate(new)}
                tree.grow(cost[:, new])
            cols = [self.at[name] for name in names]
            least, most = np.zeros(tree.k), np.zeros(tree.k)
            least[cols], most[cols] = lo, hi
            tree.load(w, least, most)
            if tree.solve(max_steps):
                return tree.flows()[:, cols], True
        tree = _Tree(cost, w, lo, hi)
        ok = tree.solve(max_steps)
        usable = ok and bool((cost < FAR / 2).all())
        self.tree, self.at = (tree, {name: g for g, name in enumerate(names)}) if usable else (None, {})
        return tree.flows(), ok


def transport(cost: np.ndarray, w: np.ndarray, lo: float, hi: float, max_steps: int | None = None) -> tuple[np.ndarray, bool]:
    """Cheapest split of demands ``w`` over districts with loads in [lo, hi]: flows, and whether
    all bounds could be met.

    Districts of equal costs (centres at one place) are solved as one, whose load they share
    evenly, unit by unit.
    """
    kind, first = _kinds(cost.T)
    part, ok = _transport(cost[:, first], kind, w, lo, hi, max_steps)
    size, flow = np.bincount(kind), np.zeros(cost.shape)
    for g, same in enumerate(np.split(kind.argsort(kind="stable"), size.cumsum()[:-1])):
        if len(same) == 1:
            flow[:, same[0]] = part[:, g]
            continue
        has = np.flatnonzero(part[:, g])
        if not len(has):
            continue
        load = part[has, g]
        ends = load.cumsum()
        share = ends[-1] / len(same) * np.arange(len(same) + 1)
        from_to = np.minimum(ends[:, None], share[1:]) - np.maximum((ends - load)[:, None], share[:-1])
        flow[has[:, None], same] = np.maximum(from_to, 0.0)
    return flow, ok


def _transport(few: np.ndarray, kind: np.ndarray, w: np.ndarray, lo: float, hi: float, max_steps: int | None = None,
               memory: Memory | None = None) -> tuple[np.ndarray, bool]:
    """:func:`transport` with a column of costs, and of flows, for each kind of district."""
    size = np.bincount(kind)
    return (memory or Memory()).solve(few, w, lo * size, hi * size, max_steps or 20_000 + 100 * (len(few) + len(kind)))


def _largest(part: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """District of each unit's largest share, of equal ones the first, where districts of a kind share
    its load evenly, unit by unit: a unit's load in a kind begins within one district's share, and
    the next district's is the whole share if the load goes on beyond it."""
    g, i = part.T.nonzero()
    load, size = part[i, g], np.bincount(kind)
    begin = load.cumsum() - load
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][:len(g)])
    begin -= np.repeat(begin[starts], np.diff(np.r_[starts, len(g)]))
    share = (np.bincount(g, weights=load, minlength=len(size)) / size)[g]
    cell = np.minimum(np.floor(begin / share + 1e-9), size[g] - 1)
    head = np.minimum(load, (cell + 1) * share - begin)
    rest = np.minimum(load - head, share)
    later = (rest > head + 1e-9 * share) & (cell + 1 < size[g])
    own = kind.argsort(kind="stable")[(size.cumsum() - size)[g] + (cell + later).astype(int)]
    order = np.lexsort((own, -np.round(np.where(later, rest, head), 9), i))
    unit, at = np.unique(i[order], return_index=True)
    lab = np.zeros(len(part), int)
    lab[unit] = own[order][at]
    return lab


def assign_lp(points, w, centers, eps=0.05, home=None, lam=0.0, memory: Memory | None = None) -> tuple[np.ndarray, float]:
    """Labels (largest share) and cost of the balanced assignment; nearest centres if there is none."""
    k = len(centers)
    mean = w.sum() / k
    kind, first = _kinds(centers)
    if home is not None:  # a unit's own district is a kind by itself
        own = np.unique(home)
        kind[own] = len(first) + np.arange(len(own))
        _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
    few = distances(points, centers[first])
    if home is not None:
        few += lam * (first[None, :] != home[:, None])
    part, ok = _transport(few, kind, w, mean * (1 - eps), mean * (1 + eps), memory=memory)
    if not ok:
        return nearest(points, centers), float("nan")
    return _largest(part, kind), float((part * few).sum())


class _Flow:
    """An optimal split of demands under bans, kept optimal while more pairs are banned.

    A ban takes the unit's share out of a district; the share is placed again along cheapest
    chains of moves that end in the gap it left. One node of the chains' graph stands for slack:
    a district below its upper bound may absorb, one above its lower bound may release load.
    Chains of least cost keep a flow optimal, so a node of the search costs a few chains.
    """

    def __init__(self, cost: np.ndarray, w: np.ndarray, lo: float, hi: float, flow: np.ndarray):
        self.cost, self.w, self.lo, self.hi, self.flow = cost, w, lo, hi, flow
        self.tol = 1e-7 * max(1.0, float(w.sum()))

    def copy(self) -> _Flow:
        return _Flow(self.cost.copy(), self.w, self.lo, self.hi, self.flow.copy())

    def _chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.cost.shape[1]
        load = self.flow.sum(0)
        step, mover = np.full((k + 1, k + 1), np.inf), np.zeros((k, k), int)
        for a in range(k):
            has = np.flatnonzero(self.flow[:, a] > self.tol)
            if len(has):
                gap = self.cost[has] - self.cost[has, a][:, None]
                best = gap.argmin(0)
                step[a, :k], mover[a] = gap[best, np.arange(k)], has[best]
        step[:k, k] = np.where(load < self.hi - self.tol, 0.0, np.inf)
        step[k, :k] = np.where(load > self.lo + self.tol, 0.0, np.inf)
        np.fill_diagonal(step, 0.0)
        step[step > FAR / 2] = np.inf
        nxt = np.tile(np.arange(k + 1), (k + 1, 1))
        for via in range(k + 1):
            new = step[:, via, None] + step[via]
            better = new < step - 1e-9
            step = np.where(better, new, step)
            nxt = np.where(better, nxt[:, via, None], nxt)
        return step, nxt, mover

    def ban(self, i: int, districts: np.ndarray) -> bool:
        """Unit i keeps out of ``districts``; False if nothing is left for it."""
        self.cost[i, districts] = FAR
        return all(self._place(i, a) for a in districts if self.flow[i, a] > 0)

    def _place(self, i: int, gap: int) -> bool:
        k = self.cost.shape[1]
        left, self.flow[i, gap] = self.flow[i, gap], 0.0
        for _ in range(50 * k):
            if left <= self.tol:
                return True
            dist, nxt, mover = self._chains_with(gap, left)
            ways = self.cost[i] + dist[:k, gap]
            at = int(ways.argmin())
            if not ways[at] < FAR / 2:
                return False
            load, moves, most, first = self.flow.sum(0), [], left, at
            load[gap] += left
            for _ in range(k + 2):
                if at == gap:
                    break
                to = int(nxt[at, gap])
                if to == k:
                    most = min(most, self.hi - load[at])
                elif at == k:
                    most = min(most, load[to] - self.lo)
                else:
                    most = min(most, self.flow[mover[at, to], at])
                    moves.append((int(mover[at, to]), at, to))
                at = to
            if at != gap or most <= 0:
                return False
            self.flow[i, first] += most
            for m, x, y in moves:
                self.flow[m, x] -= most
                self.flow[m, y] += most
            left -= most
        return False

    def _chains_with(self, gap: int, left: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chains while ``left`` is still missing in ``gap``: its load counts as before the ban."""
        spare = np.zeros((1, self.cost.shape[1]))
        spare[0, gap] = left
        flow, cost = self.flow, self.cost
        self.flow, self.cost = np.vstack([flow, spare]), np.vstack([cost, np.full((1, cost.shape[1]), FAR)])
        self.cost[-1, gap] = 0.0
        try:
            return self._chains()
        finally:
            self.flow, self.cost = flow, cost

    def value(self) -> float:
        return float((self.flow * self.cost).sum())

    def extra_cost(self) -> np.ndarray:
        """Reduced costs: by how much the optimum rises at least if a unit is put in a district."""
        price = -self._chains()[0][-1, :-1]
        price = np.where(np.isfinite(price), price, -FAR)
        whole = self.w[:, None] * (self.cost + price)
        return whole - whole.min(1, keepdims=True)


class _Knapsacks:
    """A stronger bound: each unit's single place is priced, each district then picks the cheapest
    set of units whose load is within bounds, exactly, over whole loads.

    All districts advance together, one unit a step. Tables from the last unit back give, with
    those from the first, the least cost with any single pick, by which pairs are ruled out.
    """

    def __init__(self, whole: np.ndarray, w: np.ndarray, lo: float, hi: float):
        self.whole, self.w, self.lo, self.hi = whole, w.astype(int), int(lo), int(hi)

    def _tables(self, weight: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Least cost of each load of each district, after none, one, two .. of the units."""
        f, k = gain.shape
        table = np.full((f + 1, k, self.hi + 1), np.inf)
        table[0, :, 0] = 0.0
        for j, (v, g) in enumerate(zip(weight.tolist(), gain, strict=True)):
            now = table[j + 1]
            now[:] = table[j]
            if v <= self.hi:
                np.minimum(now[:, v:], table[j][:, :self.hi + 1 - v] + g[:, None], out=now[:, v:])
        return table

    def improve(self, allowed: np.ndarray, price: np.ndarray, upper: float, rounds: int, spread: float):
        """Best bound found by subgradient steps from ``price``: bound, price, step size to go on
        with, what :meth:`forced` needs, and which pairs the bound picks."""
        n, k = self.whole.shape
        free = np.flatnonzero(allowed.sum(1) > 1)
        only = np.flatnonzero(allowed.sum(1) == 1)
        place = allowed[only].argmax(1)
        base = np.bincount(place, weights=self.w[only], minlength=k).astype(int)
        sunk, weight, cols = float(self.whole[only, place].sum()), self.w[free], np.arange(k)
        cost = np.where(allowed[free], self.whole[free], np.inf)
        loads = np.arange(self.hi + 1)
        outside = (loads < (self.lo - base)[:, None]) | (loads > (self.hi - base)[:, None])
        top, at_top, last, best = -np.inf, price, 0, None
        for r in range(rounds):
            gain = cost - price[free][:, None]
            table = self._tables(weight, gain)
            end = np.where(outside, np.inf, table[-1])
            load = end.argmin(1)
            value = sunk + float(price[free].sum()) + float(end[cols, load].sum())
            if not np.isfinite(value):
                return np.inf, price, spread, None, None
            taken = np.zeros((len(free), k), bool)
            for j in range(len(free) - 1, -1, -1):
                taken[j] = t = table[j + 1][cols, load] < table[j][cols, load]
                load = load - t * weight[j]
            if value > top + 1e-9:
                top, at_top, last, best = value, price, r, (taken, table, gain, end)
            elif r - last >= 5:
                spread, last, price = spread / 2, r, at_top
                continue
            miss = 1 - taken.sum(1)
            if top >= upper or not miss.any() or spread < 1e-3:
                break
            price = price.copy()
            price[free] += miss * spread * (upper * 1.02 - value) / (miss @ miss)
        taken, table, gain, end = best
        pick = np.zeros((n, k), bool)
        pick[free], pick[only, place] = taken, True
        return top, at_top, spread, (free, weight, base, table, gain, end.min(1)), pick

    def forced(self, value: float, layout: tuple) -> np.ndarray:
        """Bound with each pair picked; for units with a single place and for pairs that are ruled
        out it says nothing (minus infinity)."""
        free, weight, base, ahead, gain, now = layout
        out = np.full(self.whole.shape, -np.inf)
        if not len(free):
            return out
        band, f, size = self.hi - self.lo, len(free), self.hi + 1
        tail = self._tables(weight[::-1], gain[::-1])[:f][::-1]
        # cheapest tail with a load from x - band to x, by doubling
        low = np.pad(tail, ((0, 0), (0, 0), (band, band)), constant_values=np.inf)
        width = 1
        while width < band + 1:
            step = min(width, band + 1 - width)
            low[:, :, :-step] = np.minimum(low[:, :, :-step], low[:, :, step:])
            width += step
        start = (self.lo - base)[None, :, None] - weight[:, None, None] - np.arange(size) + band
        rest = np.take_along_axis(low, np.clip(start, 0, low.shape[2] - 1), 2)
        rest[(start < 0) | (start >= low.shape[2])] = np.inf
        best = (ahead[:f] + rest).min(2) + gain
        out[free] = np.where(np.isfinite(gain), value - now + best, -np.inf)
        return out


def _polish(lab: np.ndarray, whole: np.ndarray, w: np.ndarray, lo: float, hi: float, rounds: int = 200) -> np.ndarray:
    """Single moves and swaps of two units while one lowers the cost within the bounds."""
    n, k = whole.shape
    lab, rows = lab.copy(), np.arange(n)
    for _ in range(rounds):
        load, now = np.bincount(lab, weights=w, minlength=k), whole[rows, lab]
        move = whole - now[:, None]
        move[(load[lab] - w < lo - 1e-9)[:, None] | (load + w[:, None] > hi + 1e-9)] = 0.0
        move[rows, lab] = 0.0
        i, to = divmod(int(move.argmin()), k)
        swap = whole[:, lab] - now[:, None]
        swap = swap + swap.T
        after = load[lab] - w + w[:, None]  # of the column's district, if row and column change places
        fits = (after >= lo - 1e-9) & (after <= hi + 1e-9)
        swap[~(fits & fits.T) | (lab[:, None] == lab)] = 0.0
        a, b = divmod(int(swap.argmin()), n)
        if min(move[i, to], swap[a, b]) > -1e-9:
            break
        if move[i, to] <= swap[a, b]:
            lab[i] = to
        else:
            lab[a], lab[b] = lab[b], lab[a]
    return lab


def _whole_bounds(w: np.ndarray, k: int, eps: float) -> tuple[float, float]:
    """Bounds of a district's load; where demands are whole numbers, rounded inwards."""
    mean = w.sum() / k
    lo, hi = mean * (1 - eps), mean * (1 + eps)
    return (np.ceil(lo - 1e-9), np.floor(hi + 1e-9)) if np.all(w == np.round(w)) else (lo, hi)


def no_room(w: np.ndarray, k: int, eps: float) -> bool:
    """Whether counts alone show that whole units don't fit ``k`` districts: a unit is above the upper
    bound; more units than districts hold are above a half (third, fourth) of it; or districts
    that have to take two units or more, since one is below the lower bound, find too few."""
    lo, hi = _whole_bounds(w, k, eps)
    if not (len(w) and w.max() <= hi + 1e-9 and lo <= hi):
        return True
    if any((w * (p + 1) > hi * (1 + 1e-9)).sum() > p * k for p in (1, 2, 3)):
        return True
    enough = w >= lo - 1e-9
    return bool(lo > 1e-9 and enough.sum() + ((w > 0) & ~enough).sum() // 2 < k)


def _no_parts(w: np.ndarray, k: int, lo: int, hi: int, until: float = np.inf) -> bool:
    """Whether whole loads can't be dealt over ``k`` districts with sums in [lo, hi], wherever they lie,
    because not even fractions of patterns (sets of units that fill a district) would do: columns
    are made by a knapsack over loads, until that clock time. False says nothing."""
    size, count = np.unique(w[w > 0].astype(int), return_counts=True)
    m = len(size)
    base, x, missing = np.eye(m + 1), np.r_[count, k].astype(float), np.ones(m + 1, bool)
    for _ in range(200 + 4 * m):
        if time.monotonic() > until:
            return False
        try:
            dual = np.linalg.solve(base.T, missing.astype(float))
        except np.linalg.LinAlgError:
            return False
        best, takes = np.r_[0.0, np.full(hi, -np.inf)], np.zeros((m, hi + 1), int)
        for s, c, worth, take in zip(size.tolist(), count.tolist(), dual.tolist(), takes, strict=False):
            before, best = best, best.copy()
            for t in range(1, min(c, hi // s) + 1):
                better = (more := before[:hi + 1 - t * s] + t * worth) > best[t * s:]
                best[t * s:][better], take[t * s:][better] = more[better], t
        load = lo + int(best[lo:].argmax())
        value = float(best[load] + dual[m])  # no pattern lowers what is missing by more
        if not value > 1e-7:
            # no pattern is worth more than nothing, but what has to be dealt is: by Farkas there is no way
            short = dual[:m] @ count + k * (dual[m] - max(value, 0.0))
            return bool(short > 1e-6 * (1 + np.abs(dual[:m]) @ count + k * abs(dual[m])))
        column = np.zeros(m + 1)
        column[m] = 1
        for j in range(m - 1, -1, -1):
            column[j] = takes[j, load]
            load -= int(takes[j, load] * size[j])
        way = np.linalg.solve(base, column)
        ratio = np.full(m + 1, np.inf)
        ratio[way > 1e-9] = x[way > 1e-9] / way[way > 1e-9]
        least = float(ratio.min())
        if not least < np.inf:
            return False
        ties = np.flatnonzero(ratio <= least + 1e-9)
        out = int(ties[missing[ties].argmax()])
        x = np.maximum(x - least * way, 0.0)
        x[out], base[:, out], missing[out] = least, column, False
    return False


def assign_milp(points, w, centers, eps, home, lam, time_limit=10.0, gap=1e-3, memory: Memory | None = None) -> tuple[np.ndarray, dict]:
    """Whole units only: branch and bound over the flow relaxation, best bound first.

    A node bans pairs of unit and district; its relaxation starts from its parent's. Pairs whose
    reduced cost alone exceeds what the best whole assignment leaves are banned too. Whole
    assignments come from rounding and local search. Demands are whole numbers, so bounds are
    rounded inwards; where counts or patterns of loads show that whole units fit no districts, nothing
    is searched. Returns labels and a log with status (optimal, limit, infeasible), gap and
    whether a fallback was taken: without any whole assignment, the relaxation with the penalty;
    without that, nearest centres.
    """
    n, k = len(points), len(centers)
    lo, hi = _whole_bounds(w, k, eps)
    if no_room(w, k, eps):
        return assign_lp(points, w, centers, eps, home, lam, memory)[0], {"status": "infeasible", "gap": float("nan"), "fallback": True}
    cost = distances(points, centers) + lam * (np.arange(k)[None, :] != home[:, None])
    whole, rows = cost * w[:, None], np.arange(n)
    started, best, best_cost, bound, stopped = time.monotonic(), None, np.inf, -np.inf, False

    def rounded(flow: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Largest shares, then single moves that lower the violation most per cost."""
        lab = flow.argmax(1)
        for _ in range(2 * n):
            load = np.bincount(lab, weights=w, minlength=k)
            bad = np.maximum(load - hi, 0) + np.maximum(lo - load, 0)
            if bad.sum() <= 1e-9:
                break
            less, more = load[lab] - w, load[None, :] + w[:, None]
            gain = (bad[lab] - np.maximum(less - hi, 0) - np.maximum(lo - less, 0))[:, None] + bad - np.maximum(more - hi, 0) - np.maximum(lo - more, 0)
            gain[rows, lab] = -np.inf
            gain[limit >= FAR] = -np.inf
            price = whole - whole[rows, lab][:, None]
            score = np.where(gain > 1e-9, gain / (1 + np.maximum(price, 0)), -np.inf)
            i, to = np.unravel_index(score.argmax(), score.shape)
            if not np.isfinite(score[i, to]):
                break
            lab[i] = to
        return lab

    def offer(lab: np.ndarray) -> None:
        nonlocal best, best_cost
        load = np.bincount(lab, weights=w, minlength=k)
        if load.max() <= hi + 1e-9 and load.min() >= lo - 1e-9:
            lab = _polish(lab, whole, w, lo, hi)
            if (c := float(whole[rows, lab].sum())) < best_cost:
                best, best_cost = lab, c

    def search(node: _Flow, kicks: int) -> None:
        """Moves a few undecided units of the best assignment at random, mends loads, polishes."""
        rng = np.random.default_rng(n)
        allowed = node.cost < FAR / 2
        loose = np.flatnonzero(allowed.sum(1) > 1)
        for _ in range(kicks if best is not None and len(loose) else 0):
            lab = best.copy()
            for i in rng.choice(loose, min(len(loose), int(rng.integers(2, 6))), replace=False):
                lab[i] = rng.choice(np.flatnonzero(allowed[i]))
            flow = np.zeros((n, k))
            flow[rows, lab] = w
            offer(rounded(flow, node.cost))

    def enough(value: float) -> bool:
        return best is not None and value >= best_cost - gap * abs(best_cost)

    def tighten(value: float, node: _Flow, price: np.ndarray, turns: int) -> tuple[float, np.ndarray]:
        """Raise a node's bound by knapsacks and, by turns, rule out the pairs that alone exceed
        what the best whole assignment leaves."""
        spread = 1.0 if turns > 3 else 0.2
        for _ in range(turns):
            allowed, before = node.cost < FAR / 2, value
            upper = best_cost * (1 - gap) if best is not None else value * 1.05
            top, price, spread, layout, pick = sacks.improve(allowed, price, upper, 12, spread)
            if not np.isfinite(top):
                return np.inf, price
            offer(rounded(pick * w[:, None], node.cost))
            value = max(value, top)
            if best is None or enough(value):
                break
            over = allowed & (sacks.forced(top, layout) >= best_cost * (1 - gap))
            for i in np.flatnonzero(over.any(1)):
                if not node.ban(int(i), np.flatnonzero(over[i])):
                    return np.inf, price
            if over.sum() < 0.03 * allowed.sum() and value - before < 0.05 * (best_cost * (1 - gap) - before):
                break
        return max(value, node.value()), price

    todo, born = [], 0
    sacks = _Knapsacks(whole, w, lo, hi) if np.all(w == np.round(w)) and n * k * hi <= 20_000_000 else None
    flow, ok = transport(cost, w, lo, hi)
    if ok:
        root = _Flow(cost.copy(), w, lo, hi, flow)
        value = root.value()
        dual = -root._chains()[0][-1, :-1]
        price = (whole + w[:, None] * np.where(np.isfinite(dual), dual, 0.0)).min(1)
        todo.append((value, 0, root, price))
    dive = None
    while todo or dive:
        if time.monotonic() - started > time_limit:
            stopped = True
            break
        value, _, node, price = dive or heapq.heappop(todo)
        dive = None
        if enough(value):
            continue
        share = node.flow / np.maximum(w, 1e-12)[:, None]
        split = np.flatnonzero(share.max(1) < 1 - 1e-6)
        for lab in (share.argmax(1), rounded(node.flow, node.cost)):
            offer(lab)
        if not len(split) or enough(value):
            continue
        if best is None and not born and sacks is not None and lo > 0 and _no_parts(w, k, int(lo), int(hi), started + time_limit / 4):
            continue
        if best is not None:
            far = (node.extra_cost() >= best_cost * (1 - gap) - node.value()) & (node.flow <= node.tol)
            node.cost[far] = FAR
        if sacks is not None:
            if not born:
                search(node, 20)
            value, price = tighten(value, node, price, 1 if born else 25)
            if enough(value) or not value < FAR / 2:
                continue
            search(node, 3 if born else 40)
            share = node.flow / np.maximum(w, 1e-12)[:, None]
            split = np.flatnonzero(share.max(1) < 1 - 1e-6)
            if not len(split):
                offer(share.argmax(1))
                continue
        i = int(split[(w[split] * (1 - share[split].max(1))).argmax()])
        keep = int(share[i].argmax())
        children = []
        for out in (np.array([keep]), np.flatnonzero(np.arange(k) != keep)):
            child = node.copy()
            if child.ban(i, out) and not enough(v := max(value, child.value())) and v < FAR / 2:
                born += 1
                children.append((v, born, child, price))
        children.sort(key=lambda c: c[0])
        if children:
            dive = children.pop(0)
        for c in children:
            heapq.heappush(todo, c)
    if best is not None:
        bound = min([t[0] for t in todo] + ([dive[0]] if dive else []), default=best_cost) if stopped else best_cost
        left = max(0.0, (best_cost - bound) / max(abs(best_cost), 1e-12))
        return best, {"status": "limit" if stopped and left > gap else "optimal", "gap": left, "fallback": False}
    lab = assign_lp(points, w, centers, eps, home, lam, memory)[0]
    return lab, {"status": "limit" if stopped else "infeasible", "gap": float("nan"), "fallback": True}


def assign_greedy(points, w, centers, eps=0.05) -> np.ndarray:
    """Pairs by ascending distance under the upper bound; what is left goes where load is least."""
    k = len(centers)
    room = np.full(k, w.sum() / k * (1 + eps))
    d, lab = distances(points, centers), np.full(len(points), -1)
    size, free, own = w.tolist(), room.tolist(), lab.tolist()
    left, lightest = len(own), min(size, default=0.0)
    for flat in np.argsort(d, axis=None, kind="stable").tolist():
        c = flat % k
        if free[c] < lightest or own[i := flat // k] >= 0 or size[i] > free[c]:
            continue
        own[i] = c
        free[c] -= size[i]
        left -= 1
        if not left:
            break
    lab, room = np.array(own, int), np.array(free)
    for i in np.flatnonzero(lab < 0):
        lab[i] = int(room.argmax())
        room[lab[i]] -= w[i]
    return lab


def assign_wvor(points, w, centers, eps=0.05, iters=200) -> np.ndarray:
    """Additively weighted Voronoi cells whose weights follow the load."""
    k = len(centers)
    d, shift, goal = distances(points, centers), np.zeros(k), w.sum() / k
    for i in range(iters):
        lab = (d - shift).argmin(1)
        excess = np.bincount(lab, weights=w, minlength=k) - goal
        if (np.abs(excess) <= eps * goal).all():
            break
        shift = shift - excess / goal * 50 * 0.99**i
    return lab


def repair(points, w, lab, k, neighbors: list[list[int]], moves: int = 60, centers=None, eps: float = 1 / 7) -> np.ndarray:
    """Move border units with demand to an adjacent district while that lowers the worse of the
    two deviations, until all loads are within the band. Of equal gains the unit that is nearer
    to the district's centre moves."""
    lab, goal = lab.copy(), w.sum() / k
    if centers is None:
        centers = np.array([points[lab == c].mean(0) if (lab == c).any() else [np.inf, np.inf] for c in range(k)])
    far = distances(points, centers)
    for _ in range(moves):
        load = np.bincount(lab, weights=w, minlength=k)
        if (np.abs(load - goal) <= eps * goal + 1e-9).all():
            break
        options = {}
        for i in np.flatnonzero(w > 0):
            a = lab[i]
            for b in {lab[j] for j in neighbors[i]} - {a}:
                now = max(abs(load[a] - goal), abs(load[b] - goal))
                options[i, b] = now - max(abs(load[a] - w[i] - goal), abs(load[b] + w[i] - goal))
        most = max(options.values(), default=0.0)
        if most <= 1e-9:
            break
        i, b = min((o for o, gain in options.items() if gain > most - 1e-9), key=lambda o: (far[o], o))
        lab[i] = b
    return lab


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row of the cheapest matching; -1 for rows beyond the number of columns."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        slack, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, col = row, -1
        while True:
            reduced = c[i] - u[i] - v
            better = ~done & (reduced < slack)
            slack[better], came[better] = reduced[better], col
            free = np.where(done, np.inf, slack)
            j = int(free.argmin())
            delta = free[j]
            u[row] += delta
            held = np.flatnonzero(done)
            u[owner[held]] += delta
            v[held] -= delta
            slack[~done] -= delta
            done[j] = True
            col = j
            if owner[j] < 0:
                break
            i = owner[j]
        while col >= 0:
            prev = came[col]
            owner[col] = owner[prev] if prev >= 0 else row
            col = prev
    if flip:
        return owner
    out = np.full(n, -1)
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def matching(cost: np.ndarray) -> np.ndarray:
    """:func:`hungarian`; if most rows or columns repeat others (centres at one place), as a
    transport between the different ones."""
    row, at_row = _kinds(cost)
    col, at_col = _kinds(cost[at_row].T)
    return _matching(cost[at_row[:, None], at_col], row, col)


def match_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`matching` of points to points by distance. Points of both at one place are matched with
    each other first: by the triangle inequality a way over a place costs no less than the direct
    one, so some cheapest matching does so, and only what is left has to be solved."""
    free: dict[bytes, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        free.setdefault((b[j] + 0.0).tobytes(), []).append(j)
    out, taken = np.full(len(a), -1), np.zeros(len(b), bool)
    for i, place in enumerate(a):
        if same := free.get((place + 0.0).tobytes()):
            out[i] = same.pop()
            taken[out[i]] = True
    rest, open_ = np.flatnonzero(out < 0), np.flatnonzero(~taken)
    if len(rest) and len(open_):
        row, at_row = _kinds(a[rest])
        col, at_col = _kinds(b[open_])
        to = _matching(distances(a[rest][at_row], b[open_][at_col]), row, col)
        out[rest[to >= 0]] = open_[to[to >= 0]]
    return out


def _matching(few: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cheapest matching of rows to columns, given their kinds and the costs between kinds."""
    if len(row) > len(col):
        back, out = _matching(few.T, col, row), np.full(len(row), -1)
        out[back] = np.arange(len(back))
        return out
    if few.size > len(row) * len(col) / 4:
        return hungarian(few[row[:, None], col])
    size = np.bincount(col).astype(float)
    tree = _Tree(few, np.bincount(row).astype(float), np.zeros(len(size)) if len(row) < len(col) else size, size)
    if not tree.solve(20_000 + 100 * sum(few.shape)):
        return hungarian(few[row[:, None], col])
    flow, out = np.rint(tree.flows()).astype(int), np.full(len(row), -1)
    free = [np.flatnonzero(col == c).tolist()[::-1] for c in range(len(size))]
    for r in range(flow.shape[0]):
        ends = [c for c in np.flatnonzero(flow[r]) for _ in range(flow[r, c])]
        for i, c in zip(np.flatnonzero(row == r), ends, strict=True):
            out[i] = free[c].pop()
    return out
