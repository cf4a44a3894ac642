import itertools
import math

import numpy as np
import pytest

from haulgrid.operators.kernels import assignment as A
from haulgrid.operators.kernels import clusters as C
from haulgrid.operators.kernels import significance as S
from haulgrid.operators.kernels import tours as K


def everything(n, k):
    return itertools.product(range(k), repeat=n)


@pytest.mark.parametrize("seed", range(12))
def test_milp_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(3, 7)), int(rng.integers(2, 4))
    p, w, c = rng.random((n, 2)) * 1000, rng.integers(1, 6, n).astype(float), rng.random((k, 2)) * 1000
    home, lam, eps = rng.integers(0, k, n), 200.0, 0.3
    cost = (A.distances(p, c) + lam * (np.arange(k) != home[:, None])) * w[:, None]
    lo, hi = w.sum() / k * (1 - eps), w.sum() / k * (1 + eps)
    best = math.inf
    for lab in everything(n, k):
        load = np.bincount(lab, weights=w, minlength=k)
        if load.min() >= lo - 1e-9 and load.max() <= hi + 1e-9:
            best = min(best, cost[np.arange(n), list(lab)].sum())
    lab, log = A.assign_milp(p, w, c, eps, home, lam)
    if math.isinf(best):
        assert log["status"] == "infeasible" and log["fallback"]
    else:
        assert log["status"] == "optimal" and cost[np.arange(n), lab].sum() <= best * 1.0011 + 1e-9


@pytest.mark.parametrize("seed", range(8))
def test_transport_is_feasible_and_no_dearer_than_a_fine_grid(seed):
    """Demands of one each, split in whole units by enumeration, bound the flow from above."""
    rng = np.random.default_rng(seed)
    n, k = 6, 3
    p, c = rng.random((n, 2)), rng.random((k, 2)) * [1, 0.2]
    w = np.ones(n)
    cost = A.distances(p, c)
    flow, ok = A.transport(cost, w, 2.0, 2.0)
    assert ok and np.allclose(flow.sum(1), w) and np.allclose(flow.sum(0), 2.0) and (flow >= -1e-9).all()
    best = min(cost[np.arange(n), list(lab)].sum() for lab in everything(n, k) if (np.bincount(lab, minlength=k) == 2).all())
    assert abs((flow * cost).sum() - best) < 1e-9  # with unit demands the relaxation is whole


def test_transport_meets_lower_and_upper_bounds_by_duality():
    rng = np.random.default_rng(3)
    p, w, c = rng.random((60, 2)), rng.random(60) * 4 + 0.5, rng.random((5, 2)) * 0.3
    cost, mean = A.distances(p, c), w.sum() / 5
    flow, ok = A.transport(cost, w, mean * 0.95, mean * 1.05)
    load = flow.sum(0)
    assert ok and load.min() >= mean * 0.95 - 1e-6 and load.max() <= mean * 1.05 + 1e-6
    # no cheaper cycle of moves, and none that uses slack of the bounds
    dist, _, _ = A._paths(flow, cost)
    assert np.diag(dist).min() > -1e-6
    for a in range(5):
        for b in range(5):
            if load[a] > mean * 0.95 + 1e-6 and load[b] < mean * 1.05 - 1e-6:
                assert dist[a, b] > -1e-6


@pytest.mark.parametrize("shape", [(1, 1), (4, 4), (5, 5), (3, 6), (6, 3)])
def test_hungarian_against_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(10):
        c = rng.random(shape)
        got = A.hungarian(c)
        used = got[got >= 0]
        assert len(set(used.tolist())) == min(shape) == len(used)
        total = sum(c[i, j] for i, j in enumerate(got) if j >= 0)
        small = c if shape[0] <= shape[1] else c.T
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert abs(total - best) < 1e-9


def test_heuristics_label_everything_and_balance():
    rng = np.random.default_rng(5)
    p, w = rng.random((80, 2)) * 5000, rng.integers(1, 9, 80).astype(float)
    for engine in ("mcf", "greedy", "wvor"):
        lab, centers = C.cap_kmeans(p, w, 4, rng=np.random.default_rng(1), engine=engine)
        load = np.bincount(lab, weights=w, minlength=4)
        assert set(lab) <= set(range(4)) and load.sum() == w.sum() and len(centers) == 4
        assert load.max() <= w.sum() / 4 * (1.35 if engine == "wvor" else 1.2)
    lab = A.nearest(p, centers)
    near = [np.flatnonzero((row > 0) & (row < 900)).tolist() for row in A.distances(p, p)]
    fixed = A.repair(p, w, lab, 4, near)
    dev = [np.abs(np.bincount(x, weights=w, minlength=4) - w.sum() / 4).max() for x in (lab, fixed)]
    assert dev[1] <= dev[0]


def test_empty_district_keeps_its_centre():
    p = np.array([[0.0, 0], [1, 0], [2, 0]])
    out = C.recenter(p, np.ones(3), np.array([0, 0, 0]), np.array([[5.0, 5], [9, 9]]))
    assert out.tolist() == [[1, 0], [9, 9]]


def test_hull_and_estimate():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [1, 0]], float)
    assert C.hull_area(square) == 4
    for flat in ([[0, 0]], [[0, 0], [1, 1]], [[0, 0], [1, 1], [2, 2]], [[3, 3]] * 4):
        assert C.hull_area(np.array(flat, float)) == 0
    assert C.tour_bhh(square[:1]) == 0 and C.tour_bhh(square[:2]) == 4 and abs(C.tour_bhh(square) - 0.7124 * math.sqrt(24)) < 1e-12
    rng = np.random.default_rng(0)
    p = rng.random((40, 2))
    h = {tuple(x) for x in C.hull(p)}
    for x in p:  # a corner is a point that some line separates from all others
        angles = np.linspace(0, 2 * np.pi, 3600)
        ways = np.c_[np.cos(angles), np.sin(angles)]
        best = ((p - x) @ ways.T).max(0)
        assert (tuple(x) in h) or best.min() > -1e-9


@pytest.mark.parametrize("seed", range(6))
def test_tours(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 8))
    p = rng.random((n, 2))
    d = A.distances(p, p)
    km, minutes = d * rng.uniform(1, 1.3, (n, n)), d * 2
    np.fill_diagonal(km, 0)
    first = K.greedy_tour(d, 0)
    two = K.two_opt(first, d)
    three = K.or_opt(K.from_zero(two), d)
    assert sorted(first) == sorted(two) == sorted(three) == list(range(n))
    assert K.length(d, three) <= K.length(d, two) + 1e-9 <= K.length(d, first) + 2e-9
    best = min(K.length(d, (0, *q)) for q in itertools.permutations(range(1, n)))
    a, b, tour = K.route_multi(km, minutes)
    assert sorted(tour) == list(range(n)) and tour[0] == 0 and a == K.length(km, tour) and b == K.length(minutes, tour)
    assert a <= K.length(km, [0, *tour[:0:-1]]) + 1e-12
    assert K.route_multi(d, d)[0] <= best * 1.05
    assert K.route_single(d[:1, :1], d[:1, :1]) == (0.0, 0.0, [0]) and K.nn2opt(p[:1]) == 0 and abs(K.nn2opt(p[:2]) - 2 * d[0, 1]) < 1e-12


def test_shortest_paths_against_floyd_warshall():
    rng = np.random.default_rng(2)
    n, m = 25, 90
    u, v = rng.integers(0, n, m), rng.integers(0, n, m)
    a, b = rng.integers(1, 9, m).astype(float), rng.random(m)
    best = {(i, j): (math.inf, math.inf) for i in range(n) for j in range(n)}
    for i in range(n):
        best[i, i] = (0, 0)
    for x in zip(u.tolist(), v.tolist(), a, b, strict=True):
        best[x[0], x[1]] = min(best[x[0], x[1]], (x[2], x[3]))
    for k in range(n):
        for i in range(n):
            for j in range(n):
                new = tuple(p + q for p, q in zip(best[i, k], best[k, j], strict=True))
                if new < best[i, j]:
                    best[i, j] = new
    g = K.Graph(n, u, v, a, b)
    for i in range(n):
        one, two = g.shortest(i)
        for j in range(n):
            assert one[j] == best[i, j][0] and (math.isinf(one[j]) or abs(two[j] - best[i, j][1]) < 1e-9)
    label = K.strong_components(n, u, v)
    for i in range(n):
        for j in range(n):
            both = best[i, j][0] < math.inf and best[j, i][0] < math.inf
            assert (label[i] == label[j]) == both


def test_signed_rank_p_against_all_signs():
    x = np.array([1.5, -2.0, 3.0, 4.5, -0.5, 6.0, 7.5])
    ranks = np.abs(x).argsort().argsort() + 1
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(x))]
    exact = min(1.0, 2 * np.mean([s <= w for s in sums]))
    assert abs(S.signed_rank_p(x) - exact) < 1e-12
    assert S.signed_rank_p(np.zeros(4)) == 1.0
    tied = np.repeat([1.0, 2.0, -1.0], 30)
    assert 0 < S.signed_rank_p(tied) < 0.01


def test_bootstrap_covers_the_mean():
    rng = np.random.default_rng(1)
    sums, counts = rng.normal(2, 1, 50) * 5, np.full(50, 5)
    lo, hi = S.block_bootstrap(sums, counts, 2000)
    assert lo < sums.sum() / counts.sum() < hi and (lo, hi) == S.block_bootstrap(sums, counts, 2000)


def test_lloyd_separates_two_clouds():
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(0, 1, (20, 2)), rng.normal(50, 1, (20, 2))])
    _, lab = C.lloyd(p, p[[0, 1]])
    assert len(set(lab[:20])) == 1 and len(set(lab[20:])) == 1 and lab[0] != lab[-1]


def test_repair_stops_in_band_and_takes_the_nearer_of_equal_gains():
    p, w = np.array([[0.0, 0], [1, 0], [2, 0], [5, 0]]), np.array([4.0, 3, 3, 4])
    near = [[1], [0, 2], [1, 3], [2]]
    balanced = np.array([0, 0, 1, 1])
    assert A.repair(p, w, balanced, 2, near).tolist() == balanced.tolist()  # 7 and 7: nothing to do
    p = np.array([[0.0, 0], [0, 3], [0, 1], [9, 0]])
    w, lab = np.array([5.0, 3, 3, 1]), np.array([0, 0, 0, 1])
    near = [[1, 2], [0, 3], [0, 3], [1, 2]]
    fixed = A.repair(p, w, lab, 2, near, moves=1, centers=np.array([[0.0, 0], [0.0, 0.5]]))
    assert fixed.tolist() == [0, 0, 1, 1]  # both lower the deviation alike, unit 2 is nearer


@pytest.mark.parametrize("seed", range(6))
def test_milp_with_heavy_units_against_enumeration(seed):
    """Bands that bite, so bounds, eliminations and branching all take part."""
    rng = np.random.default_rng(100 + seed)
    n, k = 9, 3
    p, w, c = rng.random((n, 2)) * 1000, rng.integers(1, 12, n).astype(float), rng.random((k, 2)) * 1000
    home, lam, eps = A.nearest(p, c), 300.0, 0.12
    cost = (A.distances(p, c) + lam * (np.arange(k) != home[:, None])) * w[:, None]
    lo, hi = math.ceil(w.sum() / k * (1 - eps) - 1e-9), math.floor(w.sum() / k * (1 + eps) + 1e-9)
    best = math.inf
    for lab in everything(n, k):
        load = np.bincount(lab, weights=w, minlength=k)
        if load.min() >= lo and load.max() <= hi:
            best = min(best, cost[np.arange(n), list(lab)].sum())
    lab, log = A.assign_milp(p, w, c, eps, home, lam)
    if math.isinf(best):
        assert log["status"] == "infeasible"
    else:
        assert log["status"] == "optimal" and best - 1e-6 <= cost[np.arange(n), lab].sum() <= best * 1.0011


def test_knapsack_bounds_never_exceed_the_best_whole_assignment():
    rng = np.random.default_rng(7)
    for _ in range(5):
        n, k = 8, 3
        w, whole = rng.integers(1, 9, n).astype(float), rng.random((n, k)) * 100
        lo, hi = math.ceil(w.sum() / k * 0.85), math.floor(w.sum() / k * 1.15)
        costs = {lab: whole[np.arange(n), list(lab)].sum() for lab in everything(n, k)
                 if all(lo <= x <= hi for x in np.bincount(lab, weights=w, minlength=k))}
        if not costs:
            continue
        sacks, best = A._Knapsacks(whole, w, lo, hi), min(costs.values())
        top, _, _, layout, _ = sacks.improve(np.ones((n, k), bool), whole.min(1), best, 40, 1.0)
        assert top <= best + 1e-6
        forced = sacks.forced(top, layout)
        for i in range(n):
            for d in range(k):
                own = min((v for lab, v in costs.items() if lab[i] == d), default=math.inf)
                assert forced[i, d] <= own + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_two_opt_ends_where_no_exchange_helps(seed):
    rng = np.random.default_rng(seed)
    p = rng.random((25, 2))
    d = np.hypot(p[:, None, 0] - p[:, 0], p[:, None, 1] - p[:, 1])
    start = rng.permutation(25).tolist()
    tour = K.two_opt(start, d)
    assert sorted(tour) == list(range(25)) and K.length(d, tour) < K.length(d, start)
    for i in range(25):
        for j in range(i + 2, 25):
            other = tour[:i + 1] + tour[i + 1:j + 1][::-1] + tour[j + 1:]
            assert K.length(d, other) > K.length(d, tour) - 1e-8


def test_bootstrap_interval_against_drawing_blocks():
    rng = np.random.default_rng(1)
    sums, counts = rng.normal(3, 2, 30), rng.integers(1, 6, 30).astype(float)
    lo, hi = S.block_bootstrap(sums, counts, 20_000)
    means = []
    for _ in range(20_000):
        pick = rng.choice(30, 30)
        means.append(sums[pick].sum() / counts[pick].sum())
    want = np.quantile(means, (0.025, 0.975))
    assert abs(lo - want[0]) < 0.05 and abs(hi - want[1]) < 0.05


@pytest.mark.parametrize(("n", "k", "same"), [(40, 150, False), (72, 600, True), (60, 12, True)])
def test_transport_with_many_districts_is_optimal_and_quick(n, k, same):
    import time

    rng = np.random.default_rng(k)
    p, w = rng.random((n, 2)) * 12_000, rng.integers(200, 400, n).astype(float)
    c = p[rng.integers(0, n, k)] if same else rng.random((k, 2)) * 12_000
    cost, mean, began = A.distances(p, c), w.sum() / k, time.perf_counter()
    flow, ok = A.transport(cost, w, mean * 0.95, mean * 1.05)
    assert time.perf_counter() - began < 5
    load = flow.sum(0)
    assert ok and np.allclose(flow.sum(1), w) and (flow >= 0).all()
    assert load.min() >= mean * 0.95 - 1e-6 and load.max() <= mean * 1.05 + 1e-6
    dist, _, _ = A._paths(flow, cost)
    assert np.diag(dist).min() > -1e-5
    assert dist[np.ix_(load > mean * 0.95 + 1e-6, load < mean * 1.05 - 1e-6)].min() > -1e-5


@pytest.mark.parametrize("shape", [(60, 60), (40, 60), (60, 40)])
def test_matching_of_centres_at_few_places_costs_what_hungarian_says(shape):
    rng = np.random.default_rng(1)
    places = rng.random((9, 2))
    cost = A.distances(places[rng.integers(0, 9, shape[0])], places[rng.integers(0, 9, shape[1])])
    one, two = A.matching(cost), A.hungarian(cost)
    for got in (one, two):
        used = got[got >= 0]
        assert len(set(used.tolist())) == len(used) == min(shape)
    assert abs(sum(cost[i, j] for i, j in enumerate(one) if j >= 0) - sum(cost[i, j] for i, j in enumerate(two) if j >= 0)) < 1e-9


def test_seeds_are_those_of_single_draws():
    class Doubles:  # only draws of doubles, counted
        def __init__(self):
            self.own, self.calls = np.random.default_rng(5), 0

        def random(self, size=None):
            self.calls += 1
            return self.own.random(size)

    p, w = np.random.default_rng(1).integers(0, 4, (12, 2)).astype(float), np.arange(12.0)
    rng, plain = Doubles(), np.random.default_rng(5)
    chosen, near = [int(plain.choice(12, p=w / w.sum()))], np.full(12, np.inf)
    for _ in range(39):
        near = np.minimum(near, ((p - p[chosen[-1]]) ** 2).sum(1))
        mass = near * w
        chosen.append(int(plain.choice(12, p=mass / mass.sum() if mass.sum() > 0 else w / w.sum())))
    assert (C.kpp(p, w, 40, rng) == p[chosen]).all() and rng.calls <= 13


def test_an_assignment_that_moves_no_centre_is_not_made_again(monkeypatch):
    calls = []
    monkeypatch.setitem(C.ENGINES, "mcf", lambda p, w, c, eps: calls.append(c) or A.assign_lp(p, w, c, eps)[0])
    p = np.array([[0.0, 0.0], [9.0, 0.0]])
    lab, centers = C.cap_kmeans(p, np.ones(2), 2, start=p)
    assert lab.tolist() == [0, 1] and (centers == p).all() and len(calls) == 1


def test_places_are_matched_like_their_distances():
    rng = np.random.default_rng(2)
    for n, m, places in ((40, 40, 5), (12, 20, 9), (30, 17, 4), (6, 6, 100)):
        a, b = (rng.integers(0, places, (size, 1)) * np.array([3.0, 1.0]) for size in (n, m))
        cost, to = A.distances(a, b), A.match_places(a, b)
        plain = A.hungarian(cost)
        assert sorted(to[to >= 0].tolist()) == sorted(set(to[to >= 0].tolist())) and (to >= 0).sum() == min(n, m)
        total = [cost[np.flatnonzero(t >= 0), t[t >= 0]].sum() for t in (to, plain)]
        assert abs(total[0] - total[1]) < 1e-9 * max(1.0, total[1])


def test_bounds_that_bans_rule_out_are_told_at_once():
    cost = np.array([[1.0, A.FAR], [2.0, A.FAR]])
    tree = A._Tree(cost, np.ones(2), np.ones(2), np.full(2, 2.0))
    assert not tree.solve(50) and np.isfinite(tree.price).all() and np.isfinite(tree.flow).all()


def test_a_district_of_one_unit_has_its_place_to_the_last_bit():
    p = np.array([[0.1, 0.7], [2.0, 4.0], [4.0, 4.0]])
    out = C.recenter(p, np.array([3.0, 1.0, 1.0]), np.array([1, 0, 0]), np.zeros((3, 2)))
    assert (out == [[3.0, 4.0], [0.1, 0.7], [0.0, 0.0]]).all()


def test_a_remembered_tree_gives_the_optimum_in_fewer_pivots(monkeypatch):
    pivots, real = [], A._Tree._pivot
    monkeypatch.setattr(A._Tree, "_pivot", lambda self, *a: pivots.append(1) or real(self, *a))
    rng = np.random.default_rng(3)
    p, memory, warm, cold = rng.random((30, 2)) * 9000, A.Memory(), 0, 0
    centers = p[rng.integers(0, 30, 200)]
    home = rng.integers(0, 200, 30)
    own = A.Memory()
    for turn in range(8):
        w = rng.integers(50, 90, 30).astype(float)
        centers = centers.copy()
        centers[rng.integers(0, 200, 2)] = p[rng.integers(0, 30, 2)] + turn % 3
        pivots.clear()
        lab, cost = A.assign_lp(p, w, centers, memory=memory)
        warm, got = warm + len(pivots), len(pivots)
        pivots.clear()
        flow, ok = A.transport(A.distances(p, centers), w, w.sum() / 200 * 0.95, w.sum() / 200 * 1.05)
        cold += len(pivots)
        assert ok and got > 0 and abs(cost - (flow * A.distances(p, centers)).sum()) < 1e-6 * cost
        assert (flow[np.arange(30), lab] >= flow.max(1) - 1e-6).all()
        moved = A.distances(p, centers) + 700.0 * (np.arange(200) != home[:, None])
        flow, ok = A.transport(moved, w, w.sum() / 200 * 0.95, w.sum() / 200 * 1.05)
        assert abs(A.assign_lp(p, w, centers, home=home, lam=700.0, memory=own)[1] - (flow * moved).sum()) < 1e-6 * cost
    assert warm < cold


def test_points_at_one_place_are_matched_without_a_solver(monkeypatch):
    monkeypatch.setattr(A, "_matching", lambda *a: pytest.fail("solved"))
    b = np.array([[1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [7.0, 7.0]])
    assert A.match_places(b[[2, 1, 0]], b).tolist() == [0, 1, 2]


def test_a_day_that_is_infeasible_at_sight_remembers_its_relaxation():
    p, w, home, memory = np.arange(8.0).reshape(4, 2) * 100, np.array([90.0, 60.0, 70.0, 80.0]), np.array([0, 3, 6, 9]), A.Memory()
    centers = np.repeat(p, 5, axis=0)
    lab, log = A.assign_milp(p, w, centers, 1 / 7, home, 250.0, memory=memory)
    tree = memory.tree
    again = A.assign_milp(p, w[::-1], centers, 1 / 7, home, 250.0, memory=memory)[0]
    assert log["status"] == "infeasible" and log["fallback"] and memory.tree is tree is not None
    alone = A.assign_milp(p, w[::-1], centers, 1 / 7, home, 250.0)[0]
    assert (again == alone).all() and len(lab) == 4


def test_days_that_whole_units_cannot_fill_are_told_without_a_search():
    rng = np.random.default_rng(5)
    p, centers = rng.random((72, 2)) * 10_000, rng.random((42, 2)) * 10_000
    w = np.r_[np.full(46, 41.0), np.full(26, 20.0)]  # 46 units of more than half the upper bound, 42 districts
    lab, log = A.assign_milp(p, w, centers, 1 / 7, A.nearest(p, centers), 1000.0, time_limit=1.0)
    assert log["status"] == "infeasible" and log["fallback"] and len(lab) == 72


def test_certificates_never_deny_an_assignment_that_exists():
    from itertools import product

    rng, told = np.random.default_rng(0), {"counts": 0, "patterns": 0}
    for _ in range(300):
        n, k, eps = int(rng.integers(1, 7)), int(rng.integers(1, 4)), float(rng.choice([1 / 7, 0.05, 0.3]))
        w = rng.integers(0, 20, n).astype(float)
        lo, hi = A._whole_bounds(w, k, eps)
        if not 0 < lo <= hi:
            continue
        loads = [np.bincount(x, weights=w, minlength=k) for x in product(range(k), repeat=n)]
        fits = any(x.min() >= lo and x.max() <= hi for x in loads)
        counts, patterns = A.no_room(w, k, eps), A._no_parts(w, k, int(lo), int(hi))
        assert not (fits and (counts or patterns))
        told["counts"] += counts
        told["patterns"] += patterns and not counts
    assert told["counts"] > 20 and told["patterns"] > 5


def test_greedy_takes_pairs_by_distance():
    rng = np.random.default_rng(2)
    for n, k in ((30, 7), (5, 9), (40, 40)):
        p, c, w = rng.random((n, 2)), rng.random((k, 2)), rng.integers(1, 9, n).astype(float)
        room, want, d = np.full(k, w.sum() / k * 1.05), np.full(n, -1), A.distances(p, c)
        for flat in np.argsort(d, axis=None, kind="stable"):
            i, j = divmod(int(flat), k)
            if want[i] < 0 and w[i] <= room[j]:
                want[i], room[j] = j, room[j] - w[i]
        for i in np.flatnonzero(want < 0):
            want[i] = room.argmax()
            room[want[i]] -= w[i]
        assert (A.assign_greedy(p, w, c) == want).all()
