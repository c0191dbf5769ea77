import itertools
import math
import random

import numpy as np
import pytest

from shapeloom.functions import kernels as K


def test_canonical_worked_example():
    form = K.canonical([0, 1, 2], np.array([(0.0, 0.0), (3.0, 0.0), (1.0, 2.0)]), [(0, 1), (1, 2), (0, 2)], 0.05)
    assert form.key[0] == ((0, 0), (5, -15), (20, 0)) and form.order == (2, 0, 1)


def test_canonical_ignores_placement_and_labels():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(5, 2))
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (1, 3)]
    key = K.canonical(range(5), points, edges, 0.05).key
    a, s = 1.1, 2.3
    moved = s * points @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + [-4, 7]
    assert K.canonical(range(5), moved, edges, 0.05).key == key
    assert K.canonical(range(5), points * [1, -1], edges, 0.05).key != key
    new = [3, 0, 4, 1, 2]
    relabelled = np.empty_like(points)
    relabelled[new] = points
    assert K.canonical(range(5), relabelled, [(new[u], new[w]) for u, w in edges], 0.05).key == key


def test_zero_length_edges_have_no_form():
    with pytest.raises(ValueError):
        K.canonical([0, 1], np.zeros((2, 2)), [(0, 1)], 0.05)


def test_hull():
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)]
    assert K.hull_area(np.array(square)) == pytest.approx(4) and len(K.hull(np.array(square))) == 4
    assert K.hull_area(np.array([(0, 0), (1, 1), (2, 2)])) == 0


def test_grid_cells():
    grid = K.Grid()
    assert grid.cell(0, 0) is None and grid.cell(3.1, 0) is None and grid.cell(1.0, -1e-17)[0] == 9
    for ai, di in itertools.product(range(10), range(12)):
        assert grid.cell(*grid.center(ai, di)) == (ai, di)


@pytest.mark.parametrize("seed", range(5))
def test_exact_cover_is_the_first_of_the_largest(seed):
    rng = random.Random(seed)
    sets = [frozenset(rng.sample(range(14), 3)) for _ in range(11)]
    fits = [c for n in range(len(sets) + 1) for c in itertools.combinations(range(len(sets)), n) if sum(len(sets[i]) for i in c) == len(frozenset().union(*(sets[i] for i in c)))]
    best = max(map(len, fits))
    assert K.cover(sets) == list(min(c for c in fits if len(c) == best))


@pytest.mark.parametrize("seed", range(3))
def test_greedy_cover_takes_the_least_conflicting(seed):
    rng = random.Random(seed)
    sets = [frozenset(rng.sample(range(120), 3)) for _ in range(90)]
    left, chosen = set(range(90)), []
    while left:
        i = min(left, key=lambda k: (sum(1 for j in left if j != k and sets[j] & sets[k]), k))
        chosen.append(i)
        left -= {j for j in left if sets[j] & sets[i]}
    assert K.cover(sets) == sorted(chosen)


def test_fit():
    rng = np.random.default_rng(0)
    src = rng.normal(size=(6, 2))
    a = np.array([[1.2, -0.5], [0.5, 1.2]])
    matrix, shift, rms = K.fit(src, src @ a.T + [3, 4])
    assert np.allclose(matrix, a) and np.allclose(shift, [3, 4]) and rms < 1e-12
    mirrored = src * [1, -1]
    assert K.fit(src, mirrored)[2] > 0.1 and K.fit(src, mirrored, allow_reflection=True)[2] < 1e-12
    with pytest.raises(ValueError):
        K.fit(src[:1], src[:1])


def test_bandpass_keeps_the_band():
    t = np.arange(1600) / 160
    slow, fast = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 40 * t)
    assert np.abs(K.bandpass(slow + fast, 160, 8, 13) - slow).max() < 0.1


def test_dissolve():
    assert K.dissolve_degree2({0: {1}, 1: {0, 2}, 2: {1, 3}, 3: {2}}) == {(0, 3)}
    assert K.dissolve_degree2({0: {1}, 1: {0, 2, 3}, 2: {1}, 3: {1}}) == {(0, 1), (1, 2), (1, 3)}
    assert K.dissolve_degree2({i: {(i - 1) % 5, (i + 1) % 5} for i in range(5)}) == {(3, 4)}


def edf_bytes(samples, dig=(-100, 100), phys=(-1.0, 1.0), seconds=2):
    n, records = len(samples[0]), 2
    head = "0".ljust(8) + " " * 80 + " " * 80 + "01.01.0001.01.01" + str(256 * (len(samples) + 1)).ljust(8) + " " * 44 + str(records).ljust(8) + str(seconds).ljust(8) + str(len(samples)).ljust(4)
    column = lambda v, w: "".join(str(v).ljust(w) for _ in samples)
    head += column("EEG", 16) + column("", 80) + column("uV", 8) + column(phys[0], 8) + column(phys[1], 8) + column(dig[0], 8) + column(dig[1], 8) + column("", 80) + column(n // records, 8) + column("", 32)
    body = b"".join(np.array(s[r * n // records : (r + 1) * n // records], "<i2").tobytes() for r in range(records) for s in samples)
    return head.encode("latin1") + body


def test_edf():
    samples = [[0, 50, -50, 100], [1, 2, 3, 4]]
    x, fs = K.edf_channel(edf_bytes(samples), 0)
    assert x.tolist() == [0.0, 0.5, -0.5, 1.0] and fs == 1.0
    assert K.edf_channel(edf_bytes(samples), 1)[0].tolist() == pytest.approx([0.01, 0.02, 0.03, 0.04])
    with pytest.raises(IndexError):
        K.edf_channel(edf_bytes(samples), 2)


def test_degree2_sweeps_like_one_vertex_after_another():
    """Against plain sweeps: ascending ids, again and again until nothing changes."""
    for seed in range(300):
        rng = random.Random(seed)
        n = rng.randint(2, 14)
        links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 16))}
        near = {v: {b if a == v else a for a, b in links if v in (a, b)} for v in range(n)}
        near = {v: x for v, x in near.items() if x}
        plain, changed = {v: set(x) for v, x in near.items()}, True
        while changed:
            changed = False
            for v in sorted(plain):
                if len(plain[v]) == 2:
                    one, other = plain.pop(v)
                    plain[one] = plain[one] - {v} | {other}
                    plain[other] = plain[other] - {v} | {one}
                    changed = True
        assert K.dissolve_degree2(near) == {(v, w) for v, x in plain.items() for w in x if v < w}, seed


@pytest.mark.parametrize("n", [2, 3, 5, 7])
def test_batches_have_the_forms_of_single_patterns(n):
    rng = np.random.default_rng(n)
    points = rng.integers(0, 3, (200, n, 2)) + rng.choice([0.0, 0.3], (200, n, 2))
    points[:, -1] += 7  # edge 0-(n-1) has a length
    linked = np.triu(rng.random((200, n, n)) < 0.5, 1)
    linked[:, 0, -1] = True
    linked |= linked.transpose(0, 2, 1)
    forms, one, other = K.canonical_batch(points, linked, 0.07), *np.triu_indices(n, 1)
    for b in range(200):
        single = K.canonical(range(n), points[b], list(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(linked[b]))), strict=True)), 0.07)
        links = tuple((int(one[k]), int(other[k])) for k in np.flatnonzero(forms.links[b]))
        assert (tuple(map(tuple, forms.cells[b].tolist())), links) == single.key


def test_added_areas_are_differences_of_hulls():
    rng, grid = np.random.default_rng(0), K.Grid()
    others = np.array([grid.center(a, d) for a in range(grid.n_angle) for d in range(grid.n_dist)])
    for points in (rng.normal(size=(6, 2)), np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[0.0, 0.0], [0.5, 0.0], [1.0, 0.0]])):
        apart = [K.hull_area(np.array([*points, p])) - K.hull_area(points) for p in others]
        assert np.allclose(K.added_areas(points, others), apart, atol=1e-9)


def test_cells_of_many_points():
    points, grid = np.random.default_rng(2).normal(size=(500, 2)) * 2, K.Grid()
    within, ai, di = grid.cells(points)
    assert [(int(a), int(d)) if w else None for w, a, d in zip(within, ai, di, strict=True)] == [grid.cell(x, y) for x, y in points]
