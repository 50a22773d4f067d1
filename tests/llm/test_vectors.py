"""Operators on embeddings against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math

import numpy as np
import pytest

from domweave.llm import components, near_vectors, vector_codes, whitening
from domweave.session import configure

BAD = [None, [], [None, 1.0, 2.0, 3.0] * 2, [math.nan] * 8, [math.inf] + [0.0] * 7, [1.0, 2.0, 3.0]]


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    configure(spark)


def vectors(n, dims, seed=0):
    return np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32)


def table(spark, rows):
    """rows (vec_id, embedding, label) with columns named like the operators' own."""
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], label, "other", 7) for i, v, label in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, n long").repartition(3)


def whole(vector, scale):
    return np.floor(np.asarray(vector, np.float32).astype(float) * scale).astype(np.int64)


@pytest.mark.parametrize("seed, kinds", [(0, 50), (1, 3), (2, 1)])
def test_trie_equals_all_distances(seed, kinds):
    random = np.random.default_rng(seed)
    parts = np.unique(random.integers(-kinds, kinds, (700, 5)), axis=0)
    book = random.integers(-kinds, kinds, (40, 5))
    book[7] = book[3]  # ties go to the lower entry
    entry, distance = vector_codes.nearest_entries(parts, book)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_trie_with_large_numbers():
    parts = np.unique(np.random.default_rng(3).integers(-vector_codes.BOUND, vector_codes.BOUND, (60, 16)), axis=0)
    book = parts[::7] + 1
    entry, distance = vector_codes.nearest_entries(parts, book)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def codes_by_hand(rows, parts, entries, rounds):
    own = [(i, whole(v, 1024), label) for i, v, label in rows]
    ids = sorted({i for i, _, _ in own if i is not None})[:entries]
    start = np.array([min(tuple(x) for j, x, _ in own if j == i) for i in ids])
    dims = start.shape[1]
    cuts = [(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]
    books = [start[:, a:b].copy() for a, b in cuts]
    matrix = np.array([x for _, x, _ in own])

    def assigned():
        for (a, b), book in zip(cuts, books):
            d = ((matrix[:, None, a:b] - book[None]) ** 2).sum(axis=2)
            yield d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for (a, b), book, (entry, _) in zip(cuts, books, list(assigned())):
            for e in set(entry.tolist()):
                book[e] = matrix[entry == e, a:b].sum(axis=0) // (entry == e).sum()
    last = list(assigned())
    error = sum(d for _, d in last)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel()).encode()).hexdigest()
    per_label = {}
    for (_, _, label), e in zip(own, error):
        per_label[label] = per_label.get(label, 0) + int(e)
    return [(i, "".join(f"{e[k]:02x}" for e, _ in last), int(error[k]), per_label[label], digest) for k, (i, _, label) in enumerate(own)]


def test_codes(spark):
    v = vectors(150, 8)
    good = [(i, v[i], None if i % 7 == 0 else i % 3) for i in range(150)]
    good += [(200 + i, v[5], 1) for i in range(60)]  # a hot vector
    good += [(3, v[9], 2), (4, v[4], 1), (None, v[11], None), (300, [0.0] * 8, 0), (301, [-1e-9] * 8, 0)]
    got = vector_codes.compress(table(spark, good + [(1000 + k, b, 1) for k, b in enumerate(BAD)]), entries=20, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(codes_by_hand(good, 4, 20, 3), key=str)


def test_codes_of_odd_lengths_and_huge_components(spark):
    v = vectors(40, 7)
    rows = [(i, v[i], 0) for i in range(40)]
    assert sorted(map(tuple, vector_codes.compress(table(spark, rows), entries=5).collect())) == sorted(codes_by_hand(rows, 4, 5, 4))
    huge = vector_codes.compress(table(spark, [(1, [3e38, -3e38] * 4, 0), (2, [0.0] * 8, 0)]), entries=1, rounds=0).collect()
    assert {r.vec_id: r.error for r in huge} == {1: 0, 2: 8 * (1 << 54)}


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(None, [1.0, 2.0], 0)]])
def test_codes_of_nothing(spark, rows):
    assert vector_codes.compress(table(spark, rows)).collect() == []


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


@pytest.mark.parametrize("x", [
    np.floor(vectors(200, 12) * 40 * np.linspace(1, 0.1, 12)), np.ones((5, 4)), np.eye(6) * 3, np.repeat(np.arange(12.0).reshape(4, 3), 3, axis=0),
    np.array([[0, 0, 0], [1e6, 0, 0], [1, 1e-3, 0]]), np.array([[1e9, 1], [1e9, 2], [1e9 + 1, 1]]), np.zeros((4, 3)), np.arange(9.0).reshape(9, 1),
    np.kron(np.eye(8), np.ones((3, 1))) * 5,
])
def test_spectrum_is_that_of_the_scatter(x):
    own, rest = whitening.Spectrum.empty(x.shape[1]), whitening.Spectrum.empty(x.shape[1])
    for row in x[: len(x) // 3]:
        own.add(row)
    for row in x[len(x) // 3 :]:
        rest.add(row)
    own.combine(rest)
    want = scatter(x)
    assert np.abs(own.vectors * own.values @ own.vectors.T - want).max() <= 1e-12 * max(np.abs(want).max(), 1e-300)
    assert np.abs(own.vectors.T @ own.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.allclose(own.mean, x.mean(axis=0)) and own.n == len(x)


def test_whitening(spark):
    v = vectors(400, 10, 5) * np.linspace(1, 0.2, 10, dtype=np.float32)
    good = [(i, v[i], 0) for i in range(400)] + [(500 + i, v[8], 0) for i in range(300)] + [(7, v[7], 0), (None, v[3], 0)]
    got = whitening.whiten(table(spark, good + [(1000 + k, b, 1) for k, b in enumerate(BAD)]), rows_per_task=9)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.array([whole(e, 256) for _, e, _ in good])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(scatter(fit.astype(float)) / n)
    values, basis = values[::-1], basis[:, ::-1]
    found = got.collect()
    assert len(found) == 4 * len(good) and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-10
    deviation = ((n * x - total) ** 2).sum(axis=1)
    for c in range(4):
        white = (x - total / n) @ basis[:, c] / np.sqrt(values[c])
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in found if r.component == c + 1)
        errors = [max(abs(m[2] - w[2]) for m, w in zip(mine, sorted((str(g[0]), d, s * o) for g, d, o in zip(good, deviation.tolist(), white)))) for s in (1, -1)]
        assert min(errors) < 1e-10
        assert {m[:2] for m in mine} == {(str(g[0]), d) for g, d in zip(good, deviation.tolist())}
        assert all(abs(r.explained - values[c] / values.sum()) < 1e-12 for r in found if r.component == c + 1)


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, None, 0)], 0), ([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], 0), ([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0), (None, [1.0, 2.0], 0)], 1),
    ([(i, [i * 1.0, i * i * 1.0, 0.0], 0) for i in range(5)], 2),
])
def test_whitening_of_few_directions(spark, rows, components):
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == components * len(rows) and all(r.identity_error < 1e-10 for r in got)


def test_large_deviations_are_exact_or_null(spark):
    rows = [(0, [5e5, 0.0], 0), (1, [-5e5, 0.0], 0), (2, [0.0, 1.0], 0), (3, [8e6, 0.0], 0)]
    x = [[int(c) for c in whole(v, 256)] for _, v, _ in rows]
    total = [sum(c) for c in zip(*x)]
    want = [sum((4 * c - t) ** 2 for c, t in zip(row, total)) for row in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    assert got == {i: d if d < 1 << 63 else None for i, d in enumerate(want)}


def test_recall_is_calibrated():
    for n in (500, 50_000):
        projections, least, count = near_vectors.calibrate(n, 0.95, 0.995)
        chance = near_vectors.collision_chance(least, 0.95)
        assert near_vectors.recall_of(projections, chance, count) >= 0.995 > near_vectors.recall_of(projections, chance, count + 1)
    # the chance against a trial
    random = np.random.default_rng(1)
    a = random.standard_normal(2_000_000)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * random.standard_normal(len(a))
    seen = 2 * np.mean((a >= 1.5) & (b >= 1.5) & (np.abs(a - b) <= near_vectors.WINDOW))
    assert abs(seen - near_vectors.collision_chance(1.5, 0.95)) < 2e-3


def links_by_hand(rows, cosine):
    dims = next(len(v) for _, v, _ in sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0)))
    own = [np.array(v, np.float32).astype(float) if usable(v) and len(v) == dims else None for _, v, _ in rows]
    good = [k for k, v in enumerate(own) if v is not None]
    matrix = np.array([own[k] for k in good])
    length = np.sqrt((matrix**2).sum(axis=1))
    linked = matrix @ matrix.T / (length[:, None] * length[None, :]) >= cosine
    np.fill_diagonal(linked, False)
    group = list(range(len(good)))
    for i, j in zip(*np.nonzero(linked)):
        if group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    out = [(i, 0, i, i is not None) for i, _, _ in rows]
    for at, k in enumerate(good):
        ids = [rows[good[m]][0] for m in range(len(good)) if group[m] == group[at] and rows[good[m]][0] is not None]
        least, i = min(ids, default=None), rows[k][0]
        out[k] = (i, int(linked[at].sum()), least, i is not None and i == least)
    return out


def usable(v):
    return bool(v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v))


def near_table(seed):
    """Random rows, pairs at and around the threshold, a crowd of near copies, one of exact copies, a chain."""
    random = np.random.default_rng(seed)
    v = random.standard_normal((300, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, v[i], 0) for i in range(300)]

    def at(base, cosine):
        away = random.standard_normal(24)
        away -= away @ base * base
        return cosine * base + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)

    rows += [(400 + k, at(v[k], 0.94 + 0.0013 * k) * (k + 1), 0) for k in range(40)]
    rows += [(500 + k, at(v[50], 0.998), 0) for k in range(250)]
    rows += [(800 + k, at(v[51], 0.975), 0) for k in range(60)]
    rows += [(900 + k, v[52], 0) for k in range(200)]
    step = v[53]
    for k in range(25):
        step = at(step, 0.97)
        rows.append((1200 - k, step, 0))
    return rows


def test_near_duplicates(spark):
    rows = near_table(4) + [(5, near_table(4)[5][1], 0), (5, near_table(4)[8][1], 0), (None, near_table(4)[9][1], 0), (None, [0.5] * 24, 0)]
    rows += [(2000 + k, b, 1) for k, b in enumerate(BAD)] + [(2100, [0.0] * 24, 0), (2101, [0.0] * 24, 0), (None, [0.0] * 24, 0)]
    frame = table(spark, rows)
    rows = [(r.vec_id, r.embedding, 0) for r in frame.collect()]
    want = links_by_hand(rows, 0.95)
    found = near_vectors.near_duplicates(frame)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = list(map(tuple, found.collect()))
    assert len(got) == len(want)
    links = sum(w[1] for w in want)
    # nothing false, and nearly every link
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1]))):
        assert g[0] == w[0] and g[1] <= w[1]
    assert sum(g[1] for g in got) >= 0.995 * links
    same = sum(g == w for g, w in zip(sorted(got, key=str), sorted(want, key=str)))
    assert same >= 0.97 * len(want)


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    steps, keep = [], near_vectors.written
    for module in (near_vectors, components):
        monkeypatch.setattr(module, "written", lambda rows, *a, **b: steps.append(rows) or keep(rows, *a, **b))
    steps.append(near_vectors.near_duplicates(table(spark, near_table(5))))
    plans = [s._jdf.queryExecution().executedPlan().toString() for s in steps]
    assert len(plans) > 12 and sum("SortMergeJoin" in p for p in plans) > 6 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("broadcast", [True, False])
def test_components_joined_either_way(spark, broadcast):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 6), (9, 9), (None, 4), (5, 7), (2, 1)], "a long, b long")
    got = sorted(map(tuple, components.connected_components(edges, broadcast=broadcast).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5)]


@pytest.mark.parametrize("rows", [[], [(1, None, 0), (2, [], 0)], [(3, [1.0, 0.0], 0)], [(3, [1.0], 0), (4, [2.0], 0), (5, [-1.0], 0)]])
def test_near_duplicates_of_little(spark, rows):
    got = sorted(map(tuple, near_vectors.near_duplicates(table(spark, rows)).collect()))
    want = [(i, 0, i, True) for i, _, _ in rows]
    if len(rows) == 3:
        want = [(3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]
    assert got == want
