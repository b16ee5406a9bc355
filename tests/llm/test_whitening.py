import math
import random
from fractions import Fraction

import numpy as np
import pytest

from hazecast.llm import whitening


def table(spark, vectors, kind="float"):
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string")


def brute_polynomial(a):
    """Coefficients of det(x - a), by traces of powers in fractions."""
    d = len(a)
    identity = [[Fraction(i == j) for j in range(d)] for i in range(d)]
    m, out = [[Fraction(0)] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + out[-1] * identity[i][j] for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(c) for c in out]


def scatter(rows):
    n, d = len(rows), len(rows[0])
    return [[n * sum(r[i] * r[j] for r in rows) - sum(r[i] for r in rows) * sum(r[j] for r in rows)
             for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,size,seed", [(1, 9, 0), (2, 50, 1), (5, 10**6, 2), (7, 3, 3), (9, 2, 4)])
def test_polynomial_equals_brute_force(spark, d, size, seed):
    draw = random.Random(seed)
    a = scatter([[draw.randint(-size, size) for _ in range(d)] for _ in range(6)])
    wanted = [c if k % 2 == 0 else -c for k, c in enumerate(brute_polynomial(a))]
    assert whitening.characteristic_polynomial(spark, a) == wanted


def test_polynomial_modulo_small_primes():
    """Zero pivots happen all the time modulo small primes."""
    draw = random.Random(7)
    for d in (1, 2, 3, 6):
        a = [[draw.randint(-4, 4) for _ in range(d)] for _ in range(d)]
        primes = [2, 3, 5, 7, 11]
        got = whitening.polynomials_modulo(np.array(a, dtype=object), primes)
        assert got.tolist() == [[c % p for c in brute_polynomial(a)] for p in primes]


def test_roots_with_multiplicity():
    sums = [1]
    for root in (0, 0, 3, 3, 3, 10, 10**12, 10**12 + 1):  # e_k of these numbers
        sums = [a + b * root for a, b in zip([*sums, 0], [0, *sums])]
    got = whitening.largest_roots(sums, 8)
    assert [many for _, many in got] == [1, 1, 1, 3]
    assert all(abs(r / w - 1) < Fraction(1, 1 << 199) for (r, _), w in zip(got, (10**12 + 1, 10**12, 10, 3)))
    assert [m for _, m in whitening.largest_roots(sums, 2)] == [1, 1]
    assert whitening.largest_roots([1, 0, 0], 3) == []


def test_close_and_repeated_eigenvalues():
    a = [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 10**14, 1], [0, 0, 1, 10**14]]
    roots = whitening.largest_roots([c if k % 2 == 0 else -c for k, c in enumerate(brute_polynomial(a))], 4)
    assert [m for _, m in roots] == [1, 1, 2]
    first, second = (whitening.null_space(a, r, m)[0] for r, m in roots[:2])
    half = math.sqrt(0.5)
    assert np.allclose(first, [0, 0, half, half], atol=1e-15) and np.allclose(np.abs(second), [0, 0, half, half], atol=1e-15)
    plane = np.array(whitening.null_space(a, roots[2][0], 2))
    assert np.allclose(plane @ plane.T, np.eye(2)) and np.allclose(plane[:, 2:], 0, atol=1e-15)


def check(rows, vectors, most=8):
    """Returned rows against doubles and whole numbers computed here."""
    x = [[math.floor(1024 * float(np.float64(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(Fraction(c, n * n)) for c in row] for row in scatter(x)])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    assert {r.component for r in rows} == set(range(1, k + 1)) and len(rows) == k * n
    whitened = np.array([r.whitened for r in sorted(rows, key=lambda r: (r.vec_id, r.component))]).reshape(n, k)
    assert np.allclose(np.cov(whitened.T, bias=True).reshape(k, k), np.eye(k), atol=1e-9)
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    # eigenvectors up to sign: whitened = centred v / sqrt(e), so cov v = e v
    for c in range(k):
        v = np.linalg.lstsq(centred, whitened[:, c], rcond=None)[0]
        assert np.allclose(cov @ v, values[c] * v, atol=1e-6 * values[0] * np.abs(v).max())
    ids = sorted({r.vec_id for r in rows})
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip(ids, x)}
    assert all(r.n == n and r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in rows)
    assert all(abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    vectors = [[float(np.float32(c)) for c in v] for v in draw.normal(size=(200, 12)) * np.arange(1, 13)]
    check(whitening.components(table(spark, vectors).repartition(3)).collect(), vectors)


def test_fewer_dimensions_and_rank(spark):
    draw = np.random.default_rng(4)
    flat = [[float(a), float(a), float(b), 5.0] for a, b in draw.integers(-9, 9, (50, 2))]
    check(whitening.components(table(spark, flat, "double")).collect(), flat)


def test_large_entries(spark):
    draw = np.random.default_rng(5)
    big = [[float(a), float(b)] for a, b in draw.normal(size=(30, 2)) * [1e14, 1e13]]
    check(whitening.components(table(spark, big, "double")).collect(), big)


def test_what_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 0.0, 0.0], [2.0, -1.0, 4.0], [1.0, 2.0, 0.5], [3.0, 3.0, 3.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 0.0, 0.0], [-inf, 0.0, 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = whitening.components(table(spark, good + bad, "double")).collect()
    assert {r.vec_id for r in rows} == set(range(5)) and {r.component for r in rows} == {1, 2, 3}
    check(rows, good)


def test_nothing_to_whiten(spark):
    assert whitening.components(table(spark, [])).count() == 0
    assert whitening.components(table(spark, [[1.0, 2.0]] * 7)).count() == 0
    with_null = table(spark, [[1.0, 2.0], [2.0, 5.0], [0.0, 1.0]]).selectExpr(
        "nullif(vec_id, 1) AS vec_id", "embedding", "component")
    assert sorted(str(r.vec_id) for r in whitening.components(with_null).filter("component = 1").collect()) == ["0", "2", "None"]
