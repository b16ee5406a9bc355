"""Whitening of embeddings from an exact characteristic polynomial.

Entries become integers, so the scatter matrix of all vectors is one of integers, summed
exactly over the table in one pass. Its characteristic polynomial is computed modulo many
primes, each by reduction to Hessenberg form, in a Spark job with a row per prime, and put
together by Chinese remaindering. All roots of it are real and none is negative, so the
changes of sign of its coefficients, moved to a point, count the roots above that point:
the largest roots are cut apart by that count and narrowed to 200 bits. Inverse iteration
in 120 digits then finds the null space of the matrix less a root: the components.

Only numbers of the order of (dimension squared) reach the driver, however many vectors.
"""

import decimal
import random
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map, stored

SCALE, SHIFT = 1024, 100000
LIMIT = float(1 << 62)
LIMB = 60
ROOT_BITS = 200
DIGITS = 120


# --- the table -------------------------------------------------------------------------

def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) of the vectors that take part, as doubles; see ``fit``."""
    v = F.col("vec")
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(float(SCALE)) < F.lit(LIMIT)))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vec")).filter(
        v.isNotNull() & (F.size("vec") > 0) & fits)
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (usual["n"] if usual else -1))


def _whole(column: pa.Array) -> np.ndarray:
    """floor(1024 * c) of each entry, a row per vector."""
    entries = np.asarray(column.flatten(), dtype=np.float64)
    return np.floor(entries * SCALE).astype(np.int64).reshape(len(column), -1)


def _products(rows: np.ndarray) -> np.ndarray:
    """rows^T rows as exact integers: doubles as long as every sum fits them."""
    most = int(np.abs(rows).max(initial=0))
    step = (1 << 53) // max(1, most * most)
    if step < 1:
        exact = rows.astype(object)
        return exact.T @ exact
    total = np.zeros((rows.shape[1],) * 2, dtype=object)
    for at in range(0, len(rows), step):
        part = rows[at:at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def moments(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products over all vectors, exact.

    Each task sends one row per pair of dimensions. A number travels as three limbs of 60
    bits, whose sums over any number of tasks fit a decimal.
    """
    def sums(batches):
        n, total, products = 0, None, None
        for batch in batches:
            if batch.num_rows:
                y = _whole(batch.column(0))
                if total is None:
                    total, products = np.zeros(y.shape[1], dtype=object), np.zeros((y.shape[1],) * 2, dtype=object)
                n += len(y)
                total = total + y.astype(object).sum(axis=0)
                products = products + _products(y)
        if n:
            d = len(total)
            cells = [(-1, -1, n), *[(-1, j, int(total[j])) for j in range(d)],
                     *[(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]]
            mask = (1 << LIMB) - 1
            out = [(i, j, v & mask, v >> LIMB & mask, v >> 2 * LIMB) for i, j, v in cells]
            yield pa.RecordBatch.from_pydict(dict(zip(("i", "j", "a", "b", "c"), zip(*out))),
                                             pa.schema([("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()),
                                                        ("b", pa.int64()), ("c", pa.int64())]))

    parts = arrow_map(rows.select("vec"), sums, "i int, j int, a long, b long, c long")
    cells = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "abc"]).collect()
    value = {(r.i, r.j): int(r.a) + (int(r.b) << LIMB) + (int(r.c) << 2 * LIMB) for r in cells}
    n = value.pop((-1, -1), 0)
    d = sum(i < 0 for i, _ in value)
    return n, [value[-1, j] for j in range(d)], [[value[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]


# --- the characteristic polynomial ----------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.2e9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product passes ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomials_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo each prime, the highest power first.

    ``matrix`` holds integers of any size. Primes lie below 2^31, so products fit 64 bits.
    All primes are reduced together, each with pivots of its own.
    """
    d, count = len(matrix), len(primes)
    p = np.array(primes, dtype=np.int64)
    h = np.stack([(matrix % q).astype(np.int64) for q in primes]).reshape(count, d, d)
    each = np.arange(count)
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1:, k] != 0, axis=1)  # k + 1 if the column is done
        h[each, pivot], h[:, k + 1] = h[:, k + 1].copy(), h[each, pivot].copy()
        swapped = h[each, :, pivot].copy()
        h[each, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = swapped
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(h[:, k + 1, k], primes)], dtype=np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % p[:, None]
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, k + 1][:, None, :] % p[:, None, None]) % p[:, None, None]
        gained = (h[:, :, k + 2:] * factor[:, None, :] % p[:, None, None]).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + gained) % p[:, None]
    # leading minors: polynomial m from those before it, constant term first
    minors = [np.zeros((count, d + 1), dtype=np.int64)]
    minors[0][:, 0] = 1 % p
    for m in range(d):
        last = minors[m]
        new = np.roll(last, 1, axis=1) - h[:, m, m][:, None] * last % p[:, None]
        chain = np.ones(count, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new = new - (h[:, i, m] * chain % p)[:, None] * minors[i] % p[:, None]
            if i % 64 == 0:
                new %= p[:, None]
        minors.append(new % p[:, None])
    return minors[d][:, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Sums e_0 .. e_d of products of eigenvalues of a positive semidefinite integer matrix.

    det(x - matrix) = sum (-1)^k e_k x^(d-k). A principal minor is at most the product of its
    diagonal (Hadamard), so e_k is at most that of the diagonal: it says how many primes do.
    """
    d = len(matrix)
    bounds = [1] + [0] * d
    for i in range(d):
        for k in range(i + 1, 0, -1):
            bounds[k] += bounds[k - 1] * matrix[i][i]
    primes = primes_for(max(bounds))

    def residues(frames):
        whole = np.array(matrix, dtype=object).reshape(d, d)
        for frame in frames:
            mine = frame["prime"].tolist()
            if mine:
                yield pd.DataFrame({"prime": mine, "residues": list(polynomials_modulo(whole, mine))})

    tasks = min(len(primes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(tasks).mapInPandas(
        residues, "prime long, residues array<long>").collect()
    product = 1
    for q in primes:
        product *= q
    sums = [0] * (d + 1)
    for r in rows:
        others = product // r.prime
        weight = others * pow(others, -1, r.prime)
        for k, x in enumerate(r.residues):
            sums[k] += (-x if k % 2 else x) * weight
    return [s % product for s in sums]


# --- its largest roots ------------------------------------------------------------------

def _above(sums: list[int], at: int, bits: int) -> int:
    """How many roots lie above at / 2^bits, repeated roots repeatedly.

    A polynomial with real roots alone has as many positive ones as its coefficients change
    sign; here the coefficients of it moved by the point, scaled to whole numbers.
    """
    c = [(-s if k % 2 else s) << bits * k for k, s in enumerate(sums)]
    for end in range(len(c), 1, -1):
        for k in range(1, end):
            c[k] += c[k - 1] * at
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(sums: list[int], at: int, bits: int) -> int:
    """Sign of the polynomial at a point."""
    value = 0
    for k, s in enumerate(sums):
        value = value * at + ((-s if k % 2 else s) << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(sums: list[int], most: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) in falling order until ``most`` roots or no positive ones are left.

    A root is known to 200 bits; roots that agree in them count as one. The last multiplicity
    may pass ``most``.
    """
    sums = list(sums)
    while len(sums) > 1 and sums[-1] == 0:
        sums.pop()  # a root at 0
    if len(sums) == 1:
        return []
    found, have = [], 0
    # intervals (low, high] / 2^bits with the counts above both ends, the highest on top
    waiting = [(0, 1 << sums[1].bit_length(), 0, len(sums) - 1, 0)]
    while waiting and have < most:
        low, high, bits, above_low, above_high = waiting.pop()
        many = above_low - above_high
        if not many:
            continue
        if many == 1:
            low, high, bits = _narrowed(sums, low, high, bits)
        if low and high - low <= low >> ROOT_BITS:
            found.append((Fraction(low + high, 1 << bits + 1), many))
            have += many
            continue
        if high - low < 2:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = _above(sums, middle, bits)
        waiting.append((low, middle, bits, above_low, above))
        waiting.append((middle, high, bits, above, above_high))
    return found


def _narrowed(sums: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """An interval with one root, halved by signs until it is narrow."""
    below = None
    while not (low and high - low <= low >> ROOT_BITS):
        if high - low < 2:
            low, high, bits = low << 32, high << 32, bits + 32
        middle = (low + high) // 2
        if below is None:
            # the sign just above the root is the one at the far end, unless the end is the root
            end = _sign(sums, high, bits)
            if end == 0:
                return (high << ROOT_BITS + 1) - 1, high << ROOT_BITS + 1, bits + ROOT_BITS + 1
            below = -end
        if _sign(sums, middle, bits) == below:
            low = middle
        else:
            high = middle
    return low, high, bits


# --- components ------------------------------------------------------------------------

def null_space(matrix: list[list[int]], root: Fraction, many: int, seed: int = 1) -> list[list[float]]:
    """``many`` orthonormal vectors that the matrix less ``root`` takes to 0, by inverse iteration."""
    context = decimal.Context(prec=DIGITS, Emin=-999999, Emax=999999)
    with decimal.localcontext(context):
        d = len(matrix)
        number = decimal.Decimal
        shift = number(root.numerator) / number(root.denominator)
        a = np.array([[number(x) for x in row] for row in matrix], dtype=object).reshape(d, d)
        a[np.arange(d), np.arange(d)] -= shift
        tiny = shift * number(10) ** (10 - DIGITS)
        order = np.arange(d)
        for k in range(d):  # rows in place: factors below the diagonal
            best = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
            a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            for r in range(k + 1, d):
                if a[r, k]:
                    a[r, k] /= a[k, k]
                    a[r, k + 1:] -= a[r, k] * a[k, k + 1:]

        def solved(v):
            v = v[order].copy()
            for k in range(d):
                v[k + 1:] -= a[k + 1:, k] * v[k]
            for k in range(d - 1, -1, -1):
                v[k] /= a[k, k]
                v[:k] -= a[:k, k] * v[k]
            return v

        def orthonormal(vectors):
            out = []
            for v in vectors:
                for _ in range(2):
                    for u in out:
                        v = v - u * (u * v).sum()
                out.append(v / (v * v).sum().sqrt())
            return out

        draw = random.Random(seed)
        vectors = orthonormal([np.array([number(draw.randint(-10**6, 10**6)) for _ in range(d)], dtype=object)
                               for _ in range(many)])
        for _ in range(60):
            new = orthonormal([solved(v) for v in vectors])
            # a vector that stays in the space of the last ones has arrived
            left = max(abs(1 - sum((u * v).sum() ** 2 for u in vectors)) for v in new)
            vectors = new
            if left < number(10) ** -40:
                break
    out = []
    for v in vectors:
        far = max(range(d), key=lambda i: (abs(v[i]), -i))
        out.append([float(x) if v[far] > 0 else -float(x) for x in v])
    return out


@dataclass(frozen=True)
class Whitener:
    """What a fit knows; every list is by component, the greatest eigenvalue first."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    vectors: list[list[float]]
    eigenvalues: list[float]
    explained: list[float]


def fitted(spark: SparkSession, n: int, sums: list[int], products: list[list[int]], most: int) -> Whitener:
    """Components from exact moments."""
    d = len(sums)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    vectors, values, shares = [], [], []
    if trace:
        for root, many in largest_roots(characteristic_polynomial(spark, scatter), min(most, d)):
            vectors += null_space(scatter, root, many)
            values += [float(root / (n * n))] * many
            shares += [float(root / trace)] * many
    return Whitener(n, sums, scatter, vectors[:most], values[:most], shares[:most])


def fit(vectors: DataFrame, components: int = 8, id_column: str = "vec_id",
        vector_column: str = "embedding") -> Whitener:
    """Fit to all vectors that take part.

    Left out are null and empty vectors, those with null or non-finite entries or with one
    that, times 1024, passes 62 bits, and those of another than the commonest dimension.
    Rows without an id, zero vectors and repeated rows take part, each row once. Directions
    without variance have no component: there are fewer then, and none for equal vectors
    or for a table without rows.
    """
    rows = usable(vectors, id_column, vector_column)
    return fitted(vectors.sparkSession, *moments(rows), components)


def whiten(vectors: DataFrame, model: Whitener, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): a row per vector that takes part, one entry per component.

    ``deviation`` is the sum over dimensions of (n x - S)^2, or null beyond 64 bits.
    """
    n, d = model.n, len(model.sums)
    sums = np.array(model.sums, dtype=object)
    turn = np.array(model.vectors, dtype=np.float64).reshape(len(model.vectors), d).T / np.sqrt(np.array(model.eigenvalues))

    def run(batches):
        for batch in batches:
            y = _whole(batch.column(1))
            most = int(np.abs(y).max(initial=0)) * n + max(map(abs, model.sums), default=0)
            if most * most * d < 1 << 63:
                centred = n * y - sums.astype(np.int64)
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                centred = n * y.astype(object) - sums
                deviation = [x if x < 1 << 63 else None for x in (centred * centred).sum(axis=1).tolist()]
            # one dimension after another: a row's value does not hang on its batch
            whitened = np.zeros((len(y), turn.shape[1]))
            for j in range(d):
                whitened += (centred[:, j].astype(np.float64) / n)[:, None] * turn[j]
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * turn.shape[1], whitened.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists],
                                             names=["id", "deviation", "whitened"])

    rows = usable(vectors, id_column, vector_column).filter(F.lit(bool(d)))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_column)


def identity_error(whitened: DataFrame) -> float:
    """Largest entry of the whitened rows' covariance less the identity, from the rows themselves.

    Each task sums doubles; tasks are summed as decimals, the same in any order.
    """
    def total(value):
        return F.sum(value.cast("decimal(38,20)")).cast("double")

    def task_sums(centre):
        def run(batches):
            n, acc = 0, None
            for b in batches:
                if b.num_rows:
                    w = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                    n += len(w)
                    part = w.sum(axis=0) if centre is None else (w - centre).T @ (w - centre)
                    acc = part if acc is None else acc + part
            if n:
                flat = acc.ravel()
                yield pa.RecordBatch.from_pydict({"cell": np.arange(len(flat), dtype=np.int32), "value": flat,
                                                  "n": np.full(len(flat), n)})
        parts = arrow_map(whitened.select("whitened"), run, "cell int, value double, n long")
        rows = parts.groupBy("cell").agg(total(F.col("value")).alias("value"), F.sum("n").alias("n")).orderBy("cell")
        return np.array([r.value / r.n for r in rows.collect()])  # a number per pair of components

    mean = task_sums(None)
    if not len(mean):
        return 0.0
    covariance = task_sums(mean).reshape(len(mean), -1)
    return float(np.abs(covariance - np.eye(len(mean))).max())


def components(vectors: DataFrame, most: int = 8, id_column: str = "vec_id",
               vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    model = fit(vectors, most, id_column, vector_column)
    rows = stored(whiten(vectors, model, id_column, vector_column), "whitened")
    error = identity_error(rows)
    shares = F.array(*[F.lit(x) for x in model.explained] or [F.lit(0.0)])
    return rows.select(id_column, "deviation", F.posexplode("whitened").alias("place", "value")).select(
        id_column, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"))
