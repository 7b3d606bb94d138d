"""Embedding whitening through the exact characteristic polynomial of the integer scatter.

Vectors become integers, so n*sum(x x') - S S' is an integer matrix M, n**2 times the covariance. Its characteristic
polynomial is found modulo many primes (Hessenberg reduction, some primes a task) and put together by the Chinese
remainder theorem; the number of primes follows from a proven bound of the coefficients. All roots are real, so Descartes'
rule counts the roots above a point exactly: a task for each component encloses its root by bisection and halves the
enclosure until BITS bits below 1. Inverse iteration in fixed point with that root gives the unit eigenvector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import prepare, widened

MOST_COMPONENTS = 32
#: Entries become floor(SCALE * c) + OFFSET; beyond LIMIT (far from any embedding) they are cut to it.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 61
#: Bits of a root below 1, and of the fixed-point numbers of the inverse iteration below 1.
BITS, FIXED = 192, 320
#: Primes of one task.
PRIMES_AT_ONCE = 16
#: Rows of one exact product: limbs of LIMB bits, so sums stay below 2**53.
LIMB, PRODUCT_ROWS = 20, 1 << 12
HALF = 60


# --- integer vectors and their scatter ------------------------------------------------------------------------------

def integers(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """(rows, d) of x - OFFSET; every row of ``batch`` holds d finite entries."""
    entries = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(entries * SCALE), -LIMIT, LIMIT).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of LIMB-bit parts with y = sum of part[i] << (LIMB * i); the last one is signed."""
    out = []
    while len(y):
        if np.abs(y).max() < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return out


def gram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and y' y, as Python integers."""
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i in range(0, len(y), PRODUCT_ROWS):
        parts = limbs(y[i:i + PRODUCT_ROWS])
        for a, p in enumerate(parts):
            sums += np.array([int(v) << (LIMB * a) for v in p.sum(axis=0)], object)
            for b, q in enumerate(parts):
                products += np.array([[int(v) << (LIMB * (a + b)) for v in row] for row in p.T @ q], object)
    return sums, products


def _scattered(column: str, d: int):
    """Per task: the entries (i, j) of the upper triangle of y'y, and (-1, j) of the sums, in two halves of HALF bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = integers(batch, column, d)
            a, b = gram(y)
            n, sums, products = n + len(y), sums + a, products + b
        cells = [(-2, 0, n), *((-1, j, int(sums[j])) for j in range(d)),
                 *((i, j, int(products[i, j])) for i in range(d) for j in range(i, d))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
             pa.array([str(c[2] >> HALF) for c in cells]), pa.array([c[2] & ((1 << HALF) - 1) for c in cells], pa.int64())],
            ["i", "j", "high", "low"])
    return run


def scatter(rows: DataFrame, column: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of x - OFFSET, and M = n * sum(y y') - S S', all exact. Tasks send d * (d + 3) / 2 + 1 sums each,
    which are added up by Spark; the driver gets one such set."""
    parts = rows.select(column).mapInArrow(_scattered(column, d), "i int, j int, high string, low long")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
                                        F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    cell = {(r.i, r.j): (int(r.high) << HALF) + int(r.low) for r in total}
    n, sums = cell.get((-2, 0), 0), [cell.get((-1, j), 0) for j in range(d)]
    m = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            m[i, j] = m[j, i] = n * cell.get((i, j), 0) - sums[i] * sums[j]
    return n, sums, m


# --- characteristic polynomial --------------------------------------------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every n below 3.2e9."""
    if n % 2 == 0:
        return n == 2
    s = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 3, 5, 7):
        x = pow(base, (n - 1) >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest primes below 2**31: products of residues fit 64 bits."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(tI - M) modulo p, highest first, through Hessenberg form."""
    d = len(m)
    h = np.array([[v % p for v in row] for row in m], np.int64).reshape(d, d)
    for k in range(1, d - 1):
        rows = np.flatnonzero(h[k:, k - 1])
        if not len(rows):
            continue
        r = k + int(rows[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k][None, :] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]                                 # of the leading blocks, lowest first
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - int(h[k, k]) * polys[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            new[:i + 1] = (new[:i + 1] - product * int(h[i, k]) % p * polys[i]) % p
        polys.append(new % p)
    return polys[d][::-1].tolist()


def _residues(m: np.ndarray, all_primes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([polynomial_mod(m, all_primes[i]) for i in at], pa.list_(pa.int64()))], ["id", "residues"])
    return run


def bound_bits(m: np.ndarray) -> int:
    """Bits of 2 * |c| + 1 for every coefficient c: they are sums of products of eigenvalues that are not negative and
    add up to the trace, so c is at most C(d, k) * (trace / d)**k."""
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    return max((math.comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1)) + 2


def joined(residues: list[list[int]], mods: list[int]) -> list[int]:
    """Coefficients of least absolute value with these residues."""
    whole = math.prod(mods)
    weights = [whole // p * pow(whole // p % p, -1, p) for p in mods]
    out = []
    for own in zip(*residues):
        c = sum(r * w for r, w in zip(own, weights)) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


def characteristic(spark, m: np.ndarray) -> list[int]:
    """Coefficients of det(tI - M), highest first."""
    mods = primes(-(-bound_bits(m) // 30))
    tasks = -(-len(mods) // PRIMES_AT_ONCE)
    rows = spark.range(0, len(mods), 1, tasks).mapInArrow(_residues(m, mods), "id long, residues array<long>").collect()
    return joined([r.residues for r in sorted(rows, key=lambda r: r.id)], mods)


# --- roots ----------------------------------------------------------------------------------------------------------

def shifted(c: list[int], a: int) -> list[int]:
    """Coefficients of p(t + a)."""
    out = list(c)
    if a:
        for end in range(len(out) - 1, 0, -1):
            for i in range(1, end + 1):
                out[i] += a * out[i - 1]
    return out


def roots_above(c: list[int], a: int) -> int:
    """Number of roots above ``a``, with multiplicity: the changes of sign of p(t + a), as all roots are real."""
    signs = [v > 0 for v in shifted(c, a) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(c: list[int], a: int) -> int:
    return reduce(lambda v, k: v * a + k, c, 0)


def root(c: list[int], k: int, top: int, bits: int = BITS) -> tuple[int, int, int]:
    """(r, place, size): the k-th largest root (from 1) lies in (r / 2**bits, (r + 1) / 2**bits], or is r / 2**bits if that is
    exact; ``size`` roots lie there, of which it is number ``place`` (from 0). 0 < all roots wanted <= ``top``."""
    low, high, above, below = 0, top, 0, roots_above(c, 0)          # roots above high and above low
    scaled = 0
    while True:
        if below - above == 1 and high - low == 1:
            break                                                    # simple: signs alone from here
        if high - low > 1:
            mid = (low + high) // 2
            n = roots_above(c, mid)
            low, below, high, above = (mid, n, high, above) if n >= k else (low, below, mid, n)
        elif scaled == bits:
            return low, k - 1 - above, below - above
        else:                                                        # one more bit below 1
            c, scaled = [v << i for i, v in enumerate(c)], scaled + 1
            low, high = 2 * low, 2 * high
    if value(c, high) == 0:
        return high << (bits - scaled), 0, 1
    sign = value(c, high) > 0
    while scaled < bits:
        c, scaled = [v << i for i, v in enumerate(c)], scaled + 1
        low, high, mid = 2 * low, 2 * high, 2 * low + 1
        v = value(c, mid)
        if v == 0:
            return mid << (bits - scaled), 0, 1
        low, high = (low, mid) if (v > 0) == sign else (mid, high)
    return low, 0, 1


# --- eigenvectors ---------------------------------------------------------------------------------------------------

def null_vectors(m: np.ndarray, r: int, size: int) -> list[list[float]]:
    """``size`` orthonormal vectors of the null space of M - r / 2**BITS: after elimination in fixed point with complete
    pivoting the last ``size`` pivots are zero but for the root's last bits, so the step of inverse iteration is the back
    substitution from a unit vector at each of them."""
    d, one = len(m), 1 << FIXED
    a = np.array([[int(v) << FIXED for v in row] for row in m], object).reshape(d, d)
    for i in range(d):
        a[i, i] -= r << (FIXED - BITS)
    order = list(range(d))
    rank = d - size
    for k in range(rank):
        rest = np.abs(a[k:, k:])
        i, j = divmod(int(np.argmax(rest)), d - k)
        a[[k, k + i]] = a[[k + i, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        order[k], order[k + j] = order[k + j], order[k]
        factor = np.array([(int(v) << FIXED) // int(a[k, k]) for v in a[k + 1:, k]], object)
        a[k + 1:, k:] = a[k + 1:, k:] - ((factor[:, None] * a[k, k:][None, :]) >> FIXED)
    basis: list[np.ndarray] = []
    for s in range(size):
        x = np.zeros(d, object)
        x[rank + s] = one
        for k in range(rank - 1, -1, -1):
            x[k] = -((int((a[k, k + 1:] * x[k + 1:]).sum())) // int(a[k, k]))
        v = np.zeros(d, object)
        v[order] = x
        for _ in range(2):                                           # Gram-Schmidt, twice
            for b in basis:
                v = v - ((int((v * b).sum()) >> FIXED) * b >> FIXED)
            length = math.isqrt(int((v * v).sum()))
            v = np.array([(int(e) << FIXED) // length for e in v], object)
        basis.append(v)
    return [[int(e) / one for e in v] for v in basis]


def _components(m: np.ndarray, coefficients: list[int], n: int):
    trace = int(sum(m[i, i] for i in range(len(m))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column("id").to_pylist():
                r, place, size = root(coefficients, k, trace)
                vector = null_vectors(m, r, size)[place]
                out.append((k, r / ((n * n) << BITS), r / (trace << BITS), vector))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], ["component", "variance", "explained", "vector"])
    return run


def components(spark, n: int, m: np.ndarray, most: int = MOST_COMPONENTS) -> list:
    """component, variance, explained and vector for the ``most`` largest eigenvalues above 0, a task each."""
    coefficients = characteristic(spark, m)
    rank = roots_above(coefficients, 0)
    count = min(most, rank)
    if not count:
        return []
    rows = spark.range(1, count + 1, 1, count).mapInArrow(
        _components(m, coefficients, n), "component int, variance double, explained double, vector array<double>").collect()
    return sorted(rows, key=lambda r: r.component)


# --- rows -----------------------------------------------------------------------------------------------------------

def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S as exactly rounded doubles, sum of its squares per row as exact integers or None beyond 64 bits)."""
    top = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    if top ** 2 * max(1, y.shape[1]) < 1 << 63:
        whole = n * y - np.array(sums, np.int64)
        return whole.astype(np.float64), (whole * whole).sum(axis=1).astype(object)
    whole = y.astype(object) * n - np.array(sums, object)
    squares = (whole * whole).sum(axis=1)
    return whole.astype(np.float64), np.array([v if v < 1 << 63 else None for v in squares], object)


def _white(column: str, d: int, n: int, sums: list[int], weights: np.ndarray):
    """Per task: sums of w w' and w of the whitened rows, as flat arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weights.shape[1]
        products, totals = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = centred(integers(batch, column, d), n, sums)[0] / n @ weights
            products, totals = products + w.T @ w, totals + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k, dtype=np.int32)),
                                          pa.array(np.concatenate([products.ravel(), totals]))], ["cell", "v"])
    return run


def identity_error(rows: DataFrame, column: str, d: int, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity, measured on the rows."""
    k = weights.shape[1]
    total = rows.select(column).mapInArrow(_white(column, d, n, sums, weights), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    flat = np.array([r.v for r in sorted(total.collect(), key=lambda r: r.cell)])
    mean = flat[k * k:] / n
    return float(np.abs(flat[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _project(column: str, d: int, n: int, sums: list[int], weights: np.ndarray, explained: list, error: float | None, keep: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, used = len(explained), weights.shape[1]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows = part.num_rows
                diff, deviation = centred(integers(part, column, d), n, sums)
                white = np.full((rows, k), np.nan)
                white[:, :used] = diff / n @ weights
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(each)) for c in keep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, n, np.int64)), pa.array(list(deviation[each]), pa.int64()),
                     pa.array(white.ravel(), from_pandas=True), pa.array(explained * rows, pa.float64()),
                     pa.array([error] * (rows * k), pa.float64())],
                    [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most: int = MOST_COMPONENTS) -> DataFrame:
    """``keep`` columns, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    Rows are left out whose vector is null, empty, or holds a null or an entry that is not finite, and rows whose
    vector is not of the most frequent length (the shorter of two that are equally frequent). Repeated rows count as
    often as they come; other columns are not read. Components are numbered by falling variance, up to
    ``most`` or the length; equal variances have an orthonormal basis of their space in elimination order. A component without
    variance has a null ``whitened`` and explains 0 (null if no component has any). ``deviation`` is null where it needs
    more than 64 bits. An empty table gives no rows. Driver and tasks hold matrices of length x length only.
    """
    spark = prepare(vectors.sparkSession)
    kept = vectors.select(*keep, F.col(column).alias("__vector"))
    if kept.schema["__vector"].dataType.simpleString() not in ("array<float>", "array<double>"):
        kept = kept.withColumn("__vector", F.col("__vector").cast("array<double>"))
    finite = F.forall("__vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.where((F.size("__vector") > 0) & finite)
    lengths = kept.groupBy(F.size("__vector").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").first()
    schema = widened(kept, keep, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = kept.where(F.size("__vector") == d)
    n, sums, m = scatter(rows, "__vector", d)
    found = components(spark, n, m, most)
    count = min(most, d)
    weights = np.array([r.vector for r in found], np.float64).reshape(-1, d).T / np.sqrt(np.array([r.variance for r in found]))
    error = identity_error(rows, "__vector", d, n, sums, weights) if found else None
    explained = [r.explained for r in found] + [0.0 if found else None] * (count - len(found))
    return rows.mapInArrow(_project("__vector", d, n, sums, weights, explained, error, keep), schema)
