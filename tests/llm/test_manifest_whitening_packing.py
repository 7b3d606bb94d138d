"""Merkle manifest, whitening and packing against plain versions, on awkward rows and on empty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gustframe.llm import binpack, merkle, packing, whitening

SF = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _plain_tree(leaves):
    """Root and, per leaf, (sibling or None, sibling is on the left) from the bottom upward."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(places):
            other = at ^ 1
            proofs[k].append((level[other] if other < len(level) else None, other < at))
            places[k] = at // 2
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], proofs


def _plain_manifest(rows):
    """Sorted result rows for (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        doc_id, source, lang, n_chars, text = r
        leaf = H(*map(_field, r))
        changed = H(*map(_field, (doc_id, source, lang, n_chars + 1, text))) if n_chars is not None else leaf
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, changed if tampered else leaf, doc_id))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in langs:
        groups[g].sort(key=lambda x: x[:3])
        trees.append(_plain_tree([x[2] for x in groups[g]]))
    root, over = _plain_tree([t[0] for t in trees])
    out = []
    for g, (subroot, proofs), above in zip(langs, trees, over):
        for row, proof in zip(groups[g], proofs):
            steps, again = proof + above, row[3]
            for sibling, left in steps:
                again = H(again) if sibling is None else H(sibling, again) if left else H(again, sibling)
            out.append((row[4], row[2], subroot, root, H(*[s for s, _ in steps if s]), again, again == root))
    return sorted(out, key=str)


def _manifest(df, **more):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return sorted((tuple(r) for r in merkle.manifest(df, is_tampered=tampered, **more).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_of_awkward_rows(spark, docs, levels):
    rows = [tuple(r) for r in docs.withColumn("n_chars", F.when(F.col("doc_id") != 4, F.length("text")))
            .select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [(i, "s", "xé" if i % 3 else "X", i, f"text {i}") for i in range(100, 137)] + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("row", F.lit("x"))
    got = _manifest(df.repartition(5), levels=levels)
    assert got == _plain_manifest(rows) and not all(r[-1] for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(7, "a", None, 3, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert _manifest(df) == _plain_manifest(rows)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_sweeps_of_every_size():
    for n in range(1, 40):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        nodes = merkle.sweep(leaves, merkle.height_of(n))
        root, proofs = _plain_tree([x.hex() for x in leaves])
        assert nodes[-1][0].hex() == root
        found = dict(merkle.unsweep(nodes, b""))
        assert sorted(found) == list(range(n)) and all(merkle.folded(leaves[i], found[i]).hex() == root for i in range(n))
        assert all([(s.hex() or None) for _, s in merkle.steps(found[i])] == [s for s, _ in proofs[i]] for i in range(n))


def _plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    diff = x - total / n
    values, components = np.linalg.eigh(diff.T @ diff / n)
    return n, ((n * x - total) ** 2).sum(axis=1), diff, values[::-1], components[:, ::-1]


def _by_row(df):
    out = {}
    for r in df.orderBy("vec_id", "component").collect():
        out.setdefault(r.vec_id, []).append(r)
    return out


def test_whitening_equals_double_precision(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    n, deviation, diff, values, components = _plain_whitening([r.embedding for r in rows])
    got = _by_row(whitening.whiten(vectors))
    assert sorted(got) == [r.vec_id for r in rows]
    w = np.array([[c.whitened for c in got[r.vec_id]] for r in rows])
    want = diff @ components[:, :32] / np.sqrt(values[:32])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    assert [got[r.vec_id][0].deviation for r in rows] == deviation.tolist()
    assert np.allclose([c.explained for c in got[rows[0].vec_id]], values[:32] / values.sum(), rtol=1e-10)
    assert got[rows[0].vec_id][0].identity_error < 1e-9 and [c.component for c in got[rows[0].vec_id]] == list(range(1, 33))


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    good = [(i, [rng.uniform(-3, 3), rng.uniform(-3, 3), 1.5, 0.0]) for i in range(40)]
    good += [(1, good[1][1]), (None, [1.0, 2.0, 1.5, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0]), (53, [nan, 0.0, 0.0, 0.0]), (54, [inf, 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("component", F.lit("x"))
    out = whitening.whiten(df).collect()
    assert len(out) == 4 * len(good) and {r.vec_id for r in out} == {i for i, _ in good}
    _, _, diff, values, _ = _plain_whitening([v for _, v in good])
    flat = [r for r in out if r.component > 2]
    assert all(r.whitened is None and r.explained == 0 for r in flat)          # two entries never change
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in out if r.component <= 2)
    assert all(r.identity_error < 1e-9 for r in out)
    w = np.array([r.whitened for r in sorted(out, key=lambda r: (r.component, str(r.vec_id))) if r.component <= 2]).reshape(2, -1)
    assert np.abs(np.cov(w, bias=True) - np.eye(2)).max() < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.where("vec_id = 3")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4


def test_scatter_of_large_entries_is_exact():
    rng = random.Random(4)
    y = [[rng.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(50)]
    sums, products = whitening.gram(np.array(y, np.int64))
    assert sums.tolist() == [sum(c) for c in zip(*y)]
    assert products.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]


def test_polynomial_and_repeated_roots():
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 10, (6, 6))
    for m in (a @ a.T, np.diag([5, 5, 3, 0, 9, 0]), np.ones((6, 6), int), np.zeros((6, 6), int)):
        m = m.astype(object)
        mods = whitening.primes(-(-whitening.bound_bits(m) // 30))
        c = whitening.joined([whitening.polynomial_mod(m, p) for p in mods], mods)
        eye = np.eye(6, dtype=int).astype(object)
        det = lambda x: sum((-1) ** sum(p[i] > p[j] for i in range(6) for j in range(i + 1, 6)) * np.prod([x[i, p[i]] for i in range(6)])
                            for p in itertools.permutations(range(6)))
        assert all(whitening.value(c, t) == det(t * eye - m) for t in (-2, 0, 1, 7))
        values = np.linalg.eigvalsh(m.astype(float))[::-1]
        rank = whitening.roots_above(c, 0)
        assert rank == (values > 1e-6).sum()
        basis = []
        for k in range(1, rank + 1):
            r, place, size = whitening.root(c, k, int(m.trace()))
            assert abs(r / (1 << whitening.BITS) - values[k - 1]) < 1e-6
            basis.append(whitening.null_vectors(m, r, size)[place])
        if basis:
            v = np.array(basis)
            assert np.abs(v @ v.T - np.eye(rank)).max() < 1e-12
            assert np.abs(v @ m.astype(float) @ v.T - np.diag(values[:rank])).max() < 1e-6


def _fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, rooms):
        if i == len(lengths):
            return True
        tried = set()
        for b, room in enumerate(rooms):
            if room >= lengths[i] and room not in tried:
                tried.add(room)
                rooms[b] -= lengths[i]
                if fits(i + 1, rooms):
                    return True
                rooms[b] += lengths[i]
        return False
    return next(b for b in range(len(lengths) + 1) if fits(0, [capacity] * b))


def test_bounds_and_best_fit():
    rng = random.Random(7)
    for _ in range(150):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 9))]
        bins, offsets, used = binpack.best_fit_decreasing(np.array(lengths, np.int64), capacity)
        rooms = []                                                   # one item at a time
        for size in sorted(lengths, reverse=True):
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                rooms.append(capacity - size)
            else:
                rooms[rooms.index(fit)] -= size
        filled = np.bincount(bins, lengths, used) if lengths else np.zeros(0)
        assert sorted(capacity - filled) == sorted(rooms)
        for b in range(used):
            own = sorted((o, n) for o, n, x in zip(offsets, lengths, bins) if x == b)
            assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        bound = binpack.lower_bound(np.bincount(np.array(lengths, int), minlength=capacity + 1), capacity)
        assert -(-sum(lengths) // capacity) <= bound <= _fewest(lengths, capacity) <= used


def _checked(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= capacity
    return len(by)


def test_packing_holds_the_ids_of_whole_texts(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack_documents(docs).collect()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, i, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048])) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    assert _checked(out, 2048) == binpack.lower_bound(np.bincount([r.length for r in out], minlength=2049), 2048)
    assert all(r.certified for r in out)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_groups_exchange_until_the_bound(spark):
    rng = random.Random(5)
    rows = [(i, i, 0, 0, rng.randrange(1, 60), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, capacity=100, part=200).collect()
    least = binpack.lower_bound(np.bincount([r[4] for r in rows], minlength=101), 100)
    assert sorted(r.row for r in out) == list(range(3000)) and least <= _checked(out, 100) <= least + 2
