from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from termwarden.llm import vectors
from termwarden.llm.common import work_folder

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(ids, labels, points, entries=256, rounds=4):
    """K-means with every part against every entry, in Python's integers."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, points[i].tolist()))
    whole = np.floor(points.astype(np.float64) * 1024).astype(np.int64)
    cut = whole.reshape(len(ids), 4, -1)
    codes, errors, books = [], np.zeros(len(ids), np.int64), []
    for part in range(4):
        values = cut[:, part]
        book = values[order[:entries]].copy()

        def nearest():
            far = ((values[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
            return far.argmin(axis=1), far.min(axis=1)

        for _ in range(rounds):
            code, _ = nearest()
            for e in range(len(book)):
                own = values[code == e]
                if len(own):
                    book[e] = [int(x) // len(own) for x in own.sum(axis=0)]
        code, error = nearest()
        codes.append(code)
        errors += error
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    total = {}
    for label, error in zip(labels, errors.tolist()):
        total[label] = total.get(label, 0) + error
    return sorted(
        (str(i), "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), total[labels[n]], digest)
        for n, i in enumerate(ids)
    )


def found_of(spark, ids, labels, points):
    rows = [(i, [float(x) for x in p], label) for i, p, label in zip(ids, points, labels)]
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((str(r[0]), *r[1:]) for r in vectors.code_digests(df, work_folder(df)).collect())


@pytest.mark.parametrize("spread", ["even", "clustered", "coarse", "outliers"])
def test_codes_against_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(len(spread))
    n = 900
    points = rng.normal(size=(n, 16)).astype(np.float32)
    if spread == "clustered":
        points = (rng.normal(size=(12, 16)) * 3)[rng.integers(0, 12, n)].astype(np.float32) + points / 50
    if spread == "coarse":  # many ties and equal vectors
        points = np.round(points).astype(np.float32) / 512
    if spread == "outliers":
        points[:40] *= np.float32(2.0) ** np.arange(40)[:, None] % 1e4
    ids = list(range(n))
    rng.shuffle(ids)
    labels = [None if x == 3 else int(x) for x in rng.integers(0, 4, n)]
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "LEAF", 5)
    points = points.astype(np.float32)
    assert found_of(spark, ids, labels, points) == plain(ids, labels, points)


def test_ties_missing_ids_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    points = np.concatenate([points, points[:200]])
    ids = [None if i % 97 == 0 else i % 250 for i in range(500)]
    labels = [i % 2 for i in range(500)]
    assert found_of(spark, ids, labels, points) == plain(ids, labels, points)


def test_rows_that_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [0.5] * 7 + [None], 1), (4, [nan] * 8, 1), (5, [inf] * 8, 1)]
    rows += [(6, [0.25] * 7 + [-inf], None), (7, [-0.0001] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("trees", "codes", "_label")})
    found = {r.vec_id: r for r in vectors.code_digests(df, work_folder(df)).collect()}
    assert found.keys() == {1, 7}
    assert found[1].code == "00000000" and found[7].code == "01010101" and found[1].error == 0
    expected = ",".join(f"{'512,512'},{'-1,-1'}" for _ in range(4))
    assert found[1].codebooks_sha256 == hashlib.sha256(expected.encode()).hexdigest()


def test_empty_tables_and_unfit_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.code_digests(empty, work_folder(empty)).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA)
    with pytest.raises(ValueError, match="equal parts"):
        vectors.code_digests(odd, work_folder(odd))
    ragged = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], SCHEMA)
    with pytest.raises(Exception, match="must have 8 components"):
        vectors.code_digests(ragged, work_folder(ragged)).count()


def test_large_components_are_compared_exactly():
    rng = np.random.default_rng(2)
    points = rng.integers(-(2**27), 2**27, (50, 4))
    entries = points[:9] + rng.integers(-2, 3, (9, 4))
    plainly = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e)) for e in entries] for p in points]
    assert vectors.squares(points, entries).tolist() == plainly


def test_balls_hold_their_parts_and_own_what_they_say():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(600, 4)) * 1000).astype(np.int64)
    points[:100] = points[0]
    tree = vectors.planted(points)
    assert sorted(tree.order.tolist()) == list(range(600))
    assert (tree.points == points[tree.order]).all()
    for ball in range(len(tree.lo)):
        own = tree.points[tree.lo[ball] : tree.hi[ball]].astype(float)
        assert (np.sqrt(((own - tree.centre[ball]) ** 2).sum(axis=1)) <= tree.radius[ball] * (1 + 1e-9)).all()
        assert (tree.total[ball] == own.sum(axis=0)).all()
    book = vectors.Codebook(np.concatenate([points[100:140], points[100:140]]))
    decided = list(vectors.balls(tree, book))
    assert sum(tree.hi[b] - tree.lo[b] for b, _ in decided) == 600
    assert any(len(left) < 40 for _, left in decided)
    again = vectors.Tree.unpacked(tree.packed())
    assert (again.radius == tree.radius).all()
