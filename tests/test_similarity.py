"""The metric index against all pairs."""

import cmath
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import similarity as S


def made(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        flux = [rnd.randrange(-20, 20) for _ in range(5)] if i % 10 else [[1, 2, 3, 4, 5], [1, 2], [], None][i // 10 % 4]
        z = [complex(rnd.choice([0, rnd.gauss(0, 2)]), rnd.choice([0, rnd.gauss(0, 2)])) for _ in range(2)]
        if rows and i % 3 == 0:  # near to one before
            z = [w * (1 + 0.04 * cmath.exp(1j * rnd.uniform(0, 6))) for w in map(complex, rows[-1][3], rows[-1][4])]
            flux = rows[-1][2] and [x + rnd.choice([-1, 0, 1]) for x in rows[-1][2]]
        rows.append((i % 2 if i % 5 else None, i, flux, [x.real for x in z], [x.imag for x in z], z[0].real, z[0].imag))
    return rows


SCHEMA = "m int, id int, flux array<int>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double"


def flux_near(a, b, tol):
    return bool(a and b and len(a) == len(b) and max(abs(x - y) for x, y in zip(a, b)) <= tol)


def complex_near(a, b, tol):
    return max(abs(x - y) / (abs(y) or 1) for x, y in zip(a, b)) <= tol


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_all_pairs(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    z = lambda r: list(map(complex, r[3], r[4]))
    pairs = [(a, b) for a in rows for b in rows if a[0] is not None and a[0] == b[0]]
    found = lambda out: {(r.a_id, r.b_id) for r in out.collect()}
    for tol in (0, 1, 3):
        assert found(S.near_flux(df, df, ["m"], tol)) == {(a[1], b[1]) for a, b in pairs if flux_near(a[2], b[2], tol)}
    for tol in (0.05, 0.3, 1.5):
        assert found(S.near(df, df, ["m"], moduli_tol=tol)) == {(a[1], b[1]) for a, b in pairs if complex_near(z(a), z(b), tol)}
        assert found(S.near(df, df, ["m"], tau_tol=tol)) == {(a[1], b[1]) for a, b in pairs if complex_near(z(a)[:1], z(b)[:1], tol)}
    both = {(a[1], b[1]) for a, b in pairs if complex_near(z(a), z(b), 0.3) and flux_near(a[2], b[2], 1)}
    assert found(S.near(df, df, ["m"], moduli_tol=0.3, flux_tol=1)) == both
    with pytest.raises(ValueError):
        S.near(df, df, ["m"])
    assert S.near_flux(df.where("false"), df.where("false"), ["m"], 1).count() == 0


def test_few_candidates(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(0, i, [rnd.randrange(3), *(rnd.randrange(100) for _ in range(6))]) for i in range(1000)], "m int, id int, flux array<int>")
    features, shares = S.layout(df, ["m"], [*S.entries("flux", 7, 2), *S.pivots(df, "flux", 2)], "id")
    assert S.candidates(df, df, ["m"], features).count() < 0.02 * 1000**2 and shares == sorted(shares, reverse=True)
    # all in one place: nothing is gained by more features
    same = df.withColumn("flux", F.array(F.lit(1), F.lit(2)))
    assert len(S.layout(same, ["m"], S.entries("flux", 2, 2), "id")[0]) == 1


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(0, i, [i // 4]) for i in range(12)] + [(0, 99, None)], "m int, id int, flux array<int>")
    first, member = S.classes(df, ["m"], ["flux"])
    assert {r.id: r.n_copies for r in first.collect()} == {0: 4, 4: 4, 8: 4, 99: 1}
    assert {r.id: r.class_id for r in member.collect()} == {i: i // 4 * 4 for i in range(12)} | {99: 99}
