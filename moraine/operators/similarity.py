"""Similarity joins of whole vectors by a metric index that is laid out from the data.

A feature is a number of a vector that differs little between near vectors: by its tolerance at
most.  For the largest difference of any entry these are the entries themselves and the
distances to a few vectors, the pivots (the triangle inequality); for differences relative to
the stored entry they are the logarithm of an entry's modulus and its direction.  Features are
cut into cells, four tolerances wide or less, so that a vector is looked for in few cells of each.

Which features are used, up to ``DEPTH``, is decided on a bounded sample of the stored rows: the
one that parts them best, then the one that parts best what the first leaves together, until
a cell has a row or two or nothing is gained.  The sample decides how many candidates there
are, never which pairs are found: every candidate is verified on the whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from moraine.functions import arrays as A

#: Stored rows that the layout is decided on, features that are used, and pivots.
SAMPLE, DEPTH, PIVOTS = 1 << 16, 4, 3
#: Entries up to which a vector is compared by columns, and entries of all vectors of a block of longer ones.
NARROW, TILE = 16, 1 << 15
#: A further feature must leave fewer than this share of the candidates.
GAIN = 0.8
_NONE = -(1 << 62)


@dataclass(frozen=True)
class Feature:
    """``value(prefix)`` is the feature of the columns with that prefix; near rows differ by ``tol`` at most.

    A cell is ``wide`` tolerances wide, so that a vector is looked for in 1 + 2 / wide cells on average.
    """

    value: Callable[[str], Column]
    tol: float
    wide: float = 4

    def width(self) -> float:
        return self.wide * self.tol if self.tol > 0 else 1.0

    def cell(self, prefix: str) -> Column:
        x = self.value(prefix).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(_NONE)).otherwise(F.floor(x / F.lit(self.width())))

    def cells(self, prefix: str) -> Column:
        """The cells that near rows can be in; a little more, for what rounding takes."""
        x = self.value(prefix).cast("double")
        slack = F.lit(self.tol) + F.abs(x) * F.lit(1e-12)
        low, high = F.floor((x - slack) / F.lit(self.width())), F.floor((x + slack) / F.lit(self.width()))
        return F.when(x.isNull() | F.isnan(x), F.array(F.lit(_NONE))).otherwise(F.sequence(low, high))


def narrowed(features: Sequence[Feature], asked: int, stored: int) -> list[Feature]:
    """The features with the narrowest cells for which the asked rows, once for each of their cells, are few beside the stored ones."""
    for wide in (1, 2):
        if asked * (1 + 2 / wide) ** len(features) <= 2 * stored:
            return [replace(f, wide=wide) for f in features]
    return list(features)


def entries(vector: str, n: int, tol: float) -> list[Feature]:
    return [Feature(lambda p, k=k: F.get(F.col(f"{p}{vector}"), F.lit(k)), tol) for k in range(n)]


def pivots(stored: DataFrame, vector: str, tol: float, n: int = PIVOTS) -> list[Feature]:
    """Distances to vectors that lie far apart among a few hundred of the stored ones."""
    some = [[float(x) for x in r[0]] for r in stored.select(vector).where(F.size(vector) > 0).limit(256).collect() if all(x is not None for x in r[0])]
    size = max((len(v) for v in some), default=0)
    some = [v for v in some if len(v) == size]
    apart = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True))
    chosen = some[:1]
    while chosen and len(chosen) < n:
        far = max(some, key=lambda v: min(apart(v, c) for c in chosen))
        if min(apart(far, c) for c in chosen) == 0:
            break
        chosen.append(far)
    return [Feature(lambda p, v=v: A.linf(f"{p}{vector}", F.array(*map(F.lit, v))), tol) for v in chosen]


def relative(re: str, im: str, n: int | None, tol: float) -> list[Feature]:
    """Features of complex entries that differ by ``tol`` of the stored modulus at most; none from a tolerance of 1.

    If |z - w| <= t |w|, then |log|z| - log|w|| <= -log(1 - t), and the directions z / |z| and w / |w|
    differ by 2 t / (1 + sqrt(1 - t^2)) at most.  An entry of 0 has no
    feature, and a stored one is near numbers of up to t: see ``near``.
    """
    if tol >= 1:
        return []
    part = lambda p, c, k: F.col(f"{p}{c}") if k is None else F.get(F.col(f"{p}{c}"), F.lit(k))
    size = lambda p, k: F.hypot(part(p, re, k), part(p, im, k))
    of = lambda x, s: F.when(s > 0, x / s)
    out = []
    turn = 2 * tol / (1 + math.sqrt(1 - tol * tol)) * (1 + 1e-9)
    for k in [None] if n is None else range(n):
        out += [
            Feature(lambda p, k=k: F.when(size(p, k) > 0, F.log(size(p, k))), -math.log1p(-tol)),
            Feature(lambda p, k=k: of(part(p, re, k), size(p, k)), turn), Feature(lambda p, k=k: of(part(p, im, k), size(p, k)), turn),
        ]
    return out


def layout(stored: DataFrame, model: Sequence[str], features: Sequence[Feature], key: str, depth: int = DEPTH) -> tuple[list[Feature], list[float]]:
    """(features that part the stored rows best, the share of all pairs that are candidates after each, for
    rows that are asked for as these are: each in all of its cells)."""
    n = stored.count()
    sample = stored if n <= SAMPLE else stored.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(SAMPLE / n * (1 << 30))))
    held = sample.select(*model, *(f.cell("").alias(f"_c{k}") for k, f in enumerate(features)))
    # a feature whose cells are wide beside its values parts little: most rows are looked for in two
    times = sample.agg(*(F.avg(F.size(f.cells(""))) for f in features)).first() if features else []
    times = [t or 1.0 for t in times]
    chosen: list[int] = []
    total = max(1, min(n, SAMPLE))
    shares: list[float] = []
    while len(chosen) < min(depth, len(features)):
        left = [k for k in range(len(features)) if k not in chosen]
        each = held.select(*model, *(f"_c{k}" for k in chosen), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("c")) for k in left))).alias("x"))
        met = each.groupBy(*model, *(f"_c{k}" for k in chosen), "x.k", "x.c").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        best = min(met.collect(), key=lambda r: (r["pairs"] * times[r["k"]], r["k"]), default=None)  # one row for each feature
        if best is None:
            break
        share = best["pairs"] * times[best["k"]] * math.prod(times[k] for k in chosen) / total**2
        if shares and share > GAIN * shares[-1]:
            break
        chosen.append(best["k"])
        shares.append(share)
        if best["pairs"] <= 2 * total:
            break
    return [features[k] for k in chosen], shares


def candidates(a: DataFrame, b: DataFrame, model: Sequence[str], features: Sequence[Feature], test: Column | None = None) -> DataFrame:
    """Pairs of rows of one model in one cell of all features; columns of ``a`` begin with ``a_``, of ``b`` with ``b_``.

    A row of ``b`` is in one cell, so no pair comes twice.  Only pairs for which ``test`` holds are kept.
    """
    left = a.select(*model, *(F.col(c).alias(f"a_{c}") for c in a.columns if c not in model))
    for k, f in enumerate(features):
        left = left.withColumn(f"_c{k}", F.explode(f.cells("a_")))
    right = b.select(*model, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in model))
    right = right.select("*", *(f.cell("b_").alias(f"_c{k}") for k, f in enumerate(features)))
    both = left.join(right, [*model, *(f"_c{k}" for k in range(len(features)))])
    return both if test is None else both.where(test)


def _shape(df: DataFrame, vector: str) -> tuple[int, bool]:
    """(entries of the longest vector, whether an entry is null)."""
    r = df.agg(F.max(F.size(vector)), F.max(F.exists(vector, lambda x: x.isNull()))).first()
    return max(0, r[0] or 0), bool(r[1])


def _greatest(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0] if columns else F.lit(None).cast("double")


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, tests, F.lit(True))


class _Flux:
    """The largest difference of vectors of up to ``NARROW`` entries, by a column for each entry: a pair costs some
    comparisons in compiled code, most only one, and no array is made for it."""

    def __init__(self, vector: str, n: int, tol: float) -> None:
        self.vector, self.n, self.tol = vector, n, tol

    def columns(self, prefix: str) -> list[Column]:
        return [F.size(self.vector).alias(f"_{self.vector}_n"), *(F.get(self.vector, F.lit(k)).cast("double").alias(f"_{self.vector}_{k}") for k in range(self.n))]

    def distance(self) -> Column:
        # as ``linf``: entries that are null count for nothing
        far = [F.abs(F.col(f"a__{self.vector}_{k}") - F.col(f"b__{self.vector}_{k}")) for k in range(self.n)]
        return F.when(F.col(f"a__{self.vector}_n") == F.col(f"b__{self.vector}_n"), _greatest(far))

    def test(self) -> Column:
        close = [F.coalesce(F.abs(F.col(f"a__{self.vector}_{k}") - F.col(f"b__{self.vector}_{k}")) <= self.tol, F.lit(True)) for k in range(self.n)]
        return _all(close) & (self.distance() <= self.tol)


class _Relative:
    """The largest difference of complex lists, or of one number (``n`` is None), relative to the stored modulus."""

    def __init__(self, re: str, im: str, n: int | None, tol: float) -> None:
        self.re, self.im, self.n, self.tol = re, im, n, tol

    def _name(self, prefix: str, part: str, k: int) -> Column:
        return F.col(f"{prefix}_{self.re}_{part}{k}")

    def columns(self, prefix: str) -> list[Column]:
        out = []
        for k in range(self.n or 1):
            re, im = (F.col(c) if self.n is None else F.get(c, F.lit(k)) for c in (self.re, self.im))
            size = F.hypot(re, im)
            size = F.when(size == 0, 1.0).otherwise(size)
            out += [re.cast("double").alias(f"_{self.re}_x{k}"), im.cast("double").alias(f"_{self.re}_y{k}")]
            if prefix == "b_":  # the stored modulus, and its tolerance with what rounding takes, squared
                out += [size.alias(f"_{self.re}_s{k}"), (size * size * F.lit(self.tol * self.tol * (1 + 1e-9))).alias(f"_{self.re}_t{k}")]
        n = F.lit(1) if self.n is None else F.size(F.zip_with(self.re, self.im, lambda x, y: x))
        return [*out, n.alias(f"_{self.re}_n")]

    def test(self) -> Column:
        exact, close = [], []
        for k in range(1 if self.n is None else self.n):
            x, y = (self._name("a_", c, k) - self._name("b_", c, k) for c in "xy")
            exact.append(F.hypot(x, y) / self._name("b_", "s", k))
            limit = self._name("b_", "t", k)
            # squares that are too small or too large for a double tell nothing
            close.append(F.coalesce((x * x + y * y <= limit) | (limit < 1e-290), F.lit(True)))
        same = F.col(f"a__{self.re}_n") == F.col(f"b__{self.re}_n")
        return same & _all(close) & (_greatest(exact) <= self.tol)


def near_flux(a: DataFrame, b: DataFrame, model: Sequence[str], tol: float, vector: str = "flux", id_col: str = "id") -> DataFrame:
    """a_id, b_id and distance for the pairs of one model whose vectors differ by ``tol`` at most in every entry.

    Empty and null vectors, and vectors of different lengths, are near nothing; of a table with
    itself both directions and each row with itself come.  Rows of one vector are best merged
    first (``classes``).  Ids may be of any type.
    """
    n, gaps = _shape(b, vector)
    gaps = gaps or (n > NARROW and _shape(a, vector)[1])
    features, shares = layout(b, model, [*entries(vector, min(64, n), tol), *pivots(b, vector, tol)], id_col)
    keep = [*model, id_col, vector]
    a, b = a.select(*keep), b.select(*keep)
    if n > NARROW and not gaps:
        return _tiled(a, b, model, features, shares, n, tol, vector, id_col)
    if n > NARROW:  # vectors with null entries are compared one by one
        distance = A.linf(f"a_{vector}", f"b_{vector}")
        both = candidates(a, b, model, features, distance <= tol).withColumn("distance", distance)
        return both.select(*model, F.col(f"a_{id_col}").alias("a_id"), F.col(f"b_{id_col}").alias("b_id"), "distance")
    features = narrowed(features, a.count(), b.count())
    flux = _Flux(vector, n, tol)
    both = candidates(a.select("*", *flux.columns("a_")), b.select("*", *flux.columns("b_")), model, features, flux.test())
    return both.select(*model, F.col(f"a_{id_col}").alias("a_id"), F.col(f"b_{id_col}").alias("b_id"), flux.distance().alias("distance"))


def _blocks(rows: DataFrame, model: Sequence[str], cells: Sequence[str], parts: int, size: str, prefix: str, vector: str, id_col: str) -> DataFrame:
    """A row for each part of a cell's rows of one length: their ids and their vectors."""
    part = F.pmod(F.xxhash64(F.lit(prefix), id_col), F.lit(parts)).cast("int")
    kind = rows.schema[vector].dataType.elementType.simpleString()
    entries_ = F.col(vector) if kind in ("float", "double") else F.transform(vector, lambda x: x.cast("double"))
    rows = rows.select(*model, *cells, size, part.alias(f"{prefix}part"), F.struct(F.col(id_col).alias("id"), entries_.alias("v")).alias("r"))
    return rows.groupBy(*model, *cells, size, f"{prefix}part").agg(F.collect_list("r").alias(f"{prefix}rows"))


def _tiled(a: DataFrame, b: DataFrame, model: Sequence[str], features: Sequence[Feature], shares: Sequence[float], n: int, tol: float, vector: str, id_col: str) -> DataFrame:
    """``near_flux`` for long vectors: the rows of a cell go in blocks of a bounded size, and blocks are compared by numpy.

    What no feature parts is divided by blocks all the same: each of the stored ones is in one strip of its
    cell, and the asked ones go to every strip, so that a cell of all rows is work for many tasks.
    """
    asked, stored = a.count(), b.count()
    one = b.groupBy(*model).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    share = min([*shares[-1:], one / max(1, stored) ** 2])
    if not shares or shares[-1] > GAIN * one / max(1, stored) ** 2:
        features = []
    cells = [f"_c{k}" for k in range(len(features))]
    left, right = (df.where(F.size(vector) > 0).withColumn("_n", F.size(vector)) for df in (a, b))
    for c, f in zip(cells, features, strict=True):
        left, right = left.withColumn(c, F.explode(f.cells(""))), right.withColumn(c, f.cell(""))
    rows = max(16, TILE // n)
    parts = lambda df_rows: max(1, math.ceil(share * df_rows / rows))
    strips = min(parts(stored), max(16, min(128, stored // max(1, asked))))
    kind = a.schema[id_col].dataType
    left = _blocks(left, model, cells, parts(asked), "_n", "a_", vector, id_col).withColumn("_strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = _blocks(right, model, cells, parts(stored), "_n", "b_", vector, id_col).withColumn("_strip", F.pmod("b_part", F.lit(strips)).cast("int"))
    names = [f"_m{k}" for k in range(len(model))]
    both = left.join(right, [*model, *cells, "_n", "_strip"]).select(*(F.col(m).alias(x) for m, x in zip(model, names, strict=True)), "a_rows", "b_rows")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"  # a row is two blocks
    if int(a.sparkSession.conf.get(name, "10000")) == 10000:
        a.sparkSession.conf.set(name, "200")
    schema = StructType([*(StructField(x, both.schema[x].dataType) for x in names), StructField("a_id", kind), StructField("b_id", b.schema[id_col].dataType), StructField("distance", DoubleType())])

    def run(batches):
        for batch in batches:
            sides = [_matrices(batch.column(len(names) + k)) for k in (0, 1)]
            for r in range(batch.num_rows):
                (x_id, x), (y_id, y) = sides[0](r), sides[1](r)
                for at in range(0, x.shape[1], 64):  # a tile that stays in the processor's cache
                    i, j, far = _near_rows(x[:, at : at + 64], y, tol)
                    if not len(i):
                        continue
                    same = [batch.column(k).take(pa.array(np.full(len(i), r))) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*same, x_id.take(pa.array(i + at)), y_id.take(pa.array(j)), pa.array(far)], names=[f.name for f in schema])

    out = both.mapInArrow(run, schema)
    return out.select(*(F.col(x).alias(m) for m, x in zip(model, names, strict=True)), "a_id", "b_id", "distance")


def _matrices(column: pa.Array) -> Callable[[int], tuple[pa.Array, np.ndarray]]:
    """For a row of blocks its ids, and a matrix with a column for each of its vectors."""

    def get(r: int) -> tuple[pa.Array, np.ndarray]:
        rows = column[r].values
        v = rows.field("v").flatten() if rows.offset == 0 else pa.compute.struct_field(rows, "v").flatten()
        ids = rows.field("id") if rows.offset == 0 else pa.compute.struct_field(rows, "id")
        return ids, np.ascontiguousarray(v.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1).T)

    return get


def _near_rows(x: np.ndarray, y: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, largest difference) of the columns of x and y that differ by ``tol`` at most.

    Whole tiles for some entries; where few pairs are left, these alone.
    """
    far = np.zeros((x.shape[1], y.shape[1]))
    gap = np.empty_like(far)
    k, step = 0, 8
    while k < len(x):
        for e in range(k, min(k + step, len(x))):
            np.subtract(x[e][:, None], y[e][None, :], out=gap)
            np.abs(gap, out=gap)
            np.maximum(far, gap, out=far)
        k += step
        if k < len(x) and np.count_nonzero(far <= tol) < 0.3 * far.size:
            break
    i, j = np.nonzero(far <= tol)
    far = far[i, j]
    while k < len(x) and len(i):
        for e in range(k, min(k + step, len(x))):
            np.maximum(far, np.abs(x[e, i] - y[e, j]), out=far)
        k += step
        held = far <= tol
        i, j, far = i[held], j[held], far[held]
    return i, j, far


def near(a: DataFrame, b: DataFrame, model: Sequence[str], moduli_tol: float | None = None, tau_tol: float | None = None, flux_tol: float | None = None, id_col: str = "id") -> DataFrame:
    """a_id and b_id of pairs of one model that are near by all that is asked for.

    Columns are ``flux``, ``moduli_re`` and ``moduli_im``, ``tau_re`` and ``tau_im``; moduli and tau differ
    relative to those of ``b``, the stored rows, and absolutely where these are 0.
    """
    columns, features, tests, zeros, scalars = [id_col], [], [], [], []
    flux_n = 0
    if tau_tol is not None:
        columns += ["tau_re", "tau_im"]
        features += relative("tau_re", "tau_im", None, tau_tol)
        scalars.append(_Relative("tau_re", "tau_im", None, tau_tol))
        zeros.append((F.col("tau_re") == 0) & (F.col("tau_im") == 0))
    if flux_tol is not None:
        columns.append("flux")
        flux_n, _ = _shape(b, "flux")
        features += [*entries("flux", min(64, flux_n), flux_tol), *pivots(b, "flux", flux_tol)]
        if flux_n <= NARROW:
            scalars.append(_Flux("flux", flux_n, flux_tol))
        else:
            tests.append(A.linf("a_flux", "b_flux") <= flux_tol)
    if moduli_tol is not None:
        columns += ["moduli_re", "moduli_im"]
        n = max(_shape(b, "moduli_re")[0], _shape(b, "moduli_im")[0])
        features += relative("moduli_re", "moduli_im", min(16, n), moduli_tol)
        if n <= NARROW:
            scalars.append(_Relative("moduli_re", "moduli_im", n, moduli_tol))
        else:
            tests.append(A.relative_linf("b_moduli_re", "b_moduli_im", "a_moduli_re", "a_moduli_im") <= moduli_tol)
        zeros.append(F.exists(F.zip_with("moduli_re", "moduli_im", lambda x, y: (x == 0) & (y == 0)), lambda z: z))
    if not (tests or scalars):
        raise ValueError("a tolerance is needed")
    every = _all([*(s.test() for s in scalars), *tests])
    a, b = (df.select(*model, *columns, *(c for s in scalars for c in s.columns(prefix))) for df, prefix in ((a, "a_"), (b, "b_")))
    back = [*model, F.col(f"a_{id_col}").alias("a_id"), F.col(f"b_{id_col}").alias("b_id")]
    zero = F.coalesce(reduce(lambda x, y: x | y, zeros), F.lit(False)) if zeros else F.lit(False)
    plain = b.where(~zero)
    chosen = narrowed(layout(plain, model, features, id_col)[0], a.count(), b.count())
    out = candidates(a, plain, model, chosen, every).select(*back)
    if not zeros:
        return out
    # a stored 0 has no direction, so these rows are sought by the entries of the flux, if any
    exact = entries("flux", min(DEPTH, flux_n), flux_tol) if flux_tol is not None else []
    return out.unionByName(candidates(a, b.where(zero), model, exact, every).select(*back))


def classes(rows: DataFrame, model: Sequence[str], columns: Sequence[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(one row for each different value of the columns in a model, by its least id, with n_copies; membership:
    every id with its class_id).  A join of the first with itself has no pair of copies to write."""
    first = rows.groupBy(*model, *columns).agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))
    same = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    on = reduce(lambda x, y: x & y, (same(c) for c in (*model, *columns)))
    return first, rows.alias("r").join(first.alias("f"), on).select(*(F.col(f"r.{m}").alias(m) for m in model), F.col(f"r.{id_col}").alias(id_col), F.col(f"f.{id_col}").alias("class_id"))
