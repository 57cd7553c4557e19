"""Arrays, sparse tensors and numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moraine.functions.ids import col

COO = "array<struct<i:bigint,j:bigint,k:bigint,v:bigint>>"


def pad(a: Column | str, size: int, fill: float = -1) -> Column:
    """The first ``size`` entries; what is missing is ``fill``, in the array's own type.  Null stays null."""
    a = col(a)
    filler = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda _: F.lit(fill)) if size > 0 else F.array()
    return F.slice(F.concat(a, F.transform(filler, lambda x: x)), 1, size) if size > 0 else F.slice(a, 1, 0)


def is_integral(flux: Column | str, tol: float = 1e-6) -> Column:
    """No entry is further than ``tol`` from its whole part."""
    return ~F.exists(col(flux), lambda x: F.abs(x - x.cast("long")) > tol)


def zip_complex(re: Column | str, im: Column | str) -> Column:
    return F.zip_with(col(re), col(im), lambda a, b: F.struct(a.alias("re"), b.alias("im")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def truncate_by_degree(charges: Column | str, values: Column | str, grading: Column | str, most: int | Column) -> Column:
    """(charge, value) of charges of degree ``most`` or less; a negative degree is an error; null stays null."""
    both = F.arrays_zip(col(charges).alias("charge"), col(values).alias("value"))
    g = col(grading)
    degree = lambda x: dot(x["charge"], g)
    limit = F.lit(most) if isinstance(most, int) else most
    checked = F.when(F.exists(both, lambda x: degree(x) < 0), F.raise_error(F.lit("a charge has a negative degree"))).otherwise(both)
    return F.filter(checked, lambda x: degree(x) <= limit)


def gv_family(charges: Column | str, values: Column | str) -> Column:
    """One family of invariants, null as a whole if either list is."""
    a, b = col(charges), col(values)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("charges"), b.alias("invariants")))


def exact_integers(texts: Column | str) -> Column:
    """Decimal texts with the integer where it fits 38 digits: (text, value)."""
    return F.transform(col(texts), lambda x: F.struct(x.alias("text"), x.try_cast("decimal(38,0)").alias("value")))


def coo(i: Column | str, j: Column | str, k: Column | str, v: Column | str) -> Column:
    """Four lists as one list of entries."""
    return F.arrays_zip(*(col(x).alias(n) for x, n in zip((i, j, k, v), "ijkv"))).cast(COO)


def canonical_coo(t: Column | str) -> Column:
    """Indices of each entry in order, equal entries summed, zeros dropped, entries sorted."""
    keyed = F.transform(
        col(t),
        lambda x: F.struct(
            F.least(x["i"], x["j"], x["k"]).alias("i"),
            (x["i"] + x["j"] + x["k"] - F.least(x["i"], x["j"], x["k"]) - F.greatest(x["i"], x["j"], x["k"])).alias("j"),
            F.greatest(x["i"], x["j"], x["k"]).alias("k"),
            x["v"].alias("v"),
        ),
    )
    ordered = F.array_sort(keyed).cast(COO)
    empty = F.array().cast(COO)

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (last["i"] == x["i"]) & (last["j"] == x["j"]) & (last["k"] == x["k"])
        summed = F.struct(x["i"].alias("i"), x["j"].alias("j"), x["k"].alias("k"), (last["v"] + x["v"]).alias("v"))
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(summed))).otherwise(F.concat(acc, F.array(x)))

    return F.filter(F.aggregate(ordered, empty, add), lambda x: x["v"] != 0)


def _index(basis: Column, x: Column) -> Column:
    return F.array_position(basis, x)


def basis_slice(t: Column | str, basis: Column | str) -> Column:
    """Entries whose indices are all in the basis, numbered by their place in it."""
    b = col(basis).cast("array<bigint>")
    inside = F.filter(col(t), lambda x: (_index(b, x["i"]) > 0) & (_index(b, x["j"]) > 0) & (_index(b, x["k"]) > 0))
    return F.transform(inside, lambda x: F.struct(*((_index(b, x[n]) - 1).alias(n) for n in "ijk"), x["v"].alias("v"))).cast(COO)


def take(a: Column | str, places: Column | str) -> Column:
    """a[p] for each place p, counted from 0."""
    return F.transform(col(places), lambda p: F.get(col(a), p.cast("int")))


def canonical_in_basis(t: Column | str, basis: Column | str) -> Column:
    return canonical_coo(basis_slice(t, basis))


def normalize_source(mode: str, t: Column | str, c2: Column | str, basis: Column | str) -> Column:
    """A source's labels as places from 0: (coo, c2, c2_origin, basis).

    ``frst``: label 0 is the origin and goes, from the tensor and from c2.  ``vex``: labels
    start at 1 and c2 has no origin.
    """
    shift = lambda x: F.struct((x["i"] - 1).alias("i"), (x["j"] - 1).alias("j"), (x["k"] - 1).alias("k"), x["v"].alias("v"))
    moved_basis = F.transform(col(basis), lambda b: b - 1)
    if mode == "frst":
        inside = F.filter(col(t), lambda x: (x["i"] != 0) & (x["j"] != 0) & (x["k"] != 0))
        c2_rest, origin = F.slice(col(c2), F.lit(2), F.greatest(F.size(col(c2)) - 1, F.lit(0))), F.get(col(c2), F.lit(0))
    elif mode == "vex":
        inside, c2_rest, origin = col(t), col(c2), F.lit(None)
    else:
        raise ValueError("mode must be 'frst' or 'vex'")
    return F.struct(canonical_coo(F.transform(inside, shift)).alias("coo"), c2_rest.cast("array<bigint>").alias("c2"), origin.cast("long").alias("c2_origin"), moved_basis.cast("array<bigint>").alias("basis"))


def dense(t: Column | str, n: Column | int) -> Column:
    """The symmetric n x n x n tensor as one flat array; of entries for one place the last counts."""
    size = F.lit(n) if isinstance(n, int) else n
    keyed = F.transform(col(t), lambda x: F.struct((F.array_min(F.array(x["i"], x["j"], x["k"])) * 1000000 + (x["i"] + x["j"] + x["k"] - F.array_min(F.array(x["i"], x["j"], x["k"])) - F.array_max(F.array(x["i"], x["j"], x["k"]))) * 1000 + F.array_max(F.array(x["i"], x["j"], x["k"]))).alias("key"), x["v"].alias("v")))

    def at(place: Column) -> Column:
        a, b, c = F.floor(place / (size * size)), F.floor(place / size) % size, place % size
        low, high = F.least(a, b, c), F.greatest(a, b, c)
        key = low * 1000000 + (a + b + c - low - high) * 1000 + high
        return F.coalesce(F.try_element_at(F.filter(keyed, lambda e: e["key"] == key), F.lit(-1))["v"], F.lit(0).cast("long"))

    return F.when(size <= 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), (size * size * size - 1).cast("long") if not isinstance(n, int) else F.lit(max(0, n**3 - 1)).cast("long")), at))


def prime_labels(n_components: Column | str) -> Column:
    """For each component the number of the divisor it is part of."""
    return F.flatten(F.transform(col(n_components), lambda n, i: F.array_repeat(i.cast("long"), n.cast("int"))))


def fold_tensor(t: Column | str, labels: Column) -> Column:
    """Entries of components summed over the divisors they are part of."""
    moved = F.transform(col(t), lambda x: F.struct(*(F.get(labels, x[n].cast("int")).alias(n) for n in "ijk"), x["v"].alias("v"))).cast(COO)
    return canonical_coo(moved)


def fold_vector(c2: Column | str, labels: Column) -> Column:
    """c2 of components summed over the divisors they are part of."""
    both = F.arrays_zip(labels.alias("d"), col(c2).alias("v"))
    top = F.coalesce(F.array_max(labels), F.lit(-1).cast("long"))
    sums = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(top, F.lit(0).cast("long"))), lambda d: F.aggregate(F.filter(both, lambda x: x["d"] == d), F.lit(0).cast("long"), lambda s, x: s + x["v"].cast("long")))
    return F.when(top < 0, F.array().cast("array<bigint>")).otherwise(sums)


def slice_basis(cy_basis: Column | str, c2: Column | str, n_components: Column | str, basis_dim: Column | str) -> Column:
    """The basis to slice by: all of it where the tensor is unfolded into components, else its first ``basis_dim``."""
    n = F.aggregate(col(n_components), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    unfolded = (F.size(col(c2)) == F.size(col(n_components))) & (F.size(col(n_components)) != n)
    return F.when(unfolded, glsm_basis(cy_basis, basis_dim)).otherwise(col(cy_basis))


def glsm_basis(cy_basis: Column | str, basis_dim: Column | str) -> Column:
    return F.slice(col(cy_basis), F.lit(1), col(basis_dim).cast("int"))


def basis_is_complete(basis: Column | str, h11: Column | str) -> Column:
    return F.size(col(basis)) == col(h11)


def class_kind(mode: Column | str) -> Column:
    return F.when(col(mode) == "frst", "cy-class").otherwise("wall-class")


def euler(h11: Column | str, h12: Column | str) -> Column:
    return 2 * (col(h11) - col(h12))


def tadpole_bound(h11: Column | str, h12: Column | str) -> Column:
    return col(h11) + col(h12) + 2


def checked_euler(h11: Column | str, h12: Column | str, chi: Column | str) -> Column:
    """chi, which must be 2 (h11 - h12) where it is given."""
    want = euler(h11, h12)
    return F.when(col(chi).isNotNull() & (col(chi) != want), F.raise_error(F.lit("chi is not 2 (h11 - h12)"))).otherwise(want)


# --- numbers ------------------------------------------------------------------------


def coupling(tau_im: Column | str) -> Column:
    """1 / Im tau, null at 0."""
    return F.lit(1.0) / F.nullif(col(tau_im).cast("double"), F.lit(0.0))


def is_missing(x: Column | str) -> Column:
    return col(x).isNull() | F.isnan(col(x))


def fill_missing(x: Column | str, value: Column) -> Column:
    return F.when(is_missing(x), value).otherwise(col(x))


def largest_modulus(re: Column | str, im: Column | str) -> Column:
    return F.array_max(F.zip_with(col(re), col(im), F.hypot))


def is_supersymmetric(re: Column | str, im: Column | str, tol: float = 1e-6) -> Column:
    return largest_modulus(re, im) < tol


def gravitino_mass(k: Column | str, w_re: Column | str, w_im: Column | str) -> Column:
    return F.exp(col(k) / 2) * F.hypot(col(w_re), col(w_im))


def linf(a: Column | str, b: Column | str) -> Column:
    """The largest difference; null for lists that are empty or of different lengths."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def relative_linf(re: Column | str, im: Column | str, to_re: Column | str, to_im: Column | str) -> Column:
    """The largest complex difference relative to the first pair's modulus (1 where that is 0)."""
    first = F.zip_with(col(re), col(im), lambda x, y: F.struct(x.alias("re"), y.alias("im")))
    other = F.zip_with(col(to_re), col(to_im), lambda x, y: F.struct(x.alias("re"), y.alias("im")))

    def one(a: Column, b: Column) -> Column:
        size = F.hypot(a["re"], a["im"])
        return F.hypot(a["re"] - b["re"], a["im"] - b["im"]) / F.when(size == 0, 1.0).otherwise(size)

    return F.when(F.size(first) == F.size(other), F.array_max(F.zip_with(first, other, one)))


def older_than(ts: Column | str, days: float, now: Column | None = None) -> Column:
    """Whether a timestamp's text is more than some days ago; what cannot be read is not."""
    now = now if now is not None else F.current_timestamp()
    return F.coalesce(F.try_to_timestamp(col(ts)) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days) * 86400)), F.lit(False))
