"""Eigenvalues of columns of matrices: all matrices of one size in an Arrow batch go into one call.

A matrix is a list of rows, given by its real part or by real and imaginary parts.  What is no
finite square matrix has null.  The least eigenvalue is of the symmetric (with an imaginary
part, Hermitian) half of the matrix and its transpose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lists(column) -> tuple[np.ndarray, pa.Array]:
    """(offsets into the values, the values) of a list column; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), column.flatten()


def _square(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of each matrix, 0 for what is none; first place of its numbers; the numbers)."""
    rows, inner = _lists(column)
    at, values = _lists(inner)
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    numbers = np.array(numbers, np.float64)
    n, width = np.diff(rows), np.diff(at)
    odd = np.concatenate([[0], np.cumsum(width != np.repeat(n, n))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    first, last = at[rows[:-1]], at[rows[1:]]
    good = (odd[rows[1:]] == odd[rows[:-1]]) & (bad[last] == bad[first])
    return np.where(good, n, 0), first, numbers


def _spectra(re, im=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, their sorted eigenvalues) for each size."""
    n, first, numbers = _square(re)
    if im is not None:
        other, first_im, numbers_im = _square(im)
        n = np.where(n == other, n, 0)
    out = []
    for k in np.unique(n[n > 0]).tolist():
        places = np.flatnonzero(n == k)
        stack = lambda a, x: x[a[places][:, None] + np.arange(k * k)].reshape(-1, k, k)
        m = stack(first, numbers)
        if im is not None:
            m = m + 1j * stack(first_im, numbers_im)
        out.append((places, np.linalg.eigvalsh((m + np.conj(np.swapaxes(m, -1, -2))) / 2)))
    return out


def _least(count: int, spectra) -> pa.Array:
    out, there = np.zeros(count), np.zeros(count, bool)
    for places, values in spectra:
        out[places], there[places] = values[:, 0], True
    return pa.array(out, pa.float64(), mask=~there)


def _all(count: int, spectra) -> pa.Array:
    size = np.zeros(count, np.int64)
    for places, values in spectra:
        size[places] = values.shape[1]
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.zeros(at[-1])
    for places, values in spectra:
        flat[at[places][:, None] + np.arange(values.shape[1])] = values
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat), mask=pa.array(size == 0)) if (size == 0).any() else lists


@F.arrow_udf(T.DoubleType())
def least_eigenvalue(matrix: pa.Array) -> pa.Array:
    """Of the symmetric part of a real matrix."""
    return _least(len(matrix), _spectra(matrix))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def spectrum(matrix: pa.Array) -> pa.Array:
    """Sorted eigenvalues of the symmetric part of a real matrix."""
    return _all(len(matrix), _spectra(matrix))


@F.arrow_udf(T.DoubleType())
def least_hermitian(re: pa.Array, im: pa.Array) -> pa.Array:
    """Of the Hermitian part of a complex matrix."""
    return _least(len(re), _spectra(re, im))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hermitian_spectrum(re: pa.Array, im: pa.Array) -> pa.Array:
    """Sorted eigenvalues of the Hermitian part of a complex matrix."""
    return _all(len(re), _spectra(re, im))


def least_of_vector(values: Column | str) -> Column:
    """Of a diagonal matrix, given by its entries; null for an empty list or one with a null, NaN counts as greatest."""
    values = F.col(values) if isinstance(values, str) else values
    return F.when(~F.exists(values, lambda x: x.isNull()), F.array_min(values)).cast("double")


def endpoint(metric_re: Column, metric_im: Column, hessian: Column, mass: Column, im_tau: Column) -> Column:
    """The certificate of an endpoint from its matrices: the metric's is Hermitian, the others' real."""
    from moraine.operators.vetting import stability

    return stability(least_hermitian(metric_re, metric_im), least_eigenvalue(hessian), least_eigenvalue(mass), im_tau)
