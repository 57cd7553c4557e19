"""Phases with their tensors, nested model rows, and derived columns by a model of physics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions import arrays as A
from moraine.functions import ids


def tensors(df: DataFrame, in_basis: bool = False, layout: str = "coo", i="intnums_coo_i", j="intnums_coo_j", k="intnums_coo_k", v="intnums_coo_v", name: str = "kappa") -> DataFrame:
    """Intersection numbers of phases with polytope data, as stored or in the basis, sparse or dense.

    The tensor comes as four lists or as one column ``intnums_coo``.
    """
    t = F.col("intnums_coo").cast(A.COO) if "intnums_coo" in df.columns else A.coo(i, j, k, v)
    if in_basis:
        t = A.basis_slice(t, "cy_basis")
    if layout == "dense":
        size = F.size("cy_basis") if in_basis else F.size("c2")
        t = A.dense(t, size.cast("long"))
    elif layout != "coo":
        raise ValueError("layout must be 'coo' or 'dense'")
    return df.withColumn(name, t)


def second_chern(df: DataFrame, in_basis: bool = False, name: str = "c2_out") -> DataFrame:
    return df.withColumn(name, A.take("c2", "cy_basis") if in_basis else F.col("c2"))


def full_tensors(df: DataFrame, h11: str = "h11", **options) -> DataFrame:
    """In-basis tensors of phases whose basis covers h11; any other is an error."""
    complete = A.basis_is_complete("cy_basis", h11)
    checked = F.when(complete, F.col("cy_basis")).otherwise(F.raise_error(F.lit("the basis does not cover h11")))
    return tensors(df.withColumn("cy_basis", checked), in_basis=True, **options)


def with_wall_hash(df: DataFrame) -> DataFrame:
    """wall_hash where a phase lacks it, from its canonical in-basis data."""
    t = F.col("intnums_coo").cast(A.COO) if "intnums_coo" in df.columns else A.coo("intnums_coo_i", "intnums_coo_j", "intnums_coo_k", "intnums_coo_v")
    made = ids.wall_hash_digest("h11", "h12", A.canonical_in_basis(t, "cy_basis"), A.take("c2", "cy_basis"))
    return df.withColumn("wall_hash", F.coalesce(F.col("wall_hash"), made) if "wall_hash" in df.columns else made)


def checked_phases(df: DataFrame, key: Iterable[str] = ("mode", "h11", "ks_id", "triang_id")) -> DataFrame:
    """Phases whose whole key is given and whose chi, if there, fits; anything else is an error when read."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    first = next(iter(key))
    out = df.withColumn(first, F.when(bad, F.raise_error(F.lit("a phase needs its whole key"))).otherwise(F.col(first)))
    return out.withColumn("chi", A.checked_euler("h11", "h12", "chi") if "chi" in df.columns else A.euler("h11", "h12"))


def cicy_rows(df: DataFrame) -> DataFrame:
    """Complete-intersection rows, stored mirrored, in the plain convention; h11 must be positive."""
    from moraine.operators.filters import swap

    out = swap(df)
    return out.withColumn("h11", F.when(F.col("h11") <= 0, F.raise_error(F.lit("h11 must be positive"))).otherwise(F.col("h11")))


def polytope_rows(df: DataFrame, points: str = "polytope_points") -> DataFrame:
    """Points, and the other columns that are not null as a struct ``extra``."""
    rest = [c for c in df.columns if c != points]
    return df.select(F.col(points), F.struct(*rest).alias("extra")) if rest else df.select(points)


def models(catalog: DataFrame, detail: DataFrame, keys: list[str], gv: DataFrame | None = None, conifolds: DataFrame | None = None, polytopes: DataFrame | None = None, max_degree: int | None = None) -> DataFrame:
    """One nested row for each model: key, detail, and what else there is of invariants, conifolds, polytope."""
    from moraine.operators.joins import nested_conifolds

    nest = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
    out = catalog.join(nest(detail, "detail"), keys)
    if gv is not None:
        if max_degree is not None:
            kept = A.truncate_by_degree("gv_charges", "gv_invariants", "grading_vector", max_degree)
            gv = gv.withColumn("_kept", kept).withColumns({"gv_charges": F.transform("_kept", lambda x: x["charge"]), "gv_invariants": F.transform("_kept", lambda x: x["value"])}).drop("_kept")
        out = out.join(nest(gv, "gv"), keys, "left")
    if conifolds is not None:
        out = out.join(nested_conifolds(conifolds, keys), keys, "left")
    if polytopes is not None:
        out = out.join(nest(polytopes, "polytope"), keys, "left")
    return out


#: Derived columns and their types.
DERIVED = {"g_s": T.DoubleType(), "N_flux": T.DoubleType(), "W_re": T.DoubleType(), "W_im": T.DoubleType(), "F_terms_re": T.ArrayType(T.DoubleType()), "F_terms_im": T.ArrayType(T.DoubleType()), "residual": T.DoubleType(), "is_susy": T.BooleanType(), "m_gravitino": T.DoubleType(), "mass2": T.ArrayType(T.DoubleType())}


def complete_missing(df: DataFrame, model, fill_missing_only: bool = True, with_masses: bool = True, tol: float = 1e-6, batch: int | None = None) -> DataFrame:
    """Derived columns by a model with ``tadpole``, ``superpotential``, ``DW`` and, for masses, ``kahler_potential`` and ``mass_matrix``.

    Each is a function of (moduli, tau, flux).  A row on which the model fails gets nulls.
    Values already there stay, unless all are to be made anew.

    With ``batch`` the functions take arrays of that many rows (moduli of n by h, tau of n, flux of n
    by f) and give values along the first axis; a batch is filled up with its last row, so that a
    compiled model sees one shape for each size of moduli and flux.  A batch that fails is
    halved until the rows that fail are alone.
    """
    if model is None:
        raise ValueError("a model is needed")
    return _completed(df, lambda key: model, [], fill_missing_only, with_masses, tol, batch)


def _values(model, z: np.ndarray, tau: np.ndarray, flux: np.ndarray, with_masses: bool) -> dict[str, np.ndarray]:
    """What the model's functions give for arrays of rows."""
    n = len(tau)
    out = {"w": np.asarray(model.superpotential(z, tau, flux), complex).reshape(n), "dw": np.asarray(model.DW(z, tau, flux), complex).reshape(n, -1), "tadpole": np.asarray(model.tadpole(flux), float).reshape(n)}
    if with_masses:
        m = np.asarray(model.mass_matrix(z, tau, flux), float)
        out |= {"kahler": np.real(np.asarray(model.kahler_potential(z, tau))).astype(float).reshape(n), "mass2": np.linalg.eigvalsh((m + np.swapaxes(m, -1, -2)) / 2)}
    return out


class _OneByOne:
    """A model of single rows, called as one of arrays is."""

    def __init__(self, model) -> None:
        self.model = model

    def __getattr__(self, name: str):
        of = getattr(self.model, name)
        return lambda *arrays: np.stack([np.asarray(of(*row)) for row in zip(*arrays, strict=True)])


def _in_batches(model, rows: np.ndarray, z: np.ndarray, tau: np.ndarray, flux: np.ndarray, batch: int, with_masses: bool, put: Callable) -> None:
    """``put(places, values)`` for the rows on which the model does not fail."""
    for a in range(0, len(rows), batch):
        part = np.arange(a, min(a + batch, len(rows)))
        full = np.concatenate([part, np.full(batch - len(part), part[-1])])
        try:
            got = _values(model, z[full], tau[full], flux[full], with_masses)
        except Exception:  # of one of these rows, or of more
            if len(part) > 1:
                for half in np.array_split(part, 2):
                    _in_batches(model, rows[half], z[half], tau[half], flux[half], batch, with_masses, put)
            continue
        put(rows[part], {k: v[: len(part)] for k, v in got.items()})


def _derived(frame: pd.DataFrame, keys: list[str], model_of: Callable[[tuple], object], with_masses: bool, tol: float, batch: int | None) -> dict[str, list]:
    """The derived values of a frame's rows, None where there are none."""
    out: dict[str, list] = {c: [None] * len(frame) for c in DERIVED}
    size: dict[tuple, list[int]] = {}
    known = {k: frame[k].tolist() for k in keys}
    lists = {c: frame[c].tolist() for c in ("flux", "moduli_re", "moduli_im")}
    tau = np.array(frame["tau_re"], float) + 1j * np.array(frame["tau_im"], float)
    for i in range(len(frame)):
        f, re, im = lists["flux"][i], lists["moduli_re"][i], lists["moduli_im"][i]
        if f is not None and re is not None and im is not None and len(re) == len(im):
            size.setdefault((tuple(known[k][i] for k in keys), len(re), len(f)), []).append(i)

    def put(places: np.ndarray, got: dict[str, np.ndarray]) -> None:
        worst = np.abs(got["dw"]).max(axis=1) if got["dw"].shape[1] else np.zeros(len(places))
        for j, i in enumerate(places.tolist()):
            w = got["w"][j]
            own = {"g_s": 1 / tau[i].imag if tau[i].imag else None, "N_flux": float(got["tadpole"][j]), "W_re": float(w.real), "W_im": float(w.imag), "F_terms_re": got["dw"][j].real.tolist(), "F_terms_im": got["dw"][j].imag.tolist(), "residual": float(worst[j]), "is_susy": bool(worst[j] < tol)}
            if with_masses:
                own |= {"m_gravitino": float(np.exp(got["kahler"][j] / 2) * abs(w)), "mass2": got["mass2"][j].tolist()}
            for c, v in own.items():
                out[c][i] = v

    for (key, *_), places in size.items():
        try:
            model = model_of(key)
        except Exception:  # these rows have no model
            continue
        rows = np.array(places)
        arrays = [np.array([lists[c][i] for i in places], float) for c in ("moduli_re", "moduli_im", "flux")]
        z = (arrays[0] + 1j * arrays[1]).reshape(len(places), -1)
        _in_batches(model if batch else _OneByOne(model), rows, z, tau[rows], arrays[2].reshape(len(places), -1), batch or 1, with_masses, put)
    return out


def _completed(df: DataFrame, model_of: Callable[[tuple], object], keys: list[str], fill_missing_only: bool = True, with_masses: bool = True, tol: float = 1e-6, batch: int | None = None) -> DataFrame:
    """Derived columns by the model of each row, known by the values of ``keys``."""
    have = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(have[c] for c in df.columns), *(T.StructField(n, t) for n, t in DERIVED.items() if n not in have)])

    plain = [c for c in df.columns if c not in DERIVED]

    def missing(x) -> bool:
        return x is None or (isinstance(x, float) and np.isnan(x))

    def run(frames: Iterable[pd.DataFrame]):
        for f in frames:
            new, done = _derived(f, keys, model_of, with_masses, tol, batch), {}
            for c in DERIVED:
                held = f[c].tolist() if c in f else None
                if held is None or not fill_missing_only:
                    done[c] = new[c]
                else:
                    done[c] = [v if missing(x) and v is not None else x for x, v in zip(held, new[c], strict=True)]
            rest = {c: f[c].tolist() for c in plain}
            yield pd.DataFrame({c: pd.Series((rest | done)[c], dtype=object) for c in schema.names})

    return df.mapInPandas(run, schema)


def derived_by_columns(df: DataFrame, kahler: Column | None = None) -> DataFrame:
    """Those derived columns that need no model, as expressions."""
    new = {"g_s": A.coupling("tau_im")}
    if {"F_terms_re", "F_terms_im"} <= set(df.columns):
        new |= {"residual": A.largest_modulus("F_terms_re", "F_terms_im"), "is_susy": A.is_supersymmetric("F_terms_re", "F_terms_im")}
    if kahler is not None and {"W_re", "W_im"} <= set(df.columns):
        new["m_gravitino"] = A.gravitino_mass(kahler, "W_re", "W_im")
    return df.withColumns({n: F.coalesce(F.col(n), e) if n in df.columns else e for n, e in new.items()})


#: Models that a worker keeps.
KEPT_MODELS = 32


def by_model(rows: DataFrame, loader: Callable[[dict], object], keys: list[str], **options) -> DataFrame:
    """Derived columns where each model has its own physics, in one pass over the rows.

    Rows of a model stand together in their partition, so a worker loads a model once, by its
    key; ``loader`` goes to the workers.
    """
    held: dict[tuple, object] = {}

    def model_of(key: tuple):
        if key not in held:
            if len(held) >= KEPT_MODELS:
                held.clear()
            held[key] = loader(dict(zip(keys, key, strict=True)))
        return held[key]

    return _completed(rows.sortWithinPartitions(*keys), model_of, list(keys), **options)
