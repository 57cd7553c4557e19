"""Validation, certification and the lifecycle of designated solutions.

What is wrong with a row is data (``errors``, an array of texts) until a caller decides.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.errors import ValidationError
from moraine.functions import arrays as A
from moraine.functions import ids
from moraine.functions import text as X
from moraine.operators.joins import anti
from moraine.operators.windows import number_rows
from moraine.schemas import CERT_STATUSES, FLOOR_COLUMNS, REQUIRED_COLUMNS


def errors_of(*checks: tuple[Column, str]) -> Column:
    """The messages of all checks that fail (are true)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks)))


def validate_rows(df: DataFrame, known: DataFrame | None = None, tadpole: float | None = None, tol: float | None = None, required: Sequence[str] = FLOOR_COLUMNS, key: Sequence[str] = ("flux",), susy_only: bool = False, residual: Column | None = None) -> DataFrame:
    """``df`` with ``errors`` and ``passed``: required values, known solutions, residual, tadpole.

    Later checks count only for rows with no earlier error.  A column that is missing fails
    every row, if it is required.  ``residual`` is worked out by the caller's model (such as a
    ``python_certifier``'s); without it the stored column counts.  A residual that is null or
    not a number is over any tolerance.
    """
    missing = [c for c in required if c not in df.columns]
    first = [(F.lit(True), f"missing column {c}") for c in missing] + [(F.col(c).isNull(), f"{c} is null") for c in required if c in df.columns]
    out = df.withColumn("errors", errors_of(*first))
    if known is not None:
        mark = known.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(key))).distinct().withColumn("_known", F.lit(True))
        on = [F.col(k) == F.col(f"_k{n}") for n, k in enumerate(key)]
        out = out.join(mark, on, "left").drop(*(f"_k{n}" for n in range(len(key)))).withColumn("errors", F.when((F.size("errors") == 0) & F.col("_known"), F.array(F.lit("already stored"))).otherwise(F.col("errors"))).drop("_known")
    later = []
    own = residual if residual is not None else F.col("residual") if "residual" in df.columns else None
    if tol is not None and own is not None:
        over = ~F.coalesce(F.abs(own) <= tol, F.lit(False))
        later.append(((F.col("is_susy") & over) if susy_only and "is_susy" in df.columns else over, "residual over the tolerance"))
    if "flux" in df.columns:
        later.append((~A.is_integral("flux"), "flux is not integral"))
    if tadpole is not None and "N_flux" in df.columns:
        later.append((F.col("N_flux") > tadpole, "tadpole over the bound"))
    if later:
        out = out.withColumn("errors", F.when(F.size("errors") == 0, errors_of(*later)).otherwise(F.col("errors")))
    return out.withColumn("passed", F.size("errors") == 0)


def split_by_validation(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that passed, the others with their errors in one text)."""
    good = report.where("passed").drop("errors", "passed")
    return good, report.where("not passed").withColumn("error", F.array_join("errors", "; ")).drop("errors", "passed")


def failures(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("passed")).alias("n_failed"))


def validate_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    """Raise once, with all that is wrong: columns, nulls, one geometry, run ids, status values."""
    problems = [f"missing column {c}" for c in required if c not in df.columns]
    checks = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in required if c in df.columns]
    if "run_id" in df.columns:
        checks.append(F.count_if(~X.is_safe_run_id("run_id")).alias("run ids that are no slugs"))
    if "cert_status" in df.columns:
        checks.append(F.count_if(F.col("cert_status").isNotNull() & ~F.col("cert_status").isin(*CERT_STATUSES)).alias("unknown cert_status"))
    if "geometry_id" in df.columns:
        checks.append(F.greatest(F.count_distinct("geometry_id") - 1, F.lit(0)).alias("geometries beyond one"))
    if checks:
        problems += [f"{name}: {n}" for name, n in df.agg(*checks).first().asDict().items() if n]
    if problems:
        raise ValidationError("; ".join(problems), problems)


def floor_compatible(columns: Iterable[str]) -> bool:
    return set(FLOOR_COLUMNS) <= set(columns)


def split_policy(report: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Strict: any failure is an error.  Else the good rows and the rejected ones."""
    if strict and (n := failures(report).first()["n_failed"]):
        raise ValidationError(f"{n} rows failed")
    return split_by_validation(report)


# --- certification ------------------------------------------------------------------

CERT_STRUCT = "struct<passed:boolean,checks:map<string,boolean>,metric:double,hessian:double,mass:double>"
#: The least values of an endpoint that is a minimum.
METRIC_TOL, HESSIAN_TOL, MASS_TOL, LEAST_IM_TAU = 1e-10, -1e-8, -1e-8, 1.0


def stability(metric: Column, hessian: Column, mass: Column, im_tau: Column) -> Column:
    """A certificate from three least eigenvalues and Im tau."""
    checks = F.create_map(
        F.lit("kahler_metric_pd"), F.coalesce((metric > METRIC_TOL) & ~F.isnan(metric), F.lit(False)),
        F.lit("hessian_min_eig"), F.coalesce((hessian >= HESSIAN_TOL) & ~F.isnan(hessian), F.lit(False)),
        F.lit("mass_min_eig"), F.coalesce((mass >= MASS_TOL) & ~F.isnan(mass), F.lit(False)),
        F.lit("im_tau_positive"), F.coalesce(im_tau >= LEAST_IM_TAU, F.lit(False)),
    )
    return F.struct(F.forall(F.map_values(checks), lambda x: x).alias("passed"), checks.alias("checks"), metric.alias("metric"), hessian.alias("hessian"), mass.alias("mass"))


def python_certifier(certify: Callable[[dict], dict], columns: Sequence[str]) -> Column:
    """A certificate by a Python function of a row's values; a row that makes it fail has not passed."""

    @F.pandas_udf("passed boolean, checks map<string,boolean>, metric double, hessian double, mass double")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            try:
                x = certify(r)
            except Exception:  # the row's own failure is its verdict
                x = {"passed": False, "checks": {}, "metric": None, "hessian": None, "mass": None}
            out.append({"passed": bool(x["passed"]), "checks": dict(x.get("checks") or {}), **{k: x.get(k) for k in ("metric", "hessian", "mass")}})
        return pd.DataFrame(out, columns=["passed", "checks", "metric", "hessian", "mass"])

    return run(F.struct(*columns))


def _stamped(df: DataFrame, certificate: Column, verifier: str, geometry: Column | str, status: str) -> DataFrame:
    """Rows with verifier, status, evidence, record id and the certificate itself, ``_cert``."""
    checks = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys("_cert.checks")), lambda k: F.concat(F.lit('"'), k, F.lit('": '), F.element_at("_cert.checks", k).cast("string"))), ", "), F.lit("}"))
    return df.withColumn("_cert", certificate).withColumns({
        "verifier_id": F.lit(verifier), "cert_status": F.when(F.col("_cert.passed"), status), "cert_checks": checks,
        "kahler_metric_min_eig": F.col("_cert.metric"), "hessian_min_eig": F.col("_cert.hessian"), "mass_min_eig": F.col("_cert.mass"),
        "record_id": ids.record_id("flux", ids.col(geometry), F.lit(verifier)),
    })


def certify(df: DataFrame, certificate: Column, verifier: str, geometry: Column | str = "geometry_id", status: str = "certified") -> tuple[DataFrame, DataFrame]:
    """(rows that passed, stamped with verifier, status, evidence and record id; the others, with no status)."""
    stamped = _stamped(df, certificate, verifier, geometry, status)
    passed = F.coalesce(F.col("_cert.passed"), F.lit(False))
    return stamped.where(passed).drop("_cert"), stamped.where(~passed).drop("_cert")


@dataclass(frozen=True)
class VerifierSpec:
    """What a verifier does.  ``payload`` is hashed, notes are not."""

    build: str
    checks: tuple[str, ...]
    tolerances: dict = field(default_factory=dict)
    stability_suite: bool = True
    notes: str = ""
    vocabulary: tuple[str, ...] = ()
    build_key: str = "build"

    def __post_init__(self) -> None:
        if self.vocabulary and list(self.checks) != [c for c in self.vocabulary if c in self.checks]:
            raise ValueError("checks must be known ones, in the order of the vocabulary")

    def payload(self) -> dict:
        return {self.build_key: str(self.build), "checks": list(self.checks), "tolerances": {k: repr(self.tolerances[k]) for k in sorted(self.tolerances)}, "stability_suite": bool(self.stability_suite)}

    @property
    def verifier_id(self) -> str:
        return ids.verifier_id(self.payload())

    def checks_metric(self) -> bool:
        return "kahler_metric_pd" in self.checks


class VerifierRegistry:
    """Verifiers by id; as a table for joins, as JSON for keeping."""

    def __init__(self, specs: Iterable[VerifierSpec] = ()) -> None:
        self._specs: dict[str, VerifierSpec] = {}
        for s in specs:
            self.register(s)

    def register(self, spec: VerifierSpec) -> str:
        held = self._specs.get(spec.verifier_id)
        if held is not None and held.payload() != spec.payload():
            raise ValueError("two verifiers have one id")
        self._specs.setdefault(spec.verifier_id, spec)
        return spec.verifier_id

    def get(self, verifier: str) -> VerifierSpec:
        return self._specs[verifier]

    def __contains__(self, verifier: str) -> bool:
        return verifier in self._specs

    def __len__(self) -> int:
        return len(self._specs)

    def to_json(self) -> str:
        return json.dumps({k: s.payload() | {"notes": s.notes, "build_key": s.build_key} for k, s in self._specs.items()}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "VerifierRegistry":
        out = VerifierRegistry()
        for k, p in json.loads(text).items():
            spec = VerifierSpec(p[p["build_key"]], tuple(p["checks"]), {n: _value(v) for n, v in p["tolerances"].items()}, p["stability_suite"], p["notes"], (), p["build_key"])
            if out.register(spec) != k:
                raise ValueError(f"the entry of {k} does not hash to it")
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, s.checks_metric()) for k, s in self._specs.items()], "verifier_id string, checks_metric boolean")


def _value(text: str):
    import ast

    return ast.literal_eval(text)


def review(df: DataFrame, known: DataFrame, certificate: Callable[[DataFrame], Column], spec: VerifierSpec, order: Sequence[str], geometry: str = "geometry_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``) of a submission.

    The verifier must check the metric.  Columns that a client could forge are dropped, rows
    are certified anew, evidence must agree, and a solution is new if neither the store nor an
    earlier row has its geometry and rounded flux.
    """
    from moraine.operators.filters import strip_untrusted

    if not spec.checks_metric():
        raise ValidationError("the verifier does not check the metric")
    bare = strip_untrusted(df)
    judged = _stamped(bare, certificate(bare), spec.verifier_id, geometry, "provisional")
    # the store's different keys, and a row's place among the equal ones of the submission that passed
    stored = known.select(F.col(geometry).alias("_g"), ids.canonical_flux("flux").alias("_f")).distinct().withColumn("_stored", F.lit(True))
    passed = F.coalesce(F.col("_cert.passed"), F.lit(False))
    proven = passed & F.coalesce(X.metric_passed("cert_checks", "kahler_metric_min_eig"), F.lit(False))
    keyed = judged.withColumns({"_flux": ids.canonical_flux("flux"), "_proven": proven})
    both = keyed.join(stored, (F.col(geometry) == F.col("_g")) & (F.col("_flux") == F.col("_f")), "left")
    # rows that tie on the order fall back on a hash of all they hold; of equal rows one is new
    held = [c for c in judged.columns if c != "_cert"]
    place = F.row_number().over(Window.partitionBy(geometry, "_flux", "_proven").orderBy(*order, F.xxhash64(*held)))
    reason = (
        F.when(~passed, "not certified").when(~F.col("_proven"), "no evidence for the metric").when(F.col("_stored"), "already stored").when(place > 1, "repeated in the submission")
    )
    both = both.withColumn("reason", reason).select(*held, "reason")
    return both.where("reason is null").drop("reason"), both.where("reason is not null")


def fully_certified(manifest: dict, registry: VerifierRegistry | None = None) -> bool:
    """Whether a manifest has records, all of them certified, with evidence, by verifiers that check the metric."""
    n = manifest["n_records"]
    status, verifier = manifest["by_status"] or {}, manifest["by_verifier"] or {}
    if not n or sum(status.values()) != n or sum(verifier.values()) != n:
        return False
    if set(status) != {"certified"} or "unverified" in verifier or manifest["n_without_evidence"]:
        return False
    return registry is None or all(v in registry and registry.get(v).checks_metric() for v in verifier)


# --- designation --------------------------------------------------------------------


def designate(rows: DataFrame, designated: DataFrame, identity: dict, label: str, author: str, today: str, order: Sequence[str], tags: Sequence[str] = (), notes: str | None = None, tadpole: float | None = None, tol: float = 1e-8, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new catalogue rows, new data rows) with contiguous ids above those in use.

    Rows that fail validation are an error, or left out with ``force``.  A solution counts as
    stored if the same model has its flux, retracted or not.
    """
    from moraine.operators.aggregates import next_id
    from moraine.schemas import DESIGNATED, DESIGNATED_DATA, conform

    own = designated
    for k, v in identity.items():
        own = own.where(F.col(k).eqNullSafe(F.lit(v)))
    report = validate_rows(rows, own.select("flux"), tadpole, tol)
    if not force and (n := failures(report).first()["n_failed"]):
        raise ValidationError(f"{n} rows failed")
    good = number_rows(report.where("passed").drop("errors", "passed"), order, next_id(designated, "designated_id"), "designated_id")
    have = lambda c, t: F.col(c) if c in good.columns else F.lit(None).cast(t)
    merged = F.to_json(X.merge_tags(X.json_tags(have("tags", "string")), F.array(*map(F.lit, tags)).cast("array<string>")))
    common = {"tags": merged, "label": F.lit(label), "committed_by": F.lit(author), "commit_date": F.lit(today), "is_susy": F.coalesce(have("is_susy", "boolean"), F.lit(False))}
    more = {"notes": F.lit(notes), "source_run_id": F.coalesce(have("run_id", "string"), F.lit("")), "retracted": F.lit(False)} | {k: F.lit(v) for k, v in identity.items()}
    full = good.withColumns(common | more)
    pick = lambda schema: conform(full.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in full.columns}), schema, keep_unknown=False)
    return pick(DESIGNATED), pick(DESIGNATED_DATA)


def retract(designated: DataFrame, ids_: Sequence[int], reason: str, by: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(the catalogue with rows marked retracted, the audit rows to append)."""
    hit = F.col("designated_id").isin(list(ids_)) & ~F.coalesce(F.col("retracted"), F.lit(False))
    base = designated if "retracted_at" in designated.columns else designated.withColumn("retracted_at", F.lit(None).cast("string"))
    audit = base.where(hit).select("designated_id", F.lit(reason).alias("reason"), F.lit(at).alias("retracted_at"), F.lit(by).alias("retracted_by"))
    out = base.withColumns({"retraction_reason": F.when(hit, reason).otherwise(F.col("retraction_reason")), "retracted_at": F.when(hit, at).otherwise(F.col("retracted_at")), "retracted": F.coalesce(F.col("retracted"), F.lit(False)) | hit})
    return out, audit


def purge(designated: DataFrame, data: DataFrame, older_than_days: float | None = None, dry_run: bool = True, confirm: bool = False, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue left, data left, catalogue rows that go): retracted rows, old enough if an age is given.

    A dry run leaves all; a real one must be confirmed.
    """
    if not dry_run and not confirm:
        raise ValueError("a purge must be confirmed")
    gone = designated.where(F.coalesce(F.col("retracted"), F.lit(False)))
    if older_than_days is not None:
        gone = gone.where(A.older_than("retracted_at", older_than_days, now))
    if dry_run:
        return designated, data, gone
    return anti(designated, gone, ["designated_id"]), anti(data, gone, ["designated_id"]), gone
