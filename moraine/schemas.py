"""Schemas of the stored tables.  Geometry columns that do not apply hold -1, not null."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types by the names that Spark's DDL has for them.
_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType()), "array<double>": T.ArrayType(T.DoubleType()),
    "array<long>": T.ArrayType(T.LongType()), "array<array<long>>": T.ArrayType(T.ArrayType(T.LongType())),
}


def _schema(ddl: str) -> T.StructType:
    """A schema from ``name type, name type``; Spark's own parser needs a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(","))])


MISSING_KEY = -1
#: The columns of stored rows, their order and types.
GEOMETRY_KEYS = ("h11", "h12", "ks_id", "triang_id", "conifold_id", "cicy_id")
FLOOR_COLUMNS = ("flux", "moduli_re", "moduli_im", "tau_re", "tau_im")
REQUIRED_COLUMNS = (*FLOOR_COLUMNS, "run_id", "geometry_id", "tadpole_charge", "created_at")
CERT_COLUMNS = ("verifier_id", "cert_status", "cert_checks", "kahler_metric_min_eig", "hessian_min_eig", "mass_min_eig", "record_id")
CERT_STATUSES = ("certified", "provisional", "invalidated")
#: Columns that a client could forge.
UNTRUSTED_COLUMNS = (
    "verifier_id", "cert_status", "cert_checks", "kahler_metric_min_eig", "hessian_min_eig", "mass_min_eig", "record_id",
    "is_susy", "is_isd", "residual", "n_iterations", "W_re", "W_im", "F_terms_re", "F_terms_im",
    "solver_name", "solver_config_hash", "tadpole_charge", "git_sha", "seed", "wall_clock_s", "created_at",
)

PRODUCTION = _schema(
    "flux array<int>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, run_id string, geometry_id string, tadpole_charge int, created_at timestamp, "
    "h11 int, h12 int, ks_id int, triang_id int, conifold_id int, cicy_id int, W_re double, W_im double, F_terms_re array<double>, F_terms_im array<double>, g_s double, mass2 array<double>, "
    "m_gravitino double, residual double, n_iterations int, is_susy boolean, is_isd boolean, solver_name string, solver_config_hash string, git_sha string, seed long, "
    "wall_clock_s float, tags string, extra_data string, verifier_id string, cert_status string, cert_checks string, kahler_metric_min_eig double, hessian_min_eig double, mass_min_eig double, record_id string"
)
SHARD_CATALOG = _schema("path string, run_id string, geometry_id string, h11 int, h12 int, ks_id int, triang_id int, conifold_id int, cicy_id int, schema_version int, n_rows long, columns string")
SESSION_ROW = _schema("vacuum_id long, flux array<int>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, W_re double, W_im double, F_terms_re array<double>, F_terms_im array<double>, N_flux double, residual double, is_susy boolean, tags string, extra_data string, timestamp timestamp")
RUN_CATALOG = _schema("run_id string, h11 int, h12 int, ks_id int, triang_id int, conifold_id int, cicy_id int, model_hash string, model_name string, n_vacua long, method string, created timestamp, metadata string, file_path string")
DESIGNATED = _schema(
    "designated_id long, h11 int, h12 int, ks_id int, triang_id int, conifold_id int, cicy_id int, model_hash string, model_name string, flux array<int>, N_flux double, is_susy boolean, tags string, "
    "label string, notes string, committed_by string, commit_date string, writer_version string, source_run_id string, retracted boolean, retraction_reason string, retracted_at string"
)
DESIGNATED_DATA = _schema(
    "designated_id long, flux array<int>, moduli_re array<double>, moduli_im array<double>, tau_re double, tau_im double, W_re double, W_im double, F_terms_re array<double>, F_terms_im array<double>, N_flux double, g_s double, mass2 array<double>, "
    "m_gravitino double, residual double, is_susy boolean, tags string, extra_data string, label string, committed_by string, commit_date string"
)
RETRACTIONS = _schema("designated_id long, reason string, retracted_at string, retracted_by string")
RUN_LOG = _schema(
    "run_id string, scope string, ks_id long, coni_class_id long, coni_id long, attempt_index long, status string, started_at timestamp, finished_at timestamp, job_id string, host string, worker string, task string, "
    "n_solutions long, n_attempted long, payload_uri string, payload_hash string, error_summary string, notes string, seq long"
)
FILE_CATALOG = _schema(
    "file_path string, basename string, status string, h12 long, ks_id long, triang_id long, cicy_id long, model_ID long, susy string, method string, nmax string, qualifiers string, classification_source string, "
    "label string, version long, committed_by string, n_rows long, schema_version long, checksum string, superseded_by string, retracted boolean, retraction_reason string, retracted_at string, uploaded_at string"
)
GEOMETRY_CATALOG = _schema(
    "h11 int, h12 int, ks_id long, triang_id long, chi long, has_gv boolean, n_conifolds long, D3_tadpole long, lcs_shard_id long, lcs_row_index long, extra_shard_id long, extra_row_index long, "
    "gv_shard_id long, gv_row_index long, polytope_shard_id long, polytope_row_index long, conifold_shard_id long, conifold_row_index long"
)
PHASE_CATALOG = _schema("h11 long, ks_id long, triang_id long, h12 long, fav_N boolean, fav_M boolean, trilayer boolean, wall_hash binary, geom_shard_id long, geom_row_index long")
PHASE_GEOMETRY = _schema("h11 long, ks_id long, triang_id long, heights array<double>, intnums_coo_i array<long>, intnums_coo_j array<long>, intnums_coo_k array<long>, intnums_coo_v array<long>, c2 array<long>, c2_origin long")
POLYTOPE_GEOMETRY = _schema("h11 long, ks_id long, polytope_hash string, vertices array<array<long>>, cy_basis array<long>, n_components array<long>, glsm_charge_matrix array<array<long>>")


def conform(df, schema: T.StructType, keep_unknown: bool = True):
    """Cast the columns that ``schema`` knows to its types, in its order, then the others; absent ones stay absent."""
    known = [f for f in schema.fields if f.name in df.columns]
    rest = [c for c in df.columns if c not in schema.names] if keep_unknown else []
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in known), *(df[c] for c in rest))
