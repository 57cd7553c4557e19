"""Identities and hashes as columns.  Each follows one exact text, so any engine can repeat it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys of a geometry's canonical JSON, in the order of that JSON.
_JSON_KEYS = ("cicy_id", "conifold_id", "h11", "h12", "ks_id", "triang_id")
DEFAULT_SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def geometry_id(**keys: Column | str | int) -> Column:
    """First 16 hex digits of the SHA-1 of the keys' compact JSON; keys not given, or null, are -1."""
    parts = []
    for k in _JSON_KEYS:
        v = keys.pop(k, -1)
        value = F.lit(int(v)) if isinstance(v, int) else F.coalesce(col(v).cast("long"), F.lit(-1))
        parts += [F.lit(("{" if k == _JSON_KEYS[0] else ",") + f'"{k}":'), value.cast("string")]
    if keys:
        raise TypeError(f"unknown geometry keys: {sorted(keys)}")
    return F.substring(F.sha1(F.concat(*parts, F.lit("}"))), 1, 16)


def canonical_flux(flux: Column | str) -> Column:
    """Entries rounded half to even, as integers."""
    return F.transform(col(flux), lambda x: F.rint(x.cast("double")).cast("int"))


def record_id(flux: Column | str, geometry: Column | str, verifier: Column | str) -> Column:
    """First 24 hex digits of the SHA-1 of the compact JSON of rounded flux, geometry and verifier."""
    text = F.concat(F.lit('{"flux":['), F.array_join(F.transform(canonical_flux(flux), lambda x: x.cast("string")), ","), F.lit('],"geometry_id":"'), col(geometry), F.lit('","verifier_id":"'), col(verifier), F.lit('"}'))
    return F.substring(F.sha1(text), 1, 24)


def dedup_key(geometry: Column | str, flux: Column | str) -> Column:
    """What makes two solutions the same, whoever verified them."""
    return F.struct(col(geometry).alias("geometry_id"), canonical_flux(flux).alias("flux"))


def bucket(geometry: Column | str, bits: int = 4) -> Column:
    """The low bits of the first byte of the SHA-1 of a geometry id; more than eight are eight."""
    mask = (1 << min(max(bits, 0), 8)) - 1
    return F.conv(F.substring(F.sha1(col(geometry)), 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(mask))


def shard_path(h11: Column | str, h12: Column | str, geometry: Column | str, run_id: Column | str, bits: int = 4) -> Column:
    return F.concat(F.lit("h12_"), col(h12).cast("string"), F.lit("/h11_"), col(h11).cast("string"), F.lit("/bucket_"), bucket(geometry, bits).cast("string"), F.lit("/run_"), col(run_id), F.lit(".parquet"))


def verifier_id(payload: Mapping) -> str:
    """``v1-`` and 16 hex digits of the SHA-1 of a verifier's compact, key-sorted JSON."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    return "v1-" + hashlib.sha1(text.encode()).hexdigest()[:16]


def split_point(key: Column | str) -> Column:
    """A number in [0, 1) from the first eight bytes of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(col(key).cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def assign_split(key: Column | str, splits: Sequence[tuple[str, float]] = DEFAULT_SPLITS) -> Column:
    """The split a key falls in; breakpoints add up in floating point, the last split takes the rest."""
    if not splits or abs(sum(s for _, s in splits) - 1) > 1e-6 or any(s < 0 for _, s in splits):
        raise ValueError("shares must not be negative and must add up to 1")
    u, total, out = split_point(key), 0.0, None
    for name, share in splits[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return F.lit(splits[-1][0]) if out is None else out.otherwise(splits[-1][0])


def _tuple(items: Column) -> Column:
    """Python's text of a tuple of the given texts."""
    return F.concat(F.lit("("), F.array_join(items, ", "), F.when(F.size(items) == 1, F.lit(",")).otherwise(F.lit("")), F.lit(")"))


def tuple_repr(values: Column | str) -> Column:
    return _tuple(F.transform(col(values), lambda x: x.cast("string")))


def normal_form_hash(matrix: Column | str) -> Column:
    """SHA-256 of the text of a matrix as nested tuples."""
    return F.sha2(_tuple(F.transform(col(matrix), tuple_repr)), 256)


def _coo_repr(coo: Column) -> Column:
    return _tuple(F.transform(coo, lambda x: F.concat(F.lit("("), F.concat_ws(", ", *(x[c].cast("string") for c in "ijkv")), F.lit(")"))))


def wall_hash(h11: Column | str, h12: Column | str, coo_in_basis: Column | str, c2_in_basis: Column | str) -> Column:
    """SHA-256 of (h11, h12, canonical tensor, c2), all in the basis; see ``arrays.canonical_coo``."""
    text = F.concat(F.lit("("), col(h11).cast("string"), F.lit(", "), col(h12).cast("string"), F.lit(", "), _coo_repr(col(coo_in_basis)), F.lit(", "), tuple_repr(c2_in_basis), F.lit(")"))
    return F.sha2(text, 256)


def wall_hash_digest(*args: Column | str) -> Column:
    return F.unhex(wall_hash(*args))


def content_tiebreak(coo: Column | str, c2: Column | str, c2_origin: Column | str) -> Column:
    """SHA-256 of the whole content of a phase, to order phases that agree in all else."""
    text = F.concat(F.lit("("), _coo_repr(col(coo)), F.lit(", "), tuple_repr(c2), F.lit(", "), F.coalesce(col(c2_origin).cast("string"), F.lit("None")), F.lit(")"))
    return F.sha2(text, 256)


def phase_id(mode: Column | str, h11: Column | str, ks_id: Column | str, triang_id: Column | str) -> Column:
    return F.concat_ws(":", *(col(x).cast("string") for x in (mode, h11, ks_id, triang_id)))


def hex_digest(x: Column | str) -> Column:
    return F.lower(F.hex(col(x)))


def model_hash(text: Sequence[Column | str], arrays: Sequence[Column | str]) -> Column:
    """SHA-256 over text fields and arrays of numbers as big-endian doubles would be engine-bound;
    instead over their decimal texts, null apart from empty.  Stable across engines."""
    parts = [F.coalesce(F.concat(F.lit("s"), F.length(col(x).cast("string")).cast("string"), F.lit(":"), col(x).cast("string")), F.lit("n")) for x in text]
    parts += [F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(col(x), lambda v: F.coalesce(v.cast("string"), F.lit("n"))), ","), F.lit("]")), F.lit("n")) for x in arrays]
    return F.sha2(F.concat_ws("|", *parts), 256)


def sampling_key(key: Column | str, seed: int) -> Column:
    """An order by this is a shuffle that depends on the key and the seed only."""
    return F.sha1(F.concat(col(key).cast("string"), F.lit(f"|{int(seed)}")))


def filter_key(filters: Mapping) -> str:
    """A text that is the same for the same filters, in any order."""
    return json.dumps({k: filters[k] for k in sorted(filters)}, sort_keys=True, default=repr)
