"""Slugs, run ids, paths, tags and JSON as columns; templates and names that only the driver makes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from moraine.functions.ids import col

#: What labels and run ids look like, and names that files must not have.
LABEL_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]*(?:_v\d+)?$"
RESERVED_NAMES = ("catalog.parquet", "retractions.parquet")
NOTHING = "na"


def slugify(x: Column | str) -> Column:
    """Runs of other characters become one dash; dashes at the ends go; nothing left is ``na``."""
    trimmed = F.regexp_replace(F.regexp_replace(F.trim(col(x).cast("string")), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", NOTHING).otherwise(trimmed)


def slug(value: object) -> str:
    text = "" if value is None else re.sub(r"[^A-Za-z0-9_-]+", "-", str(value).strip()).strip("-")
    return text or NOTHING


def date_slug(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd-HHmmss")


def is_safe_run_id(x: Column | str) -> Column:
    """A label without a double underscore, which stands for a path's slash in file names."""
    return F.coalesce(col(x).rlike(LABEL_PATTERN) & ~col(x).contains("__"), F.lit(False))


def safe_run_id(x: object) -> bool:
    return isinstance(x, str) and re.fullmatch(LABEL_PATTERN[1:-1], x) is not None and "__" not in x


def is_label(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(LABEL_PATTERN), F.lit(False))


def is_reserved(name: Column | str) -> Column:
    return col(name).isin(*RESERVED_NAMES) | col(name).startswith("_")


def render_run_id(template: str | Callable | None = None, project: str = "", now: datetime | None = None, **values) -> str:
    """A run id from ``{name}`` and ``{name?}`` (optional, then ``na``); values are made slugs first.

    No template: a random hex id.  A callable gives the id itself.  Attributes and items in a
    placeholder, unknown names and ids that are no slugs are refused.
    """
    if template is None:
        return uuid.uuid4().hex
    if callable(template):
        out = template(**values)
    else:
        now = (now or datetime.now(timezone.utc)) if now is None or now.tzinfo else now.replace(tzinfo=timezone.utc)
        known = {k: slug(v) for k, v in ({"date": now.astimezone(timezone.utc).strftime("%Y-%m-%d-%H%M%S"), "project": project} | values).items()}
        out = ""
        for literal, name, spec, conversion in Formatter().parse(template):
            out += literal
            if name is None:
                continue
            optional = name.endswith("?")
            name = name.rstrip("?") if optional else name
            if not name.isidentifier():
                raise ValueError(f"placeholders are plain names, not {{{name}}}")
            if name not in known and not optional:
                raise KeyError(f"the run id template needs {name!r}")
            value = known.get(name, NOTHING)
            out += format({"r": repr, "s": str, "a": ascii}.get(conversion or "s", str)(value), spec or "")
    if not safe_run_id(out):
        raise ValueError(f"not a valid run id: {out!r}")
    return out


def run_id_column(*parts: Column | str, sep: str = "-") -> Column:
    """The run id of each row, its parts made slugs."""
    return F.concat_ws(sep, *(slugify(p) for p in parts))


# --- paths --------------------------------------------------------------------------


def _number(x: Column, pattern: str) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1).cast("long"))


def parse_path(path: Column | str) -> Column:
    """A struct of what a stored file's relative path tells.

    namespace, basename, status, h12, ks_id, triang_id, cicy_id, model_ID, label, version.
    Paths of no known namespace are ``curated`` and tell no ids.
    """
    return F.get(F.transform(F.array(F.split(col(path), "/")), _parsed), 0)  # the parts are worked out once


def _parsed(p: Column) -> Column:
    """What the parts of a path tell.  The patterns are fixed values: the layout of stored files."""
    part = lambda k: F.get(p, F.lit(k))
    n, name = F.size(p), F.element_at(p, -1)
    first = part(0)
    deep = first.isin("tdf", "local") & (n >= 4)
    flat = (first == "cicy") & (n >= 3)
    rest = F.when(deep, 3).when(flat, 2).otherwise(99)
    one, two = F.get(p, rest), F.get(p, rest + 1)
    community = F.coalesce((one == "community") & (deep | flat), F.lit(False))
    rejected = F.coalesce(deep & (F.when(community, two).otherwise(one) == "_rejected"), F.lit(False))
    status = F.when(rejected, "rejected").when(community, "pending").otherwise("curated")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    own = F.when((status == "pending") & stem.contains("_"), F.regexp_replace(stem, "^[^_]*_", "")).otherwise(stem)
    version = F.regexp_extract(own, r"^.+?_v(\d+)$", 1)
    return F.struct(
        first.alias("namespace"), name.alias("basename"), status.alias("status"),
        F.when(deep, _number(part(1), r"^h12_(\d+)")).alias("h12"),
        F.when(deep & (first == "tdf"), F.when(part(2).rlike(r"^ks_\d+_tri_\d+"), F.regexp_extract(part(2), r"^ks_(\d+)", 1).cast("long"))).alias("ks_id"),
        F.when(deep & (first == "tdf"), _number(part(2), r"^ks_\d+_tri_(\d+)")).alias("triang_id"),
        F.when(flat, _number(part(1), r"^cicy_(\d+)")).alias("cicy_id"),
        F.when(deep & (first == "local"), _number(part(2), r"^model_(\d+)")).alias("model_ID"),
        F.when(version == "", own).otherwise(F.regexp_replace(own, r"_v\d+$", "")).alias("label"),
        F.when(version == "", F.lit(1).cast("long")).otherwise(version.cast("long")).alias("version"),
    )


def label_of(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(name), r"\.parquet$", ""), r"_v\d+$", "")


def strip_user(name: Column | str) -> Column:
    """A submission's name without the user before the first underscore."""
    return F.regexp_replace(col(name), "^[^_]*_", "")


def guess_susy(name: Column | str) -> Column:
    low = F.lower(col(name))
    return F.when(low.contains("nonsusy") | low.contains("non_susy") | low.contains("non-susy"), "nonsusy").when(low.contains("susy"), "susy")


def model_dir(h12: Column | str, ks_id: Column | str, triang_id: Column | str, cicy_id: Column | str, model_name: Column | str | None = None) -> Column:
    """The folder of a model: by cicy_id, else by polytope and triangulation, else by name."""
    h12, ks, tri, cicy = (F.coalesce(col(x).cast("long"), F.lit(-1)) for x in (h12, ks_id, triang_id, cicy_id))
    name = slugify(model_name) if model_name is not None else F.lit("unnamed")
    return F.when(cicy >= 0, F.concat(F.lit("cicy/cicy_"), cicy.cast("string"))).when((ks >= 0) & (tri >= 0), F.format_string("tdf/h12_%d/ks_%d_tri_%d", h12, ks, tri)).otherwise(F.concat(F.lit("custom/"), name))


def stage_dir(ks_id: Column | str, class_id: Column | str, conifold: Column | str) -> Column:
    return F.format_string("ks_%d/class_%d/coni_%d", *(col(x).cast("long") for x in (ks_id, class_id, conifold)))


def free_version(label: str, taken: Iterable[str], policy: str = "error") -> str:
    """A file name for a label: refuse a name in use, append to it, or take the first free ``_vN``."""
    taken = set(taken)
    name = f"{label}.parquet"
    if name not in taken or policy == "append":
        return name
    if policy != "new_version":
        raise FileExistsError(name)
    n = 2
    while f"{label}_v{n}.parquet" in taken:
        n += 1
    return f"{label}_v{n}.parquet"


# --- tags and JSON ------------------------------------------------------------------


def tags_of(cell: Column | str) -> Column:
    """Tags of a text divided by commas, semicolons or bars: trimmed, none empty, none twice."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(col(cell), F.lit("")), "[,;|]"), lambda t: F.trim(t)), lambda t: t != ""))


def json_tags(cell: Column | str) -> Column:
    """Tags of a JSON array; what cannot be read has none."""
    return F.coalesce(F.from_json(col(cell), "array<string>"), F.array().cast("array<string>"))


def has_all_tags(tags: Column, wanted: Iterable[str]) -> Column:
    wanted = list(wanted)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0 if wanted else F.lit(True)


def has_any_tag(tags: Column, wanted: Iterable[str]) -> Column:
    wanted = list(wanted)
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def has_no_tag(tags: Column, unwanted: Iterable[str]) -> Column:
    unwanted = list(unwanted)
    return ~F.arrays_overlap(tags, F.array(*map(F.lit, unwanted))) if unwanted else F.lit(True)


def to_tag_json(tags: str | Iterable[str] | None) -> str:
    return json.dumps([] if tags is None else [tags] if isinstance(tags, str) else list(tags))


def merge_tags(a: Column, b: Column) -> Column:
    """Both lists, in order, none twice."""
    return F.array_distinct(F.concat(a, b))


def json_map(cell: Column | str) -> Column:
    """A JSON object as a map of texts; what cannot be read is empty."""
    return F.coalesce(F.from_json(col(cell), "map<string,string>"), F.create_map().cast("map<string,string>"))


def with_defaults(parsed: Column, **defaults: Column | str) -> Column:
    """The map with defaults for keys it does not have."""
    extra = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), col(v).cast("string")))) if defaults else F.create_map().cast("map<string,string>")
    return F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(parsed, k)), parsed)


def merge_maps(a: Column, b: Column) -> Column:
    """Both maps; where both have a key, b's value counts."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def check_passed(checks: Column | str, name: str) -> Column:
    """Whether a JSON object has ``true`` under a name: the boolean, not a text."""
    v = F.try_parse_json(col(checks))
    value = F.try_variant_get(v, f"$.{name}", "variant")
    return F.coalesce((F.schema_of_variant(value) == "BOOLEAN") & F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False))


def metric_passed(checks: Column | str, eigenvalue: Column | str) -> Column:
    """The metric check is ``true`` and its least eigenvalue is a finite positive number."""
    e = col(eigenvalue)
    return check_passed(checks, "kahler_metric_pd") & F.coalesce((e > 0) & ~F.isnan(e) & (e < F.lit(float("inf"))), F.lit(False))
