"""Session and configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "moraine", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings already given by the cluster stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.filterPushdown": "true"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Config:
    """Where data lives and how publishing is limited; one value for a process, never changed in place.

    ``resolve`` fills gaps from the environment: an argument counts before a variable, a
    variable before the default.
    """

    data_dir: str = "~/.moraine/data"
    store_dir: str = "~/.moraine/store"
    staging_dir: str = "~/.moraine/staging"
    project: str = ""
    offline: bool = False
    commit_budget: int = 90
    window_s: float = 3600.0
    max_batch: int = 500
    cache_warn_bytes: int = 500 * 1024 * 1024
    extra: dict = field(default_factory=dict)

    @staticmethod
    def resolve(**given) -> "Config":
        base = Config()
        env = {
            "data_dir": os.environ.get("MORAINE_DATA_DIR"),
            "store_dir": os.environ.get("MORAINE_STORE_DIR"),
            "staging_dir": os.environ.get("MORAINE_STAGING_DIR"),
            "project": os.environ.get("MORAINE_PROJECT"),
        }
        found = {k: v for k, v in env.items() if v} | {k: v for k, v in given.items() if v is not None}
        return replace(base, **found)

    def path(self, name: str) -> Path:
        return Path(getattr(self, name)).expanduser()
