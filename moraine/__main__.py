"""Command line: status and sync of a staging folder; validate, catalogue and curate files."""

from __future__ import annotations

import argparse
import json
import sys

from moraine.session import Config, get_session
from moraine.sources import files, shards


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="moraine")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("status", "sync"):
        s = sub.add_parser(name)
        s.add_argument("--staging", default=None)
        s.add_argument("--to", default=None)
    s = sub.add_parser("validate")
    s.add_argument("paths", nargs="+")
    for name in ("catalog", "curate"):
        s = sub.add_parser(name)
        s.add_argument("root")
        s.add_argument("target")
    a = p.parse_args(argv)
    config = Config.resolve(staging_dir=getattr(a, "staging", None), store_dir=getattr(a, "to", None))
    if a.what == "status":
        staging = config.path("staging_dir")
        for state in shards.STATES:
            found = shards.list_state(staging, state)
            print(state, len(found), *(x.run_id for x in found[:10]))
        return 0
    if a.what == "sync":
        staging = shards.ensure_layout(config.path("staging_dir"))
        budget = shards.CommitBudget(staging / "budget.json", config.commit_budget, config.window_s)
        report = shards.sync(staging, shards.FolderPublisher(config.path("store_dir")), budget, config.max_batch)
        print(shards.report_json(report))
        return int(report.n_failed > 0)
    if a.what == "curate":
        print(files.curate(a.root, a.target))
        return 0
    spark = get_session()
    if a.what == "validate":
        told, markdown, code = files.change_report(files.validate_files(spark, a.paths))
        print(markdown)
        print(json.dumps(told, sort_keys=True))
        return code
    files.rebuild_catalog(spark, a.root).coalesce(1).write.mode("overwrite").parquet(a.target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
