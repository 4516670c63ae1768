"""Command line: index, query, search, text, symbols, file, callers, callees, patterns, status, sync, remove, setup, config."""

from __future__ import annotations

import argparse
import json
import os

from lodestone.sources import config as cfg


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--store", default=os.path.expanduser("~/.lodestone/store"))
    p.add_argument("--config", default=os.path.expanduser("~/.lodestone/config.toml"))
    p.add_argument("--project", "-p")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--name")
    for flag in ("force", "dry-run", "all"):
        index.add_argument(f"--{flag}", action="store_true")
    for name in ("query", "search", "similar", "text", "symbols", "file", "callers", "callees", "remove", "setup"):
        sub.add_parser(name).add_argument("what")
    for name in ("status", "sync", "projects", "patterns"):
        sub.add_parser(name)
    conf = sub.add_parser("config")
    conf.add_argument("action", choices=["show", "set", "reset"])
    conf.add_argument("values", nargs="*")
    a = p.parse_args(argv)
    config = cfg.load(a.config)
    if a.command == "config":
        if a.action == "reset":
            config = cfg.Config()
        elif a.action == "set":
            config = cfg.set_value(config, *a.values)
        if a.action != "show":
            cfg.save_private(a.config, cfg.dumps(config))
        print(cfg.dumps(config), end="")
        return 0
    from pyspark.sql import SparkSession

    from lodestone.api import Engine

    e = Engine(SparkSession.builder.appName("lodestone").getOrCreate(), a.store, config)

    def show(df) -> None:
        for r in df.toJSON().collect() if a.json else df.collect():
            print(r if a.json else "  ".join(str(v) for v in r))

    if a.command == "index":
        if a.dry_run:
            show(e.dry_run(a.folder, a.all))
        else:
            print(e.index(a.folder, a.name, a.force, a.all))
    elif a.command == "query":
        answer = e.query(a.what, a.project)
        print(json.dumps({"answer": answer.text, "sources": answer.sources}) if a.json else "\n".join([answer.text, *answer.sources]))
    elif a.command in ("sync", "setup"):
        for name, report in (e.sync() if a.command == "sync" else e.setup(a.what)).items():
            print(name, report)
    elif a.command == "remove":
        print(e.remove(a.what))
    elif a.command == "patterns":
        for name, rows in e.project_patterns(a.project).items():
            print(name)
            show(rows)
    elif a.command in ("status", "projects"):
        show(e.status() if a.command == "status" else e.list_projects())
    else:
        tool = {"search": e.search_code, "similar": e.find_similar_code, "text": e.text_search, "symbols": e.search_symbols, "file": e.get_file, "callers": e.find_callers, "callees": e.find_callees}[a.command]
        show(tool(a.what, a.project))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
