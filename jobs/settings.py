"""What the jobs' command lines share: settings from a small TOML file, options that override them, a session."""
from __future__ import annotations

import argparse
import json
import logging
import tomllib
from collections.abc import Callable
from dataclasses import MISSING, fields
from pathlib import Path


def read(kind: type, path: str | None, given: dict):
    """Settings of a dataclass from a TOML file and from values given, which win. Unknown and missing ones are errors."""
    values = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    values |= {k: v for k, v in given.items() if v is not None}
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    if missing := sorted(n for n, f in known.items() if n not in values and f.default is MISSING and f.default_factory is MISSING):
        raise ValueError(f"settings without a value: {', '.join(missing)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def main(kind: type, run: Callable, name: str, argv: list[str] | None = None) -> int:
    """Runs a job from the command line: its settings file, then any setting as an option. Creates the session, and stops it."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    parser.add_argument("--config", help="a TOML file of settings")
    for f in fields(kind):
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=int if f.type == "int" else str, nargs="+" if f.type.startswith("tuple") else None)
    given = vars(parser.parse_args(argv))
    settings = read(kind, given.pop("config"), given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(run(spark, settings)))
    finally:
        spark.stop()
    return 0
