"""A language registry from configuration instead of generated code."""

from __future__ import annotations

import json
import re
import shlex

from pyspark.sql import SparkSession

KEYS = {"prompt", "install", "container", "filename", "compile", "execute"}
REQUIRED = {"prompt", "filename", "execute"}


def parse_language(text: str) -> dict:
    """One language's configuration, YAML or JSON; unknown or missing keys are errors.

    container is exactly {base-image, type: debian}; install is a single line if it is text.
    """
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict) or set(found) - KEYS or REQUIRED - set(found):
        raise ValueError(f"keys must be among {sorted(KEYS)} and hold {sorted(REQUIRED)}")
    box = found.get("container")
    if box is not None and (set(box) != {"base-image", "type"} or box["type"] != "debian"):
        raise ValueError("container must be {base-image, type: debian}")
    if isinstance(found.get("install"), str) and "\n" in found["install"].strip():
        raise ValueError("install must be a single line")
    return found


def registered(configs: dict[str, str]) -> dict[str, tuple]:
    """Rows for runner.LANGUAGES: (file name, compile command or None, run command, flags)."""
    out = {}
    for name, text in configs.items():
        c = parse_language(text)
        out[name] = (c["filename"], shlex.split(c["compile"]) if c.get("compile") else None, shlex.split(c["execute"]), {})
    return out


def read_configs(spark: SparkSession, path: str) -> dict[str, str]:
    """Language configurations by name: the YAML and JSON files in a folder, each named by its language.

    They are a bounded part of a run's settings, so they come to the driver; a bad one is an error here and not in a task.
    """
    rows = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()
    found = {}
    for r in rows:
        stem, _, kind = r["name"].rpartition(".")
        if kind not in ("yaml", "yml", "json") or not re.fullmatch(r"[\w+#-]+", stem):
            raise ValueError(f"not a language's configuration: {r['name']!r}")
        if stem in found:
            raise ValueError(f"two configurations of {stem!r}")
        parse_language(r["value"])
        found[stem] = r["value"]
    return found
