"""Declared dependencies of projects, from their manifest files."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Manifests, and folders of others' code.
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "requirements.txt")
SKIPPED = ("node_modules", "target", "vendor", ".git", ".venv", "dist", "build")


def parse_manifest(name: str, text: str) -> list[tuple[str, str, str | None]]:
    """(ecosystem, package, version) of a manifest; a broken one has none."""
    try:
        if name == "Cargo.toml":
            found = tomllib.loads(text)
            return [("cargo", k, v if isinstance(v, str) else v.get("version")) for part in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in found.get(part, {}).items()]
        if name == "package.json":
            found = json.loads(text)
            return [("npm", k, v.lstrip("^~>=< ") or None) for part in ("dependencies", "devDependencies") for k, v in found.get(part, {}).items()]
        if name == "pyproject.toml":
            lines = tomllib.loads(text).get("project", {}).get("dependencies", [])
        else:
            lines = text.splitlines()
        out = []
        for line in lines:
            if m := re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*(?:[=~><!]=?\s*([\w.]+))?", line.split("#")[0]):
                out.append(("pypi", m[1].lower(), m[2]))
        return out
    except (ValueError, AttributeError):
        return []


def dependencies(spark: SparkSession, root: str) -> DataFrame:
    """(path, ecosystem, package, version) of all manifests at most three folders below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(MANIFESTS) + "}").load(root)
    below = F.size(F.split(F.regexp_replace("path", "^" + re.escape(root if "://" in root else "file:" + root) + "/*", ""), "/")) - 1
    kept = files.filter(~F.col("path").rlike("/(" + "|".join(map(re.escape, SKIPPED)) + ")/")).withColumn("depth", below).filter("depth <= 3")

    def run(batches):
        for batch in batches:
            rows = [(p, *dep) for p, c in zip(batch["path"], batch["content"], strict=True) for dep in parse_manifest(p.rsplit("/", 1)[-1], bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "package", "version"])

    return kept.select("path", "content").mapInPandas(run, "path string, ecosystem string, package string, version string")
