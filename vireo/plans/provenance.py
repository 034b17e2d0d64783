"""Canonical JSON, fingerprints and what a run ran on."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def sha256(value: object) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else canonical_json(value)).hexdigest()


def without_nan(value: object) -> object:
    """The value as JSON has it, numbers that aren't finite as null."""
    return json.loads(json.dumps(value), parse_constant=lambda name: None)


def implementation_sha256() -> str:
    """Over the package's own Python files, by name and content; the training-data folder isn't part of it."""
    root = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for p in sorted(p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"):
        digest.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes() + b"\0")
    return digest.hexdigest()


def environment(spark: SparkSession) -> dict:
    import numpy

    conf = spark.sparkContext.getConf()
    return {
        "python": platform.python_version(), "numpy": numpy.__version__, "spark": spark.version, "machine": platform.machine(), "system": platform.system(), "cpus": os.cpu_count(),
        "byteorder": sys.byteorder, "master": conf.get("spark.master", ""), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }


def write_once(path: str | Path, value: dict) -> str:
    """A JSON document that is never overwritten; returns its digest."""
    with open(path, "x", encoding="utf-8") as out:
        out.write(json.dumps(without_nan(value), sort_keys=True, indent=2))
    return sha256(without_nan(value))
