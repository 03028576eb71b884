"""Text sources and definition files (S1-S4, S11, S13-S16) and sinks for text (K8, K9)."""

from __future__ import annotations

import ipaddress
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(paths: list[str], recursive: bool = False) -> list[str]:
    """Files at, directly under, or with ``recursive`` anywhere under the paths, sorted."""
    out: list[str] = []
    for p in paths:
        if not os.path.isdir(p):
            out.append(p)
        elif recursive:
            out += [os.path.join(d, n) for d, _, names in os.walk(p) for n in names]
        else:
            out += [f for n in os.listdir(p) if os.path.isfile(f := os.path.join(p, n))]
    return sorted(out)


def targets(given: list[str], default: str, recursive: bool = False) -> list[str]:
    """Paths of a command line override the configured ones."""
    return listed(given or [default], recursive)


def lines(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """(line, path): the lines of text files (S1). A local folder is passed over with a warning unless ``recursive``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not recursive:
        for p in [p for p in paths if os.path.isdir(p)]:
            warnings.warn(f"{p} is a folder; passed over", stacklevel=2)
            paths.remove(p)
    if not paths:
        return spark.createDataFrame([], "line string, path string")
    read = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


def template_definitions(spark: SparkSession, path: str, mode: str = "plain") -> DataFrame:
    """(template): one a line; mode ``ids`` drops the first token."""
    if mode not in ("plain", "ids"):
        raise ValueError(f"unknown mode {mode!r}")
    line = F.col("value")
    body = line if mode == "plain" else F.regexp_replace(line, r"^\S+\s+", "")
    return spark.read.text(path).select(F.trim(body).alias("template")).filter("template <> ''")


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(grp, value) of ``[group]`` sections, one value a line, ``#`` comments; many to many."""
    rows, grp = [], None
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split("#")[0].strip()
            if line.startswith("[") and line.endswith("]"):
                grp = line[1:-1]
            elif line and grp is not None:
                rows.append((grp, line))
    return spark.createDataFrame(rows, "grp string, value string")


def host_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(name, host, grp, lo, hi): aliases by lower-case name, networks by address range.

    ``<alias> name ip ...`` names a host; a bare name is its own; ``[group]`` starts a group, ``default`` before the first.
    """
    rows, grp = [], "default"
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split("#")[0].strip()
            if not line:
                continue
            if line.startswith("[") and line.endswith("]"):
                grp = line[1:-1]
                continue
            parts = line.split()
            host = parts[0][1:-1] if parts[0].startswith("<") else parts[0]
            for name in dict.fromkeys([host, *parts[1:]]):
                low, span = name.lower(), (None, None)
                try:
                    net = ipaddress.ip_network(name, strict=False)
                    if net.version == 4 and net.num_addresses > 1:
                        span = (int(net[0]), int(net[-1]))
                    elif "/" not in name:
                        low = str(ipaddress.ip_address(name))
                except ValueError:
                    pass
                rows.append((low, host, grp, *span))
    return spark.createDataFrame(rows, "name string, host string, grp string, lo long, hi long")


def write_rejects(rows: DataFrame, path: str, column: str = "line") -> None:
    """Lines without a template, as text (K8)."""
    rows.select(F.col(column).alias("value")).write.mode("append").text(path)


def write_log(log: DataFrame, path: str) -> None:
    """``YYYY-MM-DD HH:MM:SS host message`` by time (K9)."""
    out = log.orderBy("dt", "host", "message").select(F.concat_ws(" ", F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), "host", "message").alias("value"))
    out.write.mode("overwrite").text(path)
