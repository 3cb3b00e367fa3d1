"""A scan cache as documents: one JSON text a file, in a new folder for each version, and a pointer that is written last.

Readers see the version of the highest pointer. A pointer appears under its name at once, when all of
its version is there, and is never changed; a write that fails leaves none, and the version before it
stays what readers see.
"""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import upsert
from .ranges import located

FORMAT = 1
FIELDS = {"path": "string", "size": "bigint", "mtime_ns": "bigint", "rules": "string", "bucket": "string", "seen": "bigint"}
_POINTER = re.compile(r"current-(\d+)$")


def pointers(folder: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers below the folder, the latest last."""
    files, root = located(folder)
    if files.get_file_info(root).type != pafs.FileType.Directory:
        return []
    found = []
    for info in files.get_file_info(pafs.FileSelector(root)):
        if m := _POINTER.search(info.path):
            with files.open_input_file(info.path) as f:
                found.append((int(m[1]), f.read().decode()))
    return sorted(found)


def parsed(texts: DataFrame, rules: str, column: str = "value") -> DataFrame:
    """The usable entries among texts: path, size, mtime_ns, rules, bucket, seen.

    What is no JSON, of another format or of other rules, or lacks a field or has one of another kind
    is left out, one by one; `seen` may be missing and counts as 0. More fields do no harm.
    """
    text = F.rtrim(F.regexp_replace(column, "^﻿", ""))
    # the parser stops where a text's first value ends; within brackets what follows it is a fault
    v = F.when(text.endswith("}"), F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$[0]", "variant"))
    # a field of another kind is not converted: its schema says what it is
    kind = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    fit = lambda name, to: F.when(kind(name) == to.upper(), F.try_variant_get("v", f"$.{name}", to))
    rows = texts.select(v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.where(fit("format", "bigint") == FORMAT).select(*(fit(n, to).alias(n) for n, to in FIELDS.items())).withColumn("seen", F.coalesce("seen", F.lit(0)))
    return rows.where(F.col("rules") == rules).dropna(subset=[n for n in FIELDS if n != "seen"])


def read(spark: SparkSession, folder: str, rules: str) -> DataFrame:
    """The entries of the current version, of these rules, one a path (the latest seen); none where there is no cache."""
    found = pointers(folder)
    if not found:
        return spark.createDataFrame([], ", ".join(f"{n} {to}" for n, to in FIELDS.items()))
    rows = parsed(spark.read.text(f"{folder}/{found[-1][1]}"), rules)
    return rows.groupBy("path").agg(F.max_by(F.struct(*[n for n in FIELDS if n != "path"]), F.struct("seen", "size", "mtime_ns", "bucket")).alias("e")).select("path", "e.*").select(*FIELDS)


def documents(rows: DataFrame) -> DataFrame:
    """One JSON text a row, as `value`."""
    return rows.select(F.to_json(F.struct(F.lit(FORMAT).alias("format"), *(F.col(n).cast(to).alias(n) for n, to in FIELDS.items()))).alias("value"))


def publish(texts: DataFrame, folder: str) -> str:
    """Write texts as a new version and point to it. The name of the version is returned.

    Two writers at once: the later one to finish finds its number taken, which is an error; its
    version is never read.
    """
    files, root = located(folder)
    number = (pointers(folder) or [(0, "")])[-1][0] + 1
    version = f"version-{uuid.uuid4().hex}"
    texts.select("value").write.option("compression", "gzip").text(f"{folder}/{version}")
    temporary, final = f"{root}/.{version}", f"{root}/current-{number}"
    with files.open_output_stream(temporary) as out:
        out.write(version.encode())
    if files.get_file_info(final).type != pafs.FileType.NotFound:
        files.delete_file(temporary)
        raise RuntimeError(f"{final} was written by another writer meanwhile")
    files.move(temporary, final)
    return version


def update(spark: SparkSession, folder: str, fresh: DataFrame, rules: str) -> bool:
    """Add entries, of which the latest a path stays, and publish; without entries nothing is written and False returned."""
    if fresh.isEmpty():
        return False
    publish(documents(upsert(read(spark, folder, rules), fresh.select(*FIELDS))), folder)
    return True
