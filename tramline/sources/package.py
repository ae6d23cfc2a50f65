"""Typed, content-addressed packages of all relations: writing, validating and reading.

The data are checked by Spark (key order, nulls, counts); sizes, digests and footers by the driver,
relation by relation. The first failure raises.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..contract import RELATIONS, SCHEMA_VERSION, Relation
from ..operators.checks import key_order
from . import joined

#: Manifest entries that are digests, beside one for each relation.
DIGESTS = ("build_key_sha256", "source_set_sha256", "overlay_policy_sha256", "compiler_sha256", "compiler_options_sha256", "gtfs_sha256", "serving_sha256")
IDENTITY = ("provisional-v0", "registry-v1")
#: Footer keys; a package of another producer can use another prefix.
PREFIX = "tramline"
BATCH = 65_536
#: Relations that are scanned or written at once.
JOBS = 8


class PackageError(ValueError):
    """A package breaks the contract."""


def canonical_json(value: object) -> bytes:
    """Sorted keys, no blanks, UTF-8, one line end."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()


def digest_of(document: object) -> str:
    return hashlib.sha256(canonical_json(document)).hexdigest()


def file_sha256(path: str | os.PathLike) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def arrow_schema(relation: Relation) -> pa.Schema:
    return to_arrow_schema(relation.schema)


def schema_document(relation: Relation) -> list[dict[str, Any]]:
    return [{"name": f.name, "type": str(f.type), "nullable": f.nullable} for f in arrow_schema(relation)]


def write_package(relations: dict[str, DataFrame], root: str | os.PathLike, manifest: dict[str, Any], prefix: str = PREFIX) -> dict[str, Any]:
    """Writes each relation sorted by its key as one file with its footer keys, and then the manifest, which is returned.

    Row groups are sorted and written side by side, in tasks of their own, and then joined as they are: equal rows give equal bytes, however many tasks
    there were. On a cluster root must be a folder that executors and driver share.
    """
    serving = Path(root).resolve() / "serving"
    serving.mkdir(parents=True)

    def write(name: str) -> dict[str, Any]:
        relation = RELATIONS[name]
        schema = arrow_schema(relation)
        marks = {f"{prefix}.schema_version": str(SCHEMA_VERSION), f"{prefix}.relation": name}
        rows = relations[name].select(*[relations[name][f.name].cast(f.dataType) for f in relation.schema])
        path = str(serving / f"{name}.parquet")
        n = joined.write_parquet(rows, list(relation.sort_key), path, schema.with_metadata(marks), BATCH)
        return {"name": name, "schema": schema_document(relation), "sort_key": list(relation.sort_key), "path": f"serving/{name}.parquet", "sha256": file_sha256(path), "size_bytes": os.path.getsize(path), "row_count": n}

    with ThreadPoolExecutor(JOBS) as pool:
        entries = list(pool.map(write, RELATIONS))
    digests = [{k: e[k] for k in ("name", "sha256", "row_count")} for e in entries]
    out = manifest | {"schema_version": SCHEMA_VERSION, "relations": entries, "serving_sha256": digest_of(digests)}
    (Path(root) / "manifest.json").write_bytes(canonical_json(out))
    return out


@dataclass(frozen=True)
class Package:
    root: Path
    manifest: dict[str, Any]
    manifest_sha256: str
    rows: dict[str, int]

    def read(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {name: spark.read.schema(r.schema).parquet(str(self.root / "serving" / f"{name}.parquet")) for name, r in RELATIONS.items()}


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise PackageError(message)


def _is_digest(value: object) -> bool:
    return isinstance(value, str) and re.fullmatch("[0-9a-f]{64}", value) is not None


def _check_header(m: Any, extra: dict[str, Any]) -> None:
    _need(isinstance(m, dict), "the manifest is no object")
    _need(m.get("schema_version") == SCHEMA_VERSION, "unsupported schema version")
    _need(m.get("identity_contract") in IDENTITY, "unsupported identity contract")
    _need(isinstance(m.get("feed_version"), str) and bool(m["feed_version"]), "feed_version must be text")
    for key in DIGESTS:
        _need(_is_digest(m.get(key)), f"{key} must be a lower-case SHA-256 digest")
    registry = m.get("registry_snapshot_sha256")
    _need(registry is None or _is_digest(registry), "registry_snapshot_sha256 must be a lower-case SHA-256 digest")
    _need(m["identity_contract"] != "registry-v1" or registry is not None, "registry-v1 needs a registry snapshot")
    _need(isinstance(m.get("compiler_identity"), dict), "compiler_identity must be an object")
    for key, value in extra.items():
        _need(m.get(key) == value, f"unsupported {key}")


def _check_entry(root: Path, entry: dict[str, Any], relation: Relation, prefix: str) -> None:
    name = relation.name
    _need(entry.get("schema") == schema_document(relation), f"{name}: the manifest's schema differs")
    _need(entry.get("sort_key") == list(relation.sort_key), f"{name}: the manifest's sort key differs")
    _need(isinstance(entry.get("path"), str) and PurePosixPath(entry["path"]).parts == ("serving", f"{name}.parquet"), f"{name}: the path isn't canonical")
    path = (root / "serving" / f"{name}.parquet").resolve()
    _need(root.resolve() in path.parents, f"{name}: the file is outside the package")
    _need(_is_digest(entry.get("sha256")), f"{name}: sha256 must be a lower-case SHA-256 digest")
    for key in ("size_bytes", "row_count"):
        _need(type(entry.get(key)) is int and entry[key] >= 0, f"{name}: {key} must be a number from 0")
    _need(path.is_file(), f"{name}: the file is missing")
    _need(path.stat().st_size == entry["size_bytes"] and file_sha256(path) == entry["sha256"], f"{name}: size or digest differs")
    footer = pq.ParquetFile(path)
    _need(footer.schema_arrow.remove_metadata().equals(arrow_schema(relation)), f"{name}: the file's schema differs")
    marks = footer.schema_arrow.metadata or {}
    _need(marks.get(f"{prefix}.schema_version".encode()) == str(SCHEMA_VERSION).encode() and marks.get(f"{prefix}.relation".encode()) == name.encode(), f"{name}: the footer's marks differ")
    _need(footer.metadata.num_rows == entry["row_count"], f"{name}: the row count differs")


def check_keys(spark: SparkSession, path: str, relation: Relation) -> None:
    """Keys rise strictly in the file's physical order: Spark checks batches of it in parallel."""
    rows = spark.read.schema(relation.schema).parquet(path).select(*relation.sort_key, F.col("_metadata.row_index").alias("_at"))
    found = {r["kind"]: r["violations"] for r in key_order(rows.withColumn("_part", F.floor(F.col("_at") / BATCH)), list(relation.sort_key), "_at", "_part").collect()}
    for kind in ("null", "duplicate", "unsorted"):
        _need(not found.get(kind), f"{relation.name}: {found.get(kind)} {kind} keys")


def validate_package(spark: SparkSession, root: str | os.PathLike, prefix: str = PREFIX, extra: dict[str, Any] | None = None) -> Package:
    """The package if it keeps the contract, else PackageError for the first breach: header, each relation's entry and file, their keys, then the whole."""
    root = Path(root).resolve()
    try:
        raw = (root / "manifest.json").read_bytes()
        manifest = json.loads(raw)
    except (OSError, ValueError) as error:
        raise PackageError(f"the manifest can't be read: {error}") from error
    _check_header(manifest, extra or {})
    entries = manifest.get("relations")
    _need(isinstance(entries, list), "relations must be an array")
    rows: dict[str, int] = {}
    digests = []
    for entry in entries:
        _need(isinstance(entry, dict) and entry.get("name") in RELATIONS and entry["name"] not in rows, "an entry names no relation, or one twice")
        relation = RELATIONS[entry["name"]]
        _check_entry(root, entry, relation, prefix)
        rows[relation.name] = entry["row_count"]
        digests.append({"name": relation.name, "sha256": entry["sha256"], "row_count": entry["row_count"]})
    # the scans are independent jobs; the first breach in the relations' order is told
    with ThreadPoolExecutor(JOBS) as pool:
        for _ in pool.map(lambda name: check_keys(spark, str(root / "serving" / f"{name}.parquet"), RELATIONS[name]), rows):
            pass
    _need(list(rows) == list(RELATIONS), f"relations are missing or out of order: {sorted(set(RELATIONS) - set(rows))}")
    _need(digest_of(digests) == manifest["serving_sha256"], "the package's digest differs")
    return Package(root, manifest, hashlib.sha256(raw).hexdigest(), rows)
