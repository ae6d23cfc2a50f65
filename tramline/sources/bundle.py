"""Snapshots and bundles on the driver's side: verified copies, inventories, deterministic archives, atomic publishing, configuration."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import tomllib
import zipfile
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joined
from .package import canonical_json, digest_of, file_sha256
from .publish import storage_key

#: The time that all members of a deterministic archive have: the earliest that the format knows.
EPOCH = (1980, 1, 1, 0, 0, 0)


class BundleError(ValueError):
    """A snapshot, bundle or configuration that can't be used."""


def manifest_of(root: str | os.PathLike) -> list[dict[str, Any]]:
    """(path, bytes, sha256) of all files under root, by path."""
    base = Path(root)
    files = sorted((p for p in base.rglob("*") if p.is_file()), key=lambda p: p.relative_to(base).as_posix())
    return [{"path": p.relative_to(base).as_posix(), "bytes": p.stat().st_size, "sha256": file_sha256(p)} for p in files]


def copy_snapshot(source: str | os.PathLike, target: str | os.PathLike, expected: Iterable[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Copies a snapshot and checks every object again; links and unlisted or changed objects are an error. Equal inputs give an equal manifest."""
    base = Path(source)
    if any(p.is_symlink() for p in base.rglob("*")):
        raise BundleError("a snapshot has no links")
    for x in expected:
        storage_key(x["path"])
    shutil.copytree(base, target)
    found = manifest_of(target)
    if found != sorted(map(dict, expected), key=lambda x: x["path"]):
        raise BundleError("the snapshot's objects differ from its manifest")
    return found


def recheck_inventory(frozen: Iterable[str], now: Iterable[str]) -> list[str]:
    """Objects that came up since; that any is gone is an error."""
    before, after = set(frozen), set(now)
    if gone := sorted(before - after):
        raise BundleError(f"{len(gone)} objects are gone, the first {gone[:20]}")
    return sorted(after - before)


def deterministic_zip(root: str | os.PathLike, target: str | os.PathLike, level: int = 6) -> str:
    """An archive whose bytes depend on the files' names and contents only; its digest."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as archive:
        for x in manifest_of(root):
            info = zipfile.ZipInfo(x["path"], EPOCH)
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o100644 << 16, 3
            with open(Path(root) / x["path"], "rb") as f, archive.open(info, "w") as out:
                shutil.copyfileobj(f, out, 1 << 20)
    return file_sha256(target)


def publish(target: str | os.PathLike, build: Callable[[Path], None]) -> Path:
    """Builds into a folder beside the target, which then takes its name at once. What a failed build leaves stays, with its reason."""
    final = Path(target)
    staging = final.with_name(f".{final.name}.staging")
    if final.exists() or staging.exists():
        raise BundleError(f"{final} or its staging folder is there already")
    staging.mkdir(parents=True)
    try:
        build(staging)
    except Exception as error:
        (staging / "failure.json").write_bytes(canonical_json({"error": str(error), "kind": type(error).__name__}))
        raise
    os.replace(staging, final)
    return final


def provenance(commit: str, difference: bytes, inputs: Iterable[str | os.PathLike], command: Iterable[str]) -> dict[str, Any]:
    """What a build was made with: a changed tree is told, not refused."""
    return {"commit": commit, "dirty": bool(difference), "diff_sha256": hashlib.sha256(difference).hexdigest() if difference else None, "inputs": {os.path.basename(p): file_sha256(p) for p in sorted(map(str, inputs))}, "command": list(command)}


def cache_key(version: int, tool: Mapping[str, Any], inputs: Iterable[str]) -> str:
    return digest_of({"version": version, "tool": dict(tool), "inputs": list(inputs)})


@dataclass(frozen=True)
class Derived:
    """A derived file and what it was derived from."""

    path: Path
    key: str
    size: int
    mtime_ns: int

    @staticmethod
    def of(path: str | os.PathLike, key: str) -> Derived:
        s = os.stat(path)
        return Derived(Path(path), key, s.st_size, s.st_mtime_ns)

    def check(self, key: str) -> Path:
        """The file, if it is of this key and unchanged; never made anew behind the caller's back."""
        s = os.stat(self.path)
        if (self.key, self.size, self.mtime_ns) != (key, s.st_size, s.st_mtime_ns):
            raise BundleError(f"{self.path} is stale")
        return self.path


def load_config(path: str | os.PathLike, modes: Iterable[str], paths: Iterable[str], pairs: Iterable[tuple[str, str]] = ()) -> dict[str, Any]:
    """A TOML file with exactly one of the modes as a table, whose paths are absolute and whose pairs are given together or not at all."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    chosen = [m for m in modes if m in found]
    if len(chosen) != 1 or not isinstance(found[chosen[0]], dict):
        raise BundleError(f"one of {sorted(modes)} must be given, and one only")
    table = found[chosen[0]]
    for key in paths:
        if key in table and not (isinstance(table[key], str) and os.path.isabs(table[key])):
            raise BundleError(f"{chosen[0]}.{key} must be an absolute path")
    for a, b in pairs:
        if (a in table) != (b in table):
            raise BundleError(f"{a} and {b} must be given together")
    return {"mode": chosen[0], **table}


def dictionary_catalog(operations: Mapping[str, DataFrame], code: str = "code") -> dict[str, list[dict[str, Any]]]:
    """Dictionaries of a code list service as one document: each operation's rows without empty values, by code."""
    return {name: [{k: v for k, v in sorted(r.asDict().items()) if v not in (None, "")} for r in df.dropDuplicates([code]).orderBy(code).toLocalIterator()] for name, df in sorted(operations.items())}


def write_csv(df: DataFrame, target: str | os.PathLike, order: list[str]) -> int:
    """One CSV of sorted rows with a header, nulls as empty fields and booleans as 0 and 1, as timetable feeds have it; the number of rows.

    Its pieces are written side by side. On a cluster the target must be in a shared folder.
    """
    columns = df.columns

    def encode(path: str, batches: list[pa.RecordBatch], group: int) -> None:
        with open(path, "w", encoding="utf-8", newline="") as file:
            rows = csv.writer(file, lineterminator="\r\n")
            if not group:
                rows.writerow(columns)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    rows.writerow(["" if v is None else int(v) if isinstance(v, bool) else v for v in row])

    return joined.write_sorted(df, order, str(Path(target).resolve()), encode, lambda _, parts, path: joined.join_bytes(parts, path))


def write_feed(tables: Mapping[str, tuple[DataFrame, list[str]]], root: str | os.PathLike) -> dict[str, int]:
    """Files of a feed or of its extensions: name to rows and their order; rows written of each. Columns without a value are left out if named with a question mark."""
    base = Path(root)
    base.mkdir(parents=True, exist_ok=True)
    out = {}
    for name, (df, order) in tables.items():
        keep = [c for c in df.columns if not c.endswith("?")]
        optional = [c for c in df.columns if c.endswith("?")]
        if optional:
            there = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in optional]).first()
            keep += [c for c in optional if there[c]]
        rows = df.select(*[F.col(f"`{c}`").alias(c.removesuffix("?")) for c in df.columns if c in keep])
        out[name] = write_csv(rows, base / name, order)
    return out


def read_catalog(path: str | os.PathLike) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))
