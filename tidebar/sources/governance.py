"""A registry that is published in versions: checked, compared, committed once, verified, and rolled back.

A registry is one JSON object (symbol, anchor_tf, laws, ...). Its bytes lie under their own hash; a version is a small file,
numbered in order, that names the hash. A publisher states the version that it read and makes the next one by creating its
file, which fails if another has made it: of two publishers on one base the second is refused and has to read again. Bytes are
read back and hashed before the version is made, so that no version names bytes that aren't there. Old versions stay: rolling
back makes a new version with the old one's bytes. A version's file is its line of audit too. All paths are Hadoop
paths; the store must create a file only where there is none, as HDFS does.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidebar.sources import files

# Fixed values of the format.
REQUIRED = ("name", "symbol", "anchor_tf", "validation_status", "tier", "side", "conditions", "effect", "metrics")
OBJECTS = ("conditions", "effect", "metrics")
AUDIT = "timestamp_utc string, action string, version long, base long, approved_by string, reason string, previous_hash string, published_hash string, added long, removed long, changed long, unchanged long, allow_removals boolean"


class RegistryError(RuntimeError):
    pass


def canonical_hash(payload: Mapping[str, Any]) -> str:
    """SHA-256 of the JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def problems(payload: Mapping[str, Any], symbol: str, anchor_tf: str | None = None) -> list[str]:
    """What is wrong with a registry; nothing if it may be published."""
    want = {"symbol": symbol} | ({"anchor_tf": anchor_tf} if anchor_tf else {})
    fits = lambda value, name: str(value).upper() == want[name].upper()
    found = [] if str(payload.get("registry_schema_version", "")).strip() else ["registry_schema_version is missing"]
    found += [f"{n} is {payload.get(n)!r}, not {x!r}" for n, x in want.items() if not fits(payload.get(n, ""), n)]
    laws = payload.get("laws")
    if not isinstance(laws, list):
        return [*found, "laws is no list"]
    seen: set[str] = set()
    for k, law in enumerate(laws):
        if not isinstance(law, dict):
            found.append(f"laws[{k}] is no object")
            continue
        name = str(law.get("law_id", "")).strip() or f"laws[{k}]"
        if name == f"laws[{k}]":
            found.append(f"{name} has no law_id")
        elif name in seen:
            found.append(f"{name} stands twice")
        seen.add(name)
        found += [f"{name}.{n} is missing" for n in REQUIRED if n not in law]
        found += [f"{name}.{n} doesn't fit" for n in want if n in law and not fits(law[n], n)]
        found += [f"{name}.{n} is no object" for n in OBJECTS if n in law and not isinstance(law[n], dict)]
        if not isinstance(law.get("segment_modulators", []), list):
            found.append(f"{name}.segment_modulators is no list")
    return found


def difference(current: Mapping[str, Any], candidate: Mapping[str, Any]) -> dict[str, Any]:
    """Laws that are new, gone, changed (with the fields) and the same, by law_id."""
    old, new = ({str(x["law_id"]): x for x in p.get("laws", []) if isinstance(x, dict) and x.get("law_id")} for p in (current, candidate))
    fields = {n: sorted(f for f in {*old[n], *new[n]} if old[n].get(f) != new[n].get(f)) for n in sorted(old.keys() & new.keys())}
    return {"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "changed": {n: f for n, f in fields.items() if f}, "unchanged": [n for n, f in fields.items() if not f]}


class Registry:
    """The versions of one registry in a folder."""

    def __init__(self, spark: SparkSession, folder: str, symbol: str, anchor_tf: str):
        self.spark, self.folder, self.symbol, self.anchor_tf = spark, folder.rstrip("/"), symbol, anchor_tf

    def _path(self, number: int) -> str:
        return f"{self.folder}/versions/{number:09d}.json"

    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json")), default=0)

    def content(self, number: int | None = None) -> bytes:
        """The bytes of a version (the newest), checked against their hash."""
        number = self.version() if number is None else number
        if not number:
            raise RegistryError("nothing is published yet")
        name = files.read_json(self.spark, self._path(number))["content"]
        data = files.read_bytes(self.spark, f"{self.folder}/contents/{name}.json")
        if hashlib.sha256(data).hexdigest() != name:
            raise RegistryError(f"version {number}: its bytes differ from their hash")
        return data

    def payload(self, number: int | None = None) -> dict[str, Any]:
        value = json.loads(self.content(number).decode("utf-8-sig"))
        if not isinstance(value, dict):
            raise RegistryError("a registry is one JSON object")
        return value

    def publish(self, candidate: bytes | Mapping[str, Any], base: int, approved_by: str, reason: str, expected_hash: str | None = None, allow_removals: bool = False) -> int:
        """Make the version after `base`, the one that the candidate was compared with. Refused: a candidate that isn't valid or brings
        nothing new, one whose hash isn't the expected one, removed laws without leave, and a base that is no longer the newest."""
        data = candidate if isinstance(candidate, bytes) else (json.dumps(dict(candidate), ensure_ascii=False, indent=2) + "\n").encode()
        new = json.loads(data.decode("utf-8-sig"))
        if found := problems(new, self.symbol, self.anchor_tf):
            raise RegistryError("the candidate is not valid: " + "; ".join(found))
        if expected_hash and expected_hash != canonical_hash(new):
            raise RegistryError(f"the candidate changed: {canonical_hash(new)} is not {expected_hash}")
        old = self.payload(base) if base else {}
        if base and canonical_hash(old) == canonical_hash(new):
            raise RegistryError("the candidate equals the published registry")
        diff = difference(old, new)
        if diff["removed"] and not allow_removals:
            raise RegistryError(f"the candidate removes {len(diff['removed'])} laws: {', '.join(diff['removed'])}")
        return self._commit("PUBLISH_REGISTRY", data, base, approved_by, reason, old, new, diff, allow_removals)

    def rollback(self, number: int, approved_by: str, reason: str) -> int:
        """A new version with the bytes of an older one."""
        data, base = self.content(number), self.version()
        new, old = json.loads(data.decode("utf-8-sig")), self.payload(base)
        if found := problems(new, self.symbol, self.anchor_tf):
            raise RegistryError(f"version {number} is not valid: " + "; ".join(found))
        return self._commit("ROLLBACK_REGISTRY", data, base, approved_by, reason, old, new, difference(old, new), True)

    def _commit(self, action: str, data: bytes, base: int, approved_by: str, reason: str, old: Mapping, new: Mapping, diff: Mapping, allow_removals: bool) -> int:
        name, number = hashlib.sha256(data).hexdigest(), base + 1
        place = f"{self.folder}/contents/{name}.json"
        if not files.exists(self.spark, place):
            files.write_bytes(self.spark, place, data)
        if hashlib.sha256(files.read_bytes(self.spark, place)).hexdigest() != name:
            raise RegistryError("the bytes that were written can't be read back")
        entry = {
            "timestamp_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "action": action, "version": number, "base": base, "approved_by": approved_by, "reason": reason,
            "previous_hash": canonical_hash(old) if base else None, "published_hash": canonical_hash(new), **{k: len(v) for k, v in diff.items()}, "allow_removals": allow_removals,
        }
        try:
            files.create(self.spark, self._path(number), json.dumps({"content": name, **entry}).encode())
        except FileExistsError:
            raise RegistryError(f"version {number} exists: another has published on version {base}; read it and compare again") from None
        return number

    def audit(self) -> DataFrame:
        """Every publication and rollback, as the versions state them."""
        if not self.version():
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(f"{self.folder}/versions")
