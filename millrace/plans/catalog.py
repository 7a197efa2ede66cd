"""Datasets, versions and runs as documents, with upsert by key."""

from __future__ import annotations

import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.profile import infer_schema, null_counts, schema_hash
from millrace.sources.files import hash_file, read_csv, read_json, write_json


class Catalog:
    """JSON documents under a folder: datasets/<id>.json, runs/<dataset>/<run>.json, in order of time."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def register(self, spark: SparkSession, dataset_id: str, path: str | Path, description: str | None = None) -> dict[str, Any]:
        """A version for each distinct content; the same content gives the version that is there."""
        content = hash_file(path)
        doc = read_json(self._dataset(dataset_id)) or {"dataset_id": dataset_id, "description": None, "versions": []}
        if description is not None:
            doc["description"] = description
        found = next((v for v in doc["versions"] if v["source_hash"] == content), None)
        if found is None:
            rows = read_csv(spark, path)
            schema = infer_schema(rows)
            found = {"version": f"v{len(doc['versions']) + 1}", "source_hash": content, "schema": schema, "schema_hash": schema_hash(schema), "row_count": rows.count(), "null_counts": null_counts(rows), "created_at": time.time()}
            doc["versions"].append(found)
        write_json(self._dataset(dataset_id), doc)
        return found

    def _dataset(self, dataset_id: str) -> Path:
        if not dataset_id or "/" in dataset_id or dataset_id.startswith("."):
            raise ValueError(f"unsafe dataset id {dataset_id!r}")
        return self.root / "datasets" / f"{dataset_id}.json"

    def dataset(self, dataset_id: str) -> dict[str, Any] | None:
        """With versions in numeric order."""
        doc = read_json(self._dataset(dataset_id))
        return doc and doc | {"versions": sorted(doc["versions"], key=lambda v: int(v["version"][1:]))}

    def datasets(self) -> list[dict[str, Any]]:
        return [read_json(p) for p in sorted((self.root / "datasets").glob("*.json"))]

    def record(self, run: dict[str, Any]) -> None:
        write_json(self.root / "runs" / run["dataset_id"] / f"{run['run_id']}.json", run)

    def runs(self, dataset_id: str) -> list[dict[str, Any]]:
        return sorted((read_json(p) for p in (self.root / "runs" / dataset_id).glob("*.json")), key=lambda r: r["created_at"])

    def successful(self, dataset_id: str, business_date: str, source_hash: str) -> dict[str, Any] | None:
        """A passed run of the same content and date.  The log is append-only, so A, B, A finds the first A."""
        return next((r for r in reversed(self.runs(dataset_id)) if (r["business_date"], r["source"]["hash"], r["quality"]["passed"]) == (business_date, source_hash, True)), None)

    def previous_schema(self, dataset_id: str) -> str | None:
        passed = [r for r in self.runs(dataset_id) if r["quality"]["passed"]]
        return passed[-1]["schema_hash"] if passed else None

    def reuse(self, run: dict[str, Any]) -> dict[str, Any]:
        run = run | {"reuse_count": run.get("reuse_count", 0) + 1, "last_reused_at": time.time()}
        self.record(run)
        return run

    def frame(self, spark: SparkSession, dataset_id: str) -> DataFrame:
        rows = [(r["run_id"], r["business_date"], r["source"]["hash"], r["schema_hash"], r["quality"]["passed"], [(x["name"], x["path"], x["parents"]) for x in r["layers"]]) for r in self.runs(dataset_id)]
        return spark.createDataFrame(rows, "run_id string, business_date string, source_hash string, schema_hash string, passed boolean, layers array<struct<name:string,path:string,parents:array<string>>>")


def report(run: dict[str, Any]) -> dict[str, Any]:
    """What an operator asks of a run: its counts, its checks by status, and its lineage back to the source."""
    checks = run["quality"]["checks"]
    by = lambda s: [c["name"] for c in checks if c["status"] == s]
    layers = {x["name"]: x for x in run["layers"]}
    return {
        "run_id": run["run_id"], "dataset_id": run["dataset_id"], "business_date": run["business_date"], "grain": run.get("grain", []), "stats": run["stats"],
        "quality": {"total_checks": len(checks), "pass_count": len(by("pass")), "warn_count": len(by("warn")), "fail_count": len(by("fail")), "failed_checks": by("fail"), "warning_checks": by("warn")},
        "lineage": [layers[n] for n in ("gold", "silver", "bronze") if n in layers] + [{"name": "source", **run["source"]}],
    }
