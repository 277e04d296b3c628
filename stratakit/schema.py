"""The relations of the engine, as explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

DDL = {
    "snapshots": "project_id string, snapshot_id string, parent_snapshot_id string, created_at_utc string, name string, tool_version string, file_count bigint, logical_size_bytes bigint, total_path_bytes bigint, manifest_kind int, manifest_id string",
    "snapshot_entries": "snapshot_id string, path string, portable_key string, size_bytes bigint, modified_at_utc string, object_id string",
    "working_files": "path string, size_bytes bigint, modified_at_utc string, object_id string, fingerprint string",
    "scan_warnings": "relative_path string, reason string, makes_incomplete boolean",
    "objects": "object_id string, size_bytes bigint, location string, location_valid boolean",
    "object_refs": "object_id string, expected_size_bytes bigint, reference_count bigint, present_size_bytes bigint",
    "manifest_edges": "parent_kind int, parent_id string, edge int, child_kind int, child_id string",
    "manifest_leaf_entries": "chunk_id string, path string, size_bytes bigint, modified_at_utc string, object_id string",
    "inventory_states": "state_id string, project_id string, generation bigint, count bigint, operation string, parent_id string, snapshot_id string, operation_id string",
    "plan_operations": "operation_type string, path string, before_hash string, before_size_bytes bigint, before_modified_at_utc string, after_hash string, after_size_bytes bigint, after_modified_at_utc string",
    "journals": "transaction_id string, state string, checkpoint_id string, kind string, created_at_utc string, updated_at_utc string, operations array<struct<operation_type: string, path: string, before_hash: string, before_size_bytes: bigint, before_modified_at_utc: string, after_hash: string, after_size_bytes: bigint, after_modified_at_utc: string>>",
    "name_overrides": "snapshot_id string, name string",
    "file_fingerprints": "project_id string, path string, size_bytes bigint, modified_at_utc string, fingerprint string, object_id string",
    "registry": "project_id string, last_root_path string, display_name string",
}


def schema(name: str) -> StructType:
    return _parse_datatype_string(DDL[name])


def mismatches(df: DataFrame, name: str) -> list[str]:
    """What keeps ``df`` from being relation ``name``: exact columns, in order, with exact types. Empty if nothing."""
    want = [(f.name, f.dataType.simpleString()) for f in schema(name)]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if want == have:
        return []
    return [f"expected {w}, found {h}" for w, h in zip(want + [None] * len(have), have + [None] * len(want), strict=False) if w != h and (w or h)]


def validate_schema(df: DataFrame, name: str) -> DataFrame:
    found = mismatches(df, name)
    if found:
        raise ValueError(f"{name}: {'; '.join(found)}")
    return df
