"""Schemas of the relations that the engine reads and writes."""

from __future__ import annotations

STATIC = "src long, dst long"
UPDATES = "seq long, src long, dst long, typ tinyint"
WEIGHTED = "src long, dst long, weight long"
LEVEL_EDGES = "src int, dst int, weight int, diff smallint"
DISTANCES = "vertex long, distance long"
#: Measurement records (JSON lines); *_sha256 columns and flags may be missing, so gates read them from ``raw`` too.
RECORD = (
    "case_id string, system string, warmup boolean, correct boolean, graph_sha256 string, source long, performance_claim_eligible boolean, "
    "performance_valid boolean, integration_dirty boolean, source_states map<string, struct<commit: string, tracked_dirty: boolean>>"
)
SELECTION = "cases array<struct<case_id: string, graph_sha256: string, bfs_source: long>>"
MANIFEST = ["case", "family", "vertices", "static_edges", "update_edges", "final_edges", "source", "supersteps", "default_weight", "graph", "result", "weighted_edges", "expected", "metadata"]
CLASSIFICATION = [
    "case", "status", "raw_edges", "batches", "final_edges", "final_max_level", "max_partition_edges", "first_failure_batch", "failure_level",
    "failure_partition", "failure_partition_edges", "failure_partition_capacity", "failure_reason", "edge_file",
]
