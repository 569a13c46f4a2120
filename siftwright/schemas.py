"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

METHOD = "struct<name: string, line: int, end_line: int>"
POSITION = "struct<line: int, column: int>"
LEDGER_ITEM = "struct<id: string, source: string, delta: bigint, reason: string>"

SOURCE_FILES = "path string, size bigint, mtime timestamp, content string"
FACTS = (
    "path string, package_name string, type_name string, kind string, implements_types array<string>, extends_type string, "
    f"annotations array<string>, methods array<{METHOD}>, fact_source string"
)
FILE_RECORDS = "path string, mtime_ms double, size bigint, batch_id string, package_name string, type_name string, kind string, seq bigint"
SYMBOL_RECORDS = "path string, batch_id string, kind string, name string, line int, end_line int"
SEMANTIC_EDGES = "kind string, src_file string, src_line int, src_col int, dst_file string, dst_line int, dst_col int, depth int"
EVIDENCE = (
    "query_id string, path string, stage int, ord int, score bigint, match_count bigint, positions array<struct<line: int, column: int>>, "
    "categories array<string>, reasons array<string>, verified_by array<string>, confidence string, "
    "module string, layer string, source_set string"
)
CHANGES = "uri string, file_path string, change_type int, event_time timestamp"
SCENARIO = (
    "id string, name string, projectId string, layoutProfile string, repoCommit string, scenarioVersion int, warmState string, "
    "anchor struct<file: string, line: int, column: int, profile: string, focusModules: array<string>, taskKeywords: array<string>>, "
    "golden struct<mustHit: array<string>, shouldHit: array<string>, side: array<string>>, "
    "goldenMeta map<string, struct<shouldBlocksTask: boolean, note: string>>, groundTruth array<string>"
)
