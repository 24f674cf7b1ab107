"""Schemas of the library's tables. Reads are always by schema, never inferred."""

from __future__ import annotations

METADATA = "struct<created:string,coding_level_1:string,coding_level_2:string,coding_level_3:string>"
RECORD = f"id string, content string, metadata {METADATA}"
#: As it arrives: unknown keys must be seen before they are refused.
RAW_RECORD = "id string, content string, metadata map<string,string>, _corrupt_record string"
CALL = "tenant_id string, operation string, call_id string, ts timestamp, call_duration_ms bigint, model string, input_tokens bigint, output_tokens bigint, cost_usd decimal(12,6), status string, error_class string"
FRAMEWORK = "node_id string, parent_id string, name string, level int, position int"
PRICES = "model string, input_per_token double, output_per_token double"
COMPLETION = "struct<content:string,model:string,input_tokens:bigint,output_tokens:bigint,cost:double,status:string,error_class:string,duration_ms:bigint>"

# Fixed values.
METADATA_KEYS = ("created", "coding_level_1", "coding_level_2", "coding_level_3")
DEPRECATED_KEYS = ("feedback_record_id",)
MAX_CONTENT = 100_000
OPERATIONS = ("analyze", "summarize", "assign_codes", "detect_sensitive")
STATUSES = ("ok", "error")
