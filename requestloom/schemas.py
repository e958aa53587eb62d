"""Table schemas shared by several modules."""

from __future__ import annotations

MANIFEST = (
    "totalRecordCount bigint, processedRecordCount bigint, successRecordCount bigint, "
    "errorRecordCount bigint, inputTokenCount bigint, outputTokenCount bigint"
)
REGISTRY_ENTRY = (
    "job_arn string, output_bucket string, output_prefix string, aws_region string, "
    "input_bucket string, input_prefix string, timestamp string"
)
REJECTS = "file_path string, file_name string, reason string"
CATALOG = "modality string, model_name string, model_id string"
