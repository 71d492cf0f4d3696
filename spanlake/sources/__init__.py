"""Readers and writers: records, calibration tables, run artifacts, chunked and split outputs."""
from spanlake.sources.records import (  # noqa: F401
    read_ground_truth, read_many, read_records, read_records_strict, with_row_idx, duplicate_ids,
)
from spanlake.sources.tables import read_calibration_csv, read_chunk_runs, read_run_artifacts  # noqa: F401
from spanlake.sources.sinks import write_chunks, write_csv, write_jsonl, write_kept_discarded  # noqa: F401
