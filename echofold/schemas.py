"""Fixed schemas of the three tables an inventory consists of."""

from pyspark.sql import types as T

FILE = "F"
FOLDER = "D"

RUNNING = "Running"
COMPLETED = "Completed"
CANCELED = "Canceled"
FAILED = "Failed"

# Two rows hold the same content exactly when both of these agree.
CONTENT_KEY = ["content_hash", "size_bytes"]

ENTRIES = T.StructType([
    T.StructField("scan_run_id", T.StringType()),
    T.StructField("entry_type", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("date_modified_utc", T.TimestampNTZType()),
    T.StructField("date_created_utc", T.TimestampNTZType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("scan_error", T.StringType()),
    T.StructField("scanned_at_utc", T.TimestampNTZType()),
])

SKIPS = T.StructType([
    T.StructField("full_path", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("scan_run_id", T.StringType()),
    T.StructField("scanned_at_utc", T.TimestampNTZType()),
])

SCANS = T.StructType([
    T.StructField("scan_run_id", T.StringType()),
    T.StructField("started_at_utc", T.TimestampNTZType()),
    T.StructField("completed_at_utc", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("machine_name", T.StringType()),
    T.StructField("drive", T.StringType()),
    T.StructField("roots", T.StringType()),
    T.StructField("compute_hash", T.BooleanType()),
    T.StructField("files_written", T.LongType()),
    T.StructField("scan_error", T.StringType()),
])

# The run log is append-only: one event when a run opens, one when it closes.
SCAN_EVENTS = T.StructType(
    [T.StructField("event_at_utc", T.TimestampNTZType())] + SCANS.fields
)

# What a batch has finished, so that it can go on after a stop: "listed" (with the number of hash buckets)
# and "hashed" (with the number of the bucket).
LISTED, HASHED = "listed", "hashed"

PROGRESS = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("number", T.LongType()),
    T.StructField("at_utc", T.TimestampNTZType()),
])

HASHES = T.StructType([
    T.StructField("scan_run_id", T.StringType()),
    T.StructField("full_path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("bucket", T.LongType()),
])

FAILURES = T.StructType([
    T.StructField("scan_run_id", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("batch", T.StringType()),
])
