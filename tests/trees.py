"""Small folder trees written as ``path -> (content label, size)``; a null label is an unhashed file."""

import hashlib

from pyspark.sql import functions as F

ENTRY = (
    "scan_run_id string, entry_type string, file_name string, full_path string, size_bytes bigint, "
    "date_modified_utc timestamp_ntz, date_created_utc timestamp_ntz, content_hash string, scan_error string"
)


def digest(label):
    return hashlib.sha256(label.encode()).hexdigest()


def files(spark, tree, run="r", root="s3://b/"):
    """File rows of a tree; ``lone`` keeps the root itself out of every set."""
    rows = []
    for path, content in {**tree, "lone": ("alone", 7)}.items():
        label, size = content if isinstance(content, tuple) else (content, 10)
        hashed = None if label is None else digest(label)
        rows.append((run, "F", path.rsplit("/", 1)[-1], root + path, size, None, None, hashed, None))
    frame = spark.createDataFrame(rows, ENTRY)
    day = F.to_timestamp_ntz(F.lit("2024-01-01"), F.lit("yyyy-MM-dd"))
    return frame.withColumn("date_modified_utc", day)
