"""Record layouts of messages, requests, bus records and change records."""

from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("integration_id", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("payload_ref", T.StringType()),
    T.StructField("payload_size", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("current_step", T.IntegerType()),
    T.StructField("step_history", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("expires_at", T.TimestampType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("last_error", T.StringType()),
])

ENVELOPE_COLUMNS = [field.name for field in ENVELOPE]

# Layout of the binaryFile source; a file stream has to be given it.
FILE_LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

CHANGE = T.StructType([
    T.StructField("lsn", T.LongType()),
    T.StructField("txid", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("op", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("before", T.MapType(T.StringType(), T.StringType())),
    T.StructField("after", T.MapType(T.StringType(), T.StringType())),
])

MESSAGE_STATUSES = ["received", "processing", "retry", "completed", "dead_letter"]
CHANGE_OPERATIONS = ["I", "U", "D"]

DEFAULT_TTL = "15 minutes"
INLINE_PAYLOAD_LIMIT = 256 * 1024
MAX_PAYLOAD_BYTES = 1024 ** 3
