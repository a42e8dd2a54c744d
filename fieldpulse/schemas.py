"""Table schemas, enumerations and the settings with fixed meaning."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------
DEVICE_TYPES = ("temperature_sensor", "vibration_sensor", "pressure_sensor", "smart_meter", "gps_tracker")
DEVICE_STATUSES = ("registered", "provisioned", "active", "inactive", "decommissioned", "rejected")
NODE_STATUSES = ("joining", "alive", "suspect", "dead", "leaving")

RAW_TELEMETRY = "raw_telemetry"
CONSUMER_GROUPS = ("ml_inference", "data_persistence", "alert_handler")

# payload keys that never count as sensor values
NON_FEATURE_KEYS = ("anomaly", "anomaly_type", "unit")
# message keys that are not sensor data when a message has no payload object
ENVELOPE_KEYS = ("device_id", "device_type", "timestamp", "metadata")

FEATURE_WIDTH = 8
MAX_TRAINING_WIDTH = 16
FEATURE_WINDOW = 10

PROCESSING_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
INFERENCE_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

RATE_LIMIT_REQUESTS = 100
RATE_LIMIT_WINDOW_SECONDS = 60
ROLE_MULTIPLIERS = {"admin": 5.0, "user": 1.0, "device": 2.0}
RATE_LIMIT_EXCLUDED_PATHS = ("/health", "/ready", "/health/dependencies")
# --- end of fixed values --------------------------------------------------------

# columns an ad-hoc count query may group by
GROUP_COLUMNS = {
    "telemetry_count": ("device_type", "device_id", "metric"),
    "anomaly_count": ("device_type", "device_id", "severity"),
}

RAW_MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("arrived_at", T.TimestampType()),
])

READING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

LOG_ENTRY = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("details", T.StringType()),
])
