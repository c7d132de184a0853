"""Table schemas and vocabularies of the catalog and of the change log."""

from __future__ import annotations

from enum import Enum, IntEnum

from pyspark.sql import types as T


class Scope(str, Enum):
    PRODUCT = "product"
    VARIATION = "variation"

    @classmethod
    def parse(cls, value: object) -> "Scope":
        """Unknown or missing scopes mean products."""
        try:
            return cls(value)
        except ValueError:
            return cls.PRODUCT


class ChangeStatus(IntEnum):
    PENDING = 0
    APPLIED = 1
    FAILED = 2
    SKIPPED = 3


CHANGE_STATUS_LABELS = {s.value: s.name.lower() for s in ChangeStatus}

ACTIVE_OPERATION_STATUSES = ("queued", "running")
TERMINAL_OPERATION_STATUSES = ("completed", "failed", "reverted")
OPERATION_STATUSES = ("draft", "queued", "running", "paused", "completed", "failed", "reverted")
OPERATION_SOURCES = ("ui", "cli", "schedule", "undo")


class ConflictPolicy(str, Enum):
    SKIP = "skip"
    FORCE = "force"

    @classmethod
    def parse(cls, value: object) -> "ConflictPolicy":
        """Anything but an explicit force is the safe policy."""
        try:
            return cls(value)
        except ValueError:
            return cls.SKIP


class Recurrence(str, Enum):
    ONCE = "once"
    HOURLY = "hourly"
    DAILY = "daily"
    WEEKLY = "weekly"
    MONTHLY = "monthly"


PRICE_TYPE = T.DecimalType(19, 4)

OBJECTS = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("min_price", PRICE_TYPE),
        T.StructField("max_price", PRICE_TYPE),
        T.StructField("stock_quantity", T.LongType()),
        T.StructField("stock_status", T.StringType()),
    ]
)

META = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("meta_key", T.StringType()),
        T.StructField("meta_value", T.StringType()),
    ]
)

TERMS = T.StructType(
    [
        T.StructField("term_id", T.LongType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("slug", T.StringType()),
    ]
)

OBJECT_TERMS = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("taxonomy", T.StringType()),
        T.StructField("term_id", T.LongType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("operation_id", T.LongType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("object_id", T.LongType()),
        T.StructField("action_ix", T.IntegerType()),
        T.StructField("field_type", T.StringType()),
        T.StructField("field_key", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ]
)

OPERATIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("last_progress_at", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("parent_op_id", T.LongType()),
        T.StructField("filter_json", T.StringType()),
        T.StructField("actions_json", T.StringType()),
        T.StructField("target_count", T.LongType()),
        T.StructField("processed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("mode", T.StringType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("conflict_policy", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("filter_json", T.StringType()),
        T.StructField("actions_json", T.StringType()),
        T.StructField("recurrence", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("next_run", T.TimestampType()),
        T.StructField("last_run", T.TimestampType()),
        T.StructField("last_op_id", T.LongType()),
        T.StructField("notify_email", T.StringType()),
    ]
)

CHANGE_COLUMNS = CHANGES.fieldNames()
CHANGE_KEY = ["operation_id", "object_id", "action_ix"]
