from .apply import (
    apply_changes,
    apply_deletes,
    apply_inserts,
    apply_multi_table,
    apply_updates,
    change_summary,
    is_live,
    late_changes,
    live_row_timeline,
    state_as_of,
)
from .carry import LOG_RANGE_BITS, RANGE_BITS, carry_last, running_total
from .events import (
    assign_segment,
    carry_position,
    event_headers,
    event_profile,
    format_events,
    resume_from,
    rotate_events,
    supported_events,
    with_seq,
)
from .history import conform, folded_types, misfits, schema_history
from .observe import change_metrics, tap
from .schema import (
    attach_table_map,
    column_catalog,
    reject_types,
    schema_asof,
    unmatched_rows,
)
from .sketches import (
    key_sketches, merge_key_sketches, read_key_sketches, write_key_sketches,
)
from .validate import key_reason, split_valid, validate_key

__all__ = [
    "LOG_RANGE_BITS", "RANGE_BITS",
    "apply_changes", "apply_deletes", "apply_inserts", "apply_multi_table", "apply_updates",
    "assign_segment", "attach_table_map", "carry_last", "carry_position", "change_metrics",
    "change_summary", "column_catalog", "conform", "event_headers", "event_profile",
    "folded_types", "format_events", "is_live", "key_reason", "key_sketches", "late_changes", "live_row_timeline", "merge_key_sketches",
    "misfits", "read_key_sketches", "reject_types", "resume_from", "rotate_events",
    "running_total", "schema_asof", "schema_history", "split_valid", "state_as_of",
    "supported_events", "tap", "unmatched_rows", "validate_key", "with_seq", "write_key_sketches",
]
