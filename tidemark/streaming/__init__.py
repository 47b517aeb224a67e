from .apply import (
    apply_stream, compact_state, maintain_store, read_state, state_per_core, stream_state,
    use_rocksdb,
)
from .metrics import ObservedTotals, read_metrics, read_observed, stream_metrics
from .resolve import resolve_stream
from .route import publish, read_target, route_stream, targets
from .source import binlog_stream, change_stream

__all__ = ["ObservedTotals", "apply_stream", "binlog_stream", "change_stream", "compact_state",
           "maintain_store", "publish", "read_metrics", "read_observed", "read_state",
           "read_target", "resolve_stream", "route_stream", "state_per_core",
           "stream_metrics", "stream_state", "targets", "use_rocksdb"]
