from .binlog import (
    bad_events,
    binlog_scan,
    build_changes,
    changes_of,
    decode_rows,
    read_changes,
    read_images,
    split_logs,
    table_maps,
    table_row_type,
    tables_row_type,
)
from .datasource import LogDataSource
from .ranges import range_index, range_lookup, range_scan, read_ranges, write_ranges
from .scratch import new_path, shared_folder
from .store import (
    add_changes,
    apply_late,
    create_store,
    merge_changes,
    read_store,
    snapshots,
    state_from_snapshots,
    store_lookup,
    take_snapshot,
    vacuum,
)
from .tables import (
    create_target,
    folded_targets,
    full_refresh,
    key_lookup,
    read_refreshed,
    route_changes,
    route_typed,
    snapshot_scan,
    state_to_json,
    write_state,
)

__all__ = [
    "LogDataSource", "add_changes", "apply_late", "bad_events", "binlog_scan", "build_changes",
    "changes_of", "create_store", "create_target", "decode_rows", "folded_targets", "full_refresh",
    "key_lookup", "merge_changes", "new_path", "range_index", "range_lookup", "range_scan",
    "read_changes", "read_images", "read_ranges", "read_refreshed", "read_store", "route_changes",
    "route_typed", "shared_folder", "snapshot_scan", "snapshots", "split_logs",
    "state_from_snapshots", "state_to_json", "store_lookup", "table_maps", "table_row_type",
    "tables_row_type", "take_snapshot", "vacuum", "write_ranges", "write_state",
]
