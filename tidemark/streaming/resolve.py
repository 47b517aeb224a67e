"""Schema resolution on a stream of log events that come in any order, in any micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from .apply import use_rocksdb

_NUMBERS = ("file_seq", "byte_off", "event_us", "type_code", "server_id", "event_size", "id_bytes",
            "table_id")
_KEPT = pa.schema([*[(c, pa.int64()) for c in _NUMBERS], ("body", pa.binary())])  # while it waits
_PIECE = 4 << 20  # bytes of waiting events in one cell of the state, if they are several
_OUT = T.StructType([
    *[S.LOG_EVENTS[c] for c in ("log_file", "file_seq", "byte_off")],
    T.StructField("event_us", T.LongType()),
    *[S.LOG_EVENTS[c] for c in ("type_code", "server_id", "id_bytes", "table_id", "body",
                                "table_map", "error")]])


class _Resolver(StatefulProcessor):
    """State of one log file: how far it is known without a gap, the table maps in force there, and
    events beyond a gap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.upto = handle.getValueState("upto", "position bigint")
        self.maps = handle.getMapState("maps", "table_id bigint", "body binary")
        self.held = handle.getMapState("held", "piece bigint", "events binary")
        self.pieces = handle.getValueState("pieces", "n bigint, least bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        fresh = pd.concat(parts) if parts else pd.DataFrame()
        broken = fresh[fresh["error"].notna()]
        if len(broken):
            yield self._out(key, broken, [None] * len(broken), broken["error"])
        upto = self.upto.get()[0] if self.upto.exists() else S.FIRST_POSITION
        fresh = fresh[fresh["error"].isna() & (fresh["byte_off"] >= upto)]
        if not (fresh["byte_off"] == upto).any():  # the gap stays
            self._hold(fresh)
            return
        fresh = self._with_held(fresh)
        off = fresh["byte_off"].to_numpy(np.int64)
        ends = off + fresh["event_size"].to_numpy(np.int64)
        follows = off == np.concatenate([[upto], ends[:-1]])
        known = len(off) if follows.all() else int(np.argmin(follows))
        self._hold(fresh.iloc[known:])
        self.upto.update((int(ends[known - 1]),))
        yield from self._resolve(key, fresh.iloc[:known])

    def _hold(self, events: pd.DataFrame) -> None:
        """Let events wait, many to a cell. What is delivered again and again meanwhile is dropped
        whenever the cells have doubled."""
        if not len(events):
            return
        n, least = self.pieces.get() if self.pieces.exists() else (0, 0)
        cells = _cells(events)
        if n and n + len(cells) > 2 * least + 16:
            cells = _cells(self._with_held(events))
            n, least = 0, len(cells)
        for i, cell in enumerate(cells):
            self.held.updateValue((n + i,), (cell,))
        self.pieces.update((n + len(cells), least))

    def _with_held(self, fresh: pd.DataFrame) -> pd.DataFrame:
        """The events with all that wait, which leave the state, in order; one that was delivered
        twice is one event."""
        if self.pieces.exists():
            old = [pa.ipc.open_stream(bytes(v[0])).read_pandas() for _, v in self.held.iterator()]
            fresh = pd.concat([fresh[_KEPT.names], *old])
            self.held.clear()
            self.pieces.clear()
        return fresh.drop_duplicates("byte_off").sort_values("byte_off")

    def _resolve(self, key, events: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows events of a gapless stretch with the map in force at each."""
        force: dict[int, bytes | None] = {}
        changed, places, maps = set(), [], []
        for n, (code, table, body) in enumerate(zip(
                events["type_code"].tolist(), events["table_id"].tolist(),
                events["body"].tolist())):
            if code == S.TABLE_MAP_EVENT:
                force[int(table)] = body
                changed.add(int(table))
            elif code in S.ROWS_EVENTS:
                table = int(table)
                if table not in force:
                    force[table] = (self.maps.getValue((table,))[0]
                                    if self.maps.containsKey((table,)) else None)
                places.append(n)
                maps.append(force[table])
            elif code == S.ROTATE_EVENT:  # a file ends here; its maps do not reach the next one
                force, changed = {}, set()
                self.maps.clear()
        for table in changed:
            self.maps.updateValue((table,), (force[table],))
        if places:
            yield self._out(key, events.iloc[places], maps, [None] * len(places))

    @staticmethod
    def _out(key, rows: pd.DataFrame, maps, errors) -> pd.DataFrame:
        out = pd.DataFrame({"log_file": key[0], **{
            c: rows[c].astype("Int64") for c in ("file_seq", "byte_off", "event_us", "type_code",
                                                 "server_id", "id_bytes", "table_id")}})
        out["body"], out["table_map"], out["error"] = rows["body"], list(maps), list(errors)
        return out[_OUT.names]

    def close(self) -> None:
        pass


def _cells(events: pd.DataFrame) -> list[bytes]:
    """Events as Arrow streams of about ``_PIECE`` bytes."""
    batch = pa.RecordBatch.from_pandas(events[_KEPT.names], schema=_KEPT, preserve_index=False)
    rows = max(1, batch.num_rows * _PIECE // max(1, batch.nbytes))
    cells = []
    for start in range(0, batch.num_rows, rows):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KEPT) as stream:
            stream.write_batch(batch.slice(start, rows))
        cells.append(sink.getvalue().to_pybytes())
    return cells


def resolve_stream(log_events: DataFrame) -> DataFrame:
    """Streaming twin of ``attach_table_map``: rows events of a stream of ``log_events`` with the
    table map in force at each of them, each given once.

    Maps and rows may come in different micro-batches and in any order, and again. The sizes of a
    file's events say where the next one begins, so an event waits in the state until everything
    before it has been seen; then no earlier map can be missing. ``log_events`` must hold all events
    of a file from its start (bodies are needed of maps and rows only). Kept per file are a
    position, the maps in force (until the file's rotate event) and what waits. Files that cannot be
    read on pass their ``error`` through.
    """
    use_rocksdb(log_events.sparkSession)
    flat = log_events.select(
        "log_file", "file_seq", "byte_off", F.unix_micros("event_ts").alias("event_us"),
        "type_code", "server_id", "event_size", "id_bytes", "table_id", "body", "error")
    flat = flat.select("log_file", *[F.col(c).cast("bigint").alias(c) for c in _NUMBERS],
                       F.when(F.col("type_code").isin(S.TABLE_MAP_EVENT, *S.ROWS_EVENTS),
                              F.col("body")).alias("body"), "error")
    found = flat.groupBy("log_file").transformWithStateInPandas(
        _Resolver(), _OUT, "Append", "None")
    return found.withColumn("event_ts", F.timestamp_micros("event_us")).drop("event_us")
