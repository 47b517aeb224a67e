"""The same results as plain SQL over the given tables, written independently of the engine:
row-by-row definitions with window functions instead of order-free aggregates."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

FEED_A = """
feed_a AS (
  SELECT 'e_store' AS "database", 'users' AS "table",
         lpad(CAST(user_id AS VARCHAR), 24, '0') AS key,
         CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
              ELSE 'UPDATE' END AS op,
         event_id AS seq, event_type, value,
         CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k
  FROM events)
"""

FEED_D = """
feed_d AS (
  SELECT 'e_store' AS "database", 'orders' AS "table",
         lpad(CAST(o_orderkey AS VARCHAR), 24, '0') AS key, 'INSERT' AS op,
         CAST(0 AS BIGINT) AS seq, o_orderstatus AS status, o_totalprice AS price
  FROM orders
  UNION ALL
  SELECT 'e_store', 'orders', lpad(CAST(l_orderkey AS VARCHAR), 24, '0'),
         CASE WHEN l_returnflag = 'R' THEN 'DELETE' ELSE 'UPDATE' END,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey),
         l_linestatus, l_extendedprice
  FROM lineitem)
"""


def _replay(feed: str, columns: str, by: str = "key", where: str = "TRUE") -> str:
    """Current rows: after the last delete, from the first insert on, the last image."""
    on = " AND ".join(f'c.{b} = f.{b}' for b in by.split(", "))
    return f"""
cut AS (
  SELECT {by}, max(CASE WHEN op = 'DELETE' THEN seq END) AS deleted
  FROM {feed} WHERE {where} GROUP BY {by}),
kept AS (
  SELECT f.* FROM {feed} f JOIN cut c ON {on}
  WHERE ({where}) AND op <> 'DELETE' AND (c.deleted IS NULL OR f.seq > c.deleted)),
born AS (
  SELECT {by}, min(seq) AS first_insert FROM kept WHERE op = 'INSERT' GROUP BY {by}),
ranked AS (
  SELECT f.*, row_number() OVER (
           PARTITION BY {", ".join("f." + b for b in by.split(", "))} ORDER BY f.seq DESC) AS rn
  FROM kept f JOIN born c ON {on} WHERE f.seq >= c.first_insert),
state AS (SELECT {by}, {columns}, seq AS last_seq FROM ranked WHERE rn = 1)
"""


STATE_A = f"WITH {FEED_A}, {_replay('feed_a', 'event_type, value, k')}"
STATE_D = f"WITH {FEED_D}, {_replay('feed_d', 'status, price')}"

_FIRST_HALF = "seq <= (SELECT (min(seq) + max(seq)) // 2 FROM feed_a)"
ORACLE["resume_from"] = f"""
WITH {FEED_A}
SELECT key, op, ((seq // 1000) << 32) + 4 + seq % 1000 AS seq, value
FROM feed_a WHERE seq > (SELECT (min(seq) + max(seq)) // 2 FROM feed_a)"""

ORACLE["snapshot_scan"] = f"{STATE_A} SELECT * FROM state"
ORACLE["full_refresh"] = f"{STATE_A} SELECT * FROM state"
ORACLE["state_to_json"] = f"{STATE_A} SELECT key, event_type, value, k FROM state"
ORACLE["key_lookup"] = f"{STATE_A} SELECT * FROM state WHERE key = '000000000000000000000001'"
ORACLE["route_typed"] = f"""{STATE_A}
SELECT CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN 'users' ELSE 'guests' END AS "table",
       count(*) AS n_rows, CAST(sum(last_seq) AS BIGINT) AS event_ids, count(value) AS n_values
FROM state GROUP BY ALL"""
ORACLE["route_stream"] = ORACLE["route_typed"]
ORACLE["apply_changes"] = f"{STATE_A} SELECT * FROM state"
ORACLE["apply_changes_on_state"] = f"{STATE_A} SELECT * FROM state"
ORACLE["tap"] = f"{STATE_A} SELECT * FROM state"
ORACLE["maintain_store"] = f"{STATE_A} SELECT * FROM state"
ORACLE["store_lookup"] = ORACLE["key_lookup"]
_FIVE_EIGHTHS = "seq <= (SELECT min(seq) + (max(seq) - min(seq)) * 5 // 8 FROM feed_a)"
ORACLE["state_from_snapshots"] = (
    f"WITH {FEED_A}, {_replay('feed_a', 'event_type, value, k', where=_FIVE_EIGHTHS)}"
    " SELECT * FROM state")
ORACLE["range_lookup"] = ORACLE["key_lookup"]
ORACLE["range_scan"] = f"""{STATE_A}
SELECT * FROM state WHERE CAST(key AS BIGINT) BETWEEN 10 AND 500"""
ORACLE["state_as_of"] = (
    f"WITH {FEED_A}, {_replay('feed_a', 'event_type, value, k', where=_FIRST_HALF)}"
    " SELECT * FROM state")
for _name in ("apply_changes_orders", "apply_changes_join_back", "apply_changes_text_key",
              "merge_changes"):
    ORACLE[_name] = f"{STATE_D} SELECT key, status, price, last_seq FROM state"

ORACLE["route_changes"] = f"""
WITH {FEED_A}, {FEED_D},
feed_c AS (SELECT "database", "table", key, op FROM feed_a
           UNION ALL SELECT "database", "table", key, op FROM feed_d)
SELECT "database", "table", op, count(*) AS n_changes, count(DISTINCT key) AS n_keys
FROM feed_c GROUP BY ALL"""

ORACLE["apply_multi_table"] = f"""
WITH {FEED_A}, {FEED_D},
feed_c AS (
  SELECT "database", "table", key, op, seq, event_type, value, k,
         NULL AS status, CAST(NULL AS DOUBLE) AS price FROM feed_a
  UNION ALL
  SELECT "database", "table", key, op, seq, NULL, NULL, NULL, status, price FROM feed_d),
{_replay('feed_c', 'event_type, value, k, status, price', by='"database", "table", key')}
SELECT "database", "table", key, event_type, value, k, status, price, last_seq FROM state"""

ORACLE["change_metrics"] = f"""
WITH {FEED_A}, {FEED_D},
feed_c AS (SELECT "database", "table", key, op, seq FROM feed_a
           UNION ALL SELECT "database", "table", key, op, seq FROM feed_d),
seen AS (
  SELECT *, coalesce(last_value(CASE WHEN op <> 'UPDATE' THEN op END IGNORE NULLS) OVER (
             PARTITION BY "database", "table", key ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'DELETE') = 'INSERT' AS live
  FROM feed_c)
SELECT "database", "table", op, count(*) AS n_changes,
       count(*) FILTER (WHERE op = 'INSERT' AND live) AS duplicate_inserts,
       count(*) FILTER (WHERE op <> 'INSERT' AND NOT live) AS missing_key_changes
FROM seen GROUP BY ALL"""

ORACLE["stream_metrics"] = ORACLE["change_metrics"]

ORACLE["key_sketches"] = f"""
WITH {FEED_A}
SELECT "database", "table", op, count(*) AS n_changes, count(DISTINCT key) AS distinct_keys,
       true AS estimate_within_a_tenth
FROM feed_a GROUP BY ALL"""

CODE = """CASE event_type WHEN 'signup' THEN 23 WHEN 'error' THEN 25 WHEN 'purchase' THEN 2
     ELSE 24 END"""

ORACLE["supported_events"] = f"""
SELECT event_id, user_id, {CODE} AS type_code, value FROM events
WHERE {CODE} IN (4, 15, 19, 23, 24, 25)"""

ORACLE["classify_op"] = """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE'
                      WHEN 'purchase' THEN NULL ELSE 'UPDATE' END AS op FROM events"""

ORACLE["carry_position"] = """
WITH e AS (SELECT user_id, event_id,
                  CASE WHEN event_type = 'view' THEN 0 ELSE event_id + 4 END AS log_pos
           FROM events)
SELECT user_id, event_id, log_pos,
       last_value(nullif(log_pos, 0) IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY event_id) AS position
FROM e"""

ORACLE["assign_segment"] = """
SELECT user_id, event_id, event_type,
       'mysql-bin.' || lpad(CAST(coalesce(turn, 0) AS VARCHAR), 12, '0') AS segment,
       CASE WHEN turn % 2 = 0 THEN turn ELSE 4 END AS segment_start
FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (
               PARTITION BY user_id ORDER BY event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn FROM events)"""

ORACLE["event_profile"] = """
SELECT event_type, count(*) AS n_events, CAST(sum(length(props)) AS BIGINT) AS total_bytes,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM events GROUP BY event_type"""

PAIRED = """
feed_b AS (SELECT user_id AS table_id, event_id AS seq, event_type = 'signup' AS is_schema, value
           FROM events),
paired AS (
  SELECT *, max(CASE WHEN is_schema THEN seq END) OVER (
           PARTITION BY table_id ORDER BY seq) AS schema_seq FROM feed_b)
"""

ORACLE["schema_asof"] = f"""
WITH {PAIRED}
SELECT r.table_id, r.seq, r.value, r.schema_seq, s.value AS schema_value
FROM paired r LEFT JOIN feed_b s ON s.seq = r.schema_seq WHERE NOT r.is_schema"""

ORACLE["unmatched_rows"] = f"""
WITH {PAIRED}
SELECT table_id, seq, value, 'no_schema' AS reason FROM paired
WHERE NOT is_schema AND schema_seq IS NULL"""

ORACLE["null_mask"] = """
SELECT event_id, event_id & 1 = 1 AS null_0, event_id & 2 = 2 AS null_1,
       event_id & 4 = 4 AS null_2,
       CASE WHEN event_id & 1 = 0 THEN user_id END AS user_id,
       CASE WHEN event_id & 2 = 0 THEN event_type END AS event_type,
       CASE WHEN event_id & 4 = 0 THEN value END AS value
FROM events"""

ORACLE["cast_columns"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS id,
       CASE WHEN event_id * 7 - 20000 BETWEEN -32768 AND 32767
            THEN CAST(event_id * 7 - 20000 AS INTEGER) END AS s,
       value AS d, event_type, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k
FROM events"""

ORACLE["int24_sign"] = """
SELECT event_id, CAST(CASE WHEN raw >= 8388608 THEN raw - 16777216 ELSE raw END AS INTEGER)
       AS signed_value
FROM (SELECT event_id, event_id * 7919 % 16777216 AS raw FROM events)"""

ORACLE["char_pad"] = "SELECT c_custkey, rpad(c_mktsegment, 16, ' ') AS segment FROM customer"
ORACLE["format_key"] = """
SELECT event_id, lpad(CAST(event_id AS VARCHAR), 24, '0') AS key FROM events"""

KEYED = """
keyed AS (
  SELECT event_id, user_id, CASE
           WHEN event_type = 'click' THEN 'primary_key_count'
           WHEN event_type = 'view' THEN 'primary_key_name'
           WHEN event_type = 'error' AND k < 30 THEN 'null_key'
           WHEN k >= 90 OR k < 10 THEN 'key_type' END AS reason
  FROM (SELECT *, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k FROM events))
"""
for _name in ("validate_key", "validate_key_split"):
    ORACLE[_name] = f"""
WITH {KEYED}
SELECT event_id, CASE WHEN reason IS NULL THEN lpad(CAST(user_id AS VARCHAR), 24, '0') END AS key,
       reason
FROM keyed"""

ORACLE["reject_types"] = """
SELECT user_id AS table_id, event_id AS ordinal, event_type AS name,
       CAST(event_id % 256 AS INTEGER) AS type_code
FROM events WHERE event_id % 256 NOT IN (1, 2, 3, 4, 5, 8, 9, 15, 244, 254)"""

ORACLE["build_document"] = """
SELECT event_id, user_id, event_type, CASE WHEN k < 50 THEN value END AS value, k,
       CAST(NULL AS INTEGER) AS absent
FROM (SELECT *, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k FROM events)"""

ORACLE["apply_inserts"] = f"""
WITH {FEED_D}
SELECT key, status, price, seq AS last_seq FROM feed_d
QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""

ORACLE["apply_deletes"] = """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 24, '0') AS key, o_orderstatus AS status,
       o_totalprice AS price, CAST(0 AS BIGINT) AS last_seq
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""

ORACLE["apply_updates"] = f"""
WITH {FEED_D}
SELECT key, status, price, seq AS last_seq FROM feed_d WHERE op <> 'DELETE'
QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""

ORACLE["live_row_timeline"] = f"""
WITH {FEED_A},
alive AS (
  SELECT *, CASE WHEN last_value(CASE WHEN op <> 'UPDATE' THEN op END IGNORE NULLS) OVER (
                   PARTITION BY key ORDER BY seq) = 'INSERT' THEN 1 ELSE 0 END AS live
  FROM feed_a),
step AS (
  SELECT *, live - coalesce(lag(live) OVER (PARTITION BY key ORDER BY seq), 0) AS delta
  FROM alive)
SELECT key, seq, op, CAST(sum(delta) OVER (ORDER BY seq) AS BIGINT) AS live_rows FROM step"""


# The log the events are packed to: files of 4096 ids, rows events of consecutive changes with
# the same table and kind, table maps at every 16th rows event of a file.
PACKED = """
packed AS (
  SELECT *, CAST(event_id // 4096 + 1 AS INTEGER) AS file_seq,
         CASE WHEN user_id % 2 = 0 THEN 'users' ELSE 'guests' END AS tab,
         CASE event_type WHEN 'signup' THEN 23 WHEN 'error' THEN 25 ELSE 24 END AS code,
         CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec,
         CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS k0
  FROM events),
marked AS (
  SELECT *, CASE WHEN lag(tab) OVER w = tab AND lag(code) OVER w = code THEN 0 ELSE 1 END AS starts
  FROM packed WINDOW w AS (PARTITION BY file_seq ORDER BY event_id)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY file_seq ORDER BY event_id) - 1 AS run FROM marked),
runs AS (
  SELECT file_seq, run, code, min(sec) AS sec FROM numbered GROUP BY file_seq, run, code),
log AS (
  SELECT file_seq, code, sec FROM runs
  UNION ALL SELECT file_seq, unnest([2, 19, 19]), sec FROM runs WHERE run % 16 = 0
  UNION ALL SELECT DISTINCT file_seq, unnest([15, 4]), 0 FROM runs)
"""

for _name in ("binlog_scan", "binlog_scan_binary_files", "binlog_stream",
              "binlog_stream_growing", "binlog_scan_indexed", "binlog_stream_bounded"):
    ORACLE[_name] = f"""
WITH {PACKED}
SELECT file_seq, code AS type_code, count(*) AS n_events, count(*) AS n_offsets
FROM log GROUP BY ALL"""

ORACLE["event_headers"] = f"""
WITH {PACKED}
SELECT file_seq, code AS type_code, CAST(1 AS BIGINT) AS server_id, 0 AS flags, sec AS event_s,
       TRUE AS position_agrees FROM log"""

ORACLE["rotate_events"] = f"""
WITH {PACKED}
SELECT DISTINCT file_seq, 'mysql-bin.' || lpad(CAST(file_seq + 1 AS VARCHAR), 6, '0') AS next_file,
       CAST(4 AS BIGINT) AS next_pos FROM runs"""

ORACLE["format_events"] = f"""
WITH {PACKED}
SELECT DISTINCT file_seq, 4 AS log_version, 19 AS header_length, 0 AS checksum,
       8 AS table_map_length FROM runs"""

ORACLE["assign_segment_log"] = f"""
WITH {PACKED}
SELECT 'mysql-bin.' || lpad(CAST(file_seq AS VARCHAR), 6, '0') AS segment,
       CAST(4 AS BIGINT) AS segment_start, code = 4 AS is_rotate, count(*) AS n_events
FROM log GROUP BY ALL"""

ORACLE["table_maps"] = f"""
WITH {PACKED},
versions("table", table_id, names, types) AS (VALUES
  ('users', CAST(64 AS BIGINT), '_id,event_id,event_type,value,k,props,label,medium,counter',
   '8,8,15,5,2,15,254,9,3'),
  ('guests', CAST(65 AS BIGINT), '_id,event_id,value,event_type', '8,8,5,15'))
SELECT file_seq, table_id, 'e_store' AS "database", "table", names, types, '0' AS pk,
       CAST(NULL AS VARCHAR) AS error
FROM runs, versions WHERE run % 16 = 0"""

ORACLE["column_catalog"] = f"""
WITH {PACKED},
logged("table", ordinal, name, type_code, meta, "unsigned", is_pk) AS (VALUES
  ('users', 0, '_id', 8, 0, TRUE, TRUE), ('users', 1, 'event_id', 8, 0, FALSE, FALSE),
  ('users', 2, 'event_type', 15, 80, FALSE, FALSE), ('users', 3, 'value', 5, 8, FALSE, FALSE),
  ('users', 4, 'k', 2, 0, FALSE, FALSE), ('users', 5, 'props', 15, 1200, FALSE, FALSE),
  ('users', 6, 'label', 254, 64 * 256 + 254, FALSE, FALSE),
  ('users', 7, 'medium', 9, 0, FALSE, FALSE), ('users', 8, 'counter', 3, 0, TRUE, FALSE),
  ('guests', 0, '_id', 8, 0, TRUE, TRUE), ('guests', 1, 'event_id', 8, 0, FALSE, FALSE),
  ('guests', 2, 'value', 5, 8, FALSE, FALSE), ('guests', 3, 'event_type', 15, 80, FALSE, FALSE))
SELECT 'e_store' AS "database", logged.*, FALSE AS nullable,
       (SELECT count(*) FROM runs WHERE run % 16 = 0) AS n_versions
FROM logged"""

for _name in ("decode_rows", "decode_rows_resolved", "resolve_stream"):
    ORACLE[_name] = f"""
WITH {PACKED}
SELECT tab AS "table", code AS type_code, CAST(file_seq AS BIGINT) AS file_seq,
       CAST(NULL AS VARCHAR) AS reason, CAST(user_id AS VARCHAR) AS _id, event_id, event_type,
       value, CASE WHEN tab = 'users' AND k0 % 7 <> 0 THEN k0 END AS k,
       CASE WHEN tab = 'users' THEN props END AS props,
       CASE WHEN tab = 'users' THEN rpad(event_type, 16, ' ') END AS label,
       CASE WHEN tab = 'users'
            THEN CAST(event_id * 7919 % 16777216 - 8388608 AS INTEGER) END AS medium,
       CASE WHEN tab = 'users' THEN 4294967295 - event_id END AS counter
FROM packed"""

ORACLE["pair_images"] = f"""
WITH {PACKED}
SELECT event_id AS before_event_id, event_id AS after_event_id,
       CAST(user_id AS VARCHAR) AS before_id, CAST(user_id AS VARCHAR) AS after_id,
       CAST(NULL AS DOUBLE) AS before_value, value AS after_value
FROM packed WHERE code = 24"""

ORACLE["build_changes"] = f"""
WITH {PACKED}
SELECT 'e_store' AS "database", tab AS "table",
       CASE code WHEN 23 THEN 'INSERT' WHEN 24 THEN 'UPDATE' ELSE 'DELETE' END AS op,
       lpad(CAST(user_id AS VARCHAR), 24, '0') AS key, CAST(NULL AS VARCHAR) AS reason,
       CAST(file_seq AS BIGINT) AS file_seq, event_id, event_type, value,
       CASE WHEN tab = 'users' THEN rpad(event_type, 16, ' ') END AS label
FROM packed"""

ORACLE["resume_log"] = f"""
WITH {PACKED} SELECT tab AS "table", code AS type_code, event_id FROM packed WHERE event_id > 0"""

ORACLE["log_profile"] = f"""
WITH {PACKED}
SELECT code AS type_code, count(*) AS n_events, min(sec) AS first_s, max(sec) AS last_s
FROM log GROUP BY code"""

for _name in ("replay_log", "replay_log_stream"):
    ORACLE[_name] = f"""{STATE_A}
SELECT 'e_store' AS "database",
       CASE WHEN CAST(key AS BIGINT) % 2 = 0 THEN 'users' ELSE 'guests' END AS "table",
       key, last_seq AS event_id, event_type, value
FROM state"""

ORACLE["apply_stream"] = f"{STATE_A} SELECT * FROM state"

# Every type a column may get, the narrowest first, and the widest whole number (bits with sign) and
# fraction (bits) it holds; the first one that holds all logged types is the folded one.
ORACLE["schema_history"] = """
WITH types(code, "unsigned", small, own, whole, part) AS (VALUES
  (244, FALSE, NULL, 'boolean', 1, 0), (244, TRUE, NULL, 'boolean', 1, 0),
  (1, FALSE, NULL, 'tinyint', 8, 0), (1, TRUE, NULL, 'smallint', 9, 0),
  (2, FALSE, NULL, 'smallint', 16, 0), (2, TRUE, NULL, 'int', 17, 0),
  (9, FALSE, NULL, 'int', 24, 0), (9, TRUE, NULL, 'int', 25, 0),
  (3, FALSE, NULL, 'int', 32, 0), (3, TRUE, NULL, 'bigint', 33, 0),
  (8, FALSE, NULL, 'bigint', 64, 0), (8, TRUE, NULL, 'decimal(20,0)', 65, 0),
  (4, NULL, TRUE, 'float', 0, 24), (4, NULL, FALSE, 'double', 0, 53),
  (5, NULL, TRUE, 'float', 0, 24), (5, NULL, FALSE, 'double', 0, 53),
  (15, NULL, NULL, 'string', 1000, 1000)),
targets(rank, target, whole, part) AS (VALUES
  (1, 'boolean', 1, 0), (2, 'tinyint', 8, 0), (3, 'smallint', 16, 0), (4, 'int', 32, 0),
  (5, 'bigint', 64, 0), (6, 'decimal(20,0)', 65, 0), (7, 'float', 17, 24), (8, 'double', 54, 53),
  (9, 'string', 1000, 1000)),
logged AS (
  SELECT event_type AS "table", event_id, user_id, o.ordinal,
         (user_id + o.ordinal) % 6 AS number,
         [244, 1, 2, 9, 3, 8, 4, 5, 15][
           (user_id + o.ordinal) % 6 + user_id % (1 + length(event_type) % 3) + 1] AS code,
         user_id % 4 <> 0 AS small, user_id % 2 = length(event_type) % 2 AS "unsigned"
  FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS ordinal) o),
typed AS (
  SELECT l.*, t.own, t.whole, t.part
  FROM logged l JOIN types t ON l.code = t.code
   AND (t."unsigned" IS NULL OR t."unsigned" = l."unsigned")
   AND (t.small IS NULL OR t.small = l.small)),
ends AS (SELECT event_type AS "table", min(event_id) AS a, max(event_id) AS z, count(*) AS n
         FROM events GROUP BY 1),
each AS (
  SELECT "table", number, arg_max(ordinal, event_id) AS ordinal, min(event_id) AS first_seq,
         max(event_id) AS last_seq, count(*) AS n_maps,
         string_agg(DISTINCT own, ' ' ORDER BY own) AS types,
         bool_or(own = 'string') AND bool_or(own <> 'string')
           OR bool_or(own IN ('float', 'double')) AND bool_or(whole > 54 AND part = 0) AS mixed
  FROM typed GROUP BY 1, 2),
least AS (
  SELECT "table", number, min(rank) AS rank FROM (
    SELECT l."table", l.number, g.rank
    FROM (SELECT DISTINCT "table", number, whole, part FROM typed) l CROSS JOIN targets g
    GROUP BY ALL HAVING bool_and(g.whole >= l.whole AND g.part >= l.part)) GROUP BY 1, 2)
SELECT 'e_store' AS "database", "table", 'c' || number AS name, ordinal, target AS data_type,
       types, first_seq, last_seq, n_maps, n AS of_maps, first_seq > a AS added,
       last_seq < z AS dropped, CASE WHEN mixed THEN 'mixed_kinds' END AS reason
FROM each JOIN least USING ("table", number) JOIN targets USING (rank) JOIN ends USING ("table")"""
