"""Cheapest repair of the structure of conversations, over one automaton of all their signatures.

A row's symbol joins its role's initial and its fault: ``s``, ``u``, ``a`` and ``o`` (another
role), in upper case if its text is truncated, and ``x`` for a row that has to go (blank, or role
and text of an earlier row). A conversation's symbols are its signature. Signatures become an
automaton from their ends: a node is a symbol and the node after it, so equal endings of any
conversations are one node. For each node and each state of the grammar ``(s?(ua)+)?`` the cost to
go and the least audit that reaches it are found once, and conversations look theirs up.

Long conversations: rows are sorted by (conv_id, turn, role, digest of the text) over ranges, so
that one conversation may lie in many tasks, and cut into signatures of up to ``CHUNK`` rows. A
node's costs are kept for every state that may follow its chunk; chunks of a conversation are then
joined from the last one back. Audits of one chunk that lead to the same cost differ in some
letter, so comparing them within the chunk decides the least audit of the whole.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty row of either 5; a
truncated row that stays costs 5 more. Ties go to the least audit (D < I < K < R).

Defined cases: null role and text stand as one space; rows of one turn go by role, then by digest
of the text; null turns come first and count for no gap; rows without conv_id are one conversation;
a row whose role is empty has no initial and cannot be kept as it is; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import new_path

#: Rows of a signature, and parts over which the chunks of one signature are spread.
CHUNK, SALTS = 64, 16
_SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: nothing yet, after s, after u, after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_STEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
         (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_INSERT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
#: What it costs to end in a state, and the audit of that.
_END = {_START: (0, ""), _SYSTEM: (10, "II"), _USER: (5, "I"), _ASSISTANT: (0, "")}


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` as a crc32 of ``conv_id:turn`` modulo 20 damages
    them: 0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role
    user. Nulls of any column stand as one space there."""
    def spaced(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        spaced("role").alias("role"), spaced("text").alias("text"),
        (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20)
        .alias("h")).filter("h <> 0")
    rows = rows.withColumn("text", F.when(F.col("h") == 1, "").when(
        F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn(
        "role", F.when(F.col("h") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(
        F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))).drop("copy", "h")


def _options(symbol: str, state: int, after: list[dict]) -> Iterator[tuple[int, str, dict]]:
    """(cost, action, what follows) of what can be done with a row in a state."""
    yield 2, "D", after[state]
    if symbol == "x":
        return
    more = 5 if symbol.isupper() else 0
    kept = _STEP.get((state, symbol.lower()))
    if kept is not None:
        yield more, "K", after[kept]
    yield more + 1, "R", after[_INSERT[state]]


def node_costs(symbol: str, after: list[dict]) -> list[dict]:
    """For each state before a row the least (cost, audit) up to each state after its chunk, from
    those of the node after it. Rows may be inserted before the row."""
    act: list[dict] = []
    for state in _STATES:
        best: dict[int, tuple[int, str]] = {}
        for cost, action, rest in _options(symbol, state, after):
            for end, (more, audit) in rest.items():
                found = (cost + more, action + audit)
                if end not in best or found < best[end]:
                    best[end] = found
        act.append(best)
    out = []
    for state in _STATES:
        best, at = dict(act[state]), state
        for inserted in (1, 2):  # a third one only comes back to the first one's state
            at = _INSERT[at]
            for end, (more, audit) in act[at].items():
                found = (5 * inserted + more, "I" * inserted + audit)
                if end not in best or found < best[end]:
                    best[end] = found
        out.append(best)
    return out


_LEAF = [{state: (0, "")} for state in _STATES]
_COSTS = "array<struct<state int, end int, cost bigint, audit string>>"


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of signatures that come sorted by their reverse: nodes of the last signature's ending
    that the next one shares are not made again."""
    nodes, last = [_LEAF], ""
    for batch in batches:
        rows = []
        for tail in batch.column("tail").to_pylist():
            same = 0
            while same < min(len(tail), len(last)) and tail[same] == last[same]:
                same += 1
            del nodes[same + 1:]
            for symbol in tail[same:]:
                nodes.append(node_costs(symbol, nodes[-1]))
            last = tail
            rows.append([{"state": state, "end": end, "cost": cost, "audit": audit}
                         for state, ends in enumerate(nodes[-1])
                         for end, (cost, audit) in sorted(ends.items())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tail"), batch.column("salts"), pa.array(rows, pa.list_(pa.struct([
                ("state", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                ("audit", pa.string())])))], ["tail", "salts", "costs"])


_CHUNKS = ("conv_id bigint, part int, chunk int, signature string, keys array<binary>, "
           "first_turn bigint, low_turn bigint, last_turn bigint, first_role string, "
           "last_role string, turns bigint, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint")
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _pair_is_illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of up to ``CHUNK`` rows of sorted rows; ``n`` equal rows are one and n - 1 that
    have to go."""
    part = TaskContext.get().partitionId()
    done: list[dict] = []
    now: dict | None = None
    number = 0

    def batch() -> pa.RecordBatch:
        names = _FIELDS.names
        out = pa.RecordBatch.from_arrays(
            [pa.array([d[c] for d in done], _FIELDS.field(c).type) for c in names], names)
        done.clear()
        return out

    for rows in batches:
        for r in rows.to_pylist():
            for copy in range(r["n"]):
                if now is not None and (len(now["keys"]) >= CHUNK or now["conv_id"] != r["conv_id"]):
                    done.append(now)
                    now = None
                    if len(done) >= 512:
                        yield batch()
                if now is None:
                    now = {"conv_id": r["conv_id"], "part": part, "chunk": number, "signature": "",
                           "keys": [], "first_turn": r["turn"], "low_turn": None,
                           "first_role": r["role"], "last_turn": None, "last_role": None,
                           **dict.fromkeys(_COUNTS, 0)}
                    number += 1
                elif _pair_is_illegal(now["last_role"], r["role"]):
                    now["illegal"] += 1
                if r["turn"] is not None and r["turn"] != now["last_turn"]:
                    now["turns"] += 1
                    now["low_turn"] = r["turn"] if now["low_turn"] is None else now["low_turn"]
                again = not r["blank"] and (copy > 0 or not r["first"])
                now["blank"] += r["blank"]
                now["duplicate"] += again
                initial = r["role"][:1]
                symbol = initial if initial and initial in "sua" else "o"
                if r["blank"] or again:
                    symbol = "x"
                elif r["truncated"]:
                    now["truncated"] += 1
                    symbol = symbol.upper()
                now["signature"] += symbol
                now["keys"].append(r["key"])
                now["last_turn"], now["last_role"] = r["turn"], r["role"]
    if now is not None:
        done.append(now)
    if done:
        yield batch()


_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("signature", pa.string()),
    ("keys", pa.list_(pa.binary())), ("first_turn", pa.int64()), ("low_turn", pa.int64()),
    ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64())])


def _walk(signature: str, audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """(action, new role or "") of every letter of a chunk's audit, and the state it ends in."""
    out, at = [], 0
    for action in audit:
        if action == "I":
            state = _INSERT[state]
            out.append(("I", _ROLE[state]))
            continue
        symbol = signature[at]
        at += 1
        if action == "K":
            state = _STEP[state, symbol.lower()]
        elif action == "R":
            state = _INSERT[state]
        out.append((action, _ROLE[state] if action == "R" else ""))
    return out, state


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk of conversations whose chunks come last first: where its audit
    starts in the conversation's, its edits and, on the first chunk, the conversation's figures."""
    held: list[tuple[dict, dict]] = []   # chunks last first; per state (cost, audit, end)
    best: dict[int, int] = {}            # cost to go from each state at the chunk's start

    def settle() -> pa.RecordBatch:
        first, total = held[-1][0], best[_START]
        counts = {c: sum(chunk[c] for chunk, _ in held) for c in _COUNTS}
        for (later, _), (earlier, _) in zip(held, held[1:]):
            counts["illegal"] += _pair_is_illegal(earlier["last_role"], later["first_role"])
            same = later["first_turn"] is not None and later["first_turn"] == earlier["last_turn"]
            counts["turns"] -= same
        low = [c["low_turn"] for c, _ in held if c["low_turn"] is not None]
        high = held[0][0]["last_turn"]
        gaps = high - min(low) + 1 - counts.pop("turns") if low else 0
        state, at, rows = _START, 0, []
        for n, (chunk, choice) in enumerate(reversed(held)):
            _, audit, end = choice[state]
            if n == len(held) - 1:
                audit += _END[end][1]
            edits, _ = _walk(chunk["signature"], audit, state)
            keys = iter(chunk["keys"])
            rows.append({
                "conv_id": chunk["conv_id"], "audit_at": at, "audit": audit,
                "edits": [{"action": a, "role": r, "key": None if a == "I" else next(keys)}
                          for a, r in edits],
                "figures": {"gaps": gaps, "cost": total, **counts} if n == 0 else None})
            at += len(audit)
            state = end
        held.clear()
        return pa.RecordBatch.from_pylist(rows, _EDITS)

    for batch in batches:
        for chunk in batch.to_pylist():
            costs = chunk.pop("costs")
            if held and held[-1][0]["conv_id"] != chunk["conv_id"]:
                yield settle()
            if not held:
                best = {state: _END[state][0] for state in _STATES}
            choice: dict[int, tuple[int, str, int]] = {}
            for c in costs:
                # At the very end the audit goes on with that of the end.
                audit = c["audit"] if held else c["audit"] + _END[c["end"]][1]
                found = (c["cost"] + best[c["end"]], audit, c["end"])
                if c["state"] not in choice or found < choice[c["state"]]:
                    choice[c["state"]] = found
            if not held:
                choice = {s: (cost, audit[:len(audit) - len(_END[end][1])], end)
                          for s, (cost, audit, end) in choice.items()}
            best = {state: choice[state][0] for state in choice}
            held.append((chunk, choice))
    if held:
        yield settle()


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("audit_at", pa.int64()), ("audit", pa.string()),
    ("edits", pa.list_(pa.struct([("action", pa.string()), ("role", pa.string()),
                                  ("key", pa.binary())]))),
    ("figures", pa.struct([(c, pa.int64()) for c in _FIGURES]))])
_EDITS_DDL = ("conv_id bigint, audit_at bigint, audit string, "
              "edits array<struct<action string, role string, key binary>>, "
              f"figures struct<{', '.join(f'{c}: bigint' for c in _FIGURES)}>")


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows with their number ``n``, and whether they are the first with their role and
    text. All by aggregates, so that equal rows meet as counts only."""
    said = F.rtrim("text", F.lit(_SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).substr(1, 32).alias("digest"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("truncated"))
    runs = narrow.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count("*").alias("n"), F.bool_or("blank").alias("blank"),
        F.bool_or("truncated").alias("truncated"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(
        F.col("turn").isNotNull().alias("some"), "turn")).alias("at")).select(
        "conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(0).cast("bigint").alias("n"),
        F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("truncated"),
        F.lit(True).alias("first"))
    return runs.withColumn("first", F.lit(False)).unionByName(firsts).groupBy(
        "conv_id", "turn", "role", "digest").agg(
        F.sum("n").alias("n"), F.bool_or("blank").alias("blank"),
        F.bool_or("truncated").alias("truncated"), F.bool_or("first").alias("first"))


def _row_key(conv_id, turn, role, digest):
    """16 bytes that stand for one different row."""
    none = F.lit("-")
    return F.unhex(F.md5(F.concat_ws(
        ":", F.coalesce(conv_id.cast("string"), none), F.coalesce(turn.cast("string"), none), digest,
        role).cast("binary")))


def plan_repair(rows: DataFrame) -> DataFrame:
    """Edits of every conversation, one row for each chunk of up to ``CHUNK`` of its rows:
    ``conv_id``, ``audit_at`` (letters of its audit before), ``audit``, ``edits`` (action, new role,
    key of the row) and ``figures`` (on its first chunk). Written, so that what reads it is cheap."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = _marked(rows)
    key = _row_key(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest"))
    order = ("conv_id", "turn", "role", "digest")  # nulls first
    path = new_path(spark, "chunks")
    marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", key.alias("key"), "n", "blank", "truncated", "first").mapInArrow(
        _chunks, _CHUNKS).write.parquet(path)
    chunks = spark.read.parquet(path).withColumn(
        "salt", F.pmod(F.xxhash64("conv_id", "part", "chunk"), F.lit(SALTS)).cast("int"))
    tails = chunks.select(F.reverse("signature").alias("tail"), "salt").groupBy("tail").agg(
        F.collect_set("salt").alias("salts"))  # at most SALTS of them
    path = new_path(spark, "nodes")
    tails.repartitionByRange(parts, "tail").sortWithinPartitions("tail").mapInArrow(
        _automaton, f"tail string, salts array<int>, costs {_COSTS}").write.parquet(path)
    nodes = spark.read.parquet(path).select(
        F.reverse("tail").alias("signature"), F.explode("salts").alias("salt"), "costs")
    known = chunks.join(nodes, ["signature", "salt"]).select(
        "conv_id", "part", "chunk", "signature", "keys", "first_turn", "low_turn", "last_turn",
        "first_role", "last_role", *_COUNTS, "costs")
    path = new_path(spark, "edits")
    known.repartition(parts, "conv_id").sortWithinPartitions(
        F.col("conv_id"), F.desc("part"), F.desc("chunk")).mapInArrow(
        _join_chunks, _EDITS_DDL).write.parquet(path)
    return spark.read.parquet(path)


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows that stay or are inserted: ``conv_id``, ``position`` (place in the audit),
    ``action``, ``role``, ``text``."""
    edits = plan.select("conv_id", "audit_at", F.posexplode("edits").alias("at", "edit")).filter(
        "edit.action <> 'D'").select(
        "conv_id", (F.col("audit_at") + F.col("at")).alias("position"),
        F.col("edit.action").alias("action"), F.col("edit.role").alias("new_role"),
        F.col("edit.key").alias("key"))
    inserted = edits.filter("action = 'I'").select(
        "conv_id", "position", "action", F.col("new_role").alias("role"), F.lit("").alias("text"))
    # Equal rows meet as one row before they are sent on.
    texts = rows.select(
        _row_key(F.col("conv_id"), F.col("turn"), F.col("role"),
                 F.sha2("text", 256).substr(1, 32)).alias("key"), "role", "text").groupBy(
        "key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    stay = edits.filter("action <> 'I'").join(texts, "key").select(
        "conv_id", "position", "action",
        F.when(F.col("action") == "R", F.col("new_role")).otherwise(F.col("role")).alias("role"),
        "text")
    return stay.unionByName(inserted)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the lines of conversations that come in order, one line at a time."""
    now, state, ids, found = None, None, [], []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist()
                                         for c in ("conv_id", "role", "text"))):
            if state is None or conv_id != now:
                if state is not None:
                    ids.append(now)
                    found.append(state.hexdigest())
                now, state = conv_id, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(ids) > 10_000:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()),
                                              "sha": pa.array(found, pa.string())})
            ids, found = [], []
    if state is not None:
        ids.append(now)
        found.append(state.hexdigest())
    yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()),
                                      "sha": pa.array(found, pa.string())})


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For every conv_id of ``conversations`` the figures, audit and hash of the repair of its
    ``rows``. A hash reads its conversation's rows in order, so they pass through one task, a line
    at a time; audits are as long as their conversations."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = plan_repair(rows)
    audits = plan.groupBy("conv_id").agg(
        F.max("figures").alias("figures"),
        F.array_sort(F.collect_list(F.struct("audit_at", "audit"))).alias("audits")).select(
        "conv_id", "figures", F.concat_ws("", F.col("audits.audit")).alias("audit"),
        F.lit(None).cast("string").alias("sha"))
    hashes = repaired_rows(rows, plan).repartition(parts, "conv_id").sortWithinPartitions(
        "conv_id", "position").select("conv_id", "role", "text").mapInArrow(
        _digest, "conv_id bigint, sha string")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    figures = plan.schema["figures"].dataType
    none = F.lit(None)
    every = every.select("conv_id", none.cast(figures).alias("figures"),
                         none.cast("string").alias("audit"), none.cast("string").alias("sha"))
    hashes = hashes.select("conv_id", none.cast(figures).alias("figures"),
                           none.cast("string").alias("audit"), "sha")
    return every.unionByName(audits).unionByName(hashes).groupBy("conv_id").agg(
        F.max("figures").alias("figures"), F.max("audit").alias("audit"),
        F.max("sha").alias("sha")).select(
        "conv_id", *[F.coalesce(f"figures.{c}", F.lit(0)).cast("bigint").alias(c)
                     for c in _FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
