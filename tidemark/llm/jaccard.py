"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes.

Tokens are hashes of word shingles, in one global order: by their estimated document frequency
(a counter array over all texts, summed in the cluster, and corrected by exact counts for tokens
that prefixes share often), then by hash. Of a document with ``n``
tokens, every partner shares at least ``need = ceil(threshold * n)``. For any ``l``, two linked
documents share ``l`` tokens or more of their prefixes of ``n - need + l`` tokens. Each document
chooses the ``l`` of the smallest estimated cost: index entries to read plus candidates to verify,
of which there are at most (entries / l). A pair is a candidate if its prefixes share at least the
smaller ``l`` of the two.

Work is arranged so that no group of copies meets in one task or is listed as pairs:

1. Equal texts collapse to one row.
2. Linked documents share a token of their shortest prefixes (``l`` of one). Where more than
   ``RARE`` of these hold it, it gives a star to its smallest document; the tokens that longer
   prefixes add, which are their most frequent ones, give no stars. All other shared tokens give
   candidate pairs, filtered by size, position and the number of shared tokens, where those that
   are not paired count as shared. Components of both are clusters: linked documents are always in
   one.
3. Clusters are cut into blocks of bounded size; small ones share blocks. Tasks get the prefixes of
   one or two blocks and apply the prefix rule, then the texts of documents with candidates, verify
   these exactly and keep only links that join what was apart. First every block alone and with the first block of its cluster; when the components of
   that are known, the remaining pairs of blocks, without those inside one component.

Defined cases: a null text is empty; a document without words has an empty set, no links and its
own doc_id as component; rows with one doc_id are documents each; a null doc_id is never the
smallest unless alone; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import drop, new_path
from .components import connected_components
from .text import shingle_sets, sized

#: Counters of the frequency estimate (4 bytes each): 16 for each text, within these bounds. More
#: only improve the order.
MIN_COUNTERS, MAX_COUNTERS = 1 << 20, 1 << 24
#: What a token counts as whose counter shows no more than others leave in any: rare ones are shared
#: by chance, too, and of long documents that pairs very many if one such token is enough.
FAINT = 1 / 16
#: Bits that mark documents to be read: 16 for each of them, up to this number (32 MB).
MAX_MARKS = 1 << 28
_CHUNK = 1 << 16
_FAN_IN = 64
#: Bytes of text, and entries of token lists, that a task works on at once.
_SLICE, _ENTRIES = 1 << 20, 1 << 20
#: Up to this many candidates of a document are intersected one by one, more through an index.
_DIRECT = 48
#: Most tokens that prefixes may have to share, and documents of a token that pair directly.
MOST_SHARED, RARE = 6, 16
#: Tokens whose counters are corrected by exact counts, at most.
MAX_RAISED = 1 << 18
#: Documents in a block; one with more than ``LONG`` shingles counts as so many times that.
BLOCK, LONG = 512, 1024


def _count_tokens(width: int, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(size, np.uint32)
        for batch in sized(batches, limit=_SLICE):
            sets = list(shingle_sets(batch.column("text"), width))
            slots, counts = np.unique(np.concatenate(sets) & np.uint64(size - 1),
                                      return_counts=True)
            counters[slots.astype(np.int64)] += counts.astype(np.uint32)
        yield from _filled(counters, TaskContext.get().partitionId())
    return count


def _packed(counters: np.ndarray) -> bytes:
    """Counters in as few bytes each as hold them (one, two or four), compressed, after a byte with
    that number; none if all are zero."""
    top = int(counters.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    data = counters.astype(f"<u{width}").tobytes()
    return bytes([width]) + pa.compress(data, codec="zstd", asbytes=True) if top else b""


def _unpacked(data) -> np.ndarray:
    data = memoryview(data)
    width = data[0]
    plain = pa.decompress(pa.py_buffer(data[1:]), decompressed_size=width * _CHUNK, codec="zstd")
    return np.frombuffer(plain, f"<u{width}").astype(np.uint32)


def _filled(counters: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """The counters by chunk, without chunks of zeros."""
    for at in range(0, len(counters), _CHUNK):
        if counts := _packed(counters[at:at + _CHUNK]):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([at // _CHUNK], pa.int32()), "part": pa.array([part], pa.int32()),
                "counts": [counts]})


def _sum_counts(table: pa.Table) -> pa.Table:
    counters = sum(_unpacked(counts.as_buffer()) for counts in table.column("counts"))
    return pa.table({
        "chunk": table.column("chunk").slice(0, 1),
        "part": pa.array([table.column("part")[0].as_py() // _FAN_IN], pa.int32()),
        "counts": pa.array([_packed(counters)], pa.binary())})


def token_frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """Estimated document frequencies: an array of counters over the tokens of all texts."""
    schema = "chunk int, part int, counts binary"
    wanted = 1 << (16 * max(1, texts.count()) - 1).bit_length()
    size = min(MAX_COUNTERS, max(MIN_COUNTERS, wanted))
    parts = texts.select("text").mapInArrow(_count_tokens(width, size), schema)
    parts = parts.groupBy("chunk", F.expr(f"part div {_FAN_IN}")).applyInArrow(_sum_counts, schema)
    parts = parts.groupBy("chunk").applyInArrow(_sum_counts, schema)
    counters = np.zeros(size, np.uint32)
    for row in parts.select("chunk", "counts").collect():  # 4 bytes a counter at most
        counters[row.chunk * _CHUNK:(row.chunk + 1) * _CHUNK] = _unpacked(row.counts)
    return counters


def raised(counters: np.ndarray, posts: DataFrame) -> np.ndarray:
    """The counters with those of tokens that more than ``RARE`` prefixes hold set above all
    others, in the order of these numbers: for the ``MAX_RAISED`` most frequent ones."""
    often = posts.groupBy("token").agg(F.count("*").alias("held")).filter(f"held > {RARE}")
    found = often.orderBy(F.desc("held"), "token").limit(MAX_RAISED).toArrow()
    token, held = (found.column(c).to_numpy() for c in ("token", "held"))
    out = counters.copy()
    np.maximum.at(out, token & (len(counters) - 1),
                  (int(counters.max(initial=0)) + held).astype(np.uint32))
    return out


def adaptive_prefix(tokens: np.ndarray, counters: np.ndarray, noise: float, num: int,
                    den: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in global order, and how many tokens of it a partner must share."""
    n = len(tokens)
    seen = counters[(tokens & np.uint64(len(counters) - 1)).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    need = -(-num * n // den)
    most = min(MOST_SHARED, need)
    entries = np.cumsum(np.maximum(seen[order[:n - need + most]] - noise, FAINT))[n - need:]
    shared = np.arange(1, most + 1)
    best = int(np.argmin(entries + entries / shared * n))
    return tokens[order[:n - need + best + 1]], best + 1


def _postings(shared, noise: float, width: int, num: int, den: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in sized(batches, limit=_SLICE):
            out, meta = [], []
            for node, tokens in zip(batch.column("node").to_pylist(),
                                    shingle_sets(batch.column("text"), width)):
                if len(tokens):
                    prefix, least = adaptive_prefix(tokens, counters, noise, num, den)
                    out.append(prefix)
                    meta.append((node, len(tokens), least, len(prefix)))
            if not out:
                continue
            node, n, least, size = (np.array(x) for x in zip(*meta))
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int32()),
                "least": pa.array(least, pa.int32()), "tokens": pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(out).view(np.int64)))})
    return emit


def _exploded(prefixes: DataFrame) -> DataFrame:
    return prefixes.select("node", "n", "least", F.posexplode("tokens").alias("pos", "token"))


def _clusters(posts: DataFrame, num: int, den: int) -> DataFrame:
    """``node`` and ``root`` of the clusters of documents that may be linked."""
    spark = posts.sparkSession
    # The shortest prefix has ``least`` - 1 tokens less than the one written.
    posts = posts.withColumn("short", F.expr(f"pos <= n - ({num} * n + {den - 1}) div {den}"))
    often = posts.groupBy("token").agg(
        F.count("*").alias("held"), F.count_if("short").alias("short_held"),
        F.min(F.when(F.col("short"), F.col("node"))).alias("head")).filter("held > 1")
    path = new_path(spark, "shared-tokens")
    posts.join(often, "token").write.parquet(path)
    shared = spark.read.parquet(path)
    stars = shared.filter(f"short and short_held > {RARE} and node <> head").select(
        F.col("node").alias("a"), F.col("head").alias("b"))
    # Tokens of a prefix that are not paired may be shared with anyone.
    loose = shared.filter(f"held > {RARE}").groupBy("node").agg(F.count("*").alias("loose"))
    one = shared.filter(f"held <= {RARE} or (short and short_held <= {RARE})").select(
        "token", "node", "n", "least", "pos", (F.col("held") <= RARE).alias("paired"))
    two = one.select(*[F.col(c).alias(c if c == "token" else f"{c}2") for c in one.columns])
    # The most that two sets can share, given where a common token stands in both.
    most = F.least("pos", "pos2") + 1 + F.least(F.expr("n - pos - 1"), F.expr("n2 - pos2 - 1"))
    pairs = one.join(two, (one["token"] == two["token"]) & (F.col("node") < F.col("node2"))
                     & (F.least("n", "n2") * den >= F.greatest("n", "n2") * num)
                     & (most * (num + den) >= (F.col("n") + F.col("n2")) * num))
    pairs = pairs.groupBy("node", "node2").agg(
        F.count_if("paired").alias("c"), F.least(F.first("least"), F.first("least2")).alias("l"))
    for name in ("node", "node2"):
        pairs = pairs.join(loose.select(F.col("node").alias(name), F.col("loose").alias(
            f"loose_{name}")), name, "left")
    pairs = pairs.filter(F.col("c") + F.coalesce(
        F.least(F.coalesce("loose_node", F.lit(0)), F.coalesce("loose_node2", F.lit(0))), F.lit(0))
        >= F.col("l")).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    roots = connected_components(stars.unionByName(pairs))
    drop(spark, path)
    return roots


def _index(parts: list[np.ndarray]):
    """For each token the places of the parts that hold it."""
    tokens = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    order = np.argsort(tokens, kind="stable")
    values, start = np.unique(tokens[order], return_index=True)
    return values, np.append(start, len(tokens)), owner[order], len(parts)


def _shared(tokens: np.ndarray, lists) -> np.ndarray:
    """How many of some indexed tokens each part holds."""
    values, start, owner, parts = lists
    at = np.searchsorted(values, tokens)
    first, count = start[at], start[at + 1] - start[at]
    ends = np.cumsum(count)
    found, done = np.zeros(parts, np.int64), 0
    while done < len(tokens):
        base = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, base + _ENTRIES, "right")))
        part, size = first[done:stop], count[done:stop]
        places = np.repeat(part - (ends[done:stop] - size - base), size)
        places += np.arange(len(places))
        found += np.bincount(owner[places], minlength=parts)
        done = stop
    return found


def candidates(prefixes: list[tuple[np.ndarray, int]], size: np.ndarray, known: np.ndarray,
               side: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set the earlier ones that may be linked to it by the rules of prefixes and sizes,
    without those ``known`` says are together (which may change meanwhile)."""
    short = _index([p[0] for p in prefixes])
    least = np.array([p[1] for p in prefixes])
    for x in range(len(prefixes)):
        other = (_shared(prefixes[x][0], short) >= np.minimum(least, least[x])) & (known != known[x])
        other &= np.minimum(size, size[x]) * den >= np.maximum(size, size[x]) * num
        if side[x]:
            other &= side != side[x]
        other[x:] = False  # a pair is looked at from its later set
        if other.any():
            yield x, np.flatnonzero(other)


def join_sets(sets: list[np.ndarray], prefixes: list[tuple[np.ndarray, int]],
              group: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """What links join: for each group that became part of another one, (its first set, that
    one's first set).

    ``group`` holds what is known to be together. Sets with a non-zero ``side`` are compared with
    those of the other side only.
    """
    parent = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]]
    size, whole = np.array([len(s) for s in sets]), None
    known = parent.copy()
    for x, near in candidates(prefixes, size, known, side, num, den):
        if len(near) <= _DIRECT:
            overlap = np.array([np.isin(sets[y], sets[x], assume_unique=True).sum() for y in near])
        else:
            whole = whole or _index(sets)
            overlap = _shared(sets[x], whole)[near]
        for y in near[overlap * den >= num * (size[near] + size[x] - overlap)]:
            if known[y] != known[x]:
                known[known == max(known[y], known[x])] = min(known[y], known[x])
    first = np.unique(parent)
    return [(int(g), int(known[g])) for g in first if known[g] != g]


def _sift(num: int, den: int):
    """Rows of a tile that may be linked to another one, from their prefixes alone."""
    def sift(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("tokens").combine_chunks()
        tokens = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        prefixes = list(zip(np.split(tokens, ends[:-1]), table.column("least").to_numpy()))
        group = table.column("group").to_numpy()
        met = np.zeros(len(group), bool)
        for x, near in candidates(prefixes, table.column("n").to_numpy().astype(np.int64), group,
                                  table.column("side").to_numpy(), num, den):
            met[x] = True
            met[near] = True
        return table.select(["tile", "node", "cluster", "group", "side"]).filter(pa.array(met))
    return sift


def _join_tile(shared, noise: float, width: int, num: int, den: int):
    def join(table: pa.Table) -> pa.Table:
        counters = shared.value
        table = table.combine_chunks()
        text = table.column("text")
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        nodes = table.column("node").to_numpy()
        sets = []
        for batch in sized(iter([pa.record_batch({"text": text})]), limit=_SLICE):
            sets += shingle_sets(batch.column("text"), width)
        prefixes = [adaptive_prefix(s, counters, noise, num, den) for s in sets]
        links = join_sets(sets, prefixes, table.column("group").to_numpy(),
                          table.column("side").to_numpy(), num, den)
        cluster = table.column("cluster")[0].as_py()
        return pa.table({"a": pa.array([nodes[x] for x, _ in links], pa.int64()),
                         "b": pa.array([nodes[y] for _, y in links], pa.int64()),
                         "cluster": pa.array([cluster] * len(links), pa.int64())})
    return join


def _marked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``node`` is one of ``nodes``, and few others: marks in a bounded bitmap keep
    the rest from being shuffled to the join that follows."""
    found = nodes.agg(F.approx_count_distinct("node")).first()[0]
    bits = min(MAX_MARKS, max(1 << 15, 1 << (16 * max(1, found) - 1).bit_length()))
    slot = F.pmod(F.xxhash64("node"), F.lit(bits))
    chunk, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    marks = nodes.groupBy(chunk.alias("chunk")).agg(F.bitmap_construct_agg(place).alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", (place / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return rows.withColumn("chunk", chunk).join(F.broadcast(marks), "chunk").filter(
        F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1).select(*rows.columns)


def _links(texts: DataFrame, heads: DataFrame, nodes: DataFrame, tiles: DataFrame, run, num: int,
           den: int) -> DataFrame:
    """Links found in tiles, written. ``nodes``: node, cluster, block, group; ``tiles``: cluster,
    tile, block, side. Tiles first get prefixes (``heads``), then the texts of those documents that
    these leave a partner; no others are shuffled."""
    placed = nodes.join(tiles, ["cluster", "block"]).select("node", "cluster", "group", "tile",
                                                            "side")
    met, path = _written(_marked(heads, nodes.select("node")).join(placed, "node").select(
        "tile", "node", "cluster", "group", "side", "n", "least", "tokens").groupBy(
        "tile").applyInArrow(_sift(num, den), "tile string, node bigint, cluster bigint, "
                                              "group bigint, side int"), "met")
    chosen = _marked(texts, met.select("node"))
    links, _ = _written(chosen.join(met, "node").select(
        "tile", "node", "cluster", "group", "side", "text").groupBy("tile").applyInArrow(
        run, "a bigint, b bigint, cluster bigint"), "links")
    drop(texts.sparkSession, path)
    return links


def _cross_links(texts: DataFrame, heads: DataFrame, nodes: DataFrame, links: DataFrame, run,
                 num: int, den: int) -> DataFrame:
    """Links between the components that blocks of one cluster still have, written.

    Large components get blocks of their own, small ones of a cluster share blocks; pairs of
    blocks inside one component are left out."""
    roots = connected_components(links)
    known = nodes.select("node", "cluster", "weight").join(roots, "node", "left").select(
        "node", "cluster", "weight", F.coalesce("root", "node").alias("group"))
    known, known_path = _written(known, "groups")
    groups = known.groupBy("cluster", "group").agg(F.sum("weight").alias("held"))
    small = F.when(F.col("held") < BLOCK, F.col("held"))
    clusters = groups.groupBy("cluster").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(small), F.lit(0)).alias("loose")).filter(
        "groups > 1")
    groups = groups.join(clusters, "cluster").select(
        "cluster", "group", (F.col("held") >= BLOCK).alias("large"),
        F.greatest(F.ceil(F.when(F.col("held") >= BLOCK, F.col("held")).otherwise(F.col("loose"))
                          / BLOCK), F.lit(1)).alias("parts"))
    own = F.concat_ws(":", "group", F.pmod(F.xxhash64("node"), F.col("parts")))
    loose = F.concat_ws(":", F.lit("loose"), F.pmod(F.xxhash64("group"), F.col("parts")))
    dealt, path = _written(known.join(groups, ["cluster", "group"]).select(
        "node", "cluster", "group", F.when(F.col("large"), own).otherwise(loose).alias("block"),
        F.when(F.col("large"), F.col("group")).alias("inside")), "dealt")
    blocks = dealt.select("cluster", "block", "inside").distinct()
    other = blocks.select("cluster", F.col("block").alias("block2"),
                          F.col("inside").alias("inside2"))
    # A block of small components is paired with itself, too.
    pairs = blocks.join(other, "cluster").filter(
        (F.col("block") <= F.col("block2"))
        & F.coalesce(F.col("inside") != F.col("inside2"), F.lit(True)))
    sides = F.when(F.col("block") == F.col("block2"), F.array(_side("block", 0))).otherwise(
        F.array(_side("block", 1), _side("block2", 2)))
    tiles = pairs.select("cluster", F.concat_ws("/", "cluster", "block", "block2").alias("tile"),
                         F.inline(sides))
    links = _links(texts, heads, dealt.select("node", "cluster", "block", "group"), tiles, run, num,
                   den)
    drop(texts.sparkSession, known_path, path)
    return links


def _side(block: str, side: int) -> Column:
    return F.struct(F.col(block).alias("block"), F.lit(side).alias("side"))


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """A row for each different text: ``key`` (md5), ``first_id`` (smallest doc_id), ``n`` (tokens,
    null without any) and ``root``, the number its component shares. Written; what leads to it is
    removed."""
    spark = docs.sparkSession
    texts, texts_path = _written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .groupBy(F.unhex(F.md5("text")).alias("key")).agg(
            F.first("text").alias("text"), F.min("doc_id").alias("first_id")).withColumn(
            "node", F.monotonically_increasing_id()), "texts")

    counters = token_frequencies(texts, width)
    noise = float(counters.sum(dtype=np.float64)) / len(counters)

    def prefixes(shared) -> DataFrame:
        return texts.select("node", "text").mapInArrow(
            _postings(shared, noise, width, num, den),
            "node bigint, n int, least int, tokens array<bigint>")

    # The estimate mixes a token with others; where prefixes meet often, exact counts correct it.
    shared = spark.sparkContext.broadcast(counters)
    counters = raised(counters, _exploded(prefixes(shared)))
    shared.destroy()
    shared = spark.sparkContext.broadcast(counters)
    del counters
    heads, heads_path = _written(prefixes(shared), "prefixes")
    # Long documents count as several.
    clusters, clusters_path = _written(_clusters(_exploded(heads), num, den).select(
        "node", F.col("root").alias("cluster")).join(heads.select("node", F.greatest(F.lit(
            1), F.expr(f"n div {LONG}")).cast("bigint").alias("weight")), "node"), "clusters")
    run = _join_tile(shared, noise, width, num, den)
    slim = texts.select("node", "text")

    # Blocks: a cluster over BLOCK documents has its own, others share.
    held = clusters.groupBy("cluster").agg(F.sum("weight").alias("held"))
    small = held.filter(f"held <= {BLOCK}").agg(F.sum("held")).first()[0] or 0
    packs = max(1, -(-small // BLOCK))
    parts = F.ceil(F.col("held") / BLOCK).cast("bigint")
    held = held.withColumn("parts", F.when(F.col("held") > BLOCK, parts).otherwise(0))
    dealt = F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("bigint")
    nodes, nodes_path = _written(clusters.join(held, "cluster").select(
        "node", "weight", F.when(F.col("parts") > 0, F.col("cluster")).otherwise(-1).alias("cluster"),
        F.when(F.col("parts") > 0, dealt).otherwise(
            F.pmod(F.xxhash64("cluster"), F.lit(packs))).alias("block"),
        F.col("node").alias("group")), "blocks")
    blocks = nodes.select("cluster", "block").distinct()
    # Each block alone, and those after the first of a cluster with that one.
    alone, with_first = F.concat_ws("/", "cluster", "block"), F.concat_ws(
        "/", "cluster", "block", F.lit("0"))
    first = F.lit(0).cast("bigint")
    placed = [F.struct(tile.alias("tile"), block.alias("block"), F.lit(side).alias("side"))
              for tile, block, side in ((alone, F.col("block"), 0), (with_first, F.col("block"), 1),
                                        (with_first, first, 2))]
    tiles = blocks.select("cluster", F.inline(F.when(F.expr(
        "cluster >= 0 and block > 0"), F.array(*placed)).otherwise(F.array(placed[0]))))
    links = _links(slim, heads, nodes, tiles, run, num, den)

    # A cluster inside one block is done: its links lead to its components' first nodes.
    inside = links.filter("cluster < 0")
    roots = inside.select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = nodes.filter("cluster >= 0")
    if not large.isEmpty():
        links = links.filter("cluster >= 0")
        links = links.unionByName(_cross_links(slim, heads, large, links, run, num, den))
        roots = roots.unionByName(connected_components(links))
    shared.destroy()
    found, _ = _written(texts.select("key", "node", "first_id").join(roots, "node", "left").join(
        heads.select("node", "n"), "node", "left").select("key", "first_id", "n", F.coalesce("root", "node").alias(
            "root")), "components")
    drop(spark, texts_path, heads_path, clusters_path, nodes_path)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` (of ``width`` words) and ``component_id``, the smallest doc_id
    that links of ``num / den`` Jaccard similarity or more reach, for every row of ``docs``."""
    found = _components(docs, width, num, den)
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = found.join(smallest, "root").select(
        "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_shingles"), "component_id")
    # Rows are two numbers each: a text that a third of all rows share is split by skew joins.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    return rows.join(named, "key").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of every component, with the smallest
    doc_id (a null one only where no row has an id), whatever ids the other rows have. Rows without
    words are in no component and stay; so does one of wholly equal rows of these."""
    found = _components(docs, width, num, den)
    chosen = found.filter("n IS NOT NULL").groupBy("root").agg(F.min(F.struct(
        F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("best")).select(
        F.col("best.key").alias("__key"))
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # Equal texts are one row before anything is sent on.
    each = docs.filter(has_words).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.unhex(F.md5("text")).alias("__key"), F.struct(
            F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("id"),
            F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h")).alias("__place"))
    each = each.groupBy("__key").agg(F.min_by("__row", "__place").alias("__row"))
    kept = each.join(chosen, "__key", "left_semi").select("__row.*")
    return kept.unionByName(docs.filter(~has_words).dropDuplicates(["doc_id", "text"]))
