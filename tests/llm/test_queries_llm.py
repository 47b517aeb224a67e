"""Registered queries against their SQL, and those without against plain versions."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from check import compare
from tokenizers import Tokenizer

from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import default_path

MASK = (1 << 64) - 1


def documents(sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted(rows, key=lambda r: r["doc_id"])


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, sf, name):
    message, good = compare(spark, con, name, sf)
    assert good, message


@pytest.fixture(scope="module")
def ids(sf):
    tokenizer = Tokenizer.from_file(default_path())
    return {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            for r in documents(sf)}


def test_packing(spark, sf, ids):
    rows = QUERIES["op8_pack_documents"](spark, sf).collect()
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    for doc_id, tokens in ids.items():
        tokens, at = np.array(tokens + [1], "<u4"), 0
        for n, p in enumerate(sorted(pieces[doc_id], key=lambda r: r.piece)):
            part = tokens[at:at + p.length]
            assert (p.piece, p.start, p.ids_crc32) == (n, at, zlib.crc32(part.tobytes()))
            assert p.length == min(4096, len(tokens) - at)
            at += p.length
        assert at == len(tokens)
    # Best fit comes close to the number of tokens over the capacity.
    assert len(bins) <= -(-sum(len(t) + 1 for t in ids.values()) // 4096) + 1


def test_token_planes(spark, sf, ids):
    got = {r.doc_id: r for r in QUERIES["op9_token_planes"](spark, sf).collect()}
    assert len(got) == len(ids)
    at = 0
    for doc_id in sorted(ids):
        tokens = np.array(ids[doc_id] + [2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(tokens), zlib.crc32(tokens.tobytes()))
        at += len(tokens)


def plain_sketch(text):
    words = [w for w in _split(text.lower()) if w]

    def chain(parts):
        seed = 42
        for w in parts:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
        return seed - (1 << 64) if seed >> 63 else seed

    if len(words) >= 5:
        hashes = {chain(words[i:i + 5]) for i in range(len(words) - 4)}
    else:
        hashes = {chain(words)} if words else set()
    every = sorted(hashes)
    bound = -(1 << 63) + (1 << 61) - 1
    low = [h for h in every if h <= bound]
    if len(low) >= 16:
        return bound, low
    return ((1 << 63) - 1, every) if len(every) <= 16 else (every[15], every[:16])


def _split(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append(word)
            word = ""
        else:
            word += c
    return [*out, word]


def plain_likeness(a, b):
    upto = min(a[0], b[0])
    x, y = ({h for h in s[1] if h <= upto} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, sf):
    docs = documents(sf)[::-1]
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, after in zip(docs, docs[1:] + docs[:1]):
        text, other, r = d["text"] or "", after["text"] or "", got[d["doc_id"]]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + other[:cut]
        mine, new = plain_sketch(text), plain_sketch(edited)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == f"{mine[0] & MASK:x}:" + ".".join(f"{h & MASK:x}" for h in mine[1])
        assert r.near_edited == pytest.approx(plain_likeness(mine, new))
        assert r.near_next == pytest.approx(plain_likeness(mine, plain_sketch(other)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_classifiers_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = QUERIES["op1_quality"](spark, sf)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in q.filter("held_out").collect())
    held = q.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in held)
    toxic = labels.withColumnRenamed("toxic", "truth")
    held = QUERIES["op6_toxicity"](spark, sf).filter("held_out").join(toxic, "doc_id").collect()
    bad, clean = ([r for r in held if r.truth == k] for k in (1, 0))
    assert sum(r.toxic for r in bad) > 0.88 * len(bad)
    assert sum(r.toxic for r in clean) < 0.03 * len(clean)
    assert np.mean([r.severity for r in bad]) > 10 * np.mean([r.severity for r in clean])
