import zlib
from collections import Counter

import pytest

from tabulon.llm import sharding as s


def test_map_versions():
    for n in (1, 2, 8, 9, 100):
        now, then = s.slot_map(n), s.slot_map(n + 1)
        assert set(now) == set(range(n)) and max(Counter(now).values()) - min(Counter(now).values()) <= 1 + n // 8
        assert all(a == b or b == n for a, b in zip(now, then, strict=True))
    with pytest.raises(ValueError):
        s.slot_map(0)


def test_rebalance_moves_towards_equal_bytes():
    bytes_of = {i: 1 + (i * 7919) % 1000 for i in range(256)}
    old = [min(7, i // 40) for i in range(256)]
    new = s.rebalance(old, bytes_of)
    size = Counter()
    for slot, x in enumerate(new):
        size[x] += bytes_of[slot]
    assert max(size.values()) <= 1.02 * sum(size.values()) / len(size)
    assert s.rebalance([0, 0, 1], {}) == [0, 0, 1]


def test_shard(spark):
    rows = [(i, "é" * i, "z", 3) for i in range(200)] + [(None, None, "z", 3)] * 50 + [(7, "same", "z", 3)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = s.shard(docs, 3).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    again = {r.doc_id: r.shard for r in s.shard(docs.where("doc_id < 50"), 4).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in got if r.doc_id is not None and r.doc_id < 50)
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    assert s.shard(docs.limit(0), 3).count() == 0
    assert {r.virtual_slot: r.n_bytes for r in s.slot_bytes(docs).collect()}


def test_stored_versions(spark, tmp_path):
    path = f"{tmp_path}/map"
    old = s.slot_map(8)
    s.store_map(spark, path, 1, old)
    s.store_map(spark, path, 2, s.grow(old, 8))
    assert s.load_map(spark, path, 1) == (1, old) and s.load_map(spark, path) == (2, s.slot_map(9))
    with pytest.raises(Exception, match="already exists|EXISTS"):
        s.store_map(spark, path, 2, old)


def test_query_is_brute_force(spark):
    import duckdb
    import xxhash

    from tabulon.llm.queries import QUERIES

    def hashed(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
        return (seed - (1 << 64) if seed >> 63 else seed)

    def shards(n):
        """Slots dealt one shard at a time, each new one taking the last slot of whichever has most."""
        own = [list(range(s.SLOTS))]
        for k in range(1, n):
            own.append([])
            for _ in range(s.SLOTS // (k + 1)):
                giver = max(range(k), key=lambda x: (len(own[x]), -x))
                own[k].append(own[giver].pop())
            own[k].sort()
        return {slot: x for x, slots in enumerate(own) for slot in slots}

    rows = duckdb.execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    now, then = shards(8), shards(9)
    want, size, order = {}, Counter(), []
    for i, t in rows:
        raw = (t or "").encode()
        n, crc, slot = len(raw) + 1, zlib.crc32(raw), hashed(i) % s.SLOTS
        size[slot] += n
        order.append((now[slot], slot, hashed(crc, n) % s.PARTS, i, crc, n))
    at = Counter()
    for shard, slot, _, i, crc, n in sorted(order):
        want[i] = (n, crc, "key", shard, at[shard], then[slot], slot, size[slot], sum(size[x] for x in size if now[x] == shard))
        at[shard] += 1
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard, r.virtual_slot, r.slot_bytes, r.shard_bytes) for r in QUERIES["op4_sharding"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(rows) == len(got)
