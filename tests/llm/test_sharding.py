import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import queries, sharding
from tidemark.tables import ConcurrentCommit

from . import awkward


def test_awkward_documents(spark):
    docs = awkward.frame(spark)
    slots = sharding.measure(docs)
    found = sharding.assign(docs, slots).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward.documents())
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    empty = awkward.frame(spark, [])
    assert sharding.assign(empty, sharding.measure(empty)).count() == 0


def test_bytes_are_near_equal_and_growth_moves_only_into_the_new_shard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slots = sharding.measure(docs)
    loads = slots.loads()
    assert sum(loads) == sum(len((r.text or "").encode()) + 8 for r in docs.select("text").collect())
    assert max(loads) < 1.02 * sum(loads) / len(loads)
    grown = slots.grown()
    moved = [(a, b) for a, b in zip(slots.shards, grown.shards, strict=True) if a != b]
    assert moved and all(b == sharding.SHARDS for _, b in moved)
    assert 0.9 < grown.loads()[-1] / (sum(loads) / (sharding.SHARDS + 1)) < 1.1


def test_maps_are_stored_by_version(spark, tmp_path):
    slots = sharding.SlotMap.balanced([5, 1, 4, 0, 3], [1, 1, 2, 0, 1], 2)
    path = str(tmp_path / "maps")
    slots.save(spark, path)
    slots.grown().save(spark, path)
    assert sharding.SlotMap.load(spark, path, 1) == slots
    assert sharding.SlotMap.load(spark, path) == slots.grown()
    for late in (slots, slots.grown()):  # made before another writer stored theirs
        with pytest.raises(ConcurrentCommit):
            late.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == slots.grown()


def plainly(rows, virtual, n_shards, n_slots):
    """doc_id to (shard, slot, rebalanced shard) of (doc_id, size, crc) by lists: largest slots first to the emptiest shard, then the new shard takes the largest that fit from the fullest."""
    sizes = [0] * n_slots
    for key, (_, size, _) in zip(virtual, rows, strict=True):
        sizes[key] += size
    loads, held = [0] * n_shards, [k % n_shards for k in range(n_slots)]
    for k in sorted(range(n_slots), key=lambda k: (-sizes[k], k)):
        if sizes[k]:
            held[k] = min(range(n_shards), key=lambda s: (loads[s], s))
            loads[held[k]] += sizes[k]
    grown, target, done = list(held), sum(sizes) / (n_shards + 1), set()
    loads.append(0)
    while loads[-1] < target and len(done) < n_shards:
        full = min((s for s in range(n_shards) if s not in done), key=lambda s: (-loads[s], s))
        fits = [k for k in range(n_slots) if grown[k] == full and sizes[k] and loads[-1] + sizes[k] <= target * 1.001]
        if not fits:
            done.add(full)
            continue
        best = max(fits, key=lambda k: (sizes[k], k))
        grown[best] = n_shards
        loads[full] -= sizes[best]
        loads[-1] += sizes[best]
    places, out = Counter(), {}
    for key, (doc, size, crc) in sorted(zip(virtual, rows, strict=True), key=lambda x: (x[0], x[1][0], x[1][2], x[1][1])):
        out[doc] = held[key], places[held[key]], grown[key]
        places[held[key]] += 1
    return out


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_virtual_slots"](spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = docs.select("doc_id", "text", sharding.slot_of().alias("v")).collect()
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in held]
    wanted = plainly(rows, [r.v for r in held], sharding.SHARDS, sharding.SLOTS)
    assert {r.doc_id: (r.shard, r.slot, r.rebalanced_shard) for r in found} == wanted
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == set(rows)
    assert {(r.law, r.map_version) for r in found} == {("bytes", 1)}
