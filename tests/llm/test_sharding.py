import random
import zlib

import pytest

from stepweave.llm import sharding


def least_capacity(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def rows():
    rng = random.Random(2)
    out = [(i, "t" * rng.choice([1, 5, 40, 900]) + str(rng.randrange(80))) for i in range(400)]
    out += [(1000 + i, "hot " * 20) for i in range(150)] + [(None, None), (7, ""), (7, ""), (5, "é" * 30), (None, "x" * 20_000)]
    return out


@pytest.mark.parametrize("cells", [1 << 16, 8, 2])
def test_cuts_are_minimax(spark, docs_of, cells):
    """However coarse the first look is, the capacity is the least one in hash order."""
    from pyspark.sql import functions as F

    whole = F.coalesce("text", F.lit(""))
    sized = docs_of(rows()).select(
        F.xxhash64(whole).alias("h"), (F.octet_length(whole) + 1).cast("long").alias("size")
    )
    groups = {}
    for r in sized.collect():
        groups[r["h"]] = groups.get(r["h"], 0) + r["size"]
    for shards in (1, 3, 16):
        cuts, capacity = sharding.minimax_cuts(sized, shards, cells)
        if shards == 1:
            assert cuts == []
            continue
        assert capacity == least_capacity([groups[h] for h in sorted(groups)], shards)
        held = [0] * shards
        for h, size in groups.items():
            held[sum(h >= c for c in cuts)] += size
        assert max(held) <= capacity


def test_rows(docs_of):
    data = rows()
    out = sharding.shard_documents(docs_of(data)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data
    )
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in out if r["size"] == 81}) == 1


def test_empty_table(docs_of):
    assert sharding.shard_documents(docs_of([])).count() == 0
