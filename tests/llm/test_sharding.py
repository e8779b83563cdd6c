import hashlib

import pytest

from lodestone.llm import sharding

SCHEMA = "doc_id long, text string, key string, bytes string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "b", 0) for i, t in rows], SCHEMA)


def bits(doc_id):
    name = "" if doc_id is None else str(doc_id)
    return f"{int(hashlib.md5(name.encode()).hexdigest()[:15], 16):060b}"


@pytest.mark.parametrize("step", [1, 3, 8])
def test_buckets_split_only_while_they_are_over_the_limit(spark, step):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(700)] + [(1000, "y" * 5000), (1001, None)]
    found = sharding.assign_shards(frame(spark, rows), 2000, step=step).collect()
    size = {i: len(t or "") for i, t in rows}

    def inside(prefix):
        return [i for i in size if bits(i).startswith(prefix)]

    assert len(found) == len(rows)
    for r in found:
        members = inside(r["shard"])
        assert bits(r["doc_id"]).startswith(r["shard"])
        assert r["depth"] == len(r["shard"])
        assert (r["shard_bytes"], r["shard_docs"]) == (sum(size[i] for i in members), len(members))
        assert r["shard_bytes"] <= 2000 or r["shard_docs"] == 1
        if r["shard"]:
            parent = inside(r["shard"][:-1])
            assert sum(size[i] for i in parent) > 2000 and len(parent) > 1


def test_rows_of_one_id_are_cut_into_runs_within_the_limit(spark):
    rows = [(7, "x" * n) for n in [10, 20, 30, 40, 50, 60, 100, 5, 5, 300]]
    found = sharding.assign_shards(frame(spark, rows), 100).collect()
    runs = {}
    for r in found:
        runs.setdefault((r["shard"], r["overflow"]), []).append(r)
    for members in runs.values():
        total = sum(r["bytes"] for r in members)
        assert total <= 100 or len(members) == 1
        assert {(r["shard_bytes"], r["shard_docs"]) for r in members} == {(total, len(members))}
    assert sorted(r["bytes"] for r in found) == sorted(len(t) for _, t in rows)


def test_missing_ids_share_bits_and_one_bucket_may_hold_all(spark):
    found = sharding.assign_shards(frame(spark, [(None, "a"), (None, None), (3, "é")]), 1000).collect()
    assert {(r["shard"], r["shard_bytes"], r["shard_docs"]) for r in found} == {("", 3, 3)}


def test_no_rows(spark):
    assert sharding.assign_shards(frame(spark, []), 10).count() == 0
