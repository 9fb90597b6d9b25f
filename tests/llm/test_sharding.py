import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import sharding as S


def size_of(text):
    return len((text or "").encode()) + 1


def checked(docs, rows, shards=8):
    """Sizes, digests, whole groups and gapless slots; returns the bytes of each shard."""
    got = S.shard_slots(docs, shards).collect()
    assert len(got) == len(rows)
    want = sorted((repr(i), size_of(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((repr(x.doc_id), x["size"], x.text_crc32) for x in got) == want
    slots, of_text, load = defaultdict(list), defaultdict(set), [0] * shards
    for x in got:
        assert 0 <= x.shard < shards
        slots[x.shard].append(x.slot)
        of_text[x.text_crc32].add(x.shard)
        load[x.shard] += x["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of_text.values())
    return load


def test_shards_are_nearly_equal_and_groups_whole(docs_of, prose):
    r = random.Random(4)
    rows = [(i, prose(i, r.randrange(1, 200)), r.choice(["en", "fr", None]), r.choice(["hot", "hot", "hot", "a1", "a2", "b"])) for i in range(3000)]
    rows += [(5000 + i, prose(1, 150), "en", f"s{i % 3}") for i in range(50)]
    load = checked(docs_of(rows), rows)
    assert max(load) - min(load) <= 0.03 * sum(load) / 8
    again = {x.doc_id: (x.shard, x.slot) for x in S.shard_slots(docs_of(rows).repartition(9)).collect()}
    assert {x.doc_id: (x.shard, x.slot) for x in S.shard_slots(docs_of(rows)).collect()} == again
    for shards in (1, 3, 11):
        load = checked(docs_of(rows), rows, shards)
        assert max(load) - min(load) <= 0.05 * sum(load) / shards + 1300


def test_boxes_split_the_widest_dimension_at_weighted_medians(spark):
    """One dimension: shards are ranges of it, cut where a sequential pass over the sorted groups would cut."""
    r = random.Random(9)
    rows = [(i, "x" * r.randrange(1, 400) + str(i), r.random() * 1000) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at double")
    shard = {x.doc_id: x.shard for x in S.shard_slots(docs, 4, ("at",)).collect()}
    ranges = [(min(a for i, _, a in rows if shard[i] == s), max(a for i, _, a in rows if shard[i] == s)) for s in range(4)]
    assert all(ranges[k][1] < ranges[k + 1][0] for k in range(3))
    total, running, ends = sum(size_of(t) for _, t, _ in rows), 0, []
    for _, t, a in sorted(rows, key=lambda x: x[2]):
        if len(ends) < 3 and running >= total * (len(ends) + 1) / 4:
            ends.append(a)
        running += size_of(t)
    near = sorted(a for _, _, a in rows)
    for k, end in enumerate(ends):
        assert abs(near.index(end) - near.index(ranges[k + 1][0])) <= 8


def test_one_place_is_parted_by_hash_and_a_group_beyond_its_share_is_a_shard(docs_of, prose):
    rows = [(i, prose(i, 20), "en", "a") for i in range(2000)]
    docs = docs_of(rows).withColumn("n_chars", F.lit(1))
    load = checked(docs, rows)
    assert max(load) - min(load) <= 0.03 * sum(load) / 8
    rows += [(9000 + i, prose(77, 400), "en", "a") for i in range(900)]
    load = sorted(checked(docs_of(rows), rows))
    assert load[-1] == 900 * size_of(prose(77, 400))
    assert load[-2] - load[0] <= 0.05 * load[0] + 200


def test_odd_rows(docs_of, odd_rows, spark, monkeypatch):
    checked(docs_of(odd_rows), odd_rows)
    checked(docs_of([]), [])
    checked(docs_of([(1, None, None, None)]), [(1, None)])
    many = [(None, "", None, None)] * 700 + [(3, "a", None, "s")] * 40 + [(4, None, None, None)]
    monkeypatch.setattr(S, "REPEATS", 90)
    checked(docs_of(many), many)
    bare = spark.createDataFrame([("k", "text"), ("l", "other")], "doc_id string, text string")
    checked(bare, [("k", "text"), ("l", "other")], 2)


def test_columns_pass_and_agree_with_the_slots(docs_of, prose):
    rows = [(i, prose(i % 300, 30), "en", "abc"[i % 3]) for i in range(600)]
    docs = docs_of(rows).withColumn("Shard", F.lit("old")).withColumn("_h1", F.lit(1))
    wide = S.with_shards(docs)
    assert "Shard" not in wide.columns and {"comp", "_word", "_h1"} <= set(wide.columns)
    assert {x.doc_id: x.shard for x in wide.collect()} == {x.doc_id: x.shard for x in S.shard_slots(docs).collect()}
