"""Sharding by a k-d tree: shards of nearly equal bytes, each a box in the space of the documents' metadata.

The unit is the group of all rows with equal text, which stays in one shard.
Its place is the least value of its rows in each metadata dimension: numbers
and times as they are, strings as the number that their first bytes after the
common prefix make.

1. Groups that hold ``1 / (LIGHT * shards)`` of all bytes, or of all rows, are
   heavy; there are at most ``2 * LIGHT * shards`` of them, so they are known to
   the driver and are dealt first, the largest to the emptiest shard.
2. All other groups go down a k-d tree.  A node that stands for several shards
   is split along its widest dimension (extent over the extent of all), where
   the bytes on the left are in proportion to what the shards on the left
   still need: the weighted median where both sides need the same.  All nodes
   of a level are split together.  Medians come from histograms of
   ``BUCKETS`` buckets for each node, and the bucket in which a median lies is looked at
   again until the cut is within ``TOLERANCE`` of a shard; many groups at one
   coordinate are parted by a hash of their text.  A node ends when it stands
   for one shard, whose bytes then are the target.

So the driver sees extents and buckets only, whatever the number of rows.
Shards differ by the size of a light group and the tolerance, unless a single
group is larger than a shard's share; then that group is a shard and the
others share the rest.

Slots number the rows of a shard from 0 without a gap: rows are dealt by a
hash into buckets, buckets are counted, and a row's slot is the count of the
buckets before its own plus its place there.

A null text has size 1 and is of the group of empty texts.  Null metadata
comes before every value.  Rows of one id and text are counted and take
neighbouring slots, so any number of null or repeated ids is dealt evenly.  A
dimension that the table lacks is left out.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_name, load, saved

DIMENSIONS = ("source", "lang", "n_chars")
LIGHT, BUCKETS, TOLERANCE = 64, 4096, 0.001
#: Rows of a bucket in which slots are numbered, the most buckets, and rows that one row of repeats is taken apart to at once.
SLOT_ROWS, MOST_BUCKETS, REPEATS = 2000, 100_000, 100_000


@dataclass
class Node:
    """Shards that are still together; ``cut`` is (dimension, value, hash): less goes left."""

    shards: list[int]
    cut: tuple[str, float, float] | None = None
    parts: list[Node] = field(default_factory=list)


def _coordinate(kind: T.DataType, column: Column, least, most) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(F.unix_micros(column.cast("timestamp")).cast("double"), F.lit(float("-inf")))
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.nanvl(column.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    shared = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
    number = F.conv(F.rpad(F.substring(F.hex(column.cast("string")), 2 * shared + 1, 12), 12, "0"), 16, 10).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def keyed_rows(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text") -> tuple[Column, Column, Column, dict[str, Column]]:
    """Two hashes of a row's text, its size, and its coordinate in each dimension (nulls at the least number)."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    have = [d for d in dimensions if d in docs.columns]
    ends = docs.agg(F.lit(0), *(f(F.col(f"`{d}`").cast("string")) for d in have for f in (F.min, F.max))).first()
    places = {f"c{k}": _coordinate(docs.schema[d].dataType, F.col(f"`{d}`"), ends[1 + 2 * k], ends[2 + 2 * k]) for k, d in enumerate(have)}
    return F.xxhash64(t), F.xxhash64(F.lit(1), t), F.octet_length(t).cast("long") + 1, places or {"c0": F.lit(0.0)}


def _route(node: Node, leaf) -> Column:
    """The value of ``leaf(node)`` for the node that a group comes to."""
    if not node.parts or node.cut is None:
        return F.lit(leaf(node))
    c, value, bound = node.cut
    left = (F.col(c) < value) | ((F.col(c) == value) & (F.col("u") < bound))
    return F.when(left, _route(node.parts[0], leaf)).otherwise(_route(node.parts[1], leaf))


def _level(total: float, loads: list[int]) -> list[float]:
    """What each shard still takes when ``total`` is added to ``loads`` so that all end as even as can be."""
    order = sorted(loads)
    for n in range(len(order), 0, -1):
        level = (total + sum(order[:n])) / n
        if level >= order[n - 1]:
            return [max(0.0, level - x) for x in loads]
    return [0.0] * len(loads)


def _cuts(light: DataFrame, root: Node, open_nodes: list[Node], dims: list[str], needs: list[float], spans: dict[str, float], shard_bytes: float) -> None:
    """Sets ``cut`` of every open node."""
    number = {id(n): k for k, n in enumerate(open_nodes)}
    at_node = light.withColumn("node", _route(root, lambda n: number.get(id(n), -1))).where("node >= 0")
    extents = {r["node"]: r for r in at_node.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(c).alias(f"{w}_{c}") for c in dims for w, f in (("lo", F.min), ("hi", F.max)))).collect()}
    width = lambda r, c: (r[f"hi_{c}"] - r[f"lo_{c}"]) / spans[c] if spans[c] else 0.0
    state = {}
    for k, node in enumerate(open_nodes):
        half = len(node.shards) // 2
        left, both = sum(needs[s] for s in node.shards[:half]), sum(needs[s] for s in node.shards)
        r = extents.get(k)
        if r is None:
            node.cut = (dims[0], 0.0, 0.0)
            continue
        c = max(dims, key=lambda c, r=r: (width(r, c), -dims.index(c)))
        lo, hi = r[f"lo_{c}"], r[f"hi_{c}"]
        state[k] = {"c": c, "lo": lo, "hi": hi, "tie": None, "target": r["bytes"] * (left / both if both else 0.5)}
        if lo == hi:
            state[k] |= {"tie": lo, "lo": 0.0, "hi": 1.0}
    while state:
        bucket, coordinate = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, s in state.items():
            value = F.col(s["c"]) if s["tie"] is None else F.col("u")
            step = F.least(F.floor((value - s["lo"]) / (s["hi"] - s["lo"]) * BUCKETS), F.lit(BUCKETS - 1)) if s["hi"] > s["lo"] else F.lit(0)
            inside = F.when(value < s["lo"], -1).when(value > s["hi"], BUCKETS).otherwise(step.cast("int"))
            if s["tie"] is not None:
                inside = F.when(F.col(s["c"]) < s["tie"], -1).when(F.col(s["c"]) > s["tie"], BUCKETS).otherwise(inside)
            bucket, coordinate = F.when(F.col("node") == k, inside).otherwise(bucket), F.when(F.col("node") == k, value).otherwise(coordinate)
        counted = at_node.where(F.col("node").isin(list(state))).select("node", bucket.alias("b"), coordinate.alias("x"), "bytes").groupBy("node", "b").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_node: dict[int, list] = {}
        for r in counted.orderBy("node", "b").collect():  # at most BUCKETS + 2 for each node
            by_node.setdefault(r["node"], []).append(r)
        for k, rows in by_node.items():
            s, before, at = state[k], 0, 0
            while at < len(rows) - 1 and before + rows[at]["bytes"] < s["target"]:
                before += rows[at]["bytes"]
                at += 1
            r = rows[at]
            below, above = s["target"] - before, before + r["bytes"] - s["target"]
            done = min(below, above) <= TOLERANCE * shard_bytes or r["groups"] == 1
            if not done and r["lo"] < r["hi"]:
                s |= {"lo": r["lo"], "hi": r["hi"]}
                continue
            if not done and s["tie"] is None:
                s |= {"tie": r["lo"], "lo": 0.0, "hi": 1.0}
                continue
            edge = r["lo"] if below <= above else math.nextafter(r["hi"], math.inf)
            open_nodes[k].cut = (s["c"], edge, 0.0) if s["tie"] is None else (s["c"], s["tie"], edge)
            del state[k]


def plan_shards(groups: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """``h1, h2, shard`` of the heavy groups (few, known to the driver) and of the others.

    ``groups`` has h1, h2, bytes, rows, the coordinates c0, c1, ... and u, a hash of the text from 0 to 1.
    """
    dims = [c for c in groups.columns if c.startswith("c")]
    finite = lambda c: F.when(F.col(c) > float("-inf"), F.col(c))
    whole = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *(f(finite(c)).alias(f"{w}_{c}") for c in dims for w, f in (("lo", F.min), ("hi", F.max)))).first()
    # Nulls stand a tenth of the extent before the least value.
    spans = {c: (whole[f"hi_{c}"] or 0.0) - (whole[f"lo_{c}"] or 0.0) for c in dims}
    placed = groups.select("h1", "h2", "bytes", "rows", "u", *(F.when(F.col(c) > float("-inf"), F.col(c)).otherwise(F.lit((whole[f"lo_{c}"] or 0.0) - (spans[c] / 10 or 1.0))).alias(c) for c in dims))
    is_heavy = (F.col("bytes") * (LIGHT * shards) >= F.lit(whole["bytes"])) | (F.col("rows") * (LIGHT * shards) >= F.lit(whole["rows"]))
    heavy = placed.where(is_heavy).select("h1", "h2", "bytes").collect()
    loads, chosen = [0] * shards, []
    for r in sorted(heavy, key=lambda r: (-r["bytes"], r["h1"], r["h2"])):
        s = min(range(shards), key=lambda k: (loads[k], k))
        loads[s] += r["bytes"]
        chosen.append((r["h1"], r["h2"], s))
    light = placed.where(~is_heavy)
    needs = _level(whole["bytes"] - sum(loads), loads)
    root = Node(list(range(shards)))
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        _cuts(light, root, open_nodes, dims, needs, spans, max(1.0, whole["bytes"] / shards))
        for n in open_nodes:
            half = len(n.shards) // 2
            n.parts = [Node(n.shards[:half]), Node(n.shards[half:])]
        open_nodes = [p for n in open_nodes for p in n.parts if len(p.shards) > 1]
    return groups.sparkSession.createDataFrame(chosen, "h1 long, h2 long, shard int"), light.select("h1", "h2", _route(root, lambda n: n.shards[0]).cast("int").alias("shard"))


def _with_shard(rows: DataFrame, plan: tuple[DataFrame, DataFrame], h1: str, h2: str, shard: str) -> DataFrame:
    """``rows`` with their group's shard.  Rows of heavy groups meet a broadcast table, so no hot text is shuffled."""
    heavy, light = (p.select(F.col("h1").alias("_k1"), F.col("h2").alias("_k2"), F.col("shard").alias("_s")) for p in plan)
    on = (F.col(h1) == F.col("_k1")) & (F.col(h2) == F.col("_k2"))
    few = rows.join(F.broadcast(heavy), on)
    most = rows.join(F.broadcast(heavy), on, "left_anti").join(light, on)
    return few.unionByName(most).withColumn(shard, F.col("_s")).drop("_k1", "_k2", "_s")


def _groups(rows: DataFrame, count: Column) -> DataFrame:
    dims = [c for c in rows.columns if c.startswith("c") and c[1:].isdigit()]
    # The upper 53 bits of a hash, as a share.
    u = F.shiftrightunsigned("h1", 11) / F.lit(float(1 << 53))
    return saved(rows.groupBy("h1", "h2").agg(F.sum(F.col("size") * count).alias("bytes"), F.sum(count).alias("rows"), *(F.min(c).alias(c) for c in dims)).withColumn("u", u))


def shard_slots(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row; no text is shuffled."""
    h1, h2, size, places = keyed_rows(docs, dimensions, text)
    crc = F.crc32(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), size.alias("size"), crc.alias("text_crc32"), *(c.alias(n) for n, c in places.items()))
    counted = saved(rows.groupBy("doc_id", "h1", "h2").agg(F.min("size").alias("size"), F.min("text_crc32").alias("text_crc32"), F.count("*").alias("copies"), *(F.min(n).alias(n) for n in places)))
    in_shard = _with_shard(counted.select("doc_id", "h1", "h2", "size", "text_crc32", "copies"), plan_shards(_groups(counted, F.col("copies")), shards), "h1", "h2", "shard")
    total, most = counted.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    buckets = max(1, min(MOST_BUCKETS, math.ceil(total / SLOT_ROWS)))
    dealt = in_shard.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select(F.col("shard").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(firsts, (F.col("shard") == F.col("_s")) & (F.col("bucket") == F.col("_b")))
    slots = placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("earlier")).alias("low"), "copies")
    if most > REPEATS:
        slots = slots.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(REPEATS).cast("long")))).repartition("low", "skip")
        slots = slots.select("doc_id", "size", "text_crc32", "shard", (F.col("low") + F.col("skip")).alias("low"), F.least(F.col("copies") - F.col("skip"), F.lit(REPEATS)).alias("copies"))
    return slots.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("low", F.col("low") + F.col("copies") - 1)).alias("slot"))


def with_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text", out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out`` in place of one of that name, for ``write.partitionBy(out)``."""
    h1, h2, size, places = keyed_rows(docs, dimensions, text)
    a, b = fresh_name(docs, "_h1"), fresh_name(docs, "_h2")
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), size.alias("size"), *(c.alias(n) for n, c in places.items()))
    plan = plan_shards(_groups(rows, F.lit(1)), shards)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return _with_shard(docs.select(*kept, h1.alias(a), h2.alias(b)), plan, a, b, out).drop(a, b)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight shards of nearly equal bytes, equal texts together."""
    slots = shard_slots(load(spark, sf_dir, "documents"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
