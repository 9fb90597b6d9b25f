"""Bounded clusters: what belongs to the occurrence of each root, for all roots at once.

A root's cluster starts with its seeds and grows by hops, as long as it has
less than ``MOST`` members: by case links (all items of a case that is new to
the cluster), by memberships in a case and by correlation edges in both
directions.  An item joins only if it is visible, lies within the window of
the nearest dated seed (an undated item always does, and so does any item
where no seed is dated) and isn't marked as not belonging to a case that the
cluster stands for.  Of a hop's items those of least id join; if some find no
room, the cluster is marked as truncated.

A case, an item with many edges and their like are lists of items.  One of at
most ``BLOCK`` items is a row for each of its reasons, and one for the items
that its case denies; a root reads them once.  A hot key makes a list as long
as the table; so that a root never meets a whole one, longer lists are kept by
bins of time as wide as the window, in blocks of ``BLOCK`` ids in ascending
order.  A root reads the first block of the bins around its seeds and goes on
only while a further block can hold an id below the largest that still has
room: in a bin that lies whole within the window one block nearly always fills
it.

Roots go through their hops in batches: of ``ROOTS``, or larger ones where
``BATCHES`` would not do, as each reads all lists.  The lists stay, and of a
batch its clusters only.  Shuffles and hops are let go as soon as they have
been read, so the disk holds the lists, the clusters so far and one hop of one
batch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.graph import Shelf

#: Rounds of expansion, members of a cluster, days from the nearest seed, relationships that never expand.
HOPS, MOST, WINDOW_DAYS = 3, 50, 30
NOT_EXPANDING = ("mentioned_only", "recurrence")
BLOCK, ROOTS, BATCHES = 64, 300_000, 8
#: Bins beside those of time: of undated items, and of all items (for roots without a dated seed).
_UNDATED, _ALL = -(1 << 62), -(1 << 62) + 1
_DAY = 86_400_000_000
#: Kinds of lists, and what a row says of its items and root; few bytes, as they travel with every row.
_CASE, _REF, _EDGE = 0, 1, 2
_FOUND, _DENIED, _DENIED_FOR_GOOD, _MEMBER = 0, 1, 2, 3
#: While this is set, the shuffles of a query go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Keep = Callable[[DataFrame, str], DataFrame]


def _byte(n: int) -> Column:
    return F.lit(n).cast("byte")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _signals(case_links: DataFrame, memberships: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, key, id, why`` of all signals; a case link's reason follows from its key and is null."""
    types = {df.schema[c].dataType.simpleString() for df, c in ((case_links, "case_id"), (memberships, "case_id"), (edges, "a"), (edges, "b"))}
    name = (lambda c: F.col(c)) if len(types) == 1 else (lambda c: F.col(c).cast("string"))
    kind = lambda k: _byte(k).alias("kind")
    cases = case_links.where("case_id IS NOT NULL").select(kind(_CASE), name("case_id").alias("key"), "id", F.lit(None).cast("string").alias("why"))
    active = memberships.where((F.col("status") == "active") & ~F.col("relationship").isin(*NOT_EXPANDING) & F.col("case_id").isNotNull())
    refs = active.select(kind(_REF), name("case_id").alias("key"), "id", F.concat(F.lit("ticket_ref:"), F.col("relationship")).alias("why"))
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    way = lambda a, b: ends.select(kind(_EDGE), name(a).alias("key"), F.col(b).alias("id"), F.concat(F.lit("correlation:"), F.coalesce("kind", F.lit(""))).alias("why"))
    return cases.unionByName(refs).unionByName(way("a", "b")).unionByName(way("b", "a"))


def _blocks(lists: DataFrame, width: int, block: int, keep: Keep) -> DataFrame:
    """``kind, key, bin, no, last, least, ids``: each of the lists ``kind, key, id, at, whys`` by bins of time, in blocks of ascending ids.

    Rows are sorted by ranges of list and id, and blocks are counted from one
    range to the next, so that a list of any length is spread over tasks.
    """
    own = F.when(F.col("at").isNull(), F.lit(_UNDATED)).otherwise(F.floor(F.col("at") / F.lit(width)).cast("long"))
    binned = lists.withColumn("bin", F.explode(F.array(own, F.lit(_ALL).cast("long"))))
    where = ["kind", "key", "bin"]
    rows = keep(binned.repartitionByRange(*where, "id").withColumn("part", F.spark_partition_id()), "lists/binned")
    nth = F.row_number().over(Window.partitionBy("part", *where).orderBy("id"))
    packed = keep(rows.withColumn("local", F.floor((nth - 1) / block)).groupBy("part", *where, "local").agg(F.array_sort(F.collect_list(F.struct("id", "at", "whys"))).alias("ids")), "lists/packed")
    counts = packed.groupBy("part", *where).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*where).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("part", *where, before.alias("before"), F.sum("n").over(Window.partitionBy(*where)).alias("total"))
    no = F.col("before") + F.col("local")
    return keep(packed.join(placed, ["part", *where]).select(*where, no.alias("no"), (no == F.col("total") - 1).alias("last"), F.col("ids")[0]["id"].alias("least"), "ids"), "lists/blocks")


def _bins(width: int) -> Column:
    around = F.flatten(F.transform("times", lambda t: F.array(*[(F.floor(t / F.lit(width)) + d).cast("long") for d in (-1, 0, 1)])))
    return F.when(F.size("times") == 0, F.array(F.lit(_ALL).cast("long"))).otherwise(F.concat(F.array_distinct(around), F.array(F.lit(_UNDATED).cast("long"))))


def _near(width: int) -> Column:
    """Of the entries ``id`` and their times ``at`` those within the window of their root."""
    inside = lambda e: e["at"].isNull() | F.coalesce(F.abs(F.col("times")[0] - e["at"]) <= width, F.lit(False)) | ((F.size("times") > 1) & F.exists("times", lambda t: F.abs(t - e["at"]) <= width))
    return F.when(F.size("times") == 0, F.col("id")).otherwise(F.filter(F.arrays_zip("id", "at"), inside)["id"])


def _found(read: DataFrame, width: int) -> DataFrame:
    """``root, case_id, why, says, ids`` of lists ``kind, key, why, says, id, at`` that their roots have read: one row stays one."""
    case = F.when((F.col("kind") == _CASE) & (F.col("says") == _FOUND), F.col("key")).alias("case_id")
    return read.select("root", case, "why", "says", _near(width).alias("ids")).where(F.size("ids") > 0)


def _picked(found: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """``root, ids, whys, room, left, shut, times``: the items of least id that may join and one more than there is room for, and what is denied for good.

    All rows of a root meet once.
    """
    why = F.coalesce("why", F.concat(F.lit("case:"), F.col("case_id").cast("string"))).alias("why")
    rows = found.select("root", "says", why, "ids", F.lit(None).cast("array<bigint>").alias("times")).unionByName(members.select("root", _byte(_MEMBER).alias("says"), F.lit(None).cast("string").alias("why"), "ids", "times"))
    met = rows.repartition("root").groupBy("root").agg(F.collect_list(F.struct("says", "why", "ids")).alias("lists"), F.max("times").alias("times"))
    said = lambda fits: F.filter("lists", lambda r: fits(r["says"]))
    met = met.select("root", "times", said(lambda x: x == _FOUND).alias("found"), F.flatten(said(lambda x: x != _FOUND)["ids"]).alias("out"), F.flatten(said(lambda x: x == _DENIED_FOR_GOOD)["ids"]).alias("shut"), F.size(F.flatten(said(lambda x: x == _MEMBER)["ids"])).alias("n"))
    free = met.where("size(found) > 0 OR size(shut) > 0").withColumns({"free": F.array_except(F.flatten(F.col("found")["ids"]), "out"), "room": F.greatest(F.lit(most) - F.col("n"), F.lit(0))})
    left, ids = F.greatest(F.col("room") - F.size("free"), F.lit(0)).alias("left"), F.slice(F.sort_array("free"), F.lit(1), F.col("room") + 1).alias("ids")
    cut = free.where("size(free) > 0 OR size(shut) > 0").select("root", "times", "found", "room", left, F.array_distinct("shut").alias("shut"), ids)
    whys = F.transform("ids", lambda i: F.array_sort(F.array_distinct(F.filter("found", lambda r: F.array_contains(r["ids"], i))["why"])))
    return cut.select("root", "ids", whys.alias("whys"), "room", "left", "shut", "times")


def _long_lists(todo: DataFrame, blocks: DataFrame, found: DataFrame, pick: Callable[[DataFrame], DataFrame], width: int, keep: Keep, name: str) -> DataFrame:
    """What ``pick`` leaves of ``found`` and of the long lists that ``todo(root, times, kind, key)`` names, read block by block."""
    found = keep(found, f"{name}/short")
    denied, none = found.where(F.col("says") != _FOUND), F.lit(None).cast(found.schema["case_id"].dataType).alias("case_id")
    todo = todo.select("root", "times", "kind", "key", F.explode(_bins(width)).alias("bin"), F.lit(None).cast(found.schema["ids"].dataType.elementType).alias("bound"))
    pool, no = None, 0
    while True:
        read = keep(todo.join(blocks.where(F.col("no") == no), ["kind", "key", "bin"]).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))), f"{name}/read{no}")
        if pool is not None and not read.limit(1).count():
            return pool
        entries = read.select("root", "times", "kind", "key", _byte(_FOUND).alias("says"), F.inline("ids")).withColumn("why", F.explode_outer("whys")).withColumns({"id": F.array("id"), "at": F.array("at")})
        if pool is not None:
            before = pool.select("root", F.inline(F.arrays_zip("ids", "whys"))).select("root", none, F.explode("whys").alias("why"), _byte(_FOUND).alias("says"), F.array("ids").alias("ids"))
        pool = keep(pick(_found(entries, width).unionByName(found if pool is None else denied.unionByName(before))), f"{name}/pool{no}")
        left = read.where("NOT last").select("root", "times", "kind", "key", "bin")
        todo, no = left.join(pool.where("size(ids) > room").select("root", F.element_at("ids", -1).alias("bound")), "root", "left"), no + 1


def bounded_clusters(
    items: DataFrame, seeds: DataFrame, case_links: DataFrame, memberships: DataFrame, edges: DataFrame,
    hops: int = HOPS, most: int = MOST, window_days: int = WINDOW_DAYS, block: int = BLOCK, batch: int = ROOTS,
) -> DataFrame:
    """``root, id, hop, reasons, members, truncated, fingerprint``: the members of every root's cluster.

    ``items(id, at)`` are the visible ones (of a repeated id the earliest time
    counts), ``seeds(root, id)`` a root's few first items,
    ``case_links(case_id, id)``, ``memberships(case_id, id, relationship,
    status)`` and ``edges(a, b, kind)`` the signals.  A membership expands if
    it is active and neither a mere mention nor a recurrence; a negative one
    keeps the item out of each cluster that stands for the case: by a case
    link of any hop so far, or by a membership of the hop's own front.  All
    seeds are members, even beyond ``most``; roots whose seeds are all
    invisible have no rows.  The fingerprint is that of the sorted members.
    Batches are of ``batch`` roots, and ``BATCHES`` at most.
    """
    spark = items.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        paths, schema = _stored_clusters(items, seeds, case_links, memberships, edges, hops, most, window_days * _DAY, block, batch)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(*paths).select("root", "id", "hop", "reasons", "members", "truncated")
    names = F.array_sort(F.collect_list(F.col("id").cast("string")).over(Window.partitionBy("root")))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws(",", names), 256))


def _stored_clusters(items, seeds, case_links, memberships, edges, hops, most, width, block, batch) -> tuple[list[str], StructType]:
    """The folders of all batches' clusters, and the columns of their files."""
    shelf = Shelf(items.sparkSession)
    keep = shelf.keep
    signals = _signals(case_links, memberships, edges)
    name = signals.schema["key"].dataType
    sizes = keep(signals.groupBy("kind", "key").agg(F.count("*").alias("n")), "lists/sizes")
    negatives = memberships.where("status = 'negative' AND case_id IS NOT NULL AND id IS NOT NULL").select(F.col("case_id").cast(name).alias("key"), "id").distinct()
    visible = items.where("id IS NOT NULL").groupBy("id").agg(F.unix_micros(F.min("at").cast("timestamp")).alias("at"))
    items = keep(visible, "lists/items")

    # A short list is read once, with the items that its case denies; only long ones are cut by time, and what they deny is looked up.
    long = keep(sizes.where(F.col("n") > block).select("kind", "key"), "lists/long")
    cut_up = bool(long.limit(1).count())
    hot = negatives.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key")
    hot = keep((hot.unionByName(long.where(F.col("kind") != _EDGE).select("key")) if cut_up else hot).distinct(), "lists/hot")
    much = bool(hot.limit(1).count())
    many = keep(negatives.join(hot, "key"), "lists/many") if much else None
    cases = sizes.where(F.col("kind") != _EDGE).select("kind", "key")
    says = F.when(F.col("kind") == _CASE, _byte(_DENIED_FOR_GOOD)).otherwise(_byte(_DENIED))
    denied = (negatives.join(hot, "key", "left_anti") if much else negatives).join(cases, "key").select("kind", "key", "id", F.lit(None).cast("string").alias("why"), says.alias("says"))
    short = (signals.join(long, ["kind", "key"], "left_anti") if cut_up else signals).withColumn("says", _byte(_FOUND)).unionByName(denied).join(items, "id")
    entries = F.collect_set(F.struct("id", "at"))
    short = keep(short.groupBy("kind", "key", "why", "says").agg(entries.alias("e")).select("kind", "key", "why", "says", F.col("e.id").alias("id"), F.col("e.at").alias("at")), "lists/short")
    if cut_up:
        lists = signals.join(long, ["kind", "key"]).join(items, "id").groupBy("id", "kind", "key").agg(F.first("at").alias("at"), F.collect_set("why").alias("whys"))
        blocks = _blocks(lists, width, block, keep)
    own = sizes.where(F.col("kind") == _EDGE).select("kind", "key").join(items.select("id", F.col("id").cast(name).alias("key")), "key").select("id", "kind", "key")
    keys = signals.where(F.col("kind") != _EDGE).select("id", "kind", "key").join(items.select("id"), "id").distinct().unionByName(own)
    cut = F.coalesce("cut", F.lit(False)).alias("cut")
    keys = keep(keys.join(long.withColumn("cut", F.lit(True)), ["kind", "key"], "left").select("id", "kind", "key", cut) if cut_up else keys.withColumn("cut", F.lit(False)), "lists/keys")
    first = seeds.where("root IS NOT NULL").select("root", "id").distinct().join(items, "id").groupBy("root").agg(F.collect_list("id").alias("ids"), F.collect_set("at").alias("times"))
    seed, left = F.transform("ids", lambda _: F.array(F.lit("seed"))).alias("whys"), F.greatest(F.lit(most) - F.size("ids"), F.lit(0)).alias("left")
    start = keep(first.select("root", "ids", seed, F.size("ids").alias("room"), left, F.slice("ids", 1, 0).alias("shut"), "times"), "lists/start")
    shelf.drop("lists/sizes")
    shelf.drop("lists/items")
    batches = min(BATCHES, max(1, -(-start.count() // batch)))
    no_case, no_why = F.lit(None).cast(name).alias("case_id"), F.lit(None).cast("string").alias("why")
    joined = F.slice("ids", F.lit(1), F.col("room"))

    def hop(n: int, pieces: list[DataFrame], at: str) -> DataFrame:
        """The items of one hop after those of ``pieces``, which are by hops."""
        going = _union([p.where("left > 0").select("root", F.explode("ids").alias("id"), "times", F.lit(k < n - 1).alias("old")) for k, p in enumerate(pieces)])
        reached = going.join(keys, "id").where(~F.col("old") | (F.col("kind") == _CASE)).select("root", "times", "kind", "key", "old", "cut")
        fresh = lambda df: df.groupBy("root", "times", "kind", "key").agg(F.max("old").alias("old")).where("NOT old").drop("old")
        found = _found(fresh(reached.where("NOT cut").repartition("kind", "key")).join(short, ["kind", "key"]), width)
        members = _union([p.select("root", joined.alias("ids"), (F.col("times") if k == 0 else F.lit(None).cast("array<bigint>")).alias("times")) for k, p in enumerate(pieces)])
        gone = _union([p.where("size(shut) > 0").select("root", no_case, no_why, _byte(_DENIED_FOR_GOOD).alias("says"), F.col("shut").alias("ids")) for p in pieces])
        stands = keep(reached.where(F.col("kind") != _EDGE).select("root", "key").distinct(), f"{at}/stands") if much else None

        def pick(found: DataFrame) -> DataFrame:
            if much:
                found = keep(found, f"{at}/{uuid4().hex}")
                severed = found.where(F.col("says") == _FOUND).select("root", F.explode("ids").alias("id")).distinct().join(many, "id").join(stands, ["root", "key"])
                found = found.unionByName(severed.select("root", no_case, no_why, _byte(_DENIED).alias("says"), F.array("id").alias("ids")))
            return _picked(found, members, most)

        found = found.unionByName(gone)
        if not cut_up:
            return keep(pick(found), f"{at}/items")
        return _long_lists(keep(fresh(reached.where("cut")), f"{at}/todo"), blocks, found, pick, width, keep, at)

    paths, root = [], Window.partitionBy("root")
    for b in range(batches):
        pieces = [start.where(F.pmod(F.xxhash64("root"), F.lit(batches)) == b) if batches > 1 else start]
        for n in range(1, hops + 1):
            pieces.append(hop(n, pieces, f"hops/{b}/{n}"))
            if not pieces[-1].where("size(ids) > 0").limit(1).count():
                break
        rows = _union([p.select("root", F.lit(k).alias("hop"), joined.alias("id"), F.col("whys").alias("reasons"), (F.size("ids") > F.col("room")).alias("over")) for k, p in enumerate(pieces)]).repartition("root")
        rows = rows.select("root", "hop", F.arrays_zip("id", F.slice("reasons", F.lit(1), F.size("id")).alias("reasons")).alias("x"), F.sum(F.size("id").cast("long")).over(root).alias("members"), F.max("over").over(root).alias("truncated"))
        done = keep(rows.select("root", F.inline("x"), "hop", "members", "truncated"), f"clusters/{b}")
        paths.append(shelf.path(f"clusters/{b}"))
        shelf.drop(f"hops/{b}")
    shelf.drop("lists")
    shelf.drop("hops")
    return paths, done.schema
