"""Greedy merging of likely duplicates, and leader clustering, as rounds of DataFrame joins.

Both have a sequential definition (pairs by falling likeness, or rows by
rising id).  A step of such a pass depends only on earlier steps that touch the
same rows, so all steps without an open predecessor are taken together; the
result is that of the sequential pass, and with likenesses or ids that don't
follow the neighbourhood the number of rounds grows with the logarithm of the
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import saved

#: Least cosine of two accounts of one incident; greatest distances of a member of a pattern and of a new group.
LEAST_COSINE = 0.85
PATTERN_DISTANCE, GROUP_DISTANCE = 0.30, 0.27


def retire_duplicates(pairs: DataFrame, strength: DataFrame) -> DataFrame:
    """``retired, kept, similarity``: what goes when ``pairs(a, b, similarity)`` are walked by falling similarity.

    At each pair of which neither has been retired the weaker of the two is.
    Equal similarities come by a, then b.  ``strength(id, rank...)``: the
    columns after the id order the rows, the greater is stronger; of equals
    the lesser id is.

    A row can be retired by its pairs with stronger ones only.  So a pair is
    decided when it is the first open one in which its weaker row could go
    and no earlier open one could retire its stronger row.  A row that is
    stronger than all of its many copies takes one round.
    """
    order = [c for c in strength.columns if c != "id"]
    ranked = strength.select("id", F.struct(*order).alias("rank"))
    left, right = (ranked.select(F.col("id").alias(x), F.col("rank").alias(f"rank_{x}")) for x in ("a", "b"))
    named = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    joined = named.join(left, "a").join(right, "b")
    a_wins = F.col("rank_a") >= F.col("rank_b")
    step = F.struct((-F.col("similarity")).alias("s"), "a", "b").alias("step")
    open_pairs = saved(joined.select(F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("strong"), F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("weak"), step))
    done = None
    while open_pairs.limit(1).count():
        first = open_pairs.groupBy("weak").agg(F.min("step").alias("first"))
        threat = first.select(F.col("weak").alias("strong"), F.col("first").alias("threat"))
        ready = open_pairs.join(first, "weak").where(F.col("step") == F.col("first")).drop("first").join(threat, "strong", "left").where(F.col("threat").isNull() | (F.col("step") < F.col("threat"))).drop("threat")
        ready = saved(ready)
        done = ready if done is None else done.unionByName(ready)
        # From its own end on, a row takes part in no pair.
        end = ready.select(F.col("weak").alias("gone"), F.col("step").alias("end"))
        rest = open_pairs
        for side in ("weak", "strong"):
            rest = rest.join(end, F.col(side) == F.col("gone"), "left").where(F.col("end").isNull() | (F.col("step") < F.col("end"))).drop("gone", "end")
        open_pairs = saved(rest)
    if done is None:
        return open_pairs.select(F.col("weak").alias("retired"), F.col("strong").alias("kept"), (-F.col("step.s")).alias("similarity"))
    return done.select(F.col("weak").alias("retired"), F.col("strong").alias("kept"), (-F.col("step.s")).alias("similarity"))


def shared_evidence(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` whose two ids share an item of ``evidence(id, item)``."""
    items = evidence.where("item IS NOT NULL").distinct()
    left, right = items.select(F.col("id").alias("a"), "item"), items.select(F.col("id").alias("b"), "item")
    both = pairs.select("a", "b").join(left, "a").join(right, ["b", "item"]).select("a", "b").distinct()
    return pairs.join(both, ["a", "b"], "left_semi")


def _lead_at_once(rows: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``lead_clusters`` where every near member is accepted.

    Then who leads does not depend on the names of clusters.  A row can only
    lead if no member of an old cluster and no lesser row is near it.  Of two
    such rows the lesser one, if it leads, keeps the other from leading where
    it takes a row that is near the other; these few pairs are gone through in
    rounds.  A row that a leader could take goes to the least of those.  All
    others join: which members are nearest is then settled, and the least
    name among them is passed on until no name changes.
    """
    pairs = saved(pairs.where(F.col("distance") < PATTERN_DISTANCE).select("a", "b", "distance"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    before = saved(known.where(F.col("distance") < PATTERN_DISTANCE).select(F.col("id").alias("a"), F.col("cluster").cast("string").alias("cluster"), "distance"))
    ids = rows.select("id").distinct()
    waiting = before.select("a").unionByName(pairs.select(F.greatest("a", "b").alias("a"))).distinct()
    free = saved(ids.join(waiting.withColumnRenamed("a", "id"), "id", "left_anti"))
    around = both.join(free.withColumnRenamed("id", "a"), "a", "left_semi")
    takes, sees = around.where(F.col("distance") < GROUP_DISTANCE).select(F.col("a").alias("low"), "b"), around.select(F.col("a").alias("id"), "b")
    bars = saved(takes.join(sees, "b").where("low < id").select("low", "id").distinct())
    leaders, open_rows = free.join(bars, "id", "left_anti"), saved(bars.select("id").distinct())
    leaders = saved(leaders)
    while open_rows.limit(1).count():
        barred = bars.join(leaders.withColumnRenamed("id", "low"), "low", "left_semi").select("id").distinct()
        left = open_rows.join(barred, "id", "left_anti")
        waits = bars.join(left.withColumnRenamed("id", "low"), "low", "left_semi").select("id").distinct()
        left = saved(left)
        ready = left.join(waits, "id", "left_anti")
        leaders, open_rows = saved(leaders.unionByName(ready)), saved(left.join(waits, "id", "left_semi"))

    grouped = both.where(F.col("distance") < GROUP_DISTANCE).join(leaders.withColumnRenamed("id", "a"), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    settled = saved(leaders.select("id", F.col("id").alias("leader"), F.lit("leader").alias("how")).unionByName(grouped.select("id", "leader", F.lit("grouped").alias("how"))))
    joining = saved(ids.join(settled.select("id"), "id", "left_anti"))
    # A lesser row has been placed, a greater one if a lesser leader has taken it.
    seen = both.join(joining.withColumnRenamed("id", "a"), "a", "left_semi").join(settled.select(F.col("id").alias("b"), "leader"), "b", "left").where((F.col("b") < F.col("a")) | (F.col("leader") < F.col("a")))
    ways = seen.select("a", "b", F.col("leader").cast("string").alias("cluster"), "distance").unionByName(before.join(joining.withColumnRenamed("id", "a"), "a", "left_semi").select("a", F.lit(None).cast(ids.schema["id"].dataType).alias("b"), "cluster", "distance"))
    ways = saved(ways)
    nearest = saved(ways.join(ways.groupBy("a").agg(F.min("distance").alias("least")), "a").where(F.col("distance") == F.col("least")).select("a", "b", "cluster"))
    names = saved(nearest.groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster")))
    steps = saved(nearest.where("cluster IS NULL").select("a", "b"))
    changed = names.where("cluster IS NOT NULL")
    while changed.limit(1).count():
        told = steps.join(changed.select(F.col("id").alias("b"), F.col("cluster").alias("told")), "b").groupBy(F.col("a").alias("id")).agg(F.min("told").alias("told"))
        after = saved(names.join(told, "id", "left").select("id", F.least("cluster", "told").alias("cluster"), F.coalesce((F.col("told") < F.col("cluster")) | (F.col("told").isNotNull() & F.col("cluster").isNull()), F.lit(False)).alias("new")))
        names, changed = after.select("id", "cluster"), after.where("new").select("id", "cluster")
    return settled.select("id", F.col("leader").cast("string").alias("cluster"), "how").unionByName(names.select("id", "cluster", F.lit("joined").alias("how")))


def lead_clusters(rows: DataFrame, pairs: DataFrame, known: DataFrame, accept: Column | None = None) -> DataFrame:
    """``id, cluster, how``: the pass of leaders over ``rows(id)`` in order of id.

    ``pairs(a, b, distance)``: all pairs of rows nearer than
    ``PATTERN_DISTANCE``, each once.  ``known(id, cluster, distance)``: members
    of clusters that exist before, as seen from a row, nearer than that too.

    A row that is in no cluster yet joins that of its nearest member (of equal
    distances the cluster of least name), if there is one and ``accept``, a
    condition on ``id``, ``cluster`` and ``distance``, holds.  Else it leads a
    new cluster, named by its id, which takes every row in no cluster nearer
    than ``GROUP_DISTANCE``.  Rows that a leader took are members for all that come later.

    The step of a row looks at rows near it, and at what led them there, so
    it waits for lesser open ids within two pairs only; without ``accept`` it
    does not even wait for those (``_lead_at_once``).  Cluster names are
    strings; new ones are the leader's id.
    """
    if accept is None:
        return _lead_at_once(rows, pairs, known)
    both = saved(pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).where(F.col("distance") < PATTERN_DISTANCE))
    before = saved(known.where(F.col("distance") < PATTERN_DISTANCE).select(F.col("id").alias("a"), F.col("cluster").cast("string").alias("cluster"), "distance"))
    open_rows = saved(rows.select("id").distinct())
    placed = None
    while open_rows.limit(1).count():
        here = open_rows.select(F.col("id").alias("b"), F.col("id").alias("low"))
        one = open_rows.select("id").join(both.join(here, "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low")), "id", "left")
        least = saved(rows.select("id").distinct().join(both.join(here, "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low")), "id", "left"))
        two = both.join(least.select(F.col("id").alias("b"), "low"), "b").groupBy(F.col("a").alias("id")).agg(F.min("low").alias("low2"))
        ready = one.join(two, "id", "left").where((F.col("low").isNull() | (F.col("low") >= F.col("id"))) & (F.col("low2").isNull() | (F.col("low2") >= F.col("id")))).select("id")
        ready = saved(ready)
        seen = before.select("a", "cluster", "distance")
        if placed is not None:
            seen = seen.unionByName(both.join(placed.select(F.col("id").alias("b"), "cluster"), "b").select("a", "cluster", "distance"))
        nearest = seen.join(ready.select(F.col("id").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct("distance", "cluster")).alias("best")).select(F.col("a").alias("id"), "best.cluster", "best.distance")
        joins = saved(nearest if accept is None else nearest.where(accept))
        leaders = ready.join(joins, "id", "left_anti")
        taken = both.where(F.col("distance") < GROUP_DISTANCE).join(leaders.select(F.col("id").alias("a")), "a").join(open_rows.select(F.col("id").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").cast("string").alias("cluster"))
        step = joins.select("id", "cluster", F.lit("joined").alias("how")).unionByName(leaders.select("id", F.col("id").cast("string").alias("cluster"), F.lit("leader").alias("how"))).unionByName(taken.select("id", "cluster", F.lit("grouped").alias("how")))
        step = saved(step)
        placed = step if placed is None else saved(placed.unionByName(step))
        open_rows = saved(open_rows.join(step.select("id"), "id", "left_anti"))
    return placed if placed is not None else open_rows.select("id", F.lit("").alias("cluster"), F.lit("").alias("how"))
