"""Duplicates by content, containment and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import saved

#: Items of a set whose pairs are listed; a larger set meets the others by single items.
PAIRED = 24


def _sets(rows: DataFrame) -> DataFrame:
    """``id, items``: the distinct items of each id, in order."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _pairs(items: Column) -> Column:
    """All pairs (x, y), x before y, of an array."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def overlaps(rows: DataFrame) -> DataFrame:
    """``a, b, shared``: ids a < b of ``rows(id, item)`` that have two items or more in common, and how many.

    Two such sets share a pair of items, and few others do, so sets meet by
    the pairs of their items: s common items are s (s - 1) / 2 common pairs.
    A set of more than ``PAIRED`` items, which has too many pairs, meets all
    others by single items.
    """
    sets = _sets(rows.where("id IS NOT NULL AND item IS NOT NULL")).where(F.size("items") >= 2)
    small = F.size("items") <= PAIRED
    at = sets.where(small).select("id", F.explode(_pairs(F.col("items"))).alias("p")).select("id", "p.*")
    a, b = at.alias("a"), at.alias("b")
    near = a.join(b.hint("merge"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.id") < F.col("b.id")))
    few = near.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("n"))
    shared = few.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))
    one = sets.select("id", F.size("items").alias("m"), F.explode("items").alias("item"))
    large, other = one.where(F.col("m") > PAIRED).alias("a"), one.alias("b")
    once = (F.col("a.id") < F.col("b.id")) | (F.col("b.m") <= PAIRED)  # two large ones meet once
    met = large.join(other.hint("merge"), (F.col("a.item") == F.col("b.item")) & (F.col("a.id") != F.col("b.id")) & once)
    many = met.groupBy(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 2")
    return shared.unionByName(many)


def contained_sets(rows: DataFrame) -> DataFrame:
    """Ids of ``rows(id, item)`` whose items another id has as well; of equal sets all but the least id.

    Equal sets are found by their items.  A set of one item is contained if a
    larger one has it.  Any other meets those larger ones that have its two
    rarest items; of these few the items are compared.  Larger sets of more
    than ``PAIRED`` items, whose pairs are too many, are met by the rarest
    item alone.  An unknown item is never contained, but makes a set larger.
    """
    nul = F.max(F.col("item").isNull().cast("int")).alias("nul")
    sets = rows.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), nul).where(F.size("items") > 0)
    kept = saved(sets.groupBy("items", "nul").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    equal = sets.where("nul = 0").join(kept.where("copies > 1 AND nul = 0").select("items", F.col("id").alias("kept")), "items").where("id <> kept").select("id")
    distinct = kept.select("id", "items", "nul", (F.size("items") + F.col("nul")).alias("n"))
    one = distinct.select("id", "n", "nul", F.explode("items").alias("item"))
    commonness = one.groupBy("item").agg(F.count("*").alias("holders"), F.max("n").alias("most"))
    about = one.where("nul = 0").join(commonness, "item").groupBy("id", "n").agg(F.slice(F.array_sort(F.collect_list(F.struct("holders", "item"))), 1, 2).alias("rare"), F.max("most").alias("most"))
    single = about.where("n = 1 AND most > 1").select("id")
    rare = about.where("n > 1").select("id", "n", F.col("rare")[0]["item"].alias("p"), F.col("rare")[1]["item"].alias("q"))
    paired = distinct.where(F.col("n").between(3, PAIRED)).select(F.col("id").alias("other"), F.col("n").alias("m"), F.explode(_pairs(F.col("items"))).alias("p")).select("other", "m", "p.*")
    few = rare.where(F.col("n") < PAIRED).select("id", "n", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).join(paired.hint("merge"), ["x", "y"]).where("m > n").select("id", "other")
    large = one.where(F.col("n") > PAIRED).select(F.col("id").alias("other"), F.col("n").alias("m"), "item")
    many = rare.select("id", "n", F.col("p").alias("item")).join(large, "item").where("m > n").select("id", "other")
    met = few.unionByName(many).join(distinct.select("id", "items"), "id").join(distinct.select(F.col("id").alias("other"), F.col("items").alias("of")), "other")
    contained = met.where(F.size(F.array_except("items", "of")) == 0).select("id").distinct()
    # A copy of a contained set is contained as well; a copy of another one goes too.
    return single.unionByName(contained).unionByName(equal).distinct()
