"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

``source_targets`` gives each source its share of all words: by weight, and at
most ``ceiling`` times what it has, the excess shared again by weight until no
source is above.  A document of a source then has the same fractional number
of copies, target / size.  Whole copies are taken at once.  The fractions are
rounded to 0 or 1 by the pivotal method: two documents meet, one gives the
other as much of its fraction as it can hold, at random in such a way that
every expectation stays, and the one whose fraction is now 0 or 1 leaves.

The meetings form a reduction tree.  On each level the open documents of a
source are dealt, by a hash of their id, size and number, into blocks of about ``fan_in``; a
block is folded in one ``aggregate`` call and passes a single open document
to the next level, which has ``fan_in`` times fewer blocks.  So no task sees
more than a block, whatever the size of a source, and the levels grow with the
logarithm of the rows.  Documents meet others of nearly their own size first:
blocks hold one size class until the last level, which folds what the classes
left over from the largest down.  Each source's words therefore end within a
few documents of its target.

Random numbers are hashes of the two ids, so a rerun gives the same mix.

Nulls: a null text has size 0; a null source is a source like others and comes
last.  Rows of one source, id and size can't be told apart by the result;
they are counted in an aggregation and numbered 0, 1, ... when the counts are
taken apart again, so any number of null or repeated ids is dealt evenly.
Documents of size 0 take nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import load, saved

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
CEILING = 3.0
#: Up to so many sources their rows (some 50 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """One row for each source: ``source, source_size, weight, target``.

    The fair level is found in closed form.  Sources sorted by what they can
    give for each unit of weight fill up in that order; after the first k are
    full, the level of the others is the rest of the words over the rest of
    the weights, and the right k is the first whose next source can take it.
    The windows run over one row a source, after the documents were summed.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("most", F.col("source_size") * ceiling)
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    return levels.withColumn("fair", F.first(fits, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("fair") * F.col("weight"), F.col("most"))).alias("target"))


def _fold(items: str, level: int) -> Column:
    """Fold one block: ``carry`` is the open document, ``done`` those with a whole number."""
    near = lambda p: F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
    made = lambda x, p: F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["nr"].alias("nr"), near(p).alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        a, b = c["p"], x["p"]
        both = a + b
        luck = F.pmod(F.xxhash64(F.lit(level), c["doc_id"], c["nr"], x["doc_id"], x["nr"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
        small = both < 1
        carry_leads = luck * F.when(small, F.greatest(both, F.lit(1e-12))).otherwise(F.greatest(2 - both, F.lit(1e-12))) < F.when(small, a).otherwise(1 - b)
        left_p = F.when(small, F.when(carry_leads, both).otherwise(0.0)).otherwise(F.when(carry_leads, 1.0).otherwise(both - 1))
        left, right = made(c, left_p), made(x, both - left_p)
        left_open = F.when(small, carry_leads).otherwise(~carry_leads)
        return F.struct(F.when(left_open, left).otherwise(right).alias("carry"), F.concat(acc["done"], F.array(F.when(left_open, right).otherwise(left))).alias("done"))

    head = F.element_at(items, 1)
    rest = F.slice(items, 2, F.size(items))
    none = F.slice(F.array(made(head, head["p"])), 1, 0)
    return F.aggregate(rest, F.struct(made(head, head["p"]).alias("carry"), none.alias("done")), meet)


def round_copies(shares: DataFrame, fan_in: int = 48) -> DataFrame:
    """``shares(source, doc_id, size, nr, p)``, 0 < p < 1 -> ``source, doc_id, size, extra`` (0 or 1).

    The expected ``extra`` of each row is its ``p``.
    """
    blocks, levels = math.ceil(shares.count() / (4 * fan_in)), []
    while blocks > 1:
        levels.append(blocks)
        blocks = math.ceil(blocks / fan_in)
    levels += [1, 0]  # a size class left over in one block, then all classes together
    size_class = F.floor(F.log2(F.greatest(F.col("item.size"), F.lit(1)).cast("double")) * 4)
    open_rows = shares.select("source", F.struct("size", "doc_id", "nr", "p").alias("item"))
    finished = []
    for level, blocks in enumerate(levels):
        key = [F.lit(0).alias("size_class"), F.lit(0).alias("block")] if not blocks else [size_class.alias("size_class"), F.pmod(F.xxhash64(F.lit(level), "item.doc_id", "item.size", "item.nr"), F.lit(blocks)).alias("block")]
        grouped = open_rows.select("source", "item", *key).groupBy("source", "size_class", "block").agg(F.reverse(F.array_sort(F.collect_list("item"))).alias("items"))
        folded = saved(grouped.select("source", _fold("items", level).alias("out")))
        finished.append(folded.select("source", F.explode("out.done").alias("item")))
        open_rows = folded.select("source", F.col("out.carry").alias("item"))
    coin = F.pmod(F.xxhash64(F.lit(-1), "item.doc_id", "item.nr"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = open_rows.select("source", "item", (coin < F.col("item.p")).cast("long").alias("extra"))
    for part in finished:
        rows = rows.unionByName(part.select("source", "item", (F.col("item.p") > 0.5).cast("long").alias("extra")))
    return rows.select("source", "item.doc_id", "item.size", "extra")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: float = CEILING, fan_in: int = 48) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, source, text)``."""
    counted = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    targets = saved(source_targets(counted.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, ceiling))
    sized = counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("nr"))
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sent = F.broadcast if small else (lambda t: t)
    with_share = sized.alias("d").join(sent(targets.alias("t")), F.col("d.source").eqNullSafe(F.col("t.source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + 1e-9)
    part = F.greatest(share - whole, F.lit(0.0))
    rows = with_share.select("d.doc_id", "d.source", "d.size", "d.nr", "source_size", "target", whole.cast("long").alias("whole"), part.alias("p"))
    rounds = (F.col("p") > 1e-9) & (F.col("size") > 0)
    extra = round_copies(rows.where(rounds).select("source", "doc_id", "size", "nr", "p"), fan_in)
    # Every document of a source has the same whole copies, so they come back with the source's row.
    per_source = targets.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long").alias("whole"))
    rounded = extra.join(sent(per_source), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))
    plain = rows.where(~rounds).select("doc_id", "source", "size", "source_size", "target", F.col("whole").alias("copies"))
    return rounded.unionByName(plain).withColumn("taken", F.col("size") * F.col("copies"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: how many words each gives, near its source's target."""
    return mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
