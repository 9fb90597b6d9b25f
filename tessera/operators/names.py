"""Resolution of all mentions at once: identifiers, exact names, then near names that an adjudicator judges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.operators.graph import saved

#: Names or mentions of one hot gram that meet in one task.
BLOCK = 4096


def _grams_of(sets: DataFrame, column: str) -> DataFrame:
    return sets.select("kind", "name", F.explode(column).alias("gram"))


def _best_of(asked: pa.Table, held: pa.Table, most: int) -> pa.Table:
    """``kind, name, known, similarity``: the ``most`` nearest of ``held`` for each row of ``asked``.

    Those above the threshold, or, where a row has a ``word``, those that contain it.
    Counts of common trigrams come from lists of the names that have each, so no pair becomes a row.
    """
    held = held.take(pa.array(np.argsort(np.array(held["known"].to_pylist(), object), kind="stable")))
    known, sets, asking = held["known"].combine_chunks(), held["known_grams"].combine_chunks(), asked["grams"].combine_chunks()
    sizes = pc.list_value_length(sets).to_numpy(zero_copy_only=False)
    coded = sets.flatten().dictionary_encode()
    by = np.argsort(coded.indices.to_numpy(), kind="stable")
    names = np.repeat(np.arange(len(sizes)), sizes)[by]
    lists = np.split(names, np.cumsum(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))[:-1])
    ends = np.append(0, np.cumsum(pc.list_value_length(asking).to_numpy(zero_copy_only=False)))
    codes = pc.fill_null(pc.index_in(asking.flatten(), value_set=coded.dictionary), -1).to_numpy()
    rows, places, likeness, holding = [], [], [], {}
    for k, word in enumerate(asked["word"].to_pylist()):
        met = [lists[c] for c in codes[ends[k] : ends[k + 1]] if c >= 0]
        common = np.bincount(np.concatenate(met), minlength=len(sizes)) if met else np.zeros(len(sizes), np.int64)
        whole = sizes + (ends[k + 1] - ends[k]) - common
        if word is None:
            at = np.flatnonzero(I.NEAR_OF * common > I.NEAR_PARTS * whole)
        else:
            if word not in holding:
                holding[word] = np.flatnonzero(pc.match_substring(known, word).to_numpy(zero_copy_only=False))
            at = holding[word]
        near = common[at] / np.maximum(whole[at], 1)
        if len(at) > most:
            fit = near >= np.partition(near, -most)[-most]
            at, near = at[fit], near[fit]
        first = np.lexsort((at, -near))[:most]
        rows.append(np.full(len(first), k))
        places.append(at[first])
        likeness.append(near[first])
    rows, places = pa.array(np.concatenate(rows)), pa.array(np.concatenate(places).astype(np.int64))
    return pa.table({"kind": asked["kind"].take(rows), "name": asked["name"].take(rows), "known": known.take(places), "similarity": pa.array(np.concatenate(likeness))})


def _met(left: DataFrame, right: DataFrame, most: int, block: int) -> DataFrame:
    """The nearest ``known`` of ``right(kind, gram, known, known_grams)`` for each of ``left(kind, gram, name, grams, word)``, ``most`` of every gram and block.

    A gram with more than ``block`` rows on a side is dealt over blocks on both, and each pair of blocks is one group.
    """
    asked, held = left.groupBy("kind", "gram").agg(F.count("*").alias("asked")), right.groupBy("kind", "gram").agg(F.count("*").alias("held"))
    both = asked.join(held, ["kind", "gram"]).select("kind", "gram", F.ceil(F.col("asked") / block).alias("y_of"), F.ceil(F.col("held") / block).alias("x_of"))
    places = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = left.join(both, ["kind", "gram"]).withColumn("y", F.pmod(F.xxhash64("name"), F.col("y_of"))).withColumn("x", places("x_of")).drop("x_of", "y_of")
    holding = right.join(both, ["kind", "gram"]).withColumn("x", F.pmod(F.xxhash64("known"), F.col("x_of"))).withColumn("y", places("y_of")).drop("x_of", "y_of")
    empty = pa.table({"kind": pa.array([], pa.string()), "name": pa.array([], pa.string()), "known": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        return _best_of(a, b, most) if a.num_rows and b.num_rows else empty

    by = ["kind", "gram", "x", "y"]
    return asking.groupBy(*by).cogroup(holding.groupBy(*by)).applyInArrow(best, "kind string, name string, known string, similarity double")


def _prefixes(sets: DataFrame, frequency: DataFrame) -> DataFrame:
    """The rarest trigrams of each name, as many as a name at the threshold can't all miss; the same order for every name."""
    ranked = _grams_of(sets, "grams").join(frequency, ["kind", "gram"], "left").groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("r"))
    n = F.size("r")
    return ranked.select("kind", "name", F.explode(F.slice("r", F.lit(1), n - F.expr(f"size(r) * {I.NEAR_PARTS} div {I.NEAR_OF}").cast("int"))["gram"]).alias("gram"))


def near_names(mentions: DataFrame, known: DataFrame, most: int = I.MOST_CANDIDATES, block: int = BLOCK) -> DataFrame:
    """The ``most`` nearest identities of each name: ``kind, name, candidates`` with ``array<struct<identity, name, similarity>>``, nearest first.

    ``mentions(kind, name)`` and ``known(kind, identity, name)`` hold normalised
    names; only equal kinds meet.  An identity is a candidate if the trigram
    sets of the two names have a Jaccard similarity above 0.3, or its name
    contains one of the three longest words of the mention.  Equal similarity
    is settled by name, then identity.  Names without a candidate, null and
    empty names have no row; repeated rows count once.

    Both arms are exact.  Equal names are one row.  Pairs over the similarity
    share one of the rarest trigrams of both names, so only those meet; a word
    is looked up by its rarest inner trigram, and only for names that have
    less than ``most`` identities over the similarity, as those come first.
    """
    distinct = lambda df: df.where("name <> ''").select("kind", "name").distinct().withColumn("grams", I.trigrams(F.col("name")))
    asked = saved(distinct(mentions))
    held = saved(known.where("name <> ''").groupBy("kind", "name").agg(F.slice(F.array_sort(F.collect_set("identity")), 1, most).alias("identities")).withColumn("grams", I.trigrams(F.col("name"))))
    sets = held.select("kind", F.col("name").alias("known"), F.col("grams").alias("known_grams"))
    frequency = _grams_of(held, "grams").groupBy("kind", "gram").agg(F.count("*").alias("df"))

    ask = _prefixes(asked, frequency).join(asked, ["kind", "name"]).withColumn("word", F.lit(None).cast("string"))
    hold = _prefixes(held, frequency).withColumnRenamed("name", "known").join(sets, ["kind", "known"])
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("similarity"), "known"))
    best = lambda pairs: pairs.distinct().withColumn("place", place).where(F.col("place") <= most).drop("place")
    similar = saved(best(_met(ask, hold, most, block)))
    offered = similar.join(held.select("kind", F.col("name").alias("known"), F.size("identities").alias("n")), ["kind", "known"]).groupBy("kind", "name").agg(F.sum("n").alias("n"))
    few = asked.join(offered.where(F.col("n") >= most), ["kind", "name"], "left_anti")

    inner = _grams_of(held.withColumn("inner", I.inner_trigrams(F.col("name"))), "inner")
    rare = inner.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    words = few.select("kind", "name", "grams", F.explode(I.longest_words(F.col("name"))).alias("word"))
    looked = words.select("kind", "name", "word", "grams", F.explode(I.inner_trigrams(F.col("word"))).alias("gram")).join(rare, ["kind", "gram"], "left").groupBy("kind", "name", "word").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"), F.first("grams").alias("grams"))
    containing = _met(looked.where("r.df > 0").select("kind", "r.gram", "name", "grams", "word"), inner.withColumnRenamed("name", "known").join(sets, ["kind", "known"]), most, block)

    scored = best(similar.unionByName(containing)).join(held.select("kind", F.col("name").alias("known"), "identities"), ["kind", "known"]).select("kind", "name", "known", F.explode("identities").alias("identity"), "similarity")
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("similarity"), "known", "identity"))).where(F.col("place") <= most)
    return placed.groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("place", "identity", "known", "similarity"))).alias("c")).select(
        "kind", "name", F.transform("c", lambda x: F.struct(x["identity"].alias("identity"), x["known"].alias("name"), x["similarity"].alias("similarity"))).alias("candidates")
    )


def nearest(name: Column, candidates: Column) -> Column:
    """Adjudicator without a model: the nearest candidate, as sure as it is similar; a tie for the first place needs a review."""
    first, second = F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))
    clear = second.isNull() | (first["similarity"] > second["similarity"])
    return F.struct(F.when(clear, "match").otherwise("needs_review").alias("decision"), first["identity"].alias("identity"), F.round(first["similarity"], 6).alias("confidence"))


def resolve(mentions: DataFrame, identities: DataFrame, aliases: DataFrame, identifiers: DataFrame, adjudicate: Callable[[Column, Column], Column] = nearest) -> DataFrame:
    """Every mention with ``identity, method, confidence, candidates``; other columns pass through, those of these names are replaced.

    ``mentions(entity_type, name, strong)`` with ``strong`` an
    ``array<struct<kind, value>>``; ``identities(identity, entity_type, name,
    active)``, ``aliases(identity, alias)``, ``identifiers(kind, value,
    identity)``.  In this order, the first that applies:

    ``no_name``: null or blank.  ``strong:<kind>`` (1.0): the first identifier
    that has an owner, of any type and inactive ones too.  ``alias_exact``
    (0.95): an active identity of a compatible type has the name or an alias
    equal to it, the least identity of several.  ``facet_type``,
    ``unsupported_type``, ``not_a_name``: no identity may be made of it.
    ``adjudicated``: the adjudicator's match, at least as sure as the type's
    threshold.  ``below_threshold`` or ``abstained``: a review decides.
    ``provisional`` (0.5): nothing is near, or the adjudicator says so.  The
    identity is null unless one is linked.

    Tables may be empty.  A hot name or identifier is looked up once; what it
    gives is joined to its mentions, where adaptive execution splits the rows.
    """
    strong_of = F.transform(F.col("strong"), lambda s: F.struct(s["kind"].alias("kind"), I.normalised(s["value"]).alias("value")))
    rows = mentions.drop("identity", "method", "confidence", "candidates").withColumns({"_type": I.entity_type(F.col("entity_type")), "_name": I.normalised(F.col("name")), "_strong": strong_of})
    rows = rows.withColumn("_kind", I.compatible_kind(F.col("_type")))
    open_identities = identities.where("active").select("identity", I.compatible_kind(I.entity_type(F.col("entity_type"))).alias("kind"), I.normalised(F.col("name")).alias("name"))

    owners = identifiers.groupBy("kind", I.normalised(F.col("value")).alias("value")).agg(F.min("identity").alias("owner"))
    asked = rows.select("_strong").distinct().select("_strong", F.posexplode("_strong").alias("at", "s")).select("_strong", "at", "s.kind", "s.value").where("value <> ''")
    owned = asked.join(owners, ["kind", "value"]).groupBy("_strong").agg(F.min_by(F.struct("owner", "kind"), "at").alias("_owned"))

    named = open_identities.select("identity", "kind", "name").unionByName(aliases.select("identity", I.normalised(F.col("alias")).alias("name")).join(open_identities.select("identity", "kind"), "identity").select("identity", "kind", "name"))
    exact = named.groupBy(F.col("kind").alias("_kind"), F.col("name").alias("_name")).agg(F.min("identity").alias("_exact"))

    found = rows.join(owned, "_strong", "left").join(exact, ["_kind", "_name"], "left")
    reason = I.rejection_reason(F.col("_type"), F.col("name"), F.transform("_strong", lambda s: s["kind"]))
    settled = found.withColumn("_reason", F.when(F.coalesce(F.col("_name"), F.lit("")) == "", "no_name").when(F.col("_owned").isNotNull(), F.concat(F.lit("strong:"), F.col("_owned.kind"))).when(F.col("_exact").isNotNull(), "alias_exact").otherwise(reason))
    near = near_names(settled.where("_reason IS NULL").select(F.col("_kind").alias("kind"), F.col("_name").alias("name")), open_identities)
    judged = settled.join(near.select(F.col("kind").alias("_kind"), F.col("name").alias("_name"), "candidates"), ["_kind", "_name"], "left")
    judged = judged.withColumn("candidates", F.when(F.col("_reason").isNull(), F.col("candidates"))).withColumn("_verdict", F.when(F.col("candidates").isNotNull(), adjudicate(F.col("name"), F.col("candidates"))))

    decision, sure = F.col("_verdict.decision"), F.col("_verdict.confidence")
    offered = F.exists("candidates", lambda c: c["identity"] == F.col("_verdict.identity"))
    linked = (decision == "match") & offered & (sure >= I.link_threshold(F.col("_type")))
    method = F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(linked, "adjudicated").when(decision == "match", "below_threshold").when(decision == "needs_review", "abstained").otherwise("provisional")
    identity = F.when(F.col("method").startswith("strong:"), F.col("_owned.owner")).when(F.col("method") == "alias_exact", F.col("_exact")).when(F.col("method") == "adjudicated", F.col("_verdict.identity"))
    confidence = F.when(F.col("method").startswith("strong:"), 1.0).when(F.col("method") == "alias_exact", 0.95).when(F.col("method").isin("adjudicated", "below_threshold", "abstained"), sure).when(F.col("method") == "provisional", 0.5)
    return judged.withColumn("method", method).withColumns({"identity": identity, "confidence": confidence}).drop("_type", "_name", "_kind", "_strong", "_owned", "_exact", "_reason", "_verdict")
