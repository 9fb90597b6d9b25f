"""Situations: which signals describe one occurrence.

Two kinds of evidence connect signals.  A link that a person set in the source
system (a child of an incident, a duplicate) always does.  Without one, two
signals are connected only if they share an item, lie within the window of each
other, share a symptom signature and do not state different environments.
Other links, such as a shared problem, say something about causes and connect
nothing.  An item with more than ``HUB`` signals is infrastructure that all
kinds of work touch: it anchors no inferred connection.

As an item that counts has at most ``HUB`` signals, the join by item makes at
most ``HUB`` rows of each one, however hot the items of the table are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components, saved

#: Window in hours, most signals of an item that is no hub, members of a situation and of a storm.
WINDOW_HOURS, HUB, LEAST_MEMBERS, STORM = 24, 8, 2, 5
MERGING_LINKS = ("child_of_incident", "duplicate_of")


def hub_items(items: DataFrame, hub: int = HUB) -> DataFrame:
    """``item`` of those that more than ``hub`` different signals touch."""
    return items.select("id", "item").distinct().groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("item")


def inferred_links(signals: DataFrame, items: DataFrame, signatures: DataFrame, window_hours: float = WINDOW_HOURS, hub: int = HUB) -> DataFrame:
    """``a, b`` (a < b) of signals that agree in item, time and symptom.

    ``signals(id, at, environment)``, ``items(id, item)``,
    ``signatures(id, signature)``.  Undated signals agree with nothing; an
    environment that is not stated disagrees with nothing.
    """
    known = items.select("id", "item").where("item IS NOT NULL").distinct().join(signals.select("id"), "id", "left_semi")
    plain = known.join(hub_items(known, hub), "item", "left_anti")
    symptoms = signatures.where("signature IS NOT NULL").groupBy("id").agg(F.collect_set("signature").alias("symptoms"))
    rows = saved(plain.join(signals.where("at IS NOT NULL"), "id").join(symptoms, "id").select("item", "id", "at", "environment", "symptoms"))
    a, b = rows.alias("a"), rows.alias("b")
    gap = F.abs(F.unix_micros(F.col("a.at").cast("timestamp")) - F.unix_micros(F.col("b.at").cast("timestamp")))
    same_place = F.col("a.environment").isNull() | F.col("b.environment").isNull() | (F.col("a.environment") == F.col("b.environment"))
    agree = (F.col("a.item") == F.col("b.item")) & (F.col("a.id") < F.col("b.id")) & (gap <= int(window_hours * 3_600_000_000)) & same_place
    return a.join(b, agree & F.arrays_overlap("a.symptoms", "b.symptoms")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def merging_links(signals: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b`` of the links between two of the signals that say "the same occurrence"."""
    ids = signals.select("id")
    kept = links.where(F.col("kind").isin(*MERGING_LINKS) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    return kept.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def set_fingerprint(count: str, ids: str):
    """Aggregate that names a set of ids whatever their order, without a list of them: the sums of two numbers made of each id's digest."""
    half = lambda k: F.sum(F.conv(F.substring(F.md5(F.col(ids).cast("string")), 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    return F.sha2(F.concat_ws(":", F.count(count).cast("string"), half(0).cast("decimal(38,0)").cast("string"), half(1).cast("decimal(38,0)").cast("string")), 256)


def correlate(signals: DataFrame, items: DataFrame, signatures: DataFrame, links: DataFrame, window_hours: float = WINDOW_HOURS, hub: int = HUB) -> DataFrame:
    """The members of every situation.

    ``situation, id, at, role, method, status, confidence, kind, state,
    situation_confidence, onset, last_signal, members, fingerprint``; the
    situation is named by its least id.  A member with a link that a person
    set is confirmed, others are inferred.  The earliest member is the primary
    one (of equal times that of least id; undated ones last).
    """
    signals = saved(signals.select("id", "at", "environment"))
    sure = saved(merging_links(signals, links))
    likely = saved(inferred_links(signals, items, signatures, window_hours, hub))
    linked = sure.unionByName(likely)
    touched = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).distinct()
    groups = components(touched, linked).select(F.col("node").alias("id"), F.col("comp").alias("situation"))
    confirmed = sure.select(F.col("a").alias("id")).unionByName(sure.select(F.col("b").alias("id"))).distinct().withColumn("sure", F.lit(True))
    members = saved(groups.join(signals, "id").join(confirmed, "id", "left").withColumn("sure", F.coalesce("sure", F.lit(False))))
    first = F.min(F.struct(F.col("at").isNull(), "at", "id"))
    about = members.groupBy("situation").agg(
        F.count("*").alias("members"), F.bool_or("sure").alias("any_sure"), F.min("at").alias("onset"), F.max("at").alias("last_signal"), first["id"].alias("primary"), set_fingerprint("id", "id").alias("fingerprint")
    )
    kind = F.when(F.col("members") >= STORM, "incident_storm").when(F.col("any_sure"), "degradation").otherwise("unknown")
    return members.join(about.where(F.col("members") >= LEAST_MEMBERS), "situation").select(
        "situation", "id", "at", F.when(F.col("id") == F.col("primary"), "primary_incident").otherwise("related_incident").alias("role"),
        F.when(F.col("sure"), "authoritative").otherwise("inferred").alias("method"), F.when(F.col("sure"), "confirmed").otherwise("inferred").alias("status"), F.when(F.col("sure"), 0.95).otherwise(0.5).alias("confidence"),
        kind.alias("kind"), F.when(F.col("any_sure"), "active").otherwise("emerging").alias("state"), F.when(F.col("any_sure"), 0.9).otherwise(0.5).alias("situation_confidence"),
        "onset", "last_signal", "members", "fingerprint",
    )


def situation_changes(found: DataFrame, stored: DataFrame) -> DataFrame:
    """What a run does to the stored situations: ``situation, stored, action, new_members``.

    ``found`` has a row for each member of a group, ``stored(stored, id, onset, fingerprint)``
    one for each member of a live situation.  One shared member makes a found
    group that situation seen again; of several the one of earliest onset
    takes it (then the least name, without an onset last), and none is merged.
    Without any it is created; with new members it is extended; with fewer it
    is updated; a set that is the same writes nothing.
    """
    groups = found.select("situation", "id", "fingerprint")
    shared = groups.join(stored.select("stored", "id", "onset", F.col("fingerprint").alias("known")), "id")
    owner = shared.groupBy("situation").agg(F.min_by(F.struct("stored", "known"), F.struct(F.col("onset").isNull(), "onset", "stored")).alias("owner"))
    owned = groups.join(owner, "situation", "left").select("situation", "id", "fingerprint", F.col("owner.stored").alias("stored"), F.col("owner.known").alias("known"))
    here = stored.select("stored", "id", F.lit(1).alias("old"))
    fresh = owned.join(here, ["stored", "id"], "left").groupBy("situation", "stored").agg(F.count(F.when(F.col("old").isNull(), 1)).alias("new_members"), (F.first("fingerprint") == F.first("known")).alias("same"))
    action = F.when(F.col("stored").isNull(), "create").when(F.col("new_members") > 0, "extend").when(F.col("same"), "keep").otherwise("update")
    return fresh.select("situation", "stored", action.alias("action"), "new_members")
