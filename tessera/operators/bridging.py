"""Messages as members of the cases that they name, inherit from what they reply to, deny or correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.operators.graph import saved

LEDGER = ("message", "case_id", "relationship", "location", "confidence", "status")


def climb(links: DataFrame) -> DataFrame:
    """``node, root, steps`` of ``links(node, up)``, a forest: the end of each node's path, in rounds that double the steps."""
    cur = saved(links.select("node", "up", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")))
    while cur.where("open").limit(1).count():
        ahead = cur.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        moved = cur.join(ahead, "up", "left")
        cur = saved(moved.select("node", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("open")))
    return cur.select("node", F.col("up").alias("root"), "steps")


def _named(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """The surest place of each number in each message, with its case, or how many have it."""
    cases = tickets.groupBy("token").agg(F.min("case_id").alias("case_id"), F.countDistinct("case_id").alias("n"))
    found = messages.select("message", F.explode(M.places(F.col("title"), F.col("body"), F.col("cards"))).alias("p")).select("message", "p.*").where("token <> ''")
    return found.groupBy("message", "token").agg(F.min(F.struct("rank", "location")).alias("p")).select("message", "token", "p.*").join(cases, "token", "left")


def _flags(messages: DataFrame) -> DataFrame:
    label, sure = F.col("function"), F.col("function_confidence")
    return messages.select("message", "thread", "at", "reply_to", F.coalesce("is_bot", F.lit(False)).alias("is_bot"), "function_confidence", M.dissociates(label, sure, F.col("title"), F.col("body")).alias("denies"), M.corrects(label, sure).alias("corrects"))


def pending(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """``message, token, location`` of numbers that no ticket has yet; bare numbers are no mentions until one has, a denial forgets quoted ones."""
    rows = _named(messages, tickets).where("n IS NULL AND location <> 'numeric_candidate'").join(_flags(messages).select("message", "denies"), "message")
    return rows.where("NOT denies OR location <> 'quoted_body'").select("message", "token", F.when(F.col("denies"), "dissociation").otherwise(F.col("location")).alias("location"))


def settled(waiting: DataFrame, tickets: DataFrame) -> DataFrame:
    """Ledger rows of ``pending`` mentions whose number ``tickets`` has now; a number of several cases still waits."""
    one = tickets.groupBy("token").agg(F.min("case_id").alias("case_id"), F.countDistinct("case_id").alias("n")).where("n = 1")
    at = F.col("location")
    sure = F.when(at == "dissociation", M.NEGATIVE_CONFIDENCE).when(at == "transcript_normalized", M.TRANSCRIPT_CONFIDENCE).when(at == "quoted_body", M.QUOTED_CONFIDENCE).when(at == "subject", M.SUBJECT_CONFIDENCE).otherwise(M.BODY_CONFIDENCE)
    kind = F.when(at == "dissociation", "dissociation").when(at == "quoted_body", "mentioned_only").otherwise("explicit_reference")
    rows = waiting.join(one, "token").select("message", "case_id", kind.alias("relationship"), "location", sure.alias("confidence"), F.when(at == "dissociation", "negative").otherwise("active").alias("status"))
    first = F.row_number().over(Window.partitionBy("message", "case_id").orderBy(F.desc("confidence"), "location"))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def ledger(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row of each message and case: ``message, case_id, relationship, location, confidence, status``.

    ``messages(message, thread, at, reply_to, title, body, cards, is_bot,
    function, function_confidence)`` with unique ``message``;
    ``tickets(token, case_id)``, a number of several cases says nothing.

    Of several numbers of one case the surest place counts: card, subject, own
    text, quoted text, spelt out, bare number.  A message with three cases or
    more (quoted ones count half) only mentions them.  A message that denies
    gives ``negative`` rows, which no later message of its thread overrules.
    A reply inherits the one case of the message before it, along whole
    chains, unless it denies or corrects, mentions the case already, or the
    thread denied it before; of several cases nothing is inherited.  Replies
    whose parent isn't earlier, or isn't there, inherit nothing.  A correction
    then marks what its target (what it replies to, else the message before it
    in the thread) was told or inherited ``corrected``, and gives it the one
    case that it names itself.  Ties in ``at`` are ordered by ``message``.

    Chains are climbed in doubling steps, so long threads take few rounds and
    no thread is held in one task.  No number of a message is left out.
    """
    facts = saved(_flags(messages))
    known = saved(_named(messages, tickets).where("n = 1").select("message", "case_id", "rank", "location").join(facts.drop("reply_to"), "message"))
    when = F.struct("at", "message")

    negative = known.where("denies AND location <> 'quoted_body'").groupBy("message", "thread", "at", "case_id").agg(F.max(F.coalesce(F.nullif("function_confidence", F.lit(0.0)), F.lit(M.NEGATIVE_CONFIDENCE))).alias("confidence"))
    denied = negative.where("thread IS NOT NULL").groupBy("thread", "case_id").agg(F.min(when).alias("denied"))

    by_case = known.where("NOT denies").groupBy("message", "thread", "at", "is_bot", "case_id").agg(F.min(F.struct("rank", "location")).alias("p"), F.bool_or(F.col("location") != "quoted_body").alias("fresh"))
    digest = F.sum(F.when(F.col("fresh"), 1.0).otherwise(M.QUOTED_WEIGHT)).over(Window.partitionBy("message")) >= M.DIGEST_FROM
    place = F.col("p.location")
    sure = (
        F.when(place == "quoted_body", M.QUOTED_CONFIDENCE)
        .when(place == "bot_card", M.CARD_CONFIDENCE)
        .when(F.col("is_bot"), M.BOT_CONFIDENCE)
        .when(place == "transcript_normalized", M.TRANSCRIPT_CONFIDENCE)
        .when(place == "numeric_candidate", M.NUMERIC_CONFIDENCE)
        .when(F.col("digest"), M.DIGEST_CONFIDENCE)
        .when(place == "subject", M.SUBJECT_CONFIDENCE)
        .otherwise(M.BODY_CONFIDENCE)
    )
    open_to = by_case.withColumn("digest", digest).join(denied, ["thread", "case_id"], "left").where(F.col("denied").isNull() | (F.col("denied") > when))
    told = saved(open_to.select("message", "case_id", F.when(F.col("digest") | (place == "quoted_body"), "mentioned_only").otherwise("explicit_reference").alias("relationship"), place.alias("location"), sure.alias("confidence")))

    own = told.where("relationship <> 'mentioned_only'").groupBy("message").agg(F.count("*").alias("n"), F.min("case_id").alias("own"))
    parents = facts.select(F.col("message").alias("reply_to"), F.struct("at", "message").alias("parent_at"))
    heads = facts.join(parents, "reply_to", "left").withColumn("parent", F.when((F.col("parent_at") < when) & ~F.col("denies") & ~F.col("corrects"), F.col("reply_to")))
    nodes = saved(heads.join(own, "message", "left").select("message", "thread", "at", "is_bot", "parent", F.coalesce("n", F.lit(0)).alias("n"), "own"))

    def tops(stops: DataFrame) -> DataFrame:
        """``message, top``: the nearest message from its parent on that has cases of its own, or passes nothing on."""
        ends = nodes.where("parent IS NULL OR n > 0").select("message").unionByName(stops).distinct()
        inner = nodes.join(ends, "message", "left_anti").select(F.col("message").alias("node"), F.col("parent").alias("up"))
        paths = climb(inner).select(F.col("node").alias("parent"), "root")
        return nodes.where("parent IS NOT NULL").join(paths, "parent", "left").select("message", F.coalesce("root", "parent").alias("top"))

    def offered(top: DataFrame) -> DataFrame:
        """The case of each message's top, if it has one, and whether the message can't take it."""
        source = nodes.where("n = 1").select(F.col("message").alias("top"), F.col("own").alias("case_id"))
        rows = top.join(source, "top").join(nodes.select("message", "thread", "at", "is_bot", "n", "own"), "message").join(denied, ["thread", "case_id"], "left")
        rows = rows.join(told.where("relationship = 'mentioned_only'").select("message", "case_id", F.lit(True).alias("mentioned")), ["message", "case_id"], "left")
        return rows.withColumn("closed", F.coalesce("mentioned", F.lit(False)) | F.coalesce(F.col("denied") < when, F.lit(False)))

    stops = saved(offered(tops(facts.select("message").limit(0))).where("closed AND n = 0").select("message"))
    chosen = saved(offered(tops(stops).join(stops.select(F.col("message").alias("top")), "top", "left_anti")))
    turns = chosen.where("n = 1 AND NOT closed AND own <> case_id").select(F.col("message").alias("node"), F.col("top").alias("up"))
    several = climb(turns).where("steps % 2 = 1").select(F.col("node").alias("top"))
    fit = chosen.join(several, "top", "left_anti").where("NOT closed").join(told.select("message", "case_id"), ["message", "case_id"], "left_anti")
    inherited = fit.select("message", "case_id", F.lit("reply_inheritance").alias("relationship"), F.lit("reply_structure").alias("location"), F.when(F.col("is_bot"), M.BOT_INHERITED_CONFIDENCE).otherwise(M.INHERITED_CONFIDENCE).alias("confidence"))

    rows = told.unionByName(inherited).withColumn("status", F.lit("active")).unionByName(negative.select("message", "case_id", F.lit("dissociation").alias("relationship"), F.lit("dissociation").alias("location"), "confidence", F.lit("negative").alias("status")))
    previous = F.lag("message").over(Window.partitionBy("thread").orderBy("at", "message"))
    there = facts.select(F.col("message").alias("reply_to"), F.lit(True).alias("there"))
    targets = facts.withColumn("previous", F.when(F.col("thread").isNotNull(), previous)).where("corrects").join(there, "reply_to", "left").select("message", F.when(F.col("there"), F.col("reply_to")).otherwise(F.col("previous")).alias("target")).where("target IS NOT NULL")
    marked = rows.join(targets.select(F.col("target").alias("message"), F.lit(True).alias("_hit")).distinct(), "message", "left")
    correctable = F.col("_hit") & (F.col("status") == "active") & F.col("relationship").isin("explicit_reference", "reply_inheritance")
    marked = saved(marked.withColumn("status", F.when(correctable, "corrected").otherwise(F.col("status"))).select(*LEDGER))
    given = targets.join(own.where("n = 1"), "message").select(F.col("target").alias("message"), F.col("own").alias("case_id")).distinct().join(marked.select("message", "case_id"), ["message", "case_id"], "left_anti")
    return marked.unionByName(given.select("message", "case_id", F.lit("explicit_reference").alias("relationship"), F.lit("correction").alias("location"), F.lit(M.CORRECTED_CONFIDENCE).alias("confidence"), F.lit("active").alias("status")))
