"""Message threads: quotes, signatures, repeated lines, technical content, ticket numbers and their bridging to cases.

The messages are the turns of ``conversations`` in the shape of mails: each
has a sender, a subject and a body with signature, footer, delivery notes and
the message before it quoted in one of three styles, all by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.functions import text as T
from tessera.plans.registry import load, query

_BODY = """text
 || CASE WHEN turn % 2 = 0 THEN ' see INC' || (100000 + (conv_id * 7 + turn) % 30) ELSE '' END
 || CASE WHEN conv_id % 9 = 4 AND turn = 0 THEN chr(10) || 'Open: INC100001, INC100002, INC100003 and OPS-77' ELSE '' END
 || CASE WHEN conv_id % 10 = 6 AND turn = 1 THEN chr(10) || 'This is not related to INC' || (100000 + conv_id % 30) || '.' ELSE '' END
 || CASE WHEN conv_id % 6 = 5 THEN chr(10) || 'restart v8.2.5 on 10.0.0.' || (turn + 1) || ' failed with error code 503' ELSE '' END
 || CASE turn % 4 WHEN 1 THEN chr(10) || 'Thanks and regards,' || chr(10) || 'Sam Doe' || chr(10) || 'Mobile: +1 555 010 1234'
    WHEN 2 THEN chr(10) || 'Thanks' || chr(10) || 'One more thing, since the agent on the second host is still down after all of these changes.' || chr(10) || 'And the third host has shown the very same state for two days now, without any other change.'
    WHEN 3 THEN chr(10) || 'Cheers' || chr(10) || 'Kim' ELSE '' END
 || CASE WHEN conv_id % 5 = 1 THEN chr(10) || 'This e-mail is confidential and intended only for its recipient.' ELSE '' END
 || CASE WHEN conv_id % 7 = 2 THEN chr(10) || 'Follow us' || chr(10) || 'https://desk.example/a | https://desk.example/b' || chr(10) || 'www.desk.example' ELSE '' END
 || CASE WHEN conv_id % 11 = 3 AND turn = 2 THEN chr(10) || 'Delivery has failed to these recipients. The message was undeliverable.' ELSE '' END
 || CASE WHEN prev IS NULL THEN '' WHEN turn % 3 = 0 THEN chr(10) || 'On Mon, 1 Jan 2024 at 10:00, Ann Lee wrote:' || chr(10) || prev
    WHEN turn % 3 = 1 THEN chr(10) || '-----Original Message-----' || chr(10) || prev ELSE chr(10) || '> ' || replace(prev, chr(10), chr(10) || '> ') || chr(10) || 'As said: ' || prev END"""
_SENDER = "CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN 'Mail Delivery Subsystem' ELSE role END"
_SUBJECT = "CASE WHEN conv_id % 3 = 0 THEN 'Re: INC' || (100000 + conv_id % 30) ELSE 'Question ' || conv_id END"
MAIL = f"m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), mail AS (SELECT conv_id, turn, {_SENDER} AS sender, {_SUBJECT} AS subject, {_BODY} AS body FROM m)"


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = load(spark, sf_dir, "conversations").withColumn("prev", before).withColumn("text", F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", F.expr(_SENDER).alias("sender"), F.expr(_SUBJECT).alias("subject"), F.expr(_BODY).alias("body"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"
_RSTRIP = r"regexp_replace({0}, '\s+\z', '')"
_FRESH = _STRIP.format(f"array_to_string(list_filter(string_split(regexp_replace(replace(body, chr(13) || chr(10), chr(10)), {_q(M.CUT)}, ''), chr(10)), lambda x: NOT regexp_matches(x, {_q(M.QUOTED_LINE)})), chr(10))")


@query("f19_quote_strip", f"WITH {MAIL} SELECT conv_id, turn, {_FRESH} AS fresh FROM mail")
def quote_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail(spark, sf_dir).select("conv_id", "turn", M.fresh_text(F.col("body")).alias("fresh"))


# Steps of the cut: disclaimer, signature, link menu.
_LEGAL = f"CASE WHEN regexp_matches(b0, {_q(M.LEGAL)}) THEN {_RSTRIP.format(f'regexp_replace(b0, {_q(M.LEGAL)}, {_q(str())})')} ELSE b0 END"
_CUT_STEPS = f"""s0 AS (SELECT *, {_FRESH} AS b0 FROM mail), s1 AS (SELECT *, string_split({_LEGAL}, chr(10)) AS l1 FROM s0),
 s2 AS (SELECT *, list_max(list_transform(range(1, len(l1) + 1), lambda i: CASE WHEN regexp_matches(l1[i], {_q(M.SIGN_OFF)}) THEN i END)) AS at1 FROM s1),
 s3 AS (SELECT *, l1[at1:] AS t1, list_filter(list_transform(l1[at1:], lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS f1 FROM s2),
 s4 AS (SELECT *, CASE WHEN at1 IS NOT NULL AND len(f1) > 0 AND length(array_to_string(t1, chr(10))) <= 600 AND len(list_filter(f1, lambda x: length(x) > 60)) <= 1
        AND (regexp_matches(array_to_string(t1, chr(10)), {_q(M.CONTACT)}) OR (len(list_filter(f1, lambda x: length(x) > 60)) = 0 AND len(f1) <= 4)) THEN {_RSTRIP.format("array_to_string(l1[:at1 - 1], chr(10))")} ELSE array_to_string(l1, chr(10)) END AS b2 FROM s3),
 s5 AS (SELECT *, string_split(b2, chr(10)) AS l2 FROM s4),
 s6 AS (SELECT *, coalesce(list_max(list_transform(range(1, len(l2) + 1), lambda i: CASE WHEN {_STRIP.format('l2[i]')} <> '' AND NOT regexp_matches(l2[i], {_q(M.LINK)}) AND length({_STRIP.format('l2[i]')}) > 60 THEN i END)), 0) AS at2 FROM s5),
 s7 AS (SELECT *, {_STRIP.format(f"CASE WHEN length(array_to_string(l2[at2 + 1:], chr(10))) <= 800 AND len(regexp_extract_all(array_to_string(l2[at2 + 1:], chr(10)), {_q(M.LINK)})) >= 2 THEN array_to_string(l2[:at2], chr(10)) ELSE b2 END")} AS b3 FROM s6),
 cut AS (SELECT conv_id, turn, sender, body, CASE WHEN b3 = '' THEN b0 ELSE b3 END AS kept FROM s7)"""


@query("f20_boilerplate_strip", f"WITH {MAIL}, {_CUT_STEPS} SELECT conv_id, turn, kept FROM cut")
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes first, then disclaimer, signature and link menu at the end."""
    return mail(spark, sf_dir).select("conv_id", "turn", M.without_boilerplate(M.fresh_text(F.col("body"))).alias("kept"))


_BOUNCE = "(" + " OR ".join(f"contains(lower(sender), '{s}')" for s in M.AUTOMATED_SENDERS) + " OR " + " + ".join(f"CASE WHEN regexp_matches(body, {_q('(?i)' + p)}) THEN 1 ELSE 0 END" for p in T.BOUNCE_PHRASES) + " >= 2)"


@query("f21_bounce_with_sender", f"WITH {MAIL} SELECT conv_id, turn, {_BOUNCE} AS bounce FROM mail")
def bounce_with_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mail system's address, or two phrases of a delivery note."""
    return mail(spark, sf_dir).select("conv_id", "turn", (M.automated(F.col("sender")) | T.delivery_failure(F.col("body"))).alias("bounce"))


@query(
    "f22_thread_clean",
    f"""WITH {MAIL}, {_CUT_STEPS}, c AS (SELECT *, {_BOUNCE} AS bounce FROM cut),
       l AS (SELECT conv_id, turn, unnest(string_split(kept, chr(10))) AS raw, generate_subscripts(string_split(kept, chr(10)), 1) AS pos FROM c WHERE NOT bounce),
       n AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS norm FROM l),
       r AS (SELECT *, length(norm) >= 40 AND row_number() OVER (PARTITION BY conv_id, lower(norm) ORDER BY turn, pos) > 1 AS again FROM n),
       k AS (SELECT conv_id, turn, {_STRIP.format("coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT again), '')")} AS clean, coalesce(sum(length(raw)) FILTER (WHERE again), 0) AS deduped FROM r GROUP BY 1, 2)
       SELECT c.conv_id, c.turn, coalesce(clean, '') AS clean, length(body) AS original_chars, coalesce(length(clean), 0) AS kept_chars, length(body) - coalesce(length(clean), 0) AS removed_chars, CASE WHEN bounce THEN 0 ELSE length(body) - length(kept) END AS quote_stripped_chars,
              CAST(coalesce(deduped, 0) AS BIGINT) AS dedupe_removed_chars, NOT bounce AND {_STRIP.format('body')} <> '' AND coalesce(clean, '') = '' AS is_quote_only, bounce AS is_delivery_failure FROM c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn""",
)
def thread_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message with what its thread has not said before, and what was taken out.  Delivery notes say nothing and are not remembered."""
    return clean_threads(mail(spark, sf_dir))


def clean_threads(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, sender, body)``; no message is dropped.

    A line of 40 characters or more counts once in a thread, in order of
    arrival; the window is by thread and line, so a long thread is split.
    """
    body = F.coalesce("body", F.lit(""))
    bounce = M.automated(F.col("sender")) | T.delivery_failure(body)
    judged = messages.select("conv_id", "turn", body.alias("body"), bounce.alias("bounce")).withColumn("kept", F.when(~F.col("bounce"), M.without_boilerplate(M.fresh_text(F.col("body")))))
    lines = judged.where("NOT bounce").select("conv_id", "turn", F.posexplode(M.lines_of(F.col("kept"))).alias("pos", "raw"))
    norm = F.trim(F.regexp_replace("raw", r"\s+", " "))
    first = F.row_number().over(Window.partitionBy("conv_id", F.md5(F.lower(norm).cast("binary"))).orderBy("turn", "pos"))
    seen = lines.withColumn("again", (F.length(norm) >= M.LEAST_REPEATED_LINE) & (first > 1))
    kept = F.transform(F.array_sort(F.collect_list(F.when(~F.col("again"), F.struct("pos", "raw")))), lambda x: x["raw"])
    by_message = seen.groupBy("conv_id", "turn").agg(M.strip(F.array_join(kept, "\n")).alias("clean"), F.sum(F.when(F.col("again"), F.length("raw")).otherwise(0)).alias("deduped"))
    clean = F.coalesce("clean", F.lit(""))
    return judged.join(by_message, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", clean.alias("clean"), F.length("body").cast("long").alias("original_chars"), F.length(clean).cast("long").alias("kept_chars"), (F.length("body") - F.length(clean)).cast("long").alias("removed_chars"),
        F.when(F.col("bounce"), 0).otherwise(F.length("body") - F.length("kept")).cast("long").alias("quote_stripped_chars"), F.coalesce("deduped", F.lit(0)).cast("long").alias("dedupe_removed_chars"),
        (~F.col("bounce") & (M.strip(F.col("body")) != "") & (clean == "")).alias("is_quote_only"), F.col("bounce").alias("is_delivery_failure"),
    )


_CLEANED = f"regexp_replace(body, {_q(M.ANY_MARKUP)}, ' ', 'g')"
_TECHNICAL = "(" + " OR ".join(f"regexp_matches({_CLEANED}, {_q(p)})" for p in M.TECHNICAL) + ")"
_CONTENT = f"length({_STRIP.format(f'''regexp_replace(regexp_replace({_CLEANED}, {_q(M.SIGNATURE_START)}, ''), {_q(M.FOOTER_LINE)}, ' ', 'g')''')})"


@query("f23_technical_signal", f"WITH {MAIL} SELECT conv_id, turn, {_TECHNICAL} AS technical, {_CONTENT} AS content_chars, CASE WHEN {_CONTENT} = 0 THEN 'empty' WHEN {_CONTENT} < 150 AND NOT {_TECHNICAL} THEN 'coordination_only' END AS noise FROM mail")
def technical_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen signs, on text without mark-up; short *and* featureless messages are noise."""
    length, technical = M.content_length(F.col("body")), M.technical(F.col("body"))
    return mail(spark, sf_dir).select("conv_id", "turn", technical.alias("technical"), length.cast("long").alias("content_chars"), F.when(length == 0, "empty").when((length < M.LEAST_DIAGNOSTIC) & ~technical, "coordination_only").alias("noise"))


# -- clauses and outcomes of every message ---------------------------------------


@query("f10_polarity", f"WITH {MAIL} SELECT conv_id, turn, regexp_matches(regexp_split_to_array(lower(body), {_q('\\b(?:' + '|'.join(T.CLAUSE_BREAKS) + ')\\b')})[1], {_q('\\b(?:' + '|'.join(T.NEGATION_CUES) + ')\\b')}) AS negated FROM mail")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail(spark, sf_dir).select("conv_id", "turn", T.negated(F.col("body")).alias("negated"))


_NEG = f"regexp_matches(regexp_split_to_array(lower(body), {_q('\\b(?:' + '|'.join(T.CLAUSE_BREAKS) + ')\\b')})[1], {_q('\\b(?:' + '|'.join(T.NEGATION_CUES) + ')\\b')})"


@query("f10_polarity_conflicts", f"WITH {MAIL}, n AS (SELECT conv_id, turn, {_NEG} AS negated FROM mail), p AS (SELECT *, lag(negated) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM n) SELECT conv_id, turn, CASE WHEN before = negated THEN 'agree' ELSE 'conflict' END AS polarity FROM p WHERE before IS NOT NULL")
def polarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message against the one before it."""
    n = mail(spark, sf_dir).select("conv_id", "turn", T.negated(F.col("body")).alias("negated")).withColumn("before", F.lag("negated").over(Window.partitionBy("conv_id").orderBy("turn")))
    return n.where("before IS NOT NULL").select("conv_id", "turn", F.when(F.col("before") == F.col("negated"), "agree").otherwise("conflict").alias("polarity"))


_OUT = r"trim(regexp_replace(lower(body), '\s+', ' ', 'g'))"


@query("f33_outcome_classification", f"WITH {MAIL} SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches({_OUT}, {_q(rule)}) THEN '{label}'" for label, rule in T.OUTCOME_GROUPS) + f" ELSE 'unknown' END AS outcome, " + " OR ".join(f"regexp_matches({_OUT}, {_q(rule)})" for _, rule in T.OUTCOME_GROUPS) + " AS recognised FROM mail")
def outcome_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label and whether a rule was met at all."""
    return mail(spark, sf_dir).select("conv_id", "turn", T.outcome(F.col("body")).alias("outcome"), T.outcome_recognised(F.col("body")).alias("recognised"))


# -- ticket numbers --------------------------------------------------------------

_HEAD = f"regexp_replace(body, {_q(M.QUOTE_BLOCK)}, '')"
_FRESH_TOKENS = f"regexp_extract_all(array_to_string(list_filter(string_split({_HEAD}, chr(10)), lambda x: NOT regexp_matches(x, {_q(M.QUOTED_LINE)})), chr(10)), {_q(M.TICKET)})"
_MENTIONS = f"""t AS (SELECT conv_id, turn, subject, body, {_FRESH_TOKENS} AS fresh, regexp_extract_all(body, {_q(M.TICKET)}) AS every, regexp_extract_all(subject, {_q(M.TICKET)}) AS subj FROM mail),
 b AS (SELECT DISTINCT conv_id, turn, unnest(every) AS token, fresh, body FROM t), q AS (SELECT conv_id, turn, token, NOT list_contains(fresh, token) AS quoted, CASE WHEN list_contains(fresh, token) THEN 0.9 ELSE 0.55 END AS confidence FROM b),
 mentions AS (SELECT conv_id, turn, token, bool_and(quoted) AS quoted, max(confidence) AS confidence FROM (SELECT * FROM q UNION ALL SELECT DISTINCT conv_id, turn, unnest(subj), false, 0.98 FROM t) GROUP BY 1, 2, 3)"""


def mentions(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, token, quoted, confidence``: each ticket number of a message at its surest place."""
    body = messages.select("conv_id", "turn", F.explode(M.ticket_mentions(F.col("body"))).alias("m")).select("conv_id", "turn", "m.token", "m.quoted", F.when(F.col("m.quoted"), M.QUOTED_CONFIDENCE).otherwise(M.BODY_CONFIDENCE).alias("confidence"))
    subject = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(M.TICKET), 0))).alias("token")).select("conv_id", "turn", "token", F.lit(False).alias("quoted"), F.lit(M.SUBJECT_CONFIDENCE).alias("confidence"))
    return body.unionByName(subject).groupBy("conv_id", "turn", "token").agg(F.bool_and("quoted").alias("quoted"), F.max("confidence").alias("confidence"))


@query("f36_ticket_mentions", f"WITH {MAIL}, {_MENTIONS} SELECT conv_id, turn, token, quoted, CAST(confidence AS DOUBLE) AS confidence FROM mentions")
def ticket_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(mail(spark, sf_dir))


#: Registered tickets: one a supplier; every tenth number is registered twice and so says nothing.
_TICKETS = "tickets AS (SELECT 'INC' || (100000 + s_suppkey) AS token, s_suppkey AS case_id FROM supplier UNION ALL SELECT 'INC' || (100000 + s_suppkey), -s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)"


@query(
    "g31_ticket_bridge",
    f"""WITH {MAIL}, {_MENTIONS}, {_TICKETS}, one AS (SELECT token, min(case_id) AS case_id FROM tickets GROUP BY 1 HAVING count(*) = 1),
       d AS (SELECT conv_id, turn, sum(CASE WHEN quoted THEN 0.5 ELSE 1 END) >= 3 AS digest FROM mentions GROUP BY 1, 2), x AS (SELECT conv_id, turn, regexp_matches(body, '(?i)\\bnot related to\\b') AS dissociates FROM mail),
       r AS (SELECT m.*, case_id, digest, dissociates FROM mentions m JOIN one USING (token) JOIN d USING (conv_id, turn) JOIN x USING (conv_id, turn)),
       neg AS (SELECT DISTINCT conv_id, case_id FROM r WHERE dissociates AND NOT quoted),
       pos AS (SELECT conv_id, case_id, max(CASE WHEN digest THEN 0.5 ELSE confidence END) AS confidence, bool_and(digest) AS mentioned_only FROM r WHERE NOT dissociates AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.conv_id = r.conv_id AND neg.case_id = r.case_id) GROUP BY 1, 2)
       SELECT conv_id, case_id, CASE WHEN mentioned_only THEN 'mentioned_only' ELSE 'member' END AS kind, CAST(confidence AS DOUBLE) AS confidence FROM pos UNION ALL SELECT conv_id, case_id, 'negative', 1.0 FROM neg""",
)
def ticket_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as members of the cases that their numbers name."""
    suppliers = load(spark, sf_dir, "supplier").select(F.concat(F.lit("INC"), (100000 + F.col("s_suppkey")).cast("string")).alias("token"), F.col("s_suppkey").alias("case_id"))
    tickets = suppliers.unionByName(suppliers.where("case_id % 10 = 0").select("token", (-F.col("case_id")).alias("case_id")))
    return bridge(mail(spark, sf_dir), tickets)


def bridge(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """``conv_id, case_id, kind, confidence``.

    A number counts if exactly one of ``tickets(token, case_id)`` has it.  A
    message that names many numbers is a digest: its cases are only
    mentioned.  A message that takes a case away gives a negative row, which
    the other messages of the thread do not overrule; its quoted numbers are
    ignored.
    """
    single = tickets.groupBy("token").agg(F.min("case_id").alias("case_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = mentions(messages)
    digest = F.sum(F.when(F.col("quoted"), M.QUOTED_WEIGHT).otherwise(1.0)).over(Window.partitionBy("conv_id", "turn")) >= M.DIGEST_FROM
    takes = messages.select("conv_id", "turn", F.col("body").rlike(r"(?i)\bnot related to\b").alias("dissociates"))
    rows = found.withColumn("digest", digest).join(single, "token").join(takes, ["conv_id", "turn"])
    negative = rows.where("dissociates AND NOT quoted").select("conv_id", "case_id").distinct()
    positive = rows.where("NOT dissociates").join(negative, ["conv_id", "case_id"], "left_anti").groupBy("conv_id", "case_id").agg(F.max(F.when(F.col("digest"), M.DIGEST_CONFIDENCE).otherwise(F.col("confidence"))).alias("confidence"), F.bool_and("digest").alias("only"))
    return positive.select("conv_id", "case_id", F.when(F.col("only"), "mentioned_only").otherwise("member").alias("kind"), "confidence").unionByName(negative.select("conv_id", "case_id", F.lit("negative").alias("kind"), F.lit(1.0).alias("confidence")))


@query(
    "st10_retraction",
    f"""WITH {MAIL}, {_MENTIONS}, live AS (SELECT m.* FROM mentions m WHERE NOT (m.conv_id % 4 = 1 AND m.turn = 0))
       SELECT DISTINCT m.conv_id, m.token, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.conv_id = m.conv_id AND l.token = m.token) THEN 'active' ELSE 'retired' END AS status FROM mentions m""",
)
def retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that were deleted (the first of every fourth thread) retire what only they said; nothing is removed."""
    found = mentions(mail(spark, sf_dir))
    gone = (F.col("conv_id") % 4 == 1) & (F.col("turn") == 0)
    return found.groupBy("conv_id", "token").agg(F.bool_or(~gone).alias("live")).select("conv_id", "token", F.when(F.col("live"), "active").otherwise("retired").alias("status"))


# -- the salient part of a thread ------------------------------------------------

BUDGET = 600
_KEPT = f"NOT regexp_matches(line, {_q(M.BOILERPLATE_LINE)}) AND len(regexp_extract_all(line, {_q(M.EMAIL_LIKE)})) < 2 AND length(line) - length(replace(line, '|', '')) < 2"
_SCORE = f"len(regexp_extract_all(regexp_replace(flat, {_q(M.SCORE_NOISE)}, ' ', 'g'), {_q(M.TECH_WORD)})) + len(regexp_extract_all(regexp_replace(flat, {_q(M.SCORE_NOISE)}, ' ', 'g'), {_q(M.CODE_TOKEN)}))"


@query(
    "f24_salient_slice",
    f"""WITH {MAIL}, n AS (SELECT conv_id, turn, translate(body, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', 'ACEEEINOOUsaceeeinoou') AS body FROM mail), w AS (SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY turn) AS whole FROM n GROUP BY 1),
       l AS (SELECT conv_id, turn, pos, {_STRIP.format('raw')} AS line FROM (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM n)),
       c AS (SELECT *, regexp_matches(line, {_q(M.MESSAGE_START)}) AS starts FROM l), g AS (SELECT *, sum(CASE WHEN line = '' OR starts OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS seg FROM c),
       f AS (SELECT conv_id, count(*) FILTER (WHERE starts) >= 2 AS fused FROM c GROUP BY 1),
       s AS (SELECT conv_id, seg, string_agg(line, chr(10) ORDER BY turn, pos) AS text, string_agg(line, ' ' ORDER BY turn, pos) AS flat FROM g WHERE line <> '' AND NOT starts AND {_KEPT} GROUP BY 1, 2),
       u AS (SELECT conv_id, text, min(seg) AS seg, min(flat) AS flat FROM s GROUP BY 1, 2), i AS (SELECT conv_id, text, length(text) AS len, {_SCORE} AS score, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS idx FROM u),
       h AS (SELECT i.*, fused, CASE WHEN fused THEN 0 ELSE least(max(CASE WHEN idx = 0 THEN len END) OVER (PARTITION BY conv_id), 150) END AS head FROM i JOIN f USING (conv_id)),
       r AS (SELECT *, head + coalesce(sum(len + 1) OVER (PARTITION BY conv_id ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE score > 0 AND (fused OR idx > 0)),
       t AS (SELECT conv_id, idx, least(len, 599 - before) AS take FROM r WHERE 599 - before >= 40), z AS (SELECT h.*, CASE WHEN idx = 0 AND NOT fused THEN head ELSE take END AS base FROM h LEFT JOIN t USING (conv_id, idx)),
       p AS (SELECT *, 600 - max(head) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN idx > 0 OR fused THEN base + 1 END) OVER (PARTITION BY conv_id), 0) AS rest, count(base) OVER (PARTITION BY conv_id) AS taken FROM z),
       o AS (SELECT conv_id, left(string_agg(left(text, CAST(CASE WHEN taken = 0 THEN len WHEN idx = 0 AND rest > 0 THEN least(len, base + rest) ELSE base END AS BIGINT)), chr(10) ORDER BY idx) FILTER (WHERE taken = 0 OR base IS NOT NULL), 600) AS slice FROM p GROUP BY 1)
       SELECT w.conv_id, CASE WHEN length(whole) <= 600 THEN whole ELSE coalesce(slice, left(whole, 600)) END AS slice FROM w LEFT JOIN o USING (conv_id)""",
)
def salient_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling 600 characters of every thread."""
    plain = F.translate("body", "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü", "ACEEEINOOUsaceeeinoou")
    return salient_slices(mail(spark, sf_dir).select("conv_id", "turn", plain.alias("body")), BUDGET)


def salient_slices(messages: DataFrame, budget: int) -> DataFrame:
    """``conv_id, slice`` of ``messages(conv_id, turn, body)``.

    A thread within the budget stays as it is.  Otherwise its segments, each
    different one once, take their room in the order of their score, after a
    quarter for the first one unless several messages are fused; what is left
    goes to the first.  Room is a running sum, so no loop is needed.
    """
    thread = Window.partitionBy("conv_id")
    whole = messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "\n\n").alias("whole"))
    lines = messages.select("conv_id", "turn", F.posexplode(M.lines_of(F.col("body"))).alias("pos", "raw")).withColumn("line", M.strip(F.col("raw"))).withColumn("starts", F.col("line").rlike(M.MESSAGE_START))
    breaks = ((F.col("line") == "") | F.col("starts") | (F.col("pos") == 0)).cast("int")
    numbered = lines.withColumn("seg", F.sum(breaks).over(thread.orderBy("turn", "pos")))
    fused = lines.groupBy("conv_id").agg((F.count_if("starts") >= 2).alias("fused"))
    useful = (F.col("line") != "") & ~F.col("starts") & ~F.col("line").rlike(M.BOILERPLATE_LINE) & (F.regexp_count("line", F.lit(M.EMAIL_LIKE)) < 2) & (F.regexp_count("line", F.lit(r"\|")) < 2)
    parts = numbered.where(useful).groupBy("conv_id", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", "line"))), lambda x: x["line"]).alias("lines"))
    once = parts.groupBy("conv_id", F.array_join("lines", "\n").alias("text")).agg(F.min("seg").alias("seg"), F.min(F.array_join("lines", " ")).alias("flat"))
    clean = F.regexp_replace("flat", M.SCORE_NOISE, " ")
    scored = once.select("conv_id", "seg", "text", F.length("text").alias("len"), (F.regexp_count(clean, F.lit(M.TECH_WORD)) + F.regexp_count(clean, F.lit(M.CODE_TOKEN))).alias("score"))
    placed = scored.withColumn("idx", F.row_number().over(thread.orderBy("seg")) - 1).join(fused, "conv_id")
    head = F.when(F.col("fused"), 0).otherwise(F.least(F.max(F.when(F.col("idx") == 0, F.col("len"))).over(thread), F.lit(int(budget * M.HEAD_SHARE))))
    eligible = (F.col("score") > 0) & (F.col("fused") | (F.col("idx") > 0))
    by_score = thread.orderBy(F.desc("eligible"), F.desc("score"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    spent = placed.withColumn("head", head).withColumn("eligible", eligible).withColumn("before", F.col("head") + F.coalesce(F.sum(F.when(F.col("eligible"), F.col("len") + 1)).over(by_score), F.lit(0)))
    room = budget - 1 - F.col("before")
    base = F.when(~F.col("fused") & (F.col("idx") == 0), F.col("head")).when(F.col("eligible") & (room >= M.LEAST_TAKEN), F.least("len", room))
    taken = spent.withColumn("base", base).withColumn("rest", budget - F.col("head") - F.coalesce(F.sum(F.when(F.col("fused") | (F.col("idx") > 0), F.col("base") + 1)).over(thread), F.lit(0))).withColumn("taken", F.count("base").over(thread))
    size = F.when(F.col("taken") == 0, F.col("len")).when(F.col("base").isNotNull(), F.when((F.col("idx") == 0) & (F.col("rest") > 0), F.least("len", F.col("base") + F.col("rest"))).otherwise(F.col("base")))
    chosen = taken.withColumn("size", size).where("size IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.left("text", F.col("size").cast("int")).alias("part")))).alias("p"))
    cut = F.left(F.array_join(F.transform("p", lambda x: x["part"]), "\n"), F.lit(budget))
    return whole.join(chosen, "conv_id", "left").select("conv_id", F.when(F.length("whole") <= budget, F.col("whole")).otherwise(F.coalesce(cut, F.left("whole", F.lit(budget)))).alias("slice"))


# -- topics and signals over a thread ----------------------------------------------


@query(
    "g32_thread_topic",
    f"""WITH {MAIL}, {_MENTIONS}, a AS (SELECT conv_id, turn, arg_min(token, {{'c': -confidence, 't': token}}) AS anchor FROM mentions WHERE NOT quoted GROUP BY 1, 2), topics AS (SELECT m.conv_id, m.turn, CASE WHEN m.sender <> 'assistant' THEN anchor END AS anchor FROM mail m LEFT JOIN a USING (conv_id, turn))
       SELECT conv_id, turn, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), first_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 200 FOLLOWING)) AS topic,
         CASE WHEN last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL THEN 'anchored' WHEN first_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 200 FOLLOWING) IS NOT NULL THEN 'unified' ELSE 'provisional' END AS state FROM topics""",
)
def thread_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case a message speaks of: the last one named before it, else the first one named after it, up to 200 messages back; bots never name one."""
    messages = mail(spark, sf_dir)
    named = mentions(messages).where("NOT quoted").groupBy("conv_id", "turn").agg(F.min_by("token", F.struct(-F.col("confidence"), "token")).alias("anchor"))
    turns = messages.select("conv_id", "turn", "sender").join(named, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("sender") != "assistant", F.col("anchor")).alias("anchor"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    so_far, later = F.last("anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("anchor", ignorenulls=True).over(w.rowsBetween(0, 200))
    return turns.select("conv_id", "turn", F.coalesce(so_far, later).alias("topic"), F.when(so_far.isNotNull(), "anchored").when(later.isNotNull(), "unified").otherwise("provisional").alias("state"))
