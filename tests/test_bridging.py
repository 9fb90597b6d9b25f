"""The ledger of messages and cases against a pass over the messages one by one, and each rule alone."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import messages as M
from tessera.operators import bridging as B

SCHEMA = "message long, thread long, at long, reply_to long, title string, body string, cards array<string>, is_bot boolean, function string, function_confidence double"
TICKETS = [(f"INC{100000 + i}", i) for i in range(6)] + [("4711", 3), ("INC100009", 7), ("INC100009", 8), ("OPS-12345", 5)]


def msg(message, body="", *, thread=1, at=None, reply_to=None, title=None, cards=None, bot=None, function=None, sure=None):
    return (message, thread, message if at is None else at, reply_to, title, body, cards, bot, function, sure)


def rows(spark, messages, tickets=TICKETS):
    got = B.ledger(spark.createDataFrame(messages, SCHEMA), spark.createDataFrame(tickets, "token string, case_id long"))
    return sorted(tuple(r[c] for c in B.LEDGER) for r in got.collect())


def one_by_one(messages):
    """Bodies hold numbers apart by blanks, quoted ones behind ``>`` on lines of their own."""
    cases, out, negated = dict(TICKETS[:6]), {}, set()
    seen = {}
    for m in sorted(messages, key=lambda m: (m[2], m[0])):
        i, thread, at, reply_to, _, body, _, bot, function, _ = m
        seen[i] = m
        fresh = {cases[t] for line in body.split("\n") if not line.startswith(">") for t in line.split() if t in cases}
        quoted = {cases[t] for line in body.split("\n") if line.startswith(">") for t in line[1:].split() if t in cases} - fresh
        if function == "dissociation":
            for c in fresh:
                out[i, c] = ["dissociation", "dissociation", m[9], "negative"]
            negated |= {(thread, c) for c in fresh}
            continue
        digest = len(fresh) + len(quoted) / 2 >= 3
        for c in fresh | quoted:
            if (thread, c) not in negated:
                out[i, c] = ["mentioned_only", "quoted_body", 0.55, "active"] if c in quoted else ["mentioned_only" if digest else "explicit_reference", "body", 0.7 if bot else 0.5 if digest else 0.9, "active"]
        if function != "correction" and reply_to in seen and reply_to != i:
            held = {c for (j, c), r in out.items() if j == reply_to and r[3] == "active" and r[0] != "mentioned_only"}
            if len(held) == 1 and (thread, c := held.pop()) not in negated and (i, c) not in out:
                out[i, c] = ["reply_inheritance", "reply_structure", 0.6 if bot else 0.85, "active"]
    return sorted((i, c, *r) for (i, c), r in out.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_one_pass(spark, seed):
    rng, messages = random.Random(seed), []
    for i in range(300):
        tokens = lambda k: " ".join(f"INC{100000 + rng.randrange(6)}" for _ in range(rng.choice(k)))
        body = "text " + tokens([0, 0, 0, 1, 1, 2, 4]) + rng.choice(["", "", "\n> " + tokens([1, 2])])
        function, sure = rng.choice([("update", 0.9)] * 20 + [("dissociation", 0.9), ("correction", 0.5)])
        messages.append(msg(i, body, thread=i % 4, at=i // 2, reply_to=rng.choice([i - 4, i - 4, i - 4, i - 8, None, i, 999]), bot=rng.random() < 0.2, function=function, sure=sure))
    plain = [m if m[8] != "correction" else (*m[:8], "update", 0.9) for m in messages]
    assert rows(spark, messages) == one_by_one(plain)


def test_long_chains_are_inherited(spark):
    n = 70
    chain = [msg(0, "INC100001")] + [msg(i, "same here", reply_to=i - 1) for i in range(1, n)]
    assert len(rows(spark, chain)) == n
    alternate = [msg(i, f"INC{100001 + i % 2}", reply_to=i - 1 if i else None) for i in range(9)]
    assert rows(spark, alternate) == one_by_one(alternate)


def test_places_and_how_sure_they_are(spark):
    full_width = "".join(chr(ord(c) + 0xFEE0) for c in "INC100004")
    messages = [
        msg(1, "", title="Re: INC100001", thread=1),
        msg(2, "x", cards=['{"n": "INC100002"}'], bot=True, thread=2),
        msg(3, "INC100003", bot=True, thread=3),
        msg(4, "it is I N C one zero zero oh zero 1.", thread=4),
        msg(5, "see ticket no. 4711, order #99", thread=5),
        msg(6, f"new {full_width}", thread=6),
        msg(7, "INC100009 and INC999999", thread=7),
        msg(8, None, thread=None),
    ]
    assert rows(spark, messages) == [
        (1, 1, "explicit_reference", "subject", 0.98, "active"),
        (2, 2, "explicit_reference", "bot_card", 0.95, "active"),
        (3, 3, "explicit_reference", "body", 0.7, "active"),
        (4, 1, "explicit_reference", "transcript_normalized", 0.7, "active"),
        (5, 3, "explicit_reference", "numeric_candidate", 0.8, "active"),
        (6, 4, "explicit_reference", "transcript_normalized", 0.7, "active"),
    ]
    assert rows(spark, []) == rows(spark, messages, []) == []


def test_corrections_replace_what_their_target_was_told(spark):
    messages = [
        msg(1, "INC100001"),
        msg(2, "INC100001", reply_to=1),
        msg(3, "tracked under INC100002", reply_to=2, function="correction", sure=0.8),
        msg(4, "INC100003", thread=2),
        msg(5, "that was wrong", thread=2, function="correction", sure=0.6),
        msg(6, "this is unrelated to INC100004", thread=3),
        msg(7, "INC100004", thread=3),
    ]
    assert rows(spark, messages) == [
        (1, 1, "explicit_reference", "body", 0.9, "active"),
        (2, 1, "explicit_reference", "body", 0.9, "corrected"),
        (2, 2, "explicit_reference", "correction", 0.8, "active"),
        (3, 2, "explicit_reference", "body", 0.9, "active"),
        (4, 3, "explicit_reference", "body", 0.9, "corrected"),
        (6, 4, "dissociation", "dissociation", 0.7, "negative"),
    ]


def test_pending_numbers_settle_when_their_ticket_comes(spark):
    messages = spark.createDataFrame([msg(1, "INC200001 and #77\n> INC200002"), msg(2, "not related to INC200001\n> INC200002", thread=2), msg(3, "x", title="INC200003", thread=3)], SCHEMA)
    tickets = lambda t: spark.createDataFrame(t, "token string, case_id long")
    waiting = B.pending(messages, tickets([]))
    assert sorted(map(tuple, waiting.collect())) == [(1, "INC200001", "body"), (1, "INC200002", "quoted_body"), (2, "INC200001", "dissociation"), (3, "INC200003", "subject")]
    got = B.settled(waiting, tickets([("INC200001", 1), ("INC200002", 2), ("INC200003", 3), ("INC200003", 4)]))
    assert sorted(tuple(r[c] for c in B.LEDGER) for r in got.collect()) == [(1, 1, "explicit_reference", "body", 0.9, "active"), (1, 2, "mentioned_only", "quoted_body", 0.55, "active"), (2, 1, "dissociation", "dissociation", 0.7, "negative")]


def test_spelt_numbers(spark):
    texts = ["ＩＮＣ１", "c h g nine oh one", "a b c d", "I. N-C  1 2", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.unspelt(F.col("t"))).collect()]
    assert got == ["INC1", "CHG901", "a b c d", "INC12", None, ""]
