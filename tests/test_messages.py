"""Message, version, state and condition rules on literal cases; chunks hold their text."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cases as K
from tessera.functions import chunks as C
from tessera.functions import library as L
from tessera.functions import messages as M
from tessera.functions import text as T
from tessera.functions.canonical import canonical, uuid5
from tessera.plans.library import thread_chunks
from tessera.plans.mail import clean_threads, salient_slices

DIR = "/root/testdata/sf0.001"


def each(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_quotes_and_boilerplate(spark):
    cases = {
        "ok\nOn Monday 3 Aug 2026, Jane wrote:\n> old": "ok",
        "answer\n---- Original Message ----\nhistory": "answer",
        "hello\nFrom: a@b.co\nSent: today\nold": "hello",
        "> only quoted\nfresh line": "fresh line",
        "As said on Monday, the engineer wrote it down": "As said on Monday, the engineer wrote it down",
        None: "",
    }
    assert each(spark, list(cases), M.fresh_text(F.col("t"))) == list(cases.values())
    prose = "One more thing, the second host is still down after all of these changes and reboots."
    more = {
        "Done.\nThanks and regards,\nSam\nMobile: +1 555 010 1234": "Done.",
        f"Done.\nThanks\n{prose}\n{prose}": f"Done.\nThanks\n{prose}\n{prose}",
        "Thanks\nKim": "Thanks\nKim",
        "Fixed it.\nThis e-mail is confidential and intended only for you.": "Fixed it.",
        "See below\nhttps://a.example\nhttps://b.example": "See below\nhttps://a.example\nhttps://b.example",
        f"{prose}\nhttps://a.example\nwww.b.example": prose,
        f"{prose}\nhttps://a.example": f"{prose}\nhttps://a.example",
        "": "",
    }
    assert each(spark, list(more), M.without_boilerplate(F.col("t"))) == list(more.values())


def test_technical_content(spark):
    signs = ["restart on 10.0.0.3", "see v8.2.5", "0x8007007E", "OPS-123", "cat /etc/hosts", "app.log", "myFunnyName", "MAX_HEAP_SIZE", "caused by", "delete from t", "systemctl", "error code 503"]
    assert each(spark, [*signs, "please look into this", "zsu[@user:60051]zsu ok"], M.technical(F.col("t"))) == [True] * len(signs) + [False, False]


def test_threads_keep_every_message(spark):
    line = "The very same line of more than forty characters stands here."
    rows = [(1, 0, "ann", f"{line}\nThanks"), (1, 1, "bo", f"New.\n{line}\nThanks"), (1, 2, "Mail Delivery Subsystem", line), (1, 3, None, None), (2, 0, "ann", line), (2, 1, "x", "> all quoted")]
    got = {(r.conv_id, r.turn): r for r in clean_threads(spark.createDataFrame(rows, "conv_id long, turn long, sender string, body string")).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].clean == "New." and got[1, 1].dedupe_removed_chars == len(line)
    assert got[1, 2].is_delivery_failure and got[1, 2].clean == "" and got[2, 0].clean == line
    assert got[2, 1].is_quote_only and got[1, 3].original_chars == 0 and not got[1, 3].is_quote_only


def test_slices(spark):
    short, noise = "all in all short", "Hello\nwhat a day it was for all of us here in this place\n\n" * 3
    long = noise + "the database server failed with error 0x1F and a timeout on port 8080\n\n" + "nothing to see " * 40
    df = spark.createDataFrame([(1, 0, short), (2, 0, long)], "conv_id long, turn long, body string")
    got = {r.conv_id: r.slice for r in salient_slices(df, 200).collect()}
    assert got[1] == short and len(got[2]) <= 200 and "database server failed" in got[2] and "nothing to see" not in got[2]


def test_file_names(spark):
    names = ["VPN SOP Final v2.docx", "VPN_SOP_rev3.pdf", "VPN SOP (2).docx", "VPN SOP.docx", "Copy of VPN SOP v1.10.doc", "vpn-sop version 1.9.pdf", None]
    assert each(spark, names, L.family(F.col("t"))) == ["vpn sop"] * 6 + [""]
    versions = each(spark, names, L.version(F.col("t")))
    assert versions == [[2], [3], [2], None, [1, 10], [1, 9], None] and versions[4] > versions[5]
    assert each(spark, ["SOP draft", "SOP latest", "SOP"], L.qualifier_rank(F.col("t"), F.lit("Old"))) == [-3, 0, -2]


def test_sections(spark):
    html = "<h1>A</h1><p>one</p><h3>B</h3><ul><li>s1</li><li>s2</li></ul><h2>C</h2><pre>x = 1</pre><p> </p><table><tr><td>a</td><td>b</td></tr></table>"
    assert each(spark, [html], L.rendered(L.elements(F.col("t")))) == ["# A\n\none\n\n### B\n\n- s1\n- s2\n\n## C\n\nx = 1\n\na b"]
    paths = each(spark, [html], F.transform(L.with_paths(L.elements(F.col("t"))), lambda e: e["path"]))[0]
    assert paths == ["A", "A", "A > B", "A > B", "A > B", "A > C", "A > C", "A > C"]
    assert each(spark, ["no mark-up", None], F.size(L.elements(F.coalesce("t", F.lit(""))))) == [0, 0]


@pytest.mark.parametrize("text", ["", "short", "a" * 4000, ("word " * 50 + ".\n") * 30, ("Sentence one. Then two! " * 40 + "\n\n") * 5, "x" * 1500, "x" * 1501])
def test_chunks_cover_the_text(text):
    spans = C.cut_points(text)
    assert all(0 < b - a <= C.TARGET for a, b in spans)
    at = 0
    for a, b in spans:
        assert a <= at and b > at
        at = b
    assert at == len(text) if text else spans == []


def test_thread_chunks_hold_the_fresh_text(spark):
    from tessera.plans.mail import mail

    fresh = {(r.conv_id, r.turn): r.x for r in mail(spark, DIR).select("conv_id", "turn", M.fresh_text(F.col("body")).alias("x")).collect()}
    chunks = thread_chunks(spark, DIR).collect()
    assert chunks and {(r.conv_id, r.turn) for r in chunks} == {k for k, v in fresh.items() if v}
    assert all(r.chunk in fresh[r.conv_id, r.turn] and len(r.replies_to) <= 200 for r in chunks)


def test_embedding_is_a_unit_vector_or_null(spark):
    got = each(spark, ["two words", "", None], C.embedding(F.col("t")))
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1] is None and got[2] is None


def test_versions_and_tiers(spark):
    pairs = {("7*", "7.6.3"): True, ("8.2.5", "8.2.4"): False, ("8.2.4", "8.2.5"): True, ("8.x", "9.1"): False, ("V8.*", "8.0"): True, ("abc", "8.1"): None, ("7", "7.1"): True, ("9.10.0", "9.9.9"): False, (None, "1"): None}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, t string").select("i", T.version_compatible(F.col("a"), F.col("t")).alias("x")).orderBy("i")
    assert [r.x for r in df.collect()] == list(pairs.values())
    labels = {"PROD-EU": "production", "Non-Prod": None, "Pre-Prod EU": "staging", "QA2": "qa", "nonprd": None, "": None, None: None, "somewhere": None}
    assert each(spark, list(labels), K.environment_tier(F.col("t"))) == list(labels.values())


def test_outcomes_and_errors(spark):
    notes = {"The issue is resolved now": "success", "Ticket closed due to lack of user response": "unknown", "Workaround applied": "partial", "still failing after reboot": "failure", "unresolved": "failure", "closed": "unknown", "": "unknown", None: "unknown"}
    assert each(spark, list(notes), T.outcome(F.col("t"))) == list(notes.values())
    lines = {"java.lang.NullPointerException: value": "NullPointerException", "ORA-12154: TNS": "ORA_12154", "HTTP 503 Service": "HTTP_503", "exit errno=13 x": "ERRNO_13", "FATAL: disk": "LOG_ERROR", "all good": None}
    assert each(spark, list(lines), T.error_type(F.col("t"))) == list(lines.values())
    assert each(spark, ["Do not restart", "Restart but never on Friday", "Avoid it", "Restart it, however do not wait"], T.negated(F.col("t"))) == [True, False, True, False]


def test_conditions(spark):
    def verdict(requires, loose, excludes, env, expired=False, conflicts=False):
        m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        col = K.trigger_verdict(m(requires), F.array(*map(F.lit, loose)) if loose else F.array().cast("array<string>"), m(excludes), m(env), F.lit("vpn disk full on host"), F.lit(expired), F.lit(conflicts))
        v = spark.range(1).select(col.alias("v")).first().v
        return v.level, v["drop"], v.reason

    assert verdict({"os": "Linux", "app": "x"}, [], {}, {"os": "linux 9", "app": "x"}) == ("exact", False, None)
    assert verdict({"os": "Linux", "app": "x"}, [], {}, {"os": "linux", "app": "x"}, conflicts=True)[0] == "strong"
    assert verdict({"os": "linux"}, [], {}, {"os": "windows"}) == ("contradicted", True, "environment_mismatch")
    assert verdict({"os": "linux"}, [], {}, {})[0] == "unvalidated" and verdict({}, [], {}, {})[0] == "unvalidated"
    assert verdict({}, ["disk replica"], {}, {})[0] == "strong" and verdict({}, ["disk", "tape"], {}, {})[0] == "partial" and verdict({}, ["tiny ox"], {}, {})[0] == "unvalidated"
    assert verdict({}, [], {"region": "eu"}, {"region": "eu-west"}) == ("contradicted", True, "environment_excluded")
    assert verdict({"os": "linux"}, [], {}, {"os": "linux"}, expired=True) == ("contradicted", True, "expired")


def test_canonical_json_and_identifiers(spark):
    import json
    import uuid

    assert canonical(json.loads('{"b": [1.0, 1e2, 0.5, -0.0], "a": {"\u20ac": null, "\u00e9": true}, "A": "x\\n"}')) == '{"A":"x\\n","a":{"\u00e9":true,"\u20ac":null},"b":[1,100,0.5,0]}'
    numbers = {1e21: "1e+21", 1e-7: "1e-7", 123456789.5: "123456789.5", 1e20: "100000000000000000000", 0.000001: "0.000001", 5e-324: "5e-324", 1.5e300: "1.5e+300"}
    assert {x: canonical(x) for x in numbers} == numbers
    assert each(spark, ["a", "order:7", "\u00e9"], uuid5(F.col("t"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ("a", "order:7", "\u00e9")]
