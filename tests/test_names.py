"""Identity resolution against all pairs, and each layer's rule."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import identity as I
from tessera.operators import names as N


def grams(name):
    word, words = "", []
    for c in name.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words, word = [*words, f"  {word} "], ""
    return {w[i : i + 3] for w in words for i in range(len(w) - 2)}


def by_all_pairs(mentions, known, most=5):
    out = {}
    for kind, name in set(mentions):
        words = {w.strip(".,-") for w in name.replace("%", " ").replace("_", " ").split()}
        longest = sorted((w for w in words if len(w) >= 3), key=lambda w: (-len(w), w))[:3]
        rows = []
        for k, identity, other in set(known):
            a, b = grams(name), grams(other)
            common, whole = len(a & b), len(a | b)
            if k == kind and other and (10 * common > 3 * whole or any(w in other for w in longest)):
                rows.append((-common / max(whole, 1), other, identity))
        if rows:
            out[kind, name] = [(i, o, -s) for s, o, i in sorted(rows)[:most]]
    return out


@pytest.mark.parametrize("block", [2, N.BLOCK])
def test_near_names_equal_all_pairs(spark, block):
    rng = random.Random(7)
    parts = ["mail", "gate", "vpn", "acme", "node", "db", "sap", "über", "print"]
    name = lambda: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 2))) + rng.choice(["", "01", "2", "-x", "."]) for _ in range(rng.randint(1, 3)))
    known = [(rng.choice("ds"), i, name()) for i in range(90)] + [("d", 500 + i, "mail gate") for i in range(8)] + [("d", 600, ""), ("d", 601, None)]
    mentions = [(rng.choice("ds"), name()) for _ in range(70)] + [("d", "mail gate"), ("d", "mail gate"), ("s", "100%"), ("d", "--- ."), ("d", ""), ("d", None), ("d", "ab")]
    got = N.near_names(spark.createDataFrame(mentions, "kind string, name string"), spark.createDataFrame(known, "kind string, identity long, name string"), block=block)
    rows = {(r["kind"], r["name"]): [tuple(c) for c in r["candidates"]] for r in got.collect()}
    assert rows == by_all_pairs([m for m in mentions if m[1]], [k for k in known if k[2]])


def test_layers_in_order(spark):
    known = spark.createDataFrame([(1, "device", "mailgw01", True), (2, "service", "JMX Broker", True), (3, "person", "Ana Lim", True), (4, "device", "old host", False), (5, "device", "Backup Tower", True)], "identity long, entity_type string, name string, active boolean")
    aliases = spark.createDataFrame([(2, "Message Bus"), (4, "retired")], "identity long, alias string")
    owners = spark.createDataFrame([("email", "ana@x.org", 3), ("serial_number", "s-9", 4)], "kind string, value string, identity long")
    rows = [
        ("a", "person", "A. Lim", [("username", "al"), ("email", " ANA@x.org ")]),
        ("b", "device", "anything", [("serial_number", "S-9")]),
        ("c", " Application ", "message   BUS", []),
        ("d", "person", "JMX Broker", []),
        ("e", "device", "Mail-GW01 north", []),
        ("f", "device", "Backup-Tower", []),
        ("g", "version", "8.2 GA", []),
        ("h", "process", "Nightly", []),
        ("i", "device", "the old printer again and again", []),
        ("j", None, "X1", []),
        ("k", "device", "  ", []),
        ("l", "device", None, None),
        ("m", "device", "retired", []),
        ("n", "device", "Quux-7", None),
    ]
    mentions = spark.createDataFrame(rows, "id string, entity_type string, name string, strong array<struct<kind:string,value:string>>").withColumn("identity", F.lit("clash"))
    got = {r["id"]: (r["method"], r["identity"], r["confidence"]) for r in N.resolve(mentions, known, aliases, owners).collect()}
    assert len(got) == len(rows)
    assert got["a"] == ("strong:email", 3, 1.0)
    assert got["b"] == ("strong:serial_number", 4, 1.0)
    assert got["c"] == ("alias_exact", 2, 0.95)
    assert got["d"] == ("provisional", None, 0.5)
    assert got["e"][:2] == ("below_threshold", None)
    assert got["f"] == ("adjudicated", 5, 1.0)
    assert got["g"] == ("facet_type", None, None)
    assert got["h"] == ("unsupported_type", None, None)
    assert got["i"] == ("not_a_name", None, None)
    assert got["j"] == ("unsupported_type", None, None)
    assert got["k"][0] == got["l"][0] == "no_name"
    assert got["m"] == ("not_a_name", None, None)
    assert got["n"] == ("provisional", None, 0.5)


def test_adjudicator_is_a_parameter(spark):
    known = spark.createDataFrame([(1, "person", "Maria Lindt", True), (2, "person", "Maria Lind", True)], "identity long, entity_type string, name string, active boolean")
    mentions = spark.createDataFrame([("person", "Marie Lindt", [])], "entity_type string, name string, strong array<struct<kind:string,value:string>>")
    none = spark.createDataFrame([], "identity long, alias string"), spark.createDataFrame([], "kind string, value string, identity long")
    says = lambda decision, identity, sure: lambda name, candidates: F.struct(F.lit(decision).alias("decision"), F.lit(identity).cast("long").alias("identity"), F.lit(sure).alias("confidence"))
    method = lambda *a: N.resolve(mentions, known, *none, adjudicate=says(*a)).collect()[0]
    assert method("match", 2, 0.95)["identity"] == 2
    assert method("match", 2, 0.94)["method"] == "below_threshold"
    assert method("match", 9, 0.99)["method"] == "below_threshold"
    assert method("needs_review", 1, 0.7)["method"] == "abstained"
    assert method("none", None, 0.0)["method"] == "provisional"
    assert N.resolve(mentions.limit(0), known, *none).count() == 0
    assert N.resolve(mentions, known.limit(0), *none).collect()[0]["method"] == "provisional"


def test_normalised_names(spark):
    row = spark.createDataFrame([(" Ana  LIM\t", "a_bc%def.,- ghij the")], "a string, b string").select(I.normalised(F.col("a")), I.longest_words(F.col("b"))).collect()[0]
    assert tuple(row) == ("ana lim", ["ghij", "def", "the"])


def test_names_of_one_hot_word_make_no_row_for_each_pair(spark):
    names = [f"gate {a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    side = lambda name, grams: spark.createDataFrame([("d", "gat", n) for n in names], f"kind string, gram string, {name} string").withColumn(grams, I.trigrams(F.col(name)))
    sets, held = side("name", "grams"), side("known", "known_grams")
    assert N._met(sets.withColumn("word", F.lit(None).cast("string")), held, most=5, block=N.BLOCK).count() == 5 * len(names)
    assert N._met(sets.withColumn("word", F.lit("gate")), held, most=5, block=N.BLOCK).count() == 5 * len(names)
