"""The nearest of each label without a row for a pair, against a plain scan."""

import math
import random

from tessera.operators import vectors as V


def test_nearest_of_label_equals_a_scan_and_keeps_odd_vectors(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(3), [float(r.randrange(-2, 3)) + 0.25 for _ in range(4)], i % 10 == 3) for i in range(200)]
    rows += [(203, 0, [0.0, 0.0, 0.0, 0.0], True), (301, 1, None, False), (302, None, [1.0, 2.0, 3.0, 4.0], False), (303, 7, [1.0, 2.0, 3.0, 4.0], True), (304, 8, [1.0, 2.0, 3.0, 4.0], False), (313, 8, [2.0, 4.0, 6.0, 8.0], True), (305, 8, None, False)]
    frame = spark.createDataFrame(rows, "id long, label int, embedding array<float>, asks boolean")
    got = {}
    for x in V.nearest_of_label(frame, 5, run=16).collect():
        got.setdefault(x["query"], []).append((x["distance"], x["id"]))
    length = lambda v: math.sqrt(sum(x * x for x in v))
    for q, label, v, asks in rows:
        if not asks or q >= 203:
            continue
        pairs = [(round(1 - sum(x * y for x, y in zip(v, w, strict=True)) / (length(v) * length(w)), 6) + 0.0, i) for i, of, w, a in rows if of == label and not a and w is not None and length(w)]
        best = sorted(pairs)[:5]
        assert sorted(got[q]) == best
    assert got[313] == [(0.0, 304), (None, 305)] and all(math.isnan(d) for d, _ in got[203]) and len(got[203]) == 5 and 303 not in got


def test_no_pair_of_a_scan_becomes_a_row(spark):
    frame = spark.range(4000).selectExpr("id", "0 AS label", "array(float(id % 97 + 1), float(id % 89), float(id % 7)) AS embedding", "id % 10 = 3 AS asks")
    plan = V.nearest_of_label(frame, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and V.nearest_of_label(frame, 20).count() == 8000
