"""The pipeline's stages on a small corpus in which it is known what must go."""

import random
import re

import corpus_pipeline as P
from tessera.llm.secret_scan import Scanner
from tests.llm.test_jaccard import brute


def write(spark, folder, prose):
    r, rows, labels, truth = random.Random(4), [], [], {}
    bench = [(i, prose(900 + i, 30, 3000)) for i in range(5)]
    for i in range(260):
        words = prose(i, r.randrange(40, 90), 3000).split()
        kind = i % 13
        if kind in (0, 1):
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["grubbo", "zlonk", "fnarg", "mumble"]) for _ in range(8)]
        if kind == 2:
            words[5:5] = bench[i % 5][1].split()
        if kind == 3 and i > 13:
            words = rows[i - 13 + 1][1].split()[:-1] + ["changed"]
        if kind == 5:
            words.append("token = abcdef0123456789abcdef")
        truth[i] = kind
        rows.append((i, " ".join(words), "en", r.choice("abc"), len(" ".join(words))))
        labels.append((i, 1, int(kind in (0, 1))))
    rows += [(rows[4][0], *rows[4][1:]), (None, "a text without an id", None, None, None), (999, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return truth


def test_every_stage_does_its_work(spark, tmp_path, prose):
    folder = str(tmp_path / "in")
    truth = write(spark, folder, prose)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = ([x.asDict() for x in before.collect()], [x.asDict() for x in docs.collect()])
        assert name == "mixing" or docs.columns == columns
    ids = lambda rows: sorted((x["doc_id"] for x in rows), key=str)

    before, after = seen["toxicity"]
    assert set(ids(before)) - set(ids(after)) == {i for i, k in truth.items() if k in (0, 1)}

    before, after = seen["near_duplicates"]
    known = {x["doc_id"]: x["text"] for x in before if x["doc_id"] is not None}
    comps = brute(list(known.items()))
    assert ids(after) == sorted([*(i for i, (_, c) in comps.items() if c == i), None], key=str)

    before, after = seen["decontamination"]
    assert set(ids(before)) - set(ids(after)) == {i for i in ids(before) if truth.get(i) == 2}

    before, after = seen["secrets"]
    assert ids(before) == ids(after)
    texts = {x["doc_id"]: x["text"] for x in before}
    for x in after:
        assert not Scanner().spans(x["text"])
        if x["text"] is not None:
            assert x["n_chars"] == len(x["text"]) and (x["text"] == texts[x["doc_id"]] or "[SECRET]" in x["text"])

    before, after = seen["mixing"]
    size = {x["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or "")) for x in before}
    assert set(ids(after)) <= set(ids(before)) and all(x["taken"] == x["copies"] * size[x["doc_id"]] > 0 for x in after)


def test_run(spark, tmp_path, prose):
    folder = str(tmp_path / "in")
    write(spark, folder, prose)
    rows = P.run(spark, folder).collect()
    assert rows and all(0 < r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, rows))
