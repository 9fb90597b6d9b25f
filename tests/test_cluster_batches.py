"""Roots in batches: the same clusters, and of the work on them nothing stays on the disk but the clusters."""

import os
import time

from tests.test_clusters import DAY, T0, plain, run


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [os.path.basename(p) for p in files.mkString("\n").split("\n")]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def _folders(spark):
    home = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {os.path.join(home, n) for n in os.listdir(home)}


def test_batches_give_the_same_clusters_and_leave_only_them(spark):
    items = {i: None if i % 7 == 0 else T0 + (i % 5) * 9 * DAY for i in range(24)}
    links, edges = [(i % 5, i) for i in range(24)], [(i, i + 3, "x") for i in range(20)]
    memberships = [(30 + i % 4, i, "primary", "negative" if i % 6 == 0 else "active") for i in range(24)] + [(i % 5, (i * 7) % 24, "related", "negative") for i in range(9)]
    seeds = [(100 + i, i) for i in range(24)] + [(100, 9)]
    folders, shuffles = _folders(spark), _shuffles(spark)
    assert run(spark, items, seeds, links, memberships, edges, most=8, batch=9) == plain(items, seeds, links, memberships, edges, most=8)
    made = _folders(spark) - folders
    assert [sorted(os.listdir(f)) for f in made] == [["clusters"]]
    assert sorted(os.listdir(os.path.join(*made, "clusters"))) == ["0", "1", "2"]
    until = time.time() + 20
    while len(_shuffles(spark) - shuffles) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(_shuffles(spark) - shuffles) <= 1  # the one of the fingerprints, which the reader of the result has made
