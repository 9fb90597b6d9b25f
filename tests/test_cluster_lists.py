"""Short lists of a cluster are read whole and once; what very many cases deny stays out as well."""

from tessera.operators import clusters
from tests.test_clusters import T0, plain, run


def test_short_lists_are_not_cut_by_time_and_much_denied_items_stay_out(spark, monkeypatch):
    def cut(*_):
        raise AssertionError("a list of a few items was cut into blocks")

    monkeypatch.setattr(clusters, "_blocks", cut)
    items = {i: T0 for i in range(1, 6)}
    links, edges = [(7, 1), (7, 2), (7, 3)], [(1, 4, "x"), (4, 5, "y")]
    memberships = [(c, 3, "primary", "negative") for c in range(clusters.BLOCK + 5)] + [(7, 5, "primary", "negative"), (8, 2, "primary", "negative")]
    seeds = [(1, 1), (4, 4)]
    assert run(spark, items, seeds, links, memberships, edges) == plain(items, seeds, links, memberships, edges)
