"""Connected selection of graph nodes under budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SELECTED = "case long, node string, place int, score double, chars_used int, truncated string"


def select_connected(nodes: DataFrame, most_nodes: int, most_chars: int, reserved: dict[str, int], has_edges: bool) -> DataFrame:
    """The nodes of each ``case`` that its budgets admit, in order of admission.

    ``nodes(case, node, parent, type, score, chars)``, one row a node.  First
    the best nodes of each reserved type, then all by score, type and name.
    A node comes in with its ancestors or not at all; one that the node
    budget has no room for is passed over, one that the characters have no
    room for ends the selection.  With edges a tenth of the characters stays
    free.  ``truncated`` names the budgets that were met.

    A case is one group: what the expansion before it reaches, which its own
    budgets keep to some hundreds of nodes.
    """
    w = Window.partitionBy("case").orderBy(F.desc("score"), "type", "node")
    by_type = Window.partitionBy("case", "type").orderBy(F.desc("score"), "node")
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in reserved.items() for x in kv]), F.col("type")), F.lit(0)) if reserved else F.lit(0)
    ranked = nodes.withColumn("rank_", F.row_number().over(w)).withColumn("kept_", F.row_number().over(by_type) <= quota)
    room = most_chars - most_chars // 10 if has_edges else most_chars

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        info = {r.node: r for r in rows.itertuples()}
        order = list(rows.sort_values("rank_")["node"])
        first = [n for kind in reserved for n in order if info[n].type == kind and info[n].kept_]
        chosen: dict[str, int] = {}
        met: list[str] = []
        used = 0
        for k, n in enumerate([*first, *order]):
            chain = [n]
            while info[chain[-1]].parent in info and info[chain[-1]].parent not in chain:
                chain.append(info[chain[-1]].parent)
            pending = [x for x in reversed(chain) if x not in chosen]
            if not pending:
                continue
            size = sum(int(info[x].chars) for x in pending)
            reason = "max_nodes" if len(chosen) + len(pending) > most_nodes else "max_characters" if used + size > room else None
            if reason is None:
                used += size
                for x in pending:
                    chosen[x] = len(chosen) + 1
                continue
            if reason not in met:
                met.append(reason)
            if reason == "max_characters":
                break
        return pd.DataFrame({"case": rows["case"].iloc[0], "node": list(chosen), "place": list(chosen.values()), "score": [float(info[x].score) for x in chosen], "chars_used": used, "truncated": ",".join(met)}, columns=["case", "node", "place", "score", "chars_used", "truncated"])

    typed = ranked.select(F.col("case").cast("long").alias("case"), "node", "parent", "type", F.col("score").cast("double").alias("score"), F.col("chars").cast("int").alias("chars"), "rank_", "kept_")
    return typed.groupBy("case").applyInPandas(pick, SELECTED)
