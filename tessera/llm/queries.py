"""Queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from tessera.llm.decontaminate import op3_decontamination
from tessera.llm.fill_middle import OP13_SQL, op13_fill_in_middle
from tessera.llm.fingerprint import op2_fingerprints
from tessera.llm.jaccard import op8_jaccard_join
from tessera.llm.language import op4_language
from tessera.llm.licenses import op7_licenses
from tessera.llm.mixing import op5_source_mixing
from tessera.llm.quality import op10_quality
from tessera.llm.ranked_search import OP11_SQL, op11_ranked_search
from tessera.llm.secret_scan import op6_secret_scan
from tessera.llm.sharding import op12_sharding
from tessera.llm.token_count import op9_token_counts
from tessera.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_fingerprints, op3_decontamination, op4_language, op5_source_mixing, op6_secret_scan, op7_licenses, op8_jaccard_join, op9_token_counts, op10_quality, op11_ranked_search, op12_sharding, op13_fill_in_middle)}

#: The fitted scores, fingerprints, tilings, random rounding, spans, trie counts and shards have no SQL form; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(comp) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id""",
    "op11_ranked_search": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
