"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .line_dedup import op3_line_dedup
from .personal import op7_personal
from .pieces import op5_pieces
from .prefix_join import op10_prefix_join
from .quality import op1_quality
from .reshard import op2_reshard
from .token_pack import op9_token_pack
from .vector_join import op8_vector_join
from .warc import op4_warc

QUERIES = {q.__name__: q for q in (op1_quality, op2_reshard, op3_line_dedup, op4_warc, op5_pieces, op6_decontaminate, op7_personal, op8_vector_join, op9_token_pack, op10_prefix_join)}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Benchmark windows looked up among all runs of as many document words; positions in any of them are hit.
DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS run FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
 h AS (SELECT r, i, n, item FROM dw JOIN bw USING (n, run)),
 c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
 t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

#: All pairs of vectors, then the transitive closure of the links.
VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0),
 links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
 reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT reach.a, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.b GROUP BY reach.a) c ON c.a = v.r"""

#: Pairs of documents that share shingles, then the transitive closure of the links.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 met AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY 1, 2),
 links AS (SELECT a, b FROM met JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
 reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.a, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.b GROUP BY reach.a) c ON c.a = d.r"""

ORACLES: dict[str, str] = {"op6_decontaminate": DECONTAMINATE, "op8_vector_join": VECTORS, "op10_prefix_join": JACCARD}
