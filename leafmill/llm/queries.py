"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from .ann import op8_nearest_neighbours
from .decontaminate import op6_decontaminate
from .lang_id import op4_language_id
from .near_dedup import op7_minhash_dedup
from .packing import op10_best_fit_packing
from .pii import op1_pii
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op2_token_counts
from .url_filter import OP3_SQL, op3_url_filter
from .warc import op5_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

OP5_SQL = r"""
WITH r AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS owner FROM r)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + ((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i)
   FROM range(32) AS t(i)) AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM g
"""

_OP6_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_OP6_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_OP6_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, w[j : j + n - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS j FROM i)),
dw AS (SELECT rid, n, p, w[p : p + n - 1] AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM k))),
m AS (SELECT rid, p, k.n, k.item_id FROM dw JOIN k ON dw.win = k.win AND dw.n = k.n),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(key, ',' ORDER BY key) AS said FROM (SELECT DISTINCT rid, item_id::VARCHAR AS key FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

SQL = {"op6_decontaminate": OP6_SQL, "op3_url_filter": OP3_SQL, "op5_warc": OP5_SQL}
