"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.ball_codes import ENTRIES, PARTS, ROUNDS, op11_ball_codes
from gridloom.llm.bisectors import CENTROIDS, op13_bisector_clusters
from gridloom.llm.bisectors import ROUNDS as CLUSTER_ROUNDS
from gridloom.llm.byte_bpe import op12_byte_bpe
from gridloom.llm.common import benchmark, documents, labels
from gridloom.llm.decontaminate import op4_decontaminate
from gridloom.llm.hilbert import op1_hilbert_shards
from gridloom.llm.language_id import op5_language_id
from gridloom.llm.line_frequency import op2_line_frequency
from gridloom.llm.mixing import op10_source_mix
from gridloom.llm.near_dedup import op7_near_duplicates
from gridloom.llm.quality_gam import op6_quality_gam
from gridloom.llm.secrets import op9_secret_scan
from gridloom.llm.substring import op3_substring_dedup
from gridloom.llm.toxicity import op8_toxicity
from gridloom.llm.vectors import embeddings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": lambda spark, sf_dir: op1_hilbert_shards(documents(spark, sf_dir)),
        "op2_line_frequency": lambda spark, sf_dir: op2_line_frequency(documents(spark, sf_dir)),
        "op3_substring_dedup": lambda spark, sf_dir: op3_substring_dedup(documents(spark, sf_dir)),
        "op4_decontaminate": lambda spark, sf_dir: op4_decontaminate(documents(spark, sf_dir), benchmark(spark, sf_dir)),
        "op5_language_id": lambda spark, sf_dir: op5_language_id(documents(spark, sf_dir)),
        "op6_quality_gam": lambda spark, sf_dir: op6_quality_gam(documents(spark, sf_dir), labels(spark, sf_dir)),
        "op7_near_duplicates": lambda spark, sf_dir: op7_near_duplicates(documents(spark, sf_dir)),
        "op8_toxicity": lambda spark, sf_dir: op8_toxicity(documents(spark, sf_dir), labels(spark, sf_dir)),
        "op9_secret_scan": lambda spark, sf_dir: op9_secret_scan(documents(spark, sf_dir)),
        "op10_source_mix": lambda spark, sf_dir: op10_source_mix(documents(spark, sf_dir)),
        "op11_ball_codes": lambda spark, sf_dir: op11_ball_codes(embeddings(spark, sf_dir)),
        "op12_byte_bpe": lambda spark, sf_dir: op12_byte_bpe(documents(spark, sf_dir)),
        "op13_bisector_clusters": lambda spark, sf_dir: op13_bisector_clusters(embeddings(spark, sf_dir)),
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINES_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM y WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
n AS (SELECT doc_id, source, line, len(lw) AS k, translate(array_to_string(lw, ' '), '{UPPER}', '{LOWER}') AS nl FROM l WHERE len(lw) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM n GROUP BY 1),
c AS (SELECT source, nl, count(DISTINCT doc_id) AS c FROM n GROUP BY 1, 2), h AS (SELECT source, count(*) AS h FROM documents GROUP BY 1),
o AS (SELECT doc_id, count(DISTINCT nl) AS lines, sum(k)::BIGINT AS words FROM n JOIN c USING (source, nl) JOIN h USING (source) WHERE c > 10 AND c > least(0.01 * h, 100000) GROUP BY 1),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
 coalesce(u.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(o.lines, 0)::BIGINT AS n_common_lines, coalesce(o.words, 0)::BIGINT AS n_common_words
 FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 2 * n_common_words <= n_words AS kept FROM f"""

SUBSTRINGS_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM x),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE f < doc_id)),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) AS t FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), b AS (SELECT item_id, {TOKENS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM v))),
h AS (SELECT s.doc_id, s.i, s.k, v.item_id FROM s JOIN v ON s.k = v.k AND s.g = v.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
 coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


KEYS = "(?i:password|passwd|secret|token|api_?key)"
#: kind, expression with the counted part as its first group, and the least length of that part.
SECRETS = (
    ("assign", KEYS + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24),
    ("forge", "gh[pousr]_([A-Za-z0-9]+)", 36), ("chat", "xox[abprs]-([A-Za-z0-9-]+)", 10),
    ("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.]([A-Za-z0-9_-]+)", 16), ("pem", "(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)", 1),
)
#: Positions follow from the lengths of what lies between matches and of the matches before.
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {o} AS o, '{kind}' AS kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', 1) AS g, string_split_regex(t, '{rx}') AS gaps FROM d)) WHERE length(g[i]) >= {least}"""
    for o, (kind, rx, least) in enumerate(SECRETS)
)
SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SPANS}),
c AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
 string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)"""


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR = "(sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)"


def _nearest(k: int, by: str, points: str, centres: str) -> str:
    """Rows of ``points`` with their nearest centre of the k-th set: all centres compared."""
    return f"""a{k} AS MATERIALIZED (SELECT id{by}, c, d FROM (SELECT id{by}, c, d, row_number() OVER (PARTITION BY id{by} ORDER BY d, c) AS place FROM
 (SELECT v.id{by.replace(", ", ", v.")}, e.c, sum((v.x - e.x) * (v.x - e.x))::BIGINT AS d FROM {points} v JOIN {centres}{k} e USING (p{by}) GROUP BY ALL)) WHERE place = 1)"""


def _codes_sql() -> str:
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings WHERE {_USABLE}),
v AS MATERIALIZED (SELECT id, p // w AS m, p % w AS p, floor(256 * embedding[p + 1]::DOUBLE)::BIGINT AS x FROM (SELECT id, embedding, len(embedding) // {PARTS} AS w, unnest(range(0, len(embedding))) AS p FROM k)),
c0 AS MATERIALIZED (SELECT m, id - 1 AS c, p, x FROM v WHERE id <= {ENTRIES})""",
        _nearest(0, ", m", "v", "c"),
    ]
    for k in range(1, ROUNDS + 1):
        steps.append(f"""n{k} AS MATERIALIZED (SELECT m, c, p, ({_FLOOR})::BIGINT AS x FROM v JOIN a{k - 1} USING (id, m) GROUP BY m, c, p),
c{k} AS MATERIALIZED (SELECT m, c, p, coalesce(n{k}.x, c{k - 1}.x) AS x FROM c{k - 1} LEFT JOIN n{k} USING (m, c, p))""")
        steps.append(_nearest(k, ", m", "v", "c"))
    return f"""WITH {", ".join(steps)},
r AS (SELECT id, string_agg(printf('%02x', c), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY m, c, p)) FROM c{ROUNDS}) AS codebooks_sha256 FROM r JOIN k USING (id)"""


def _clusters_sql() -> str:
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, 'null'))) AS id, vec_id, embedding FROM embeddings WHERE {_USABLE} AND len(embedding) = 64),
v AS MATERIALIZED (SELECT id, p, floor(1024 * embedding[p + 1]::DOUBLE)::BIGINT AS x FROM (SELECT id, embedding, unnest(range(0, 64)) AS p FROM k)),
c0 AS MATERIALIZED (SELECT id - 1 AS c, p, x FROM v WHERE id <= {CENTROIDS})""",
        _nearest(0, "", "v", "c"),
    ]
    for k in range(1, CLUSTER_ROUNDS + 1):
        steps.append(f"""n{k} AS MATERIALIZED (SELECT c, p, ({_FLOOR})::BIGINT AS x FROM v JOIN a{k - 1} USING (id) GROUP BY c, p),
c{k} AS MATERIALIZED (SELECT c, p, coalesce(n{k}.x, c{k - 1}.x) AS x FROM c{k - 1} LEFT JOIN n{k} USING (c, p))""")
        steps.append(_nearest(k, "", "v", "c"))
    return f"""WITH {", ".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{CLUSTER_ROUNDS} GROUP BY 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{CLUSTER_ROUNDS} JOIN h USING (c) JOIN k USING (id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators draw, iterate or train, and are tested against brute force."""
    return {
        "op9_secret_scan": SECRETS_SQL, "op2_line_frequency": LINES_SQL, "op3_substring_dedup": SUBSTRINGS_SQL, "op4_decontaminate": CONTAMINATION_SQL,
        "op11_ball_codes": _codes_sql(), "op13_bisector_clusters": _clusters_sql(),
    }
