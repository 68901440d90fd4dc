"""The queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .queries import RULES, SEED, SHARDS
from .sharding import _P, ROUNDS, round_keys
from .url_filter import BLOCKED_SHARE, BLOCKED_WORDS, DAMPING, LINK, LOWER, THRESHOLD, UPPER, split_rule

#: Steps of the SQL for op3; in the tables at hand later ones bring nothing.
STEPS = 9

#: Passes of the network that the SQL for op1 allows for; more than the tables at hand need.
WALKS = 6


def _crc32(blob: str) -> str:
    """CRC-32 of a blob, four bits a step."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    swapped = f"regexp_extract_all(regexp_replace(hex({blob}), '(.)(.)', '\\2\\1', 'g'), '.')"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({swapped}, lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 4, ({table}::BIGINT[])[(xor(c, b) & 15) + 1])), 4294967295::BIGINT)"""


OP5 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n"""

OP8 = f"""
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
k AS (SELECT source, unnest(range(0, 200)) AS k, rate FROM r),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT doc_id, source, octet_length(encode(text)) AS size, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|0'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents)
SELECT d.doc_id, d.source, d.size, p.k::INT AS copy, md5('{SEED}|order|' || coalesce(d.doc_id::VARCHAR, '') || '|' || p.k) AS shuffle_key
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.cdf <= d.u"""


def _op1() -> str:
    def network(v: str) -> list[str]:
        """CTEs for one pass of the network over column v of the table v."""
        out = [f"{v}_0 AS MATERIALIZED (SELECT *, v // b AS l, v % b AS r FROM {v})"]
        for k in range(ROUNDS):
            one, other, m = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            y = f"(({other} + {round_keys(SEED)[k]}) % {_P})"
            out.append(f"{v}_y{k} AS MATERIALIZED (SELECT *, ({y} * {y} % {_P} * {y} + 12345) % {_P} AS z FROM {v}_{k})")
            out.append(f"{v}_{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (z) REPLACE (({one} + (z >> 7) + z * 3) % {m} AS {one}) FROM {v}_y{k})")
        return out

    walks: list[str] = []
    for w in range(WALKS):
        walks += network(f"w{w}")
        walks.append(f"w{w + 1} AS MATERIALIZED (SELECT * EXCLUDE (l, r, v, ok), CASE WHEN ok THEN v ELSE l * b + r END AS v, ok OR l * b + r < n AS ok FROM w{w}_{ROUNDS})")
    last = f"w{WALKS}"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS x FROM documents),
c AS MATERIALIZED (SELECT doc_id, octet_length(x) + 1 AS size, {_crc32("x")} AS text_crc32 FROM t),
m AS (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM c),
w0 AS (SELECT doc_id, size, text_crc32, n, a, (n + a - 1) // a AS b, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS v, false AS ok FROM c, m),
{", ".join(walks)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {SHARDS})::INT AS shard, v // {SHARDS} AS slot, NULL::INT AS grown_shard FROM {last}"""


OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
f AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 85 * (len(sa.sh) + len(sb.sh) - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM r JOIN s USING (doc_id) GROUP BY doc_id"""


def _op3() -> str:
    def fits(rule: str) -> str:
        host, path = split_rule(rule)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    longest = sorted(RULES, key=len, reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in longest) + " END"
    listed = lambda v: ", ".join(f"'{r}'" for r, x in RULES.items() if x == v)
    words = ", ".join(f"'{w}'" for w in BLOCKED_WORDS)
    link = LINK.replace("'", "''")
    lower = f"'{UPPER}', '{LOWER}'"
    steps = []
    for i in range(STEPS):
        steps.append(f"""k{i + 1} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT * FROM k0
          UNION ALL SELECT dst, t * forth, 0.0 FROM g JOIN k{i} ON src = host UNION ALL SELECT src, 0.0, d * back FROM g JOIN k{i} ON dst = host) GROUP BY host)""")
    return f"""
WITH a AS (SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
j AS MATERIALIZED (SELECT page_id, html, host, path, {rule} AS rule FROM h),
share AS (SELECT host, avg(coalesce(rule IN ({listed("allow")}), false)::INT) AS t, avg(coalesce(rule IN ({listed("block")}), false)::INT) AS r FROM j WHERE host <> '' GROUP BY host),
seed AS (SELECT host, t, CASE WHEN list_has_any(regexp_split_to_array(host, '[.\\-_0-9:@]+'), [{words}]) THEN 1.0::DOUBLE WHEN r >= {BLOCKED_SHARE} THEN r ELSE 0 END AS d FROM share),
k0 AS MATERIALIZED (SELECT host, {1 - DAMPING} * CASE WHEN d > 0 THEN 0 ELSE t END AS t, {1 - DAMPING} * d AS d FROM seed WHERE t > 0 OR d > 0),
f AS (SELECT DISTINCT host, regexp_replace(host, '^[^.]+\\.', '') AS up FROM j WHERE regexp_matches(host, '^[^.]+\\.[^.]+\\.[^.]+')),
n AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {lower}) AS dst FROM j),
e AS (SELECT src, dst, sum(w) AS w FROM (SELECT host AS src, up AS dst, 1.0::DOUBLE AS w FROM f
       UNION ALL SELECT src, dst, 1.0 FROM n WHERE src <> dst AND src <> '' AND dst <> '') GROUP BY src, dst),
g AS MATERIALIZED (SELECT src, dst, {DAMPING} * w / sum(w) OVER (PARTITION BY src) AS forth, {DAMPING} * w / sum(w) OVER (PARTITION BY dst) AS back FROM e),
{", ".join(steps)}
SELECT page_id, j.host, path, rule, CASE WHEN rule IN ({listed("allow")}) THEN 'allow' WHEN rule IN ({listed("block")}) THEN 'block'
  WHEN d > {THRESHOLD} * (t + d) THEN 'block' ELSE 'allow' END AS verdict FROM j LEFT JOIN k{STEPS} k ON j.host = k.host"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _op1(), "op3_url_filter": _op3(), "op9_minhash": OP9, "op5_exact_dedup": OP5, "op8_mixing": OP8}
