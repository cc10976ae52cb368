"""The registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, language_id, merkle, mixing, near_dedup, pieces, quality_rules, secrets, sharding, suffix_dedup, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, operator: Callable[[DataFrame], DataFrame], source: str = "documents", sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(table(spark, sf_dir, source))
    if sql:
        ORACLES[name] = sql


WORDS = r"'[^\x20\x09-\x0D]+'"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, regexp_extract_all(text, {WORDS}) AS w FROM d),
p AS (SELECT u, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT u, i, CASE WHEN lead(i, 4) OVER s IS NOT NULL THEN
        [x, lead(x, 1) OVER s, lead(x, 2) OVER s, lead(x, 3) OVER s, lead(x, 4) OVER s] END AS k
      FROM p WINDOW s AS (PARTITION BY u ORDER BY i)),
r AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, k) AS c FROM v WHERE k IS NOT NULL) WHERE c > 1),
c AS (SELECT u, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT u, i, lead(i) OVER (PARTITION BY u ORDER BY i) AS nxt FROM r) GROUP BY u),
b AS (SELECT d.doc_id, d.text, CAST(len(w.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(string_split(d.text, chr(10))) AS n_lines
      FROM d JOIN w USING (u) LEFT JOIN c USING (u)
      JOIN (SELECT u, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS l FROM d) l USING (u)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS upper_case,
        length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS letters,
        length(text) - length(replace(text, '!', '')) AS bangs FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 2 * upper_case > letters OR 5 * bangs > n_words OR 10 * letters < 5 * word_chars) AS kept
FROM f"""

KEY = "md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-'))"

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size,
        ('0x' || substr({KEY}, 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS w FROM s),
t AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w),
n AS (SELECT *, (3 * total - 4 * coalesce(sum(source_size) OVER o, 0))::BIGINT AS num, (all_w - coalesce(sum(w) OVER o, 0))::BIGINT AS den
      FROM t WINDOW o AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, w::HUGEINT * num <= 4::HUGEINT * source_size * den AS under FROM n),
l AS (SELECT arg_max(num, den) AS num, max(den) AS den FROM u WHERE under),
g AS (SELECT u.source, u.source_size, CASE WHEN u.under THEN u.w * (l.num::DOUBLE / (2.0::DOUBLE * l.den)) ELSE 2.0::DOUBLE * u.source_size END AS target FROM u, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
r AS (SELECT d.doc_id, d.size, d.h, q.source_size, q.target, q.passes, q.target - q.passes * q.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT u, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT v.u, v.i, v.n, g.item_id FROM v JOIN g ON v.n = g.n AND v.k = g.k),
h AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM m) GROUP BY u),
t AS (SELECT u, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT u, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY u)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (u) LEFT JOIN t USING (u)"""

CHAT_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 3 ELSE 1 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), ']', '&rb;')) END AS tag,
    CASE WHEN NOT (contains(text, '</s>') OR contains(text, '&rb;') OR contains(text, '&lt;') OR contains(text, '&amp;')) THEN length(text)
      ELSE length(replace(replace(replace(replace(text, '&', '&amp;'), '<s>[', '&lt;s>['), '</s>', '&lt;/s>'), ']', '&rb;')) END AS body FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + tag + 2 + body + 4)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""



def crc_table() -> str:
    """The 256 steps of the reflected CRC-32 polynomial, from its rule."""
    def step(n: int) -> int:
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        return n
    return "[" + ",".join(str(step(n)) for n in range(256)) + "]::BIGINT[]"


def feistel_sql(source: str, seed: int = 1) -> str:
    """One pass of the permutation over ``source`` (u, x, a, b, n)."""
    prime = sharding.PRIME
    out = f"SELECT u, a, b, n, x % a AS l, x // a AS r FROM {source}"
    for i, (m, c, d) in enumerate(sharding.constants(seed)):
        move, by, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        y = f"(({by} * {m} + {c}) % {prime})"
        out = f"SELECT u, a, b, n, ({move} + ({y} * {y} + {d}) % {prime}) % {side} AS {move}, {by} FROM ({out})"
    return f"SELECT u, r * a + l AS x, a, b, n FROM ({out})"


SHARD_SQL = f"""
WITH RECURSIVE c AS (SELECT count(*) AS n, greatest(ceil(sqrt(count(*))), 1)::BIGINT AS a FROM documents),
dims AS (SELECT n, a, greatest((n + a - 1) // a, 1) AS b FROM c),
d AS (SELECT row_number() OVER (ORDER BY {KEY}) - 1 AS u, doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, x: xor(c >> 8, ({crc_table()})[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents),
w AS ({feistel_sql("(SELECT u, u AS x, a, b, n FROM d, dims)")} UNION ALL {feistel_sql("(SELECT * FROM w WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 40)::INT AS shard, x // 40 AS slot, NULL::INT AS grown_shard FROM d JOIN w USING (u) WHERE x < n"""

MERKLE_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
MERKLE_LEAF = "sha256(" + " || ".join(MERKLE_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
ODD = f"""xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: xor(c >> 8, ({crc_table()})[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 2"""
#: Levels are lists ``h`` of nodes; a node's run of three starts at ``i - i % 3``.
UP = "list_transform(range(0, len(h), 3), lambda i: sha256(array_to_string(h[i + 1:i + 3], '')))"
SIBLINGS = "array_to_string(t.h[p.i - p.i % 3 + 1:p.i], '') || array_to_string(t.h[p.i + 2:p.i - p.i % 3 + 3], '')"
FOLD = "sha256(array_to_string(t.h[p.i - p.i % 3 + 1:p.i], '') || p.f || array_to_string(t.h[p.i + 2:p.i - p.i % 3 + 3], ''))"

MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT source, doc_id, {MERKLE_LEAF.format(text="text")} AS leaf,
    CASE WHEN {ODD} = 0 THEN {MERKLE_LEAF.format(text="replace(text, chr(10), '')")} ELSE {MERKLE_LEAF.format(text="text")} END AS f FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS u FROM d),
t AS (SELECT source, 0 AS k, list(leaf ORDER BY i) AS h FROM l GROUP BY source
  UNION ALL SELECT source, k + 1, {UP} FROM t WHERE len(h) > 1),
s AS (SELECT source, h[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE len(h) = 1),
w AS (SELECT 0 AS k, list(subroot ORDER BY i) AS h FROM s UNION ALL SELECT k + 1, {UP} FROM w WHERE len(h) > 1),
p AS (SELECT u, source, 0 AS k, i, f, '' AS proof FROM l
  UNION ALL SELECT p.u, p.source, p.k + 1, p.i // 3, {FOLD}, p.proof || {SIBLINGS}
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source AND p.k = t.k AND len(t.h) > 1),
a AS (SELECT u, source, f, proof FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC) = 1),
o AS (SELECT a.u, 0 AS k, s.i, a.f, a.proof FROM a JOIN s ON a.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT p.u, p.k + 1, p.i // 3, {FOLD}, p.proof || {SIBLINGS} FROM o AS p JOIN w AS t ON p.k = t.k AND len(t.h) > 1),
z AS (SELECT u, f, proof FROM o QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC) = 1),
r AS (SELECT h[1] AS root FROM w WHERE len(h) = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(z.proof) AS proof_sha256, z.f AS folded_root, z.f = r.root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN z USING (u), r"""

register("op1_quality_rules", quality_rules.op1_quality, sql=QUALITY_SQL)
register("op2_suffix_dedup", suffix_dedup.op2_suffix)
QUERIES["op3_decontamination"] = lambda spark, sf_dir: decontaminate.op3_decontamination(
    table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
ORACLES["op3_decontamination"] = DECONTAMINATION_SQL
register("op4_source_mixing", mixing.op4_mixing, sql=MIX_SQL)
register("op5_secret_scan", secrets.op5_secrets)
register("op6_html_extraction", html_extract.op6_html, "pages")
register("op7_chat_formatting", chat.op7_chat, "conversations", CHAT_SQL)
register("op8_sharding", sharding.op8_sharding, sql=SHARD_SQL)
register("op9_near_dedup", near_dedup.op9_near_dedup)
register("op10_language_id", language_id.op10_language)
register("op11_sentencepiece", pieces.op11_pieces)
register("op12_whitening", whitening.op12_whitening, "embeddings")
register("op13_merkle_manifest", merkle.op13_merkle, sql=MERKLE_SQL)
