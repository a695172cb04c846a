"""DuckDB statements of the expected results, where SQL can state them.

Shards, neighbours, language-model scores, quality measures and prefix tries are stated from
the tables alone.  Fingerprints (XXH64), decoded layers, tokenizers, random
draws, a trained classifier and the pipeline built on them are beyond SQL; the
tests hold them against brute force.
"""

from __future__ import annotations

from feedspark.llm import lm, quality
from feedspark.llm.sharding import _HEX

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _crc32(nibbles: str) -> str:
    """crc32 of the bytes whose hex digits are given: bytes are folded in, then eight shifts each."""
    byte = f"(instr('0123456789ABCDEF', substr({nibbles}, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({nibbles}, 2 * i + 2, 1)) - 1"
    data = f"list_transform(range(0, length({nibbles}) // 2), lambda i: ({byte})::bigint)"
    shift = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda a, b: {shift}), 4294967295::bigint)"


def _shards(n: int) -> str:
    draw = f"(('0x' || substr(md5(key || '|' || s), 1, {_HEX}))::bigint::double + 0.5) / {float(1 << 4 * _HEX)!r}"
    return f"list_max(list_transform(range(0, {n}), lambda s: {{'score': -1.0 / ln({draw}), 'shard': s}})).shard::int"


_OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id::varchar, '') AS key, strlen(coalesce(text, ''))::bigint + 1 AS size,
                  hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, size, {_crc32('h')}::bigint AS text_crc32, 'key' AS law, {_shards(8)} AS shard, {_shards(9)} AS grown_shard FROM d)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM x"""

_COSINE = "list_cosine_similarity(q.embedding::double[], e.embedding::double[])"
_OP3 = f"""
WITH e AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
      AND len(q.embedding) = len(e.embedding)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_ID_HEX = "hex(encode(coalesce(doc_id::varchar, '')))"
_K = f"({lm.PRIOR} + {lm.SHARE} * ch)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_ID_HEX} AS h FROM documents),
f AS (SELECT r, doc_id, {_crc32('h')} % 5 = 1 AS held_out,
             list_concat([' B'], {_WORDS.replace("coalesce(text, '')", _LOWER)}, [' E']) AS t FROM d),
t AS (SELECT r, held_out, unnest(t[:-2]) AS h, unnest(t[2:]) AS w FROM f),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
pair AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
ctx AS (SELECT h, count(*) AS c FROM t WHERE NOT held_out GROUP BY h),
n AS (SELECT coalesce(sum(c), 0)::bigint AS n, count(*) AS v FROM uni),
s AS (SELECT t.r, coalesce(uni.c, 0) AS c, (coalesce(uni.c, 0) + 0.5::double) / (n.n + 0.5::double * (n.v + 1)) AS p,
             coalesce(ctx.c, 0) AS ch, coalesce(pair.c, 0) AS cp
      FROM t CROSS JOIN n LEFT JOIN uni ON uni.w = t.w LEFT JOIN ctx ON ctx.h = t.h LEFT JOIN pair ON pair.h = t.h AND pair.w = t.w),
a AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, fsum(log10(p)) AS base_score,
             fsum(log10(CASE WHEN ch > 0 THEN (cp + {_K} * p) / (ch + {_K}) ELSE p END)) AS score FROM s GROUP BY r)
SELECT f.doc_id, f.held_out, a.n_tokens, a.n_known, n.n AS train_tokens, round(a.base_score, 6) AS base_score, round(a.score, 6) AS score
FROM f JOIN a USING (r) CROSS JOIN n"""

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(quality.STOP_WORDS)) + "]"


def _verdict() -> str:
    tests = []
    for r in quality.RULES:
        tests += [f"{r.measure} >= {float(r.low)!r}::double"] if r.low is not None else []
        tests += [f"{r.measure} <= {float(r.high)!r}::double"] if r.high is not None else []
    return " AND ".join(tests)


_LAST = quality.WINDOW - 1
_OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) > 0) AS lines
           FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, CASE WHEN lead(w, {_LAST}) OVER o IS NOT NULL
             THEN [w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, _LAST + 1))}] END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, {quality.WINDOW}) x(k) GROUP BY r),
m AS (SELECT r, doc_id, len(words)::bigint AS n_words,
        length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::bigint AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, len(lines) AS n_lines,
        len(list_filter(words, lambda w: list_contains({_STOP}, lower(w)))) AS n_stop,
        len(list_filter(lines, lambda x: starts_with(ltrim(x), '- ') OR starts_with(ltrim(x), '* ') OR starts_with(ltrim(x), '•'))) AS n_bullet,
        len(list_filter(lines, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_ellipsis,
        length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(text, '\\P{{Ll}}', '', 'g')) AS low FROM d),
x AS (SELECT m.*, coalesce(cov.n, 0)::bigint AS n_repeat_words, word_chars::double / greatest(n_words, 1) AS mean_word_length,
        n_symbols::double / greatest(n_words, 1) AS symbol_ratio, CASE WHEN n_words < {quality.SHORT_TEXT} THEN 1.0::double ELSE n_stop::double / greatest(n_words, 1) END AS stop_word_ratio,
        n_dup_lines::double / greatest(n_lines, 1) AS dup_line_ratio, n_bullet::double / greatest(n_lines, 1) AS bullet_line_ratio,
        n_ellipsis::double / greatest(n_lines, 1) AS ellipsis_line_ratio, up::double / greatest(up + low, 1) AS upper_ratio
      FROM m LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PCT} * n_words AS base_failed,
       NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PCT} * n_words) AND {_verdict()} AS kept
FROM x"""

_ROLE, _TEXT = "coalesce(role, '')", "coalesce(text, '')"
_OP12 = f"""
WITH t AS (SELECT conv_id::bigint AS c, length({_TEXT})::bigint AS size, turn, sha256(length({_ROLE}) || ':' || {_ROLE} || {_TEXT}) AS g
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, g, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS pos FROM t),
s AS (SELECT c, n, c - c % 100 AS b, {_crc32('x')} % 6 AS h FROM (SELECT c, count(*) AS n, any_value(hex(encode(c::varchar))) AS x FROM o GROUP BY c)),
v AS (SELECT s.c, s.n, s.b, s.h, least(s.h, coalesce(z.n, 0)) AS l FROM s LEFT JOIN s z ON z.c = s.b),
r AS (SELECT v.c, o.pos - v.h + v.l + 1 AS depth, g, size FROM o JOIN v ON v.c = o.c AND o.pos >= v.h
      UNION ALL SELECT v.c, o.pos + 1, g, size FROM v JOIN o ON o.c = v.b AND o.pos < v.l),
p AS (SELECT c, depth, size, string_agg(g, '') OVER (PARTITION BY c ORDER BY depth) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM v),
nodes AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS gain FROM p GROUP BY depth, k),
kids AS (SELECT left(k, 64 * (depth - 1)) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
x AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
up AS (SELECT left(k, 64 * i) AS k, n_children, gain FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM x)),
sub AS (SELECT k, count(*) FILTER (n_children = 0) AS n_leaves, sum(gain)::bigint AS saved_tokens FROM up GROUP BY k),
e AS (SELECT k, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, depth) AS k FROM p GROUP BY c) GROUP BY k)
SELECT x.conv_id, x.depth, up1.conv_id AS parent_conv_id, x.n_convs, x.n_children, sub.n_leaves, sub.saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM x JOIN sub USING (k) LEFT JOIN nodes up1 ON x.depth > 0 AND up1.k = left(x.k, 64 * (x.depth - 1)) LEFT JOIN e ON e.k = x.k"""

LLM_ORACLES: dict[str, str] = {"op1_sharding": _OP1, "op3_nearest": _OP3, "op4_lm_scores": _OP4, "op9_quality": _OP9, "op12_prefix_trie": _OP12}
