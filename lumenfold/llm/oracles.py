"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from . import bit_sliced, decontaminate, lines, quality, resampling
from .common import LOWER, UPPER

_WORD_GAP = r"[\x20\x09-\x0D]+"


def _split(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x <> '')"


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_split(_LOWERED, decontaminate.GAP)} AS w FROM documents),
b AS (SELECT item_id, {_split(_LOWERED, decontaminate.GAP)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + {decontaminate.SIZE - 1}), ' ') AS p, least(len(w), {decontaminate.SIZE}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.SIZE - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win USING (p)),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_TRIM = "trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
WITH r AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS raws FROM documents),
o AS (SELECT doc_id, no, raw, {_TRIM} AS l FROM (SELECT doc_id, unnest(raws) AS raw, unnest(range(len(raws))) AS no FROM r)),
f AS (SELECT l, min((doc_id, no)) AS first, row_number() OVER (ORDER BY min((doc_id, no))) AS pos FROM o WHERE l <> '' GROUP BY l),
g AS (SELECT l, pos, length(l) AS n FROM f WHERE length(l) >= {lines.MIN_CHARS}),
v AS (SELECT pos, n, i, md5(left(l, i - 1) || substr(l, i + 1)) AS rest FROM (SELECT l, pos, n, unnest(range(1, n + 1)) AS i FROM g)),
sub AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, i, rest) AS least FROM v) WHERE pos > least),
ins AS (SELECT greatest(v.pos, h.pos) AS pos FROM v JOIN (SELECT pos, md5(l) AS whole FROM g) h ON v.rest = h.whole AND v.pos <> h.pos),
near AS (SELECT DISTINCT pos FROM (SELECT * FROM sub UNION ALL SELECT * FROM ins)),
m AS (SELECT o.doc_id, o.no, o.raw, o.l, o.l <> '' AND (o.doc_id, o.no) <> f.first AS exact, o.l <> '' AND (o.doc_id, o.no) = f.first AND near.pos IS NOT NULL AS near FROM o LEFT JOIN f USING (l) LEFT JOIN near USING (pos))
SELECT doc_id, count(*) FILTER (WHERE l <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE coalesce(exact, false))::BIGINT AS n_exact, count(*) FILTER (WHERE coalesce(near, false))::BIGINT AS n_near,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE NOT coalesce(exact, false) AND NOT coalesce(near, false)), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_METRICS = {k: f"{count} / greatest({size}, 1)::DOUBLE" for k, (count, size, _) in quality.METRICS.items()}
_W = quality.WINDOW


def _quality() -> str:
    melt = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS x FROM base WHERE NOT base_failed" for k, v in _METRICS.items())
    value = f"CASE WHEN b <= 0 THEN 0 ELSE 2 * pow({quality.GAMMA}::DOUBLE, (b - 1)::DOUBLE) / {quality.GAMMA + 1.0}::DOUBLE / 1000 END"

    val = lambda b: value.replace("(b ", f"({b} ").replace("WHEN b ", f"WHEN {b} ")

    share = lambda name, part: f"{name} AS (SELECT {part}, b, n / sum(n) OVER (PARTITION BY {part}) AS p FROM {name}_n)"
    at = lambda q: f"min(b) FILTER (WHERE upto >= {q}::DOUBLE - 1e-9)"
    prior = f"{quality.PRIOR_ROWS} * p"
    sides = ", ".join(f"max(hi) FILTER (WHERE metric = '{k}') AS hi_{k}, max(lo) FILTER (WHERE metric = '{k}') AS lo_{k}" for k in quality.METRICS)
    chance = lambda k: f"{quality.SIGMA} * sqrt({quality.METRICS[k][0]} * {quality.METRICS[k][2]}::DOUBLE)"
    high = [f"coalesce({c} - {chance(k)} <= hi_{k} * {n}, true)" for k, (c, n, _) in quality.METRICS.items()]
    low = [f"coalesce({quality.METRICS[k][0]} + {chance(k)} >= lo_{k} * {quality.METRICS[k][1]}, true)" for k in quality.TWO_SIDED]
    fits = " AND ".join([*high, *low])
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_split("coalesce(text, '')", _WORD_GAP)} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {_W - 1}), ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_W - 2})) AS i FROM d WHERE len(w) >= {_W})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, p) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + {_W})) AS pos FROM twice) GROUP BY doc_id),
cnt AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WORD_GAP}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM cnt),
melt AS ({melt}),
sk AS (SELECT lang, source, metric, CASE WHEN x < 0.001 THEN 0 ELSE ceil(ln(greatest(x * 1000, 1)) / ln({quality.GAMMA}::DOUBLE))::BIGINT + 1 END AS b, count(*) AS n FROM melt GROUP BY ALL),
w_n AS (SELECT metric, b, sum(n)::DOUBLE AS n FROM sk GROUP BY ALL), {share("w", "metric")},
l_n AS (SELECT lang, metric, b, sum(n) AS n FROM (SELECT lang, metric, b, n::DOUBLE AS n FROM sk UNION ALL SELECT x.lang, x.metric, w.b, {prior} FROM (SELECT DISTINCT lang, metric FROM sk) x JOIN w ON w.metric = x.metric) GROUP BY ALL), {share("l", "lang, metric")},
g_n AS (SELECT lang, source, metric, b, sum(n) AS n FROM (SELECT lang, source, metric, b, n::DOUBLE AS n FROM sk
  UNION ALL SELECT x.lang, x.source, x.metric, l.b, {prior} FROM (SELECT DISTINCT lang, source, metric FROM sk) x JOIN l ON l.metric = x.metric AND l.lang IS NOT DISTINCT FROM x.lang) GROUP BY ALL), {share("g", "lang, source, metric")},
run AS (SELECT *, sum(p) OVER (PARTITION BY lang, source, metric ORDER BY b) AS upto FROM g),
q AS (SELECT lang, source, metric, {at(1 - quality.TAIL)} AS b1, {at(0.5)} AS b2, {at(quality.TAIL)} AS b3 FROM run GROUP BY ALL),
lim AS (SELECT lang, source, metric, {val('b1')} - {quality.SPREAD} * ({val('b2')} - {val('b1')}) AS lo, {val('b3')} + {quality.SPREAD} * ({val('b3')} - {val('b2')}) AS hi FROM q),
wide AS (SELECT lang, source, {sides} FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fits} AS kept
FROM base LEFT JOIN wide ON base.lang IS NOT DISTINCT FROM wide.lang AND base.source IS NOT DISTINCT FROM wide.source
"""


QUALITY = _quality()

_R = resampling

RESAMPLING = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, {_split(_LOWERED, decontaminate.GAP)} AS w FROM documents),
b AS (SELECT {_split(_LOWERED, decontaminate.GAP)} AS w FROM benchmark),
tw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
sw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {_R.N_BUCKETS} AS bucket
  FROM (SELECT w FROM sw UNION SELECT w FROM tw), tab),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM sw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM tw JOIN hashed USING (w) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS ss, coalesce((SELECT sum(n) FROM t), 0) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (ss + {_R.N_BUCKETS}) / ((coalesce(s.n, 0) + 1) * (tt + {_R.N_BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (bucket), tot),
weighed AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{_R.SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {_R.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {_R.PERCENT} * count(*) // 100 FROM placed) THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

_B = bit_sliced

TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({_B.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % {_B.EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {_B.K}
"""
