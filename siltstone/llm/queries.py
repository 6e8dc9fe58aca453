"""The training-data operators' queries, and SQL for those whose whole result SQL can express."""

from __future__ import annotations

from siltstone.llm.bpe_automaton import op2_bpe_codec
from siltstone.llm.chat_format import op4_chat_format
from siltstone.llm.collocations import op11_collocations
from siltstone.llm.fingerprints import op8_fingerprints
from siltstone.llm.hard_negatives import op12_hard_negatives
from siltstone.llm.jaccard_join import op10_jaccard_join
from siltstone.llm.language_id import op5_language_id
from siltstone.llm.packing import op3_packing
from siltstone.llm.pivot_search import op13_pivot_search
from siltstone.llm.quality_rules import op6_quality_rules
from siltstone.llm.rule_ensemble import op9_rule_ensemble
from siltstone.llm.secret_scan import op1_secret_scan
from siltstone.llm.token_files import op7_token_files

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_bpe_codec, op3_packing, op4_chat_format, op5_language_id, op6_quality_rules, op7_token_files, op8_fingerprints, op9_rule_ensemble, op10_jaccard_join, op11_collocations, op12_hard_negatives, op13_pivot_search)}

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role, '\\|<s>|\[INST\]|\[/INST\]|</s>')) + len(regexp_extract_all(text, '\\|<s>|\[INST\]|\[/INST\]|</s>')) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
walk AS (SELECT DISTINCT a AS node, a AS root FROM p UNION SELECT p.b, root FROM walk JOIN p ON node = p.a WHERE root < p.b),
least AS (SELECT node, min(root) AS root FROM walk GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least(root, doc_id), doc_id) AS component_id FROM s LEFT JOIN least ON node = doc_id
"""
COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, f, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM c, range(1, 3) t(cut) WHERE cut < k),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, cut, (1000000::HUGEINT * cuts.f * cuts.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3),
around AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN around o ON o.lang = least.lang AND o.phrase = least.phrase WHERE coalesce(100 * o.f < 50 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
NEGATIVES = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3
"""
NEAREST = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT a AS query_id, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INTEGER AS rank, b AS vec_id, s AS score FROM s QUALIFY rank <= 5
"""
ORACLES = {"op4_chat_format": CHAT, "op10_jaccard_join": JACCARD, "op11_collocations": COLLOCATIONS, "op12_hard_negatives": NEGATIVES, "op13_pivot_search": NEAREST}
