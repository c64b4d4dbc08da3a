"""DuckDB SQL of the queries that SQL can express. The others need XXH64, CRC-32, a tokenizer or a trained model. Patterns and bounds are
written here anew; only the licence templates and what speaks of rights are taken from their module, as data."""

from __future__ import annotations

from tessera.llm import licenses
from tessera.llm.words import LOWER, UPPER


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spans(kind: int, pattern: str) -> str:
    """Rows (doc_id, source, lang, start, stop, kind, value) of all matches of a pattern."""
    p = text(pattern)
    return f"""SELECT doc_id, source, lang, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(hits[i]) AS size, {kind} AS kind, hits[i] AS value
        FROM (SELECT doc_id, source, lang, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), {p}) AS hits, string_split_regex(coalesce(text, ''), {p}) AS gaps FROM documents WHERE regexp_matches(text, {p})))"""


def either_case(names: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){VALUE}"
NAMED = f"({either_case('pwd|passphrase|credential|bearer|private_?key|access_?key|auth_?key')}){VALUE[:-2]}{{12,}})"
BARE = "regexp_replace(value, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?', '')"
TOUCHES = "NOT EXISTS (SELECT 1 FROM {other} b WHERE b.doc_id = x.doc_id AND b.start < x.start + x.size AND x.start < b.start + b.size)"
NAMES = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || start || ':' || (start + size)"
SECRETS = f"""WITH b AS (SELECT * FROM ({spans(0, ASSIGN)}) WHERE length({BARE}) >= 12 UNION ALL {spans(1, "AKIA[A-Z0-9]{14,}")} UNION ALL {spans(2, "[0-9a-f]{16,}")}),
 c AS (SELECT * FROM ({spans(3, "[A-Za-z0-9+/_-]{20,}")}) x WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND {TOUCHES.format(other="b")}),
 n AS (SELECT * FROM ({spans(3, NAMED)}) x WHERE regexp_matches({BARE}, '[0-9]') AND regexp_matches({BARE}, '[A-Za-z]') AND {TOUCHES.format(other="b")} AND {TOUCHES.format(other="c")}),
 s AS (SELECT *, {BARE} AS secret FROM (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM n)),
 o AS (SELECT secret, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT coalesce('=' || source, '') || '/' || coalesce('=' || lang, '')) AS repositories FROM s GROUP BY secret),
 k AS (SELECT doc_id, kind, start, size, owners, repositories, owners <= 1 AND repositories <= 4 AS live FROM s JOIN o ON s.secret = o.secret WHERE kind < 3 OR (owners <= 1 AND repositories <= 4)),
 g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, coalesce(string_agg({NAMES}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base, string_agg({NAMES}, ',' ORDER BY start, kind) AS spans,
   count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied, max(owners) AS most_owners, max(repositories) AS most_repositories FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

SPACES = r"[\x20\x09-\x0D]"


def quartiles(name: str, keys: str) -> str:
    """Median and narrower quarter of each key and measure, from summed buckets."""
    by = f"{keys}, measure" if keys else "measure"
    quantile = lambda k: f"min(CASE WHEN 4 * upto >= {k} * total THEN bucket END) AS q{k}"
    return f"""{name}_m AS (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket), {name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto FROM {name}_m),
 {name} AS (SELECT {by}, docs, q2 AS median, least(q3 - q2, q2 - q1) AS quarter FROM (SELECT {by}, {quantile(1)}, {quantile(2)}, {quantile(3)}, max(total) AS docs FROM {name}_u GROUP BY {by}))"""


QUALITY = f"""WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(text, '{SPACES}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
 p AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
 m AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS BIGINT) AS n_marks,
   CAST(len(list_filter(w, lambda x: length(x) <= 3)) AS BIGINT) AS n_short, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
 v AS (SELECT doc_id, lang, source, n_words, unnest(['words', 'word_length', 'marks', 'short_words']) AS measure, unnest([n_words, word_chars * 10000 // greatest(n_words, 1), n_marks * 10000 // greatest(word_chars, 1), n_short * 10000 // greatest(n_words, 1)]) AS v FROM m),
 sketch AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) AS bucket, count(*) AS n FROM v GROUP BY ALL),
 {quartiles("own", "lang, source")}, {quartiles("by_lang", "lang")}, {quartiles("by_all", "")},
 k AS (SELECT lang, source, o.measure, CASE WHEN o.docs >= 200 THEN o.median WHEN b.docs >= 200 THEN b.median WHEN a.docs >= 200 THEN a.median END AS median, 10 * greatest(CASE WHEN o.docs >= 200 THEN o.quarter WHEN b.docs >= 200 THEN b.quarter WHEN a.docs >= 200 THEN a.quarter END, usual) AS reach
   FROM own o JOIN by_lang b USING (lang, measure) JOIN by_all a USING (measure) LEFT JOIN (SELECT lang, measure, percentile_disc(0.5) WITHIN GROUP (ORDER BY quarter DESC) AS usual FROM own WHERE docs >= 200 GROUP BY lang, measure) USING (lang, measure)),
 j AS (SELECT v.doc_id, bool_and(coalesce(k.reach = 0 OR k.median IS NULL OR CAST(v.v - k.median AS DOUBLE) * CAST(v.v - k.median AS DOUBLE) * v.n_words <= CAST(k.reach AS DOUBLE) * CAST(k.reach AS DOUBLE) * greatest(v.n_words, u.median), true)) AS inside
   FROM v JOIN k USING (lang, source, measure) JOIN k u ON u.lang = v.lang AND u.source = v.source AND u.measure = 'words' WHERE v.measure <> 'words' GROUP BY v.doc_id),
 f AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, inside FROM m JOIN j ON m.doc_id = j.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM f"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
 x AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
 y AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
 h AS (SELECT doc_id, i, y.n, item_id FROM y JOIN x ON y.n = x.n AND y.g = x.g), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""

PREFERENCE = f"""WITH a AS (SELECT conv_id, min(turn) AS first, max(turn) AS last, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
 r AS (SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN first_text ELSE text END AS text FROM conversations c LEFT JOIN a ON c.conv_id = a.conv_id WHERE NOT coalesce(role = 'assistant' AND turn = last AND first = last, false)),
 b AS (SELECT c.conv_id, c.turn, c.role, c.text, r.role AS r_role, r.text AS r_text, c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text AS differs FROM conversations c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn),
 p AS (SELECT *, min(CASE WHEN differs THEN turn END) OVER (PARTITION BY conv_id) AS parting FROM b),
 s AS (SELECT conv_id, CASE WHEN parting IS NULL OR turn < parting THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM p UNION ALL SELECT conv_id, 'rejected', turn, r_role, r_text FROM p WHERE turn >= parting AND r_role IS NOT NULL)
SELECT conv_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length('<|im_start|>' || role) + 1 ELSE 0 END AS INT) AS mask_from, CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length('<|im_start|>' || role) + 1 + length(text) ELSE 0 END AS INT) AS mask_to FROM s"""

PAIRS = f"""WITH seg AS ({PREFERENCE}),
 o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM seg)
SELECT conv_id, {", ".join(f"coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (WHERE part = '{p}'), '') AS {p}" for p in ("prompt", "chosen", "rejected"))}, {", ".join(f"coalesce(string_agg((spot + mask_from) || ':' || (spot + mask_to), ',' ORDER BY turn) FILTER (WHERE part = '{p}' AND mask_to > mask_from), '') AS {p}_masks" for p in ("chosen", "rejected"))} FROM o GROUP BY conv_id HAVING bool_or(part <> 'prompt')"""

TERMS = "regexp_extract_all(lower({}), '[A-Za-z0-9]+(?:\\.[0-9]+)*')"
SPEAKS = text(licenses.SPEAKS)
LICENCES = f"""WITH tpl(template, licence, line) AS (VALUES {", ".join("(" + ", ".join(map(text, x)) + ")" for x in licenses.template_lines())}),
 tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest({TERMS.format("line")}) AS term FROM tpl) GROUP BY ALL),
 idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf, count(DISTINCT licence) AS holders FROM tt GROUP BY term),
 tw AS (SELECT template, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS weight, sum(tf) OVER (PARTITION BY template) AS size, holders = min(holders) OVER (PARTITION BY template) AS mark FROM tt JOIN idf USING (term)),
 f AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 8 = 0 AS is_file, list_filter([source, lang, 'd' || (doc_id // 400), 'e' || (doc_id // 40)][1:CASE WHEN doc_id % 8 = 0 THEN doc_id // 8 % 4 + 1 ELSE 4 END], lambda x: x IS NOT NULL) AS folder FROM documents),
 u AS (SELECT doc_id, unnest(list_concat(list_transform(string_split(text, chr(10)), lambda x: {{'kind': 0, 'x': x}}), list_transform(string_split_regex(text, '\\n[\\x20\\t\\r]*\\n'), lambda x: {{'kind': 1, 'x': x}}), CASE WHEN is_file THEN [{{'kind': 2, 'x': text}}] ELSE [] END)) AS u FROM f WHERE regexp_matches(text, {SPEAKS})),
 n AS (SELECT row_number() OVER () AS unit, doc_id, u.kind AS kind, {TERMS.format("u.x")} AS terms FROM u WHERE u.kind = 2 OR regexp_matches(u.x, {SPEAKS})),
 ends AS (SELECT unit, doc_id, i, template, tw.size, mark FROM (SELECT unit, doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM n WHERE kind = 1) x JOIN tw USING (term) WHERE tw.size <= 24),
 leads AS (SELECT template, size, marks, unnest(own[1:4]) AS term, generate_subscripts(own[1:4], 1) AS k FROM (SELECT template, {TERMS.format("line")} AS own FROM tpl) JOIN (SELECT template, any_value(size) AS size, list(term) FILTER (WHERE mark) AS marks FROM tw GROUP BY template) USING (template) WHERE size > 24),
 w AS (SELECT unit, doc_id, '' AS meets, 0 AS spot, 0 AS size, terms FROM n UNION ALL
   SELECT DISTINCT a.unit, a.doc_id, a.template, a.i, b.i - a.i + 1, n.terms[a.i:b.i] FROM ends a JOIN ends b ON a.unit = b.unit AND a.template = b.template AND b.i BETWEEN a.i AND a.i + a.size + 3 JOIN ends m ON m.mark AND m.unit = a.unit AND m.template = a.template AND m.i BETWEEN a.i AND b.i JOIN n ON n.unit = a.unit UNION ALL
   SELECT DISTINCT x.unit, x.doc_id, leads.template, i - k + 1, len(x.terms[i - k + 1:i - k + leads.size]), x.terms[i - k + 1:i - k + leads.size] FROM (SELECT unit, doc_id, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM n WHERE kind = 1) x JOIN leads USING (term) WHERE i >= k AND list_has_any(x.terms[i - k + 1:i - k + leads.size], leads.marks)),
 tf AS (SELECT unit, doc_id, meets, spot, size, term, count(*) AS tf FROM (SELECT unit, doc_id, meets, spot, size, unnest(terms) AS term FROM w) GROUP BY ALL),
 v AS (SELECT tf.*, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM tpl)) + 1) AS w FROM tf LEFT JOIN idf USING (term)), norm AS (SELECT unit, meets, spot, size, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
 dots AS (SELECT v.unit, v.doc_id, v.meets, v.spot, v.size, template, licence, sum(w * weight) AS dot FROM v JOIN tw USING (term) WHERE meets IN ('', template) GROUP BY ALL),
 s AS (SELECT doc_id, licence, round(dot / norm, 9) AS score FROM dots JOIN norm USING (unit, meets, spot, size)),
 own AS (SELECT doc_id, score, licence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS k FROM s WHERE score >= 0.6) WHERE k = 1),
 held AS (SELECT folder, licence FROM (SELECT folder, licence, row_number() OVER (PARTITION BY folder ORDER BY score DESC, licence) AS k FROM f JOIN own USING (doc_id) WHERE is_file) WHERE k = 1),
 near AS (SELECT doc_id, up, held.folder AS holder, held.licence, row_number() OVER (PARTITION BY doc_id ORDER BY up) AS k FROM (SELECT doc_id, folder, unnest(range(0, len(folder) + 1)) AS up FROM f) x JOIN held ON held.folder = x.folder[1:len(x.folder) - up])
SELECT f.doc_id, own.licence AS own_licence, round(own.score, 6) AS score, coalesce(own.licence, near.licence) AS licence, CASE WHEN own.licence IS NULL THEN array_to_string(holder, '/') END AS inherited_from, CASE WHEN own.licence IS NULL THEN CAST(up AS INT) END AS steps_up
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near ON f.doc_id = near.doc_id AND near.k = 1"""

PHRASES = f"""WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
 g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) r(k) WHERE len(w) >= k),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
 inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM c, range(2, 5) x(m), range(1, 5) y(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
 kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE inside.a IS NULL OR 100 * inside.a < 100 * c.a),
 cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS before, array_to_string(w[j + 1:k], ' ') AS after FROM kept, range(1, 5) z(j) WHERE j < k),
 s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, l.f AS l, r.f AS r, n.n, CAST(1000 * CAST(cuts.a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = before JOIN f r ON r.lang = cuts.lang AND r.phrase = after JOIN n ON n.lang = cuts.lang),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000"""

NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLES = {"op2_licenses": LICENCES, "op4_secrets": SECRETS, "op5_quality": QUALITY, "op9_preference": PREFERENCE, "preference_pairs": PAIRS, "op10_decontaminate": CONTAMINATION, "op11_phrases": PHRASES, "op13_hard_negatives": NEGATIVES}
