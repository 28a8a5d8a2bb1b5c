"""DuckDB SQL for the operators whose rows SQL can express: signatures, leaks, line dedup and language-model scores.

Tokenizer files, secret spans with links, hash-built fingerprints, sampled splitters, hashed orders and trained models
have none; tests hold them against brute-force versions.
"""

from lodestone.llm.spotsigs import ANCHORS

_SIGNATURES = f"""ordered AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(doc_id) OVER o, min(doc_id) OVER ()) AS next_id FROM documents WINDOW o AS (ORDER BY doc_id)),
both_texts AS (SELECT a.doc_id, a.next_id, a.text, substr(a.text, 1, CAST(length(a.text) - length(a.text) // 2 AS BIGINT)) || substr(b.text, 1, CAST(length(a.text) // 2 AS BIGINT)) AS edited FROM ordered a JOIN ordered b ON a.next_id = b.doc_id),
texts AS (SELECT doc_id, 'own' AS kind, text FROM both_texts UNION ALL SELECT doc_id, 'edited', edited FROM both_texts),
listed AS (SELECT doc_id, kind, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts),
tokens AS (SELECT doc_id, kind, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM listed),
marked AS (SELECT *, CASE WHEN w IN ({", ".join(f"'{a}'" for a in ANCHORS)}) THEN 1 ELSE 0 END AS anchor FROM tokens),
counted AS (SELECT *, sum(1 - anchor) OVER p AS c FROM marked WINDOW p AS (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
content AS (SELECT doc_id, kind, c, w FROM counted WHERE anchor = 0), spots AS (SELECT DISTINCT doc_id, kind, c AS s FROM counted WHERE anchor = 1),
chains AS (SELECT DISTINCT s.doc_id, s.kind, substr(md5(' ' || a.w || coalesce(' ' || b.w, '') || coalesce(' ' || d.w, '')), 1, 8) AS sig FROM spots s JOIN content a ON a.doc_id = s.doc_id AND a.kind = s.kind AND a.c = s.s + 1
  LEFT JOIN content b ON b.doc_id = s.doc_id AND b.kind = s.kind AND b.c = s.s + 2 LEFT JOIN content d ON d.doc_id = s.doc_id AND d.kind = s.kind AND d.c = s.s + 3),
every AS (SELECT * FROM chains UNION ALL SELECT doc_id, kind, substr(md5(array_to_string(w, ' ')), 1, 8) FROM listed l WHERE len(w) > 0 AND NOT EXISTS (SELECT 1 FROM chains c WHERE c.doc_id = l.doc_id AND c.kind = l.kind)),
sets AS (SELECT l.doc_id, l.kind, coalesce(list_sort(list(DISTINCT e.sig) FILTER (e.sig IS NOT NULL)), []) AS sigs FROM listed l LEFT JOIN every e ON e.doc_id = l.doc_id AND e.kind = l.kind GROUP BY l.doc_id, l.kind)"""


def _likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"round(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) < 0.1 * greatest(len({a}), len({b})) THEN 0.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END, 9)"


_SPOTSIGS = f"""WITH {_SIGNATURES} SELECT t.doc_id, length(t.text) AS n_chars, sha256(t.edited) AS edited_sha256, len(o.sigs) || ':' || array_to_string(o.sigs, '') AS fingerprint,
len(e.sigs) || ':' || array_to_string(e.sigs, '') AS edited_fingerprint, {_likeness("o.sigs", "e.sigs")} AS near_edited, {_likeness("o.sigs", "n.sigs")} AS near_next, CAST(floor(ln(greatest(len(o.sigs), 1)) / -ln(0.1) + 1e-9) AS INTEGER) AS part
FROM both_texts t JOIN sets o ON o.doc_id = t.doc_id AND o.kind = 'own' JOIN sets e ON e.doc_id = t.doc_id AND e.kind = 'edited' JOIN sets n ON n.doc_id = t.next_id AND n.kind = 'own'"""

_LEAKS = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS s FROM d, k WHERE len(w) >= k),
sh AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT)), lambda p: array_to_string(w[p : p + least(5, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
q AS (SELECT item_id, count(*) AS q FROM sh GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(q) AS item_shingles, round(count(*) / any_value(q)::DOUBLE, 6) AS containment FROM ds JOIN sh USING (k, s) JOIN q USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(q) * 0.8 - 1e-9)"""

_MODEL = """WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d), p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY 1), c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL), total AS (SELECT greatest(count(*) - 1, 1) AS m FROM t),
s AS (SELECT p.doc_id, CASE WHEN u.n > 1 THEN u.n - 1 ELSE 0.4::DOUBLE END / m AS uni, b.n - 1 AS bi, greatest(h.n - 1, 1) AS ctx, p.v FROM p JOIN c1 u ON u.w = p.w LEFT JOIN c1 h ON h.w = p.v LEFT JOIN c2 b ON b.v = p.v AND b.w = p.w, total),
g AS (SELECT doc_id, count(*) AS n, sum(ln(CASE WHEN v IS NULL THEN uni WHEN bi > 0 THEN bi::DOUBLE / ctx ELSE 0.4::DOUBLE * uni END)) AS l FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(CASE WHEN coalesce(n, 0) > 0 THEN l / n ELSE 0.0 END, 6) AS score FROM d LEFT JOIN g USING (doc_id)"""

_AHEAD = "coalesce(nullif(list_position(list_transform(range(1, least(a.n, b.n) + 1), lambda i: a.w[i] = b.w[i]), false), 0) - 1, least(a.n, b.n))"
_BEHIND = "coalesce(nullif(list_position(list_transform(range(1, least(a.n, b.n) + 1), lambda i: a.w[a.n - i + 1] = b.w[b.n - i + 1]), false), 0) - 1, least(a.n, b.n))"
_LINES = f"""WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM s),
f AS (SELECT line, min((doc_id, i)) AS first FROM x WHERE trim(line, ' ') <> '' GROUP BY 1), u AS (SELECT line, first, CASE WHEN len(string_split(line, ' ')) >= 5 THEN string_split(line, ' ') ELSE list_transform(regexp_extract_all(line, '(?s).'), lambda c: chr(1) || c) END AS w FROM f), w AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM u),
k AS (SELECT line, first, w, n, unnest([n // 2, (n - 1) // 2]) AS k FROM w WHERE n >= 5), h AS (SELECT *, 'head' AS side, array_to_string(w[1:k], ' ') AS half FROM k UNION SELECT *, 'tail', array_to_string(w[n - k + 1 : n], ' ') FROM k),
near AS (SELECT DISTINCT b.line FROM h a JOIN h b ON a.side = b.side AND a.k = b.k AND a.half = b.half AND a.first < b.first WHERE abs(a.n - b.n) <= 1 AND {_AHEAD} + {_BEHIND} >= greatest(a.n, b.n) - 1),
fate AS (SELECT x.doc_id, x.i, x.line, CASE WHEN f.first IS NULL THEN NULL WHEN f.first <> (x.doc_id, x.i) THEN 'copy' WHEN near.line IS NOT NULL THEN 'near' END AS fate FROM x LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fate = 'copy') AS n_copies, count(*) FILTER (fate = 'near') AS n_near, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (fate IS NULL), '') AS kept FROM fate GROUP BY 1)
SELECT s.doc_id, CASE WHEN s.text IS NOT NULL THEN kept END AS text, CASE WHEN s.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_copies, n_near FROM s JOIN g USING (doc_id)"""

SQL: dict[str, str] = {"op1_spotsigs": _SPOTSIGS, "op2_decontaminate": _LEAKS, "op7_line_dedup": _LINES, "op8_language_model": _MODEL}
