"""DuckDB SQL for the operators that SQL can express."""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, n - 1 AS line, trim(x, ' ' || chr(9) || chr(13)) AS body
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
), k AS (SELECT * FROM l WHERE length(body) >= 16),
d AS (SELECT body, min({'doc': doc_id, 'line': line}) AS first, string_split(body, ' ') AS w FROM k GROUP BY body),
v AS (
  SELECT body, first, cut, CASE WHEN cut = 0 THEN body ELSE array_to_string(list_concat(w[:cut - 1], w[cut + 1:]), ' ') END AS rest
  FROM (SELECT body, first, w, unnest(range(0, len(w) + 1)) AS cut FROM d WHERE len(w) >= 10)
), near AS (
  SELECT a.body, min(b.first) AS near
  FROM v a JOIN v b ON a.rest = b.rest AND b.first < a.first AND ((a.cut = b.cut AND a.cut > 0) OR (a.cut = 0) <> (b.cut = 0))
  GROUP BY a.body
), r AS (
  SELECT k.doc_id, k.line, d.first < {'doc': k.doc_id, 'line': k.line} AS same, d.first AS first, near.near AS near
  FROM k JOIN d ON k.body = d.body LEFT JOIN near ON near.body = k.body
)
SELECT doc_id, line, CASE WHEN same THEN first.doc ELSE near.doc END AS of_doc,
  CASE WHEN same THEN first.line ELSE near.line END AS of_line, CASE WHEN same THEN 0 ELSE 1 END AS edits
FROM r WHERE same OR near IS NOT NULL
"""

_TOP = {2: 20, 3: 18, 4: 16}
_REP = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}


def _grams(n: int) -> str:
    return f"""g{n} AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g, sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS c
  FROM w
), r{n} AS (
  SELECT g{n}.doc_id, g, c, i, count(*) OVER (PARTITION BY g{n}.doc_id, g) AS n, row_number() OVER (PARTITION BY g{n}.doc_id, g ORDER BY i) AS k
  FROM g{n} JOIN d ON g{n}.doc_id = d.doc_id WHERE i + {n - 1} <= d.n_words
)"""


def _repetition() -> str:
    parts = [_grams(n) for n in range(2, 11)]
    for n in _TOP:
        parts.append(f"t{n} AS (SELECT doc_id, max(n * c) AS top_{n} FROM r{n} WHERE n > 1 GROUP BY doc_id)")
    for n in [3, *_REP]:
        which = "n > 1" if n == 3 else "k > 1"
        parts.append(f"c{n} AS (SELECT doc_id, count(*) AS words, sum(c) AS chars FROM w SEMI JOIN (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM r{n} WHERE {which}) x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY doc_id)")
    joins = " ".join(f"LEFT JOIN {t}{n} ON {t}{n}.doc_id = d.doc_id" for t, ns in (("t", _TOP), ("c", [3, *_REP])) for n in ns)
    broken = ["CASE WHEN 100 * coalesce(dup, 0) > 30 * coalesce(lines, 0) THEN 'dup_lines' END", "CASE WHEN 100 * coalesce(dup_chars, 0) > 20 * coalesce(line_chars, 0) THEN 'dup_line_chars' END", "CASE WHEN 100 * n_symbols > 20 * n_words THEN 'symbols' END"]
    broken += [f"CASE WHEN 100 * coalesce(top_{n}, 0) > {p} * word_chars THEN 'top_{n}' END" for n, p in _TOP.items()]
    broken += [f"CASE WHEN 100 * coalesce(c{n}.chars, 0) > {p} * word_chars THEN 'rep_{n}' END" for n, p in _REP.items()]
    return rf"""
WITH d AS (
  SELECT doc_id, text, ws, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), w AS (SELECT doc_id, ws, n_words, i, length(ws[i]) AS c FROM (SELECT doc_id, ws, n_words, unnest(range(1, n_words + 1)) AS i FROM d)),
ln AS (
  SELECT doc_id, count(*) AS lines, count(*) FILTER (k > 1) AS dup, sum(c) AS line_chars, sum(c) FILTER (k > 1) AS dup_chars
  FROM (SELECT doc_id, length(x) AS c, row_number() OVER (PARTITION BY doc_id, x) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))
  GROUP BY doc_id
), {", ".join(parts)}, o AS (
  SELECT d.doc_id, n_words, word_chars, n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(c3.words, 0) AS n_repeat_words,
    concat_ws(',', {", ".join(broken)}) AS broken
  FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id {joins}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND broken = '' AS kept, broken
FROM o
"""


REPETITION = _repetition()

DECONTAMINATION = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
spots AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, text, tok, len(tok) AS n, h1 % (len(tok) + 1) AS x, h2 % (len(tok) + 1) AS y, h3 % 100 AS rate, h4 % 100 AS spm
  FROM (
    SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tok, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents)
  )
), f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR rate >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tok[1:least(x, y)], '') AS p, array_to_string(tok[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(tok[greatest(x, y) + 1:], '') AS s
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""

WARC = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
) WHERE rank <= 5
"""
