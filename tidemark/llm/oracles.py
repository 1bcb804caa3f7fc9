"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat, licenses


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _escaped(c: str, role: bool = False) -> str:
    for plain, written in chat.ESCAPES if role else chat.ESCAPES[:-1]:
        c = f"replace({c}, {_quote(plain)}, {_quote(written)})"
    return c


OP4_CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat.OPEN) + len(chat.AFTER_ROLE) + len(chat.CLOSE)} + length({_escaped("role", True)}) + length({_escaped("text")})) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

_PAIRS = ", ".join(f"({_quote(s)}, {_quote(i)})" for s, i in licenses.SENTENCES.items())
_RULES = ", ".join(f"CASE WHEN contains(',' || sequence || ',', {_quote(',' + ','.join(rule) + ',')}) THEN {_quote(name)} END" for name, rule in licenses.RULES)

OP6_LICENSES = rf"""
WITH known(sentence, id) AS (VALUES {_PAIRS}),
lines AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) AS line,
    generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), 1) AS pos
  FROM documents),
hits AS (SELECT l.doc_id, l.pos, k.id FROM lines l JOIN known k ON trim(regexp_replace(lower(l.line), '[^a-z0-9]+', ' ', 'g')) = k.sentence),
seqs AS (
  SELECT d.doc_id, coalesce(h.n, 0) AS n_sentences, coalesce(h.sequence, '') AS sequence FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS sequence FROM hits GROUP BY doc_id) h ON d.doc_id = h.doc_id)
SELECT doc_id, n_sentences, sequence,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{_RULES}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM seqs
"""

#: Windows of 35 words and their number; a row number stands for each row, since ids may repeat.
OP2_SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT r, i FROM v WHERE win IN (SELECT win FROM v GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT r, list(k) AS ks FROM (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM again) GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d) WHERE (r, k) NOT IN (SELECT r, unnest(ks) FROM gone) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: All pairs of a label and what they reach.
OP7_VECTORS = r"""
WITH RECURSIVE u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM u WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a AS vec_id, min(b) AS low FROM c GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept FROM embeddings LEFT JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS8 = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Windows of ten words, or of a whole shorter item.
OP8_CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORDS8}) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, {_WORDS8}) AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item FROM v JOIN q USING (n, win)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
