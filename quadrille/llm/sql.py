"""What the queries of this subpackage return, as DuckDB SQL over the same tables."""

from __future__ import annotations

from . import chat_format
from .license_scan import NOTICES, PHRASES, _templates

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def license_scan(k: int = 2, slack: int = 2, coverage: float = 0.85) -> str:
    """Places of runs of two words, votes by diagonal, neighbours merged."""
    places, kinds = _templates(PHRASES, NOTICES, k, coverage)
    row = lambda r: "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")"
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places(gram, template, spot, bit) AS (VALUES {", ".join(map(row, places))}),
kinds(template, label, parts, least, mask, exact) AS (VALUES {", ".join(map(row, kinds))}),
runs AS (SELECT doc_id, i - 1 AS pos, ws[i] || ' ' || ws[i + 1] AS gram FROM w, unnest(range(1, len(ws))) AS u(i)),
votes AS (SELECT doc_id, template, pos - spot AS diagonal, bit_or(CAST(bit AS BIGINT)) AS seen FROM runs JOIN places USING (gram) GROUP BY ALL),
apart AS (
  SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER p > {slack}, true) THEN 1 ELSE 0 END AS new
  FROM votes JOIN kinds USING (template) WINDOW p AS (PARTITION BY doc_id, template ORDER BY diagonal)),
spans AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM apart),
merged AS (
  SELECT doc_id, template, label, exact, parts, least, mask, min(diagonal) AS first, bit_or(seen) AS seen FROM spans GROUP BY doc_id, template, label, exact, parts, least, mask, span),
good AS (SELECT *, bit_count(seen) AS found FROM merged WHERE bit_count(seen) >= least AND seen & mask = mask),
told AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(found::DOUBLE / parts) AS score
  FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN told USING (doc_id)
"""


#: Lines by their place; equal ones, and those of 16 characters or more that are one edit apart by their variants.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, no - 1 AS no, doc_id * 10000000 + no - 1 AS place, x, trim(x, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL)),
first AS (SELECT line, min(place) AS own FROM lines WHERE line <> '' GROUP BY line),
cut AS (SELECT line, own, i, left(line, i - 1) AS a, substr(line, i + 1) AS b FROM first, unnest(range(1, length(line) + 1)) AS u(i) WHERE length(line) >= 16),
swapped AS (SELECT line, min(own) OVER (PARTITION BY i, a, b) AS near FROM cut),
grown AS (SELECT DISTINCT c.line AS longer, c.own AS o1, f.line AS shorter, f.own AS o2 FROM cut c JOIN first f ON c.a || c.b = f.line WHERE length(f.line) >= 16),
near AS (
  SELECT line, min(near) AS near FROM (
    SELECT line, near FROM swapped UNION ALL SELECT longer, o2 FROM grown UNION ALL SELECT shorter, o1 FROM grown) GROUP BY line),
bar AS (SELECT first.line, least(own, coalesce(near, own)) AS bar FROM first LEFT JOIN near ON first.line = near.line),
judged AS (SELECT l.*, coalesce(l.place > bar.bar, false) AS gone FROM lines l LEFT JOIN bar ON l.line = bar.line),
told AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256 FROM documents LEFT JOIN told USING (doc_id)
"""


#: The plain counts of the quality rules.
BASE_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS run FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
many AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM runs GROUP BY doc_id, run HAVING count(*) > 1)),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM many, unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""


#: Windows of 13 words, the first document of each, and what no window of a later one covers.
SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS u(i)),
first AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN first USING (win), unnest(range(13)) AS u(j) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: All pairs of vectors; components by reachability.
EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT x AS s, x AS t FROM links UNION SELECT s, y FROM reach JOIN links ON t = x),
least AS (SELECT s, min(t) AS t FROM reach GROUP BY s),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(t, vec_id) AS component_id, vec_id = coalesce(t, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON x = vec_id LEFT JOIN least ON s = vec_id
"""


#: Each conversation beside a copy whose last turn has another text: all turns but the last are common.
CHAT_FORKS = chat_format.SQL.replace(
    "WITH said AS (",
    """WITH ends AS (SELECT conv_id, max(turn) AS stop FROM conversations GROUP BY conv_id),
forks AS (
  SELECT 2 * conv_id AS conv_id, turn, role, text FROM conversations
  UNION ALL SELECT 2 * conv_id + 1, turn, role, CASE WHEN turn = stop THEN text || '!' ELSE text END FROM conversations JOIN ends USING (conv_id)),
said AS (""",
).replace("FROM conversations WHERE conv_id IS NOT NULL", "FROM forks WHERE conv_id IS NOT NULL")
