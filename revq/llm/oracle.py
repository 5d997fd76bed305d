"""The corpus queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s
  FROM docs),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM sets LEFT JOIN least ON a = doc_id
"""

TOKENS = f"""
WITH counts AS (
  SELECT source, lang, coalesce(toxic, 0) AS toxic,
    CASE WHEN quality = 0 THEN translate(text, '#*$%&|<>', '') ELSE text END AS text
  FROM documents LEFT JOIN labels USING (doc_id)),
kept AS (SELECT source, lang, len({WORDS}) AS words, strlen(coalesce(text, '')) AS bytes FROM counts WHERE toxic <> 1),
each AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM kept
         UNION ALL SELECT source, lang, 'bytes-1', bytes FROM kept)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM each GROUP BY ALL
"""

LOADED = f"""
WITH counts AS (SELECT source, lang, len({WORDS}) AS words, strlen(coalesce(text, '')) AS bytes FROM documents),
each AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM counts
         UNION ALL SELECT source, lang, 'bytes-1', bytes FROM counts)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM each GROUP BY ALL
"""

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM docs),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
         FROM windows JOIN firsts USING (k) WHERE first < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

LINES = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
             GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped
           FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

AUDIT = f"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
measured AS (
  SELECT docs.*, {WORDS} AS ws, doc_id > least AS copy,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper
  FROM docs JOIN firsts USING (text)),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, quality = 1 AS good, toxic = 1 AS bad,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * upper > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN copy THEN 'E' ELSE '' END AS fails
  FROM measured LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
  FROM failed GROUP BY part, fails),
summed AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN bad ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD,
    "op2_token_counts": TOKENS,
    "op2_loaded_counts": LOADED,
    "op3_substring_dedup": SUBSTRINGS,
    "op7_line_dedup": LINES,
    "op11_filter_audit": AUDIT,
}
