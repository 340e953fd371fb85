"""DuckDB SQL for the queries that SQL can express on the whole tables."""

from __future__ import annotations

from strandline.llm import quality_rules as R

_BLANK = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '')"
_LINE_WORDS = "(length(x) - length(replace(x, ' ', '')) + 1)"
_BOILERPLATE = "|".join(R.BOILERPLATE)
_FAILS = f"""(trim(x, ' ') <> '' AND ((NOT regexp_matches(x, '[.!?:;"'')\\]\\x{{2026}}\\x{{201D}}\\x{{00BB}}][\\x20\\x09-\\x0D]*$') AND {_LINE_WORDS} > {R.HEADING_WORDS})
 OR (length(x) - length(replace(x, '|', ''))) * 100 > {_LINE_WORDS} * {R.MAX_BARS_PERCENT}
 OR ((length(x) - length(replace(x, '!!', ''))) // 2) * 100 > {_LINE_WORDS} * {R.MAX_SHOUTS_PERCENT}
 OR len(regexp_extract_all(x, '[#*$%&<>]')) * 100 > {_LINE_WORDS} * {R.MAX_SYMBOLS_PERCENT}
 OR len(regexp_extract_all(lower(x), '{_BOILERPLATE}')) * 100 > {_LINE_WORDS} * {R.MAX_PHRASES_PERCENT}))"""

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS solid FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(0, 5) s(k) GROUP BY doc_id),
f AS (SELECT doc_id, list_filter(solid, lambda x: {_FAILS}) AS failing FROM d),
c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(solid) - len(list_distinct(solid)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(failing) AS n_lines_removed,
  coalesce(list_sum(list_transform(failing, lambda x: length(x))), 0) AS chars_removed, coalesce(list_sum(list_transform(solid, lambda x: length(x))), 0) AS line_chars
  FROM d JOIN f USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {R.MIN_WORDS} OR n_repeat_words * 100 > n_words * {R.MAX_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {R.MIN_WORDS} OR n_repeat_words * 100 > n_words * {R.MAX_REPEAT_PERCENT}) AND chars_removed * 100 <= line_chars * {R.MAX_LOSS_PERCENT} AS kept,
  n_lines_removed, CAST(chars_removed AS BIGINT) AS chars_removed FROM c
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM p) WHERE low < doc_id),
s AS (SELECT doc_id, list(i) AS starts FROM x GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM x, range(0, 50) r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256 FROM d WINDOW g AS (PARTITION BY h)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id) c USING (doc_id)
"""

ORACLES = {"op2_quality_rules": OP2, "op4_substring_dedup": OP4, "op7_exact_dedup": OP7, "op10_ngram_join": OP10}
