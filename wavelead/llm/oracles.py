"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op6_host_rules": r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM words WHERE len(w) > 2),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM words) AS words
  LEFT JOIN covered ON covered.doc_id = words.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source),
moments AS (
  SELECT avg(f / n) AS m, var_pop(f / n) - avg(f / n * (1 - f / n) / n) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 20 END AS s FROM moments)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round((f + m * s) / (n + s), 6) AS shrunk_rate, NOT base_failed AND NOT ((f + m * s) / (n + s) > 0.5) AS kept
FROM judged JOIN hosts ON hosts.source IS NOT DISTINCT FROM judged.source, prior
""",
    "op11_fill_in_middle": r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
cut AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h
  FROM hashed),
parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(h[1] % (n + 1), h[2] % (n + 1))], '') AS a,
         array_to_string(units[least(h[1] % (n + 1), h[2] % (n + 1)) + 1 : greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS b,
         array_to_string(units[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1 : ], '') AS c
  FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                      ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output
  FROM parts),
back AS (
  SELECT *, string_split_regex(output, '<[PSM]>') AS p FROM made)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN p[2] || p[4] || p[3] ELSE p[3] || p[4] || p[2] END)
         AS restored_sha256
FROM back
""",
    "op13_ranked_search": r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
size AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM words WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
each AS (
  SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM words),
found AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY doc, doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM found, size GROUP BY term),
scores AS (
  SELECT item_id, doc, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM found JOIN weights USING (term) JOIN asked USING (term), size GROUP BY item_id, doc, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
