"""SQL of the registered queries that SQL can express."""

QUALITY = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM numbered),
windows AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) > 4)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY r),
counts AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, text, len(string_split(text, chr(10))) AS all_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
  FROM split LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * all_lines OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 10 * letters < 6 * word_chars) AS kept
FROM base
"""



def _clustering(rounds: int = 3, k: int = 16, size: int = 64) -> str:
    distance = "list_sum(list_transform(range(1, {size} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT".format(size=size)
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {size} AND list_count(embedding) = {size} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS (
  SELECT r, vec_id, v, min(d) AS d, arg_min(j, d * {k} + j) AS j
  FROM (SELECT r, vec_id, v, j, {distance} AS d FROM kept, c{t}) GROUP BY ALL)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (
  SELECT j, list(floor(s / n)::BIGINT ORDER BY i) AS c
  FROM (SELECT j, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{t}, range(1, {size + 1}) AS g(i) GROUP BY j, i) GROUP BY j),
c{t + 1} AS (SELECT c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON c{t}.j = m{t}.j)""")
    return f"""
WITH {','.join(steps)}
SELECT vec_id, a{rounds}.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.j = c{rounds}.j
"""


#: The checksum is written out: a table of 256 entries, and a fold over the bytes of id and run.
VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS g(i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 | (unicode(c)::BIGINT >> 6), 128 | (unicode(c)::BIGINT & 63)] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
shorter AS (SELECT DISTINCT less.word, less.n, v.word AS near, v.n AS near_n FROM less JOIN vocab v ON less.rest = v.word),
links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, near, near_n FROM shorter
  UNION ALL SELECT near, word, n FROM shorter),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM links),
formed AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN near_n >= 2 * vocab.n THEN near END AS form, CASE WHEN near_n >= 2 * vocab.n THEN near_n END AS form_n
  FROM vocab LEFT JOIN best ON vocab.word = best.word AND place = 1),
walk AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.reached WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, walk.reached AS root, f.n, f.n_near, f.form_n
FROM walk JOIN formed e ON e.word = walk.reached AND e.form IS NULL JOIN formed f ON f.word = walk.word
"""

LLM_ORACLES = {"op9_quality_rules": QUALITY, "op11_spelling_variants": VARIANTS, "op13_centroid_clustering": _clustering()}
