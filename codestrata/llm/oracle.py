"""SQL of the queries that SQL can express, for DuckDB."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, {WORDS} AS words,
    list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines,
    translate(text, {BLANKS}, '') AS letters
  FROM texts
), windows AS (
  SELECT row_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three, i
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeats AS (
  SELECT row_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY row_id, three) > 1
), covered AS (
  SELECT row_id, count(DISTINCT place) AS n
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM repeats) GROUP BY row_id
), stats AS (
  SELECT doc_id, text, cast(len(words) AS BIGINT) AS n_words, cast(length(letters) AS BIGINT) AS word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    cast(len(lines) AS BIGINT) AS n_lines,
    cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
    AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND 10 * n_symbols <= n_words
    AND 2 * n_dup_lines <= n_lines
    AND 10 * (length(text) - length(translate(text, '|•', ''))) <= n_words
    AND 10 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= 3 * word_chars
    AND 10 * (length(text) - length(translate(text, '!?', ''))) <= n_words
    AND 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) <= 3 * word_chars AS kept
FROM stats
"""

OP4 = """
WITH answers AS (
  SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS last
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id
), sides AS (
  SELECT conv_id AS pair_id, true AS is_chosen, turn, role, text
  FROM conversations JOIN answers USING (conv_id)
  UNION ALL
  SELECT conv_id, false, turn, role, text
  FROM conversations JOIN answers USING (conv_id) WHERE turn < last.turn
  UNION ALL
  SELECT a.conv_id, false, a.last.turn, 'assistant', b.last.text
  FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1)
), shown AS (
  SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM sides
), placed AS (
  SELECT *, row_number() OVER side - 1 AS position,
    cast(sum(length(rendered)) OVER side - length(rendered) AS BIGINT) AS start
  FROM shown
  WINDOW side AS (PARTITION BY pair_id, is_chosen ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), places AS (
  SELECT pair_id, position,
    count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same
  FROM placed GROUP BY pair_id, position
), prefixes AS (
  SELECT pair_id, coalesce(min(position) FILTER (NOT same), count(*)) AS prefix
  FROM places GROUP BY pair_id
)
SELECT pair_id,
  CASE WHEN position < prefix THEN 'prompt' WHEN is_chosen THEN 'chosen' ELSE 'rejected' END AS part,
  position, role, rendered, position >= prefix AND role = 'assistant' AS loss,
  start, length(rendered) AS length
FROM placed JOIN prefixes USING (pair_id)
WHERE is_chosen OR position >= prefix
"""

# A source's cap of twice its size binds for the lowest caps per weight; the rest shares what is
# left by weight.
OP8 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, len({WORDS}) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS shuffled
  FROM documents
), sources AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)
), capped AS (
  SELECT *,
    1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
      - coalesce(sum(2 * source_size) OVER before, 0) AS left_over,
    (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0) AS weights
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight::DOUBLE, source IS NULL, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT left_over::DOUBLE AS left_over, weights::DOUBLE AS weights FROM capped
  WHERE left_over::DOUBLE * weight / weights <= 2 * source_size ORDER BY weights DESC LIMIT 1
), plan AS (
  SELECT source, source_size, least(level.left_over * weight / level.weights, 2.0::DOUBLE * source_size) AS target
  FROM sources, level
), placed AS (
  SELECT docs.*, source_size, target, cast(floor(target) AS BIGINT) AS quota,
    cast(sum(size) OVER (PARTITION BY docs.source ORDER BY (size = 0), shuffled, doc_id, row_id) - size AS BIGINT) AS start
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, source, cast(size AS BIGINT) AS size, source_size, target,
  CASE WHEN size = 0 THEN 0::BIGINT
    ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - start)) END AS taken
FROM placed
"""

OP9 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS words FROM documents
), windows AS (
  SELECT row_id, i, array_to_string(words[i:i + 34], ' ') AS passage
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs)
), repeats AS (
  SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY passage) > 1
), gone AS (
  SELECT row_id, list(DISTINCT place) AS places
  FROM (SELECT row_id, unnest(range(i, i + 35)) AS place FROM repeats) GROUP BY row_id
), kept AS (
  SELECT docs.row_id, string_agg(word, ' ' ORDER BY place) AS text
  FROM (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM docs) AS docs
  LEFT JOIN gone ON docs.row_id = gone.row_id
  WHERE gone.row_id IS NULL OR NOT list_contains(places, place) GROUP BY docs.row_id
)
SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (row_id) LEFT JOIN kept USING (row_id)
"""

# crc32 of a word, bit by bit: each byte comes with seven zeros behind it, and every element is a step.
OP11 = r"""
WITH features AS (
  SELECT 'd' AS side, row_id, doc_id, unnest(words) AS word FROM (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
  UNION ALL
  SELECT 'b', 0, 0, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      range(0, length(digits) // 2),
      lambda i: [cast('0x' || substr(digits, 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS digits FROM features)
), counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM features JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, cast(floor(1000 * ln((t + 1) * (s_all + 10000)::DOUBLE / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM counted, (SELECT cast(sum(s) AS BIGINT) AS s_all, cast(sum(t) AS BIGINT) AS t_all FROM counted)
), weights AS (
  SELECT row_id, count(*) AS n_features, cast(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(
      sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) LEFT JOIN weights USING (row_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100
    THEN place END AS rank
FROM ranked
"""

OP12 = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM docs GROUP BY text
), marked AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part,
    (len(words) < 200)::INT
      + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT
      + 16 * coalesce(doc_id > least, false)::INT AS mask,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM docs JOIN firsts USING (text) LEFT JOIN marked USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
    [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), measured AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM measured
"""

ORACLE = {
    "op1_quality_rules": OP1,
    "op4_preference": OP4,
    "op8_mixing": OP8,
    "op9_substring": OP9,
    "op11_resampling": OP11,
    "op12_filter_audit": OP12,
}
