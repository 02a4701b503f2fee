"""The queries that SQL can express, for DuckDB."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Scripts without spaces between words, with their punctuation.
UNSPACED = "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in [
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FFF), (0x3001, 0x312F),
    (0x31A0, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF01, 0xFF9F),
    (0x20000, 0x3FFFF)])

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
grams AS (
  SELECT row_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS j FROM twice)
  GROUP BY row_id),
lines AS (
  SELECT row_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
m AS (
  SELECT doc_id, len(w)::bigint AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
    len(l)::bigint AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
    coalesce(n, 0)::bigint AS n_repeat_words,
    length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g'))::bigint AS n_letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint AS n_upper,
    length(regexp_replace(t, '[^{UNSPACED}]', '', 'g'))::bigint AS n_unspaced,
    len(list_distinct(w))::bigint AS n_kinds,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::bigint AS n_stutter
  FROM d JOIN lines USING (row_id) LEFT JOIN covered USING (row_id))
SELECT * EXCLUDE (n_unspaced), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept
FROM (SELECT *,
    if(n_words < 20, 1, 0) + if(100 * n_repeat_words > 30 * n_words, 2, 0)
    + if(10 * n_symbols > 3 * n_words, 4, 0) + if(n_lines >= 4 AND 2 * n_dup_lines > n_lines, 8, 0)
    + if(n_words > 0 AND word_chars < 2 * n_words, 16, 0) + if(word_chars > 30 * n_words AND 2 * n_unspaced <= n_letters, 32, 0)
    + if(2 * n_letters < word_chars, 64, 0)
    + if(n_words >= 20 AND 20 * n_kinds < n_words AND n_kinds < 10, 128, 0)
    + if(n_letters >= 40 AND 10 * n_upper > 7 * n_letters, 256, 0)
    + if(2 * n_stutter > n_words, 512, 0)::bigint AS failed_bits
  FROM m)
"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT row_id, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT row_id, j FROM (
    SELECT row_id, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (h) WHERE first < doc_id)),
words AS (SELECT row_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (
  SELECT row_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS k
  FROM words ANTI JOIN gone USING (row_id, j) GROUP BY row_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)
"""

SEARCH = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_id, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::integer AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

# Base32 of a hash: five hexadecimal digits are four letters.
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> {shift} & 31)::integer + 1, 1)" for shift in (15, 10, 5, 0))

ARCHIVES = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (
  SELECT sha, string_agg({_LETTERS}, '' ORDER BY i) AS payload_digest
  FROM (SELECT sha, i, ('0x' || substr(sha, i * 5 + 1, 5))::bigint AS v
        FROM (SELECT DISTINCT sha FROM p), range(8) AS r(i))
  GROUP BY sha),
firsts AS (SELECT sha, max(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, payload_bytes, payload_digest,
  if(page_id < first, 'revisit', 'response') AS record_type, if(page_id < first, first, NULL) AS refers_to
FROM p JOIN d USING (sha) JOIN firsts USING (sha)
"""

NEAR = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT row_id, doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT row_id, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row_id, doc_id, count(*) AS n FROM s GROUP BY ALL),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM (SELECT p.row_id AS r1, q.row_id AS r2, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.row_id <> q.row_id
        GROUP BY ALL)
    JOIN n a ON a.row_id = r1 JOIN n b ON b.row_id = r2
  WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x)
  SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (row_id) LEFT JOIN reach ON reach.x = d.doc_id
"""

AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    if(len(w) < 50, 1, 0) + if(100 * len(list_distinct(w)) < 65 * len(w), 2, 0)
    + if(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 4, 0)
    + if(regexp_matches(t, '[#$%&*|]'), 8, 0)
    + if(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false), 16, 0) AS mask
  FROM d LEFT JOIN said USING (doc_id)),
n AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    list_sum([0] || list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::int AS earlier
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
r AS (
  SELECT part, filter_order, step, own,
    sum(if(mask & (earlier | own) = 0, n, 0)) AS kept,
    sum(if(mask & own <> 0 AND mask & earlier = 0, n, 0)) AS removed,
    sum(if(mask & own <> 0 AND mask & earlier <> 0, n, 0)) AS redundant,
    sum(if(mask = own, n, 0)) AS unique_fails,
    sum(if(mask & own <> 0 AND mask & earlier = 0, good, 0)) AS good_lost,
    sum(if(mask & own <> 0 AND mask & earlier = 0, bad, 0)) AS toxic_lost
  FROM n, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant,
  unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley
FROM r
"""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text,
      '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/TURN\]))', '\\\1', 'g')) AS long,
    length(regexp_replace(role,
      '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[/TURN\]))', '\\\1', 'g')) AS role_long
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(long + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
                            ELSE 25 + role_long END))::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
