"""DuckDB SQL for the queries of this folder that SQL can express."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _count(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


LINE_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, text, {_WORDS.format('text')} AS w FROM docs
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r
), lines AS (
  SELECT r, l, len({_WORDS.format('l')}) AS n,
    {_count('l', '[^#*$%&|<>]+')} AS sym, {_count('l', '[^A-Z]+')} AS caps, length(l) AS chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT r, l, n,
    sym * 100 > n * 20
    OR (n > 1 AND caps * 100 > chars * 40)
    OR (n >= 8 AND NOT regexp_matches(l, '[.!?:;,…。！？؟।"''”’»)\]][\x20\x09-\x0D]*$'))
    OR len(regexp_split_to_array(l, ' (?:\||>|»|·|•) ')) > 2
    OR regexp_matches(l, '(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|enable javascript|click here|sign in|log in|sign up|subscribe (?:now|to our)|skip to (?:main )?content|back to top|share (?:this|on)|copyright (?:\(c\)|©|\d{{4}})|licensed under the)')
    AS failed
  FROM lines
), per_doc AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
    coalesce(sum(n) FILTER (WHERE NOT failed), 0)::BIGINT AS n_words_left
  FROM judged GROUP BY r
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    {_count('text', r'[\x20\x09-\x0D]+')}::BIGINT AS word_chars,
    {_count('text', '[^#*$%&|<>]+')}::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_words_left, 0)::BIGINT AS n_words_left
  FROM words LEFT JOIN repeats USING (r) LEFT JOIN per_doc USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND n_words_left * 100 >= n_words * 50 AS kept
FROM counted
"""

# CRC-32 byte by byte: eight shifts make the table, one look-up each byte.
BYTE_SHARDS = """
WITH crc_table AS (
  SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c
    WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, text FROM documents
), sized AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    xor(list_reduce(
      list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT
    ), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table
), bytes AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total
  FROM sized
), cut AS (
  SELECT *, ((2 * start + size) * 16 // (2 * total))::INTEGER AS shard FROM bytes
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM cut
"""

URL_RULES = r"""
WITH cut AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fitting AS (
  SELECT page_id, verdict, rule_host || rule_path AS rule,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fitting WHERE k = 1) USING (page_id)
"""

DECONTAMINATE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i : i + least(len(w), 10) - 1] AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT r, size, i, w[i : i + size - 1] AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)
), matches AS (
  SELECT r, i, p.size, item_id FROM places p JOIN windows USING (size, g)
), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(i, i + size)) AS k FROM matches) GROUP BY r
), item_list AS (
  SELECT r, list(DISTINCT item_id::VARCHAR) AS ids FROM matches GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN item_list USING (r)
"""

WINDOW_DEDUP = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
), dropped AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM repeated
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS body
  FROM words ANTI JOIN dropped USING (r, k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * k >= 80 * (s.n + t.n - k)
), reach AS (
  SELECT doc_id, doc_id AS root FROM docs
  UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

# Strings as hex: two digits a byte, so byte k of a text starts at digit 2 k + 1.
SUFFIX_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h
  FROM documents
), windows AS (
  SELECT r, i, substr(h, 2 * i + 1, 200) AS g
  FROM (SELECT r, h, unnest(range(length(h) // 2 - 99)) AS i FROM docs WHERE length(h) >= 200)
), later AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY md5(g), g ORDER BY r, i) AS k FROM windows
  ) WHERE k > 1
), runs AS (
  SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100, true) AS new FROM later
), spans AS (
  SELECT r, min(i) AS lo, max(i) + 100 AS hi
  FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS s FROM runs) GROUP BY r, s
), gaps AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM spans
), kept AS (
  SELECT r, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS body,
    max(hi) AS hi, sum(hi - lo) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, 5)) AS size FROM places) WHERE i + size - 1 <= len(w)
), frequent AS (
  SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size >= 2)
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, f, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM frequent WHERE size >= 3))
), held AS (
  SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY lang, phrase
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN held USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
