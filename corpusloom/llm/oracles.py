"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))

QUALITY = f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM split WHERE len(w) >= 5),
windows AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS five FROM places),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echo,
    len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop
  FROM split s LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars / n_words < 2.0 OR word_chars / n_words > 12.0 OR n_symbols / n_words > 0.1
    OR (n_words >= 50 AND n_stop / n_words < 0.02) OR n_echo / n_words > 0.3
    OR (n_lines > 0 AND n_dup_lines / n_lines > 0.5)) AS kept
FROM b
"""

#: CRC-32 has no function there: the table of 256 remainders and a fold over the bytes.
SHARDING = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h,
    coalesce(doc_id::VARCHAR, '\\N') AS key FROM documents),
summed AS (
  SELECT doc_id, key, size::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM sized, crc),
scores AS (
  SELECT DISTINCT key, s, ('0x' || substr(md5(key || '|' || s), 1, 13))::BIGINT AS u FROM summed, range(25) r(s)),
best AS (
  SELECT key, arg_max(s, u * 100 - s) FILTER (s < 24) AS shard, arg_max(s, u * 100 - s) AS grown FROM scores GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 3))::INT % 1024, doc_id, size, text_crc32) - 1 AS slot
FROM summed JOIN best USING (key)
"""

CHAT = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '<', '\\<')) + length(role) + length('### : ') + length(' </turn>') + 1 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: Lower case of A-Z only, as the contract has it.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS head FROM documents UNION SELECT l.b, r.head FROM reach r JOIN links l ON l.a = r.node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(head) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""

REPEATS = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM split WHERE len(w) >= 50)),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM places) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM repeated),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM split) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = f"""
WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM parts),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM split, range(1, 6) r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, n, cut, x.f AS l, y.f AS r, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, k, a, w, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM cuts WHERE cut = 1))
  WHERE j - i + 1 < k GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE coalesce(longer < a, true) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op1_quality_rules": QUALITY, "op3_sharding": SHARDING, "op4_chat_format": CHAT, "op6_near_duplicates": NEAR, "op8_substring_dedup": REPEATS, "op12_collocations": COLLOCATIONS}
