"""DuckDB SQL for the base queries, written from what the operators mean."""

from __future__ import annotations

from corpusloom.functions import conversations, text, urls
from corpusloom.operators import audit, chatting, crawl, generation, sampling, training
from corpusloom.plans.queries import DOMAINS, SEEDS, STOPS

#: Python's white space and line ends in RE2's syntax.
WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
NOT_WS = "[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
LB = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def simplify(x: str) -> str:
    return strip(f"substr({collapse(x)}, 1, {text.MAX_CHARS})")


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({quoted(text.STOP_WORDS)}))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def normal_url(x: str) -> str:
    bare = f"regexp_replace({x}, '[?#].*$', '')"
    path = f"regexp_replace(regexp_replace(regexp_replace({bare}, '^[a-z]+://[^/]*', ''), ';[^/]*$', ''), '/+$', '')"
    return f"regexp_extract({bare}, '^[a-z]+://[^/]*') || coalesce(nullif({path}, ''), '/')"


def host(x: str) -> str:
    return f"regexp_extract({x}, '^[a-z]+://([^/?#]*)', 1)"


def path_only(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), ';[^/]*$', ''), '^/+|/+$', '', 'g')"


def decoded(x: str) -> str:
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def first_lines(source: str, key: str, column: str) -> str:
    """Lines of a text, cleaned, each at its first place (case apart): key, pos, line."""
    return f"""
      SELECT {key}, pos, line FROM (
        SELECT *, row_number() OVER (PARTITION BY {key}, lower(line) ORDER BY pos) AS nth FROM (
          SELECT {key}, pos, {strip(collapse('raw'))} AS line FROM (
            SELECT {key}, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT {key}, regexp_split_to_array({column}, '{LB}') AS l FROM {source})))
        WHERE line <> '') WHERE nth = 1"""


PAIRS = """pairs AS (
  SELECT * FROM (SELECT doc_id, k, l[2 * k - 1] AS question, l[2 * k] AS answer FROM (
    SELECT doc_id, l, unnest(range(1, len(l) // 2 + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
  WHERE question <> '' AND answer <> '')"""
ARTICLES = f"articles AS (SELECT page_id, url, {decoded("regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g')")} AS body FROM pages)"
PAGES = f"""{ARTICLES},
lines AS ({first_lines('articles', 'page_id', 'body')}),
texts AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM lines GROUP BY page_id)"""
TITLE = f"{strip(decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}"
SLUG = f"CASE WHEN {path_only('url')} = '' THEN 'home' ELSE coalesce(nullif(lower(regexp_replace(regexp_replace(array_to_string(list_filter(string_split({path_only('url')}, '/'), lambda p: p <> ''), '-'), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'page') END"

SAMPLES = """samples AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id)"""
GOOD_MESSAGES = f"len(list_filter(range(1, n + 1), lambda i: roles[i] IN ('user', 'assistant') AND {strip('texts[i]')} <> '')) = n"
ALTERNATE = "len(list_filter(range(1, n + 1), lambda i: roles[i] = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = n"
OVERLAPS = f"""said AS (
  SELECT conv_id, turn, c.text AS answer, len(list_intersect(list_distinct({tokens('c.text')}), {tokens(simplify('d.text'))})) AS score
  FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'assistant')"""


def reasons(most: int = 45, shared: int = 2) -> str:
    return f"""{SAMPLES}, {OVERLAPS},
judged AS (
  SELECT conv_id, bool_or({" OR ".join(f"contains(lower(answer), '{p.replace("'", "''")}')" for p in conversations.BAD_PATTERNS)}) AS bad,
    bool_or(len({words('answer')}) NOT BETWEEN 4 AND {most}) AS size, bool_or(coalesce(score, 0) < {shared}) AS loose FROM said GROUP BY conv_id),
reasons AS (
  SELECT s.conv_id, CASE WHEN n < 2 OR n % 2 <> 0 THEN 'turn count' WHEN roles[1] <> 'user' THEN 'first role'
    WHEN NOT ({GOOD_MESSAGES}) THEN 'invalid message' WHEN NOT ({ALTERNATE}) THEN 'alternation'
    WHEN bad THEN 'bad phrase' WHEN size THEN 'answer length' WHEN loose THEN 'not grounded' END AS reason
  FROM samples s LEFT JOIN judged USING (conv_id))"""


STRUCTURAL = f"n >= 2 AND n % 2 = 0 AND {GOOD_MESSAGES} AND {ALTERNATE}"
LOOSE = f"n >= 2 AND roles[1] = 'user' AND {GOOD_MESSAGES}"
FLAT = f"SELECT conv_id, (i - 1)::BIGINT AS k, roles[i] AS role, {strip('texts[i]')} AS content FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kept)"
KEY = f"lower({strip('question')})"
#: Pairs that the loose validator takes, first of equals.
WEBSITE = f"""website AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {KEY}, lower({strip('answer')}) ORDER BY doc_id, k) AS nth
    FROM pairs WHERE {strip('question')} <> '' AND {strip('answer')} <> '') WHERE nth = 1)"""
CHAT = f"""chat AS (
  SELECT conv_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY roles, list_transform(texts, lambda t: lower({strip('t')})) ORDER BY conv_id) AS nth
    FROM samples WHERE {LOOSE}) WHERE nth = 1)"""
TARGET = f"least(greatest(1.0, round_even((SELECT count(*) FROM website) * {sampling.CHAT_WEIGHT}::DOUBLE / {sampling.WEBSITE_WEIGHT}::DOUBLE, 0)), (SELECT count(*) FROM chat))::BIGINT"
JSON_TEXT = "replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
PAYLOADS = f"""bodies AS (
  SELECT conv_id, '{{"messages": [' || string_agg('{{"role": "' || role || '", "content": "' || {JSON_TEXT} || '"}}', ', ' ORDER BY turn) || ']}}' AS body FROM conversations GROUP BY conv_id),
payloads AS (
  SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN '{{"items": [' || body || ']}}' WHEN 1 THEN '```json' || chr(10) || '{{"items": [' || body || ']}}' || chr(10) || '```'
    WHEN 2 THEN 'Here it is: {{"items": [' || body || ']}} Done.' ELSE '[' || body || ', ' || body || ']' END AS response FROM bodies)"""
ISSUES = f"""marked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id, k) > 1 AS duplicate, {words('lower(answer)')} AS w FROM pairs),
found AS (
  SELECT doc_id, k, duplicate, list_concat(
    CASE WHEN length(answer) > 180 THEN [['too long', 'Shorten answer to 1-2 sentences']] ELSE [] END,
    CASE WHEN length(answer) < 2 THEN [['too short', 'Answer is likely useless']] ELSE [] END,
    list_transform(list_filter([{quoted(audit.PHRASES)}], lambda p: contains(lower(answer), p)), lambda p: ['bad phrase', 'Remove ''' || p || '''']),
    CASE WHEN ends_with(answer, ':') THEN [['bad ending', 'Answer should be complete sentence']] ELSE [] END,
    CASE WHEN contains(answer, '?') THEN [['question in answer', 'Answer should not ask questions']] ELSE [] END,
    CASE WHEN len(w) > 0 AND len(list_distinct(w)) < len(w) * 0.6::DOUBLE THEN [['repetition', 'Answer may be repetitive']] ELSE [] END) AS issues
  FROM marked)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, values: dict[str, str]) -> str:
    """A template as an SQL concatenation."""
    out = [template]
    for name, expression in values.items():
        out = [p for part in out for p in ([part] if part.startswith("\0") else _cut(part, name, expression))]
    return " || ".join(p[1:] if p.startswith("\0") else sql_text(p) for p in out if p)


def _cut(part: str, name: str, expression: str) -> list[str]:
    pieces = part.split("{" + name + "}")
    out = [pieces[0]]
    for p in pieces[1:]:
        out += ["\0" + expression, p]
    return out


#: Lines of JSON by kind: 0 to 3 have another shape than the audit takes.
FIRST_PAIRS = f"{SAMPLES}, pairs AS (SELECT conv_id AS doc_id, 0 AS k, texts[1] AS question, texts[2] AS answer FROM samples WHERE conv_id % 7 > 3 AND n > 1)"
_PROMPT = {"page": "'doc ' || doc_id", "items": f"'{generation.ITEMS}'", "content": simplify(strip("text"))}

SQL: dict[str, str] = {
    "url_normalize": f"SELECT page_id, {normal_url('url')} AS normalized FROM pages",
    "url_skip": f"SELECT page_id, {' OR '.join(f"contains(url, '{p}')" for p in urls.SKIP_PATTERNS)} AS skipped FROM pages",
    "url_domain": f"SELECT page_id, {host('url')} AS netloc, {host('url')} IN ('', {quoted(DOMAINS)}) AS same_domain FROM pages",
    "url_slug": f"SELECT page_id, {SLUG} AS slug FROM pages",
    "page_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "page_text": f"WITH {PAGES} SELECT page_id, length(text)::BIGINT AS n_chars, n_lines::BIGINT AS n_lines, text FROM texts WHERE length(text) >= {crawl.MIN_CHARS}",
    "page_lines": f"WITH {PAGES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS line_no, line FROM lines",
    "page_links": f"""
      WITH hrefs AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
      joined AS (SELECT DISTINCT page_id, {normal_url('(base || href)')} AS link FROM hrefs)
      SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) - 1 AS rank FROM joined
      WHERE NOT ({' OR '.join(f"contains(link, '{p}')" for p in urls.SKIP_PATTERNS)})""",
    "page_records": f"WITH {PAGES} SELECT url, {TITLE} AS title, length(text)::BIGINT AS n_chars, {SLUG} || '.txt' AS text_file FROM texts JOIN pages USING (page_id) WHERE length(text) >= {crawl.MIN_CHARS}",
    "crawl_filter": f"""
      WITH {PAGES} SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'request failed' WHEN page_id % 7 = 6 THEN 'status' WHEN page_id % 9 = 8 THEN 'content type'
        WHEN coalesce(length(text), 0) < {crawl.MIN_CHARS} THEN 'too short' END AS skip_reason FROM pages LEFT JOIN texts USING (page_id)""",
    "crawl_order": """
      WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
      walk(node, level, place) USING KEY (node) AS (
        SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 0::BIGINT), (7, 0, 1)) v(node, level, place)
        UNION
        SELECT t.node, l + 1, (SELECT max(place) FROM recurring.walk) + row_number() OVER (ORDER BY o) FROM (
          SELECT (w.node * k + 1) % n AS node, min(w.level) AS l, min(w.place * 3 + k - 2) AS o FROM walk w, range(2, 5) r(k), n GROUP BY 1) t
        WHERE NOT EXISTS (SELECT 1 FROM recurring.walk v WHERE v.node = t.node))
      SELECT node AS page_id, level, place FROM walk""",
    "doc_simplify": f"SELECT doc_id, {simplify('text')} AS simple FROM documents",
    "doc_tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "doc_word_count": f"SELECT doc_id, len({words('text')})::BIGINT AS n_words FROM documents",
    "doc_line_dedupe": f"WITH lines AS ({first_lines('documents', 'doc_id', 'text')}) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines GROUP BY doc_id) USING (doc_id)".replace("coalesce(t, '') AS text FROM documents d LEFT", "coalesce(t, '') AS text FROM (SELECT doc_id FROM documents) d LEFT"),
    "overlap_score": f"WITH {OVERLAPS} SELECT conv_id, turn, score::BIGINT AS score FROM said WHERE conv_id IN (SELECT doc_id FROM documents)",
    "grounded_answers": f"WITH {OVERLAPS} SELECT conv_id, turn FROM said WHERE score >= 2",
    "conv_reject_reasons": f"WITH {reasons()} SELECT conv_id, reason FROM reasons",
    "conv_strict": f"WITH {reasons()} SELECT conv_id, reason IS NULL AS valid FROM reasons",
    "conv_structural": f"WITH {SAMPLES}, kept AS (SELECT * FROM samples WHERE {STRUCTURAL}) {FLAT}",
    "conv_loose": f"WITH {SAMPLES}, kept AS (SELECT * FROM samples WHERE {LOOSE}) {FLAT}",
    "question_dedupe": f"WITH {PAIRS} SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {collapse(KEY)} ORDER BY doc_id, k) AS nth FROM pairs) WHERE nth = 1",
    "question_store": f"WITH {PAIRS} SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {collapse(KEY)} ORDER BY doc_id, k) AS nth FROM pairs) WHERE nth = 1",
    "question_anti": f"""WITH {PAIRS} SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id, k) AS nth FROM pairs
      WHERE doc_id % 2 = 1 AND {KEY} NOT IN (SELECT {KEY} FROM pairs WHERE doc_id % 2 = 0)) WHERE nth = 1""",
    "conversation_dedupe": f"WITH {PAIRS}, {WEBSITE} SELECT doc_id, k FROM website",
    "mix_counts": f"WITH {PAIRS}, {SAMPLES}, {WEBSITE}, {CHAT} SELECT (SELECT count(*) FROM website) AS website, (SELECT count(*) FROM chat) AS chat, {TARGET} AS sampled",
    "mix_sample": f"""
      WITH {PAIRS}, {SAMPLES}, {WEBSITE}, {CHAT},
      ranked AS (SELECT 'c' || conv_id AS key, row_number() OVER (ORDER BY md5('{sampling.SEED}:c' || conv_id), 'c' || conv_id) AS nth FROM chat),
      both_sides AS (SELECT 'w' || doc_id || '-' || k AS key FROM website UNION ALL SELECT key FROM ranked WHERE nth <= {TARGET})
      SELECT key, md5('{sampling.SEED + 1}:' || key) AS place FROM both_sides""",
    "train_text": f"""
      WITH turns AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || {strip('text')} || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
      SELECT conv_id, '<|im_start|>system' || chr(10) || {sql_text(training.SYSTEM)} || '<|im_end|>' || chr(10) || body || '<|im_start|>assistant' || chr(10) AS text FROM turns""",
    "train_split": f"""
      WITH ids AS (SELECT conv_id, row_number() OVER (ORDER BY md5('{sampling.SEED}:' || conv_id), conv_id) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
      SELECT conv_id, CASE WHEN nth <= floor(n * {sampling.TRAIN_SPLIT}::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM ids""",
    "audit_issues": f"WITH {PAIRS}, {ISSUES} SELECT doc_id, k, duplicate, (i - 1)::BIGINT AS issue_no, issues[i][1] AS issue, issues[i][2] AS fix FROM (SELECT *, unnest(range(1, len(issues) + 1)) AS i FROM found)",
    "audit_summary": f"""
      WITH {PAIRS}, {ISSUES} SELECT count(*) AS total, sum(duplicate::INT + (len(issues) > 0)::INT)::BIGINT AS issues,
        round((count(*) - sum(duplicate::INT + (len(issues) > 0)::INT))::DOUBLE / count(*) * 100.0, 2)::DOUBLE AS score FROM found""",
    "json_salvage": f"""
      WITH {PAYLOADS}, salvaged AS (SELECT conv_id, coalesce(nullif(regexp_extract({strip('response')}, '(?s)```(?:json)?\\s*(\\{{.*\\}}|\\[.*\\])\\s*```', 1), ''),
        nullif(regexp_extract({strip('response')}, '(?s)\\{{.*\\}}'), ''), nullif(regexp_extract({strip('response')}, '(?s)\\[.*\\]'), '')) AS found FROM payloads)
      SELECT conv_id, found, json_valid(found) AS valid FROM salvaged""",
    "json_unwrap": "SELECT conv_id, 0::BIGINT AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role, text AS content FROM conversations WHERE conv_id % 4 <> 3",
    "prompt_primary": f"SELECT 'doc ' || doc_id AS page, {filled(generation.PRIMARY, _PROMPT)} AS prompt FROM documents WHERE length({strip('text')}) >= {generation.MIN_CHARS}",
    "prompt_banlist": f"""
      WITH {PAIRS}, banned AS (SELECT coalesce(string_agg('- ' || q, chr(10) ORDER BY q), '') AS banned FROM (SELECT DISTINCT {KEY} AS q FROM pairs ORDER BY q LIMIT {generation.BANNED}))
      SELECT 'doc ' || doc_id AS page, {filled(generation.ADDITIONAL, _PROMPT | {"banned": "banned"})} AS prompt FROM documents, banned""",
    "first_valid_attempt": "SELECT conv_id, min(turn) AS attempt FROM conversations WHERE length(text) % 2 = 1 GROUP BY conv_id",
    "prepare_samples": f"""
      WITH {reasons(most=400, shared=1)}, keyed AS (SELECT s.conv_id::VARCHAR AS page, row_number() OVER (PARTITION BY {collapse(f"lower({strip('texts[1]')})")} ORDER BY s.conv_id::VARCHAR) AS nth
        FROM samples s JOIN reasons r ON r.conv_id = s.conv_id WHERE reason IS NULL AND s.conv_id % 4 <> 3 AND s.conv_id IN (SELECT doc_id FROM documents))
      SELECT page, 0::BIGINT AS item FROM keyed WHERE nth = 1""",
    "augment_samples": f"""
      WITH {SAMPLES}, keyed AS (SELECT conv_id::VARCHAR AS page, row_number() OVER (PARTITION BY lower({strip('texts[1]')}) ORDER BY conv_id::VARCHAR) AS nth
        FROM samples WHERE {STRUCTURAL} AND conv_id % 4 <> 3 AND lower({strip('texts[1]')}) NOT IN (SELECT lower({strip('texts[1]')}) FROM samples WHERE conv_id % 8 = 0 AND roles[1] = 'user'))
      SELECT page, 0::BIGINT AS item FROM keyed WHERE nth = 1""",
    "crawl_pages": f"""
      WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
      site AS (SELECT page_id, 'http://site.test/p/' || page_id AS url, 'Page ' || page_id || chr(10) || trim(repeat('lorem ipsum ', 1 + (page_id % 11)::INT)) || chr(10) || 'go' AS text,
        CASE WHEN page_id % 5 = 4 THEN 'request failed' WHEN page_id % 7 = 6 THEN 'status' WHEN page_id % 9 = 8 THEN 'content type' END AS failed FROM pages),
      judged AS (SELECT *, coalesce(failed, CASE WHEN length(text) < {crawl.MIN_CHARS} THEN 'too short' END) AS skip_reason FROM site),
      links AS (SELECT page_id AS source, (page_id * k + 1) % n AS node, row_number() OVER (PARTITION BY page_id ORDER BY '/p/' || (page_id * k + 1) % n) AS rank
        FROM judged, range(2, 5) r(k), n WHERE skip_reason IS NULL),
      walk(node, level, place) USING KEY (node) AS (
        SELECT * FROM (VALUES {', '.join(f"({p}::BIGINT, 0::BIGINT, {k}::BIGINT)" for k, p in enumerate(SEEDS))}) v(node, level, place)
        UNION
        SELECT t.node, l + 1, (SELECT max(place) FROM recurring.walk) + row_number() OVER (ORDER BY o) FROM (
          SELECT x.node, min(w.level) AS l, min(w.place * 4 + rank) AS o FROM walk w JOIN links x ON x.source = w.node GROUP BY 1) t
        WHERE NOT EXISTS (SELECT 1 FROM recurring.walk v WHERE v.node = t.node))
      SELECT url, level, place, skip_reason, CASE WHEN skip_reason IS NULL THEN 'Page ' || node END AS title, CASE WHEN skip_reason IS NULL THEN length(text) ELSE 0 END::BIGINT AS n_chars,
        CASE WHEN skip_reason IS NULL THEN 'p-' || node || '.txt' END AS text_file
      FROM walk JOIN judged ON page_id = node""",
    "page_names": f"SELECT page_id, replace({SLUG}, '-', ' ') AS page FROM pages",
    "mix_datasets": f"""
      WITH {PAIRS}, {SAMPLES}, both_files AS (SELECT *, 0 AS file FROM pairs WHERE doc_id % 2 = 0 UNION ALL SELECT *, 1 FROM pairs),
      website AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY {KEY}, lower({strip('answer')}) ORDER BY file, doc_id, k) AS nth
        FROM both_files WHERE {strip('question')} <> '' AND {strip('answer')} <> '') WHERE nth = 1), {CHAT},
      ranked AS (SELECT 'c' || conv_id AS key, row_number() OVER (ORDER BY md5('{sampling.SEED}:c' || conv_id), 'c' || conv_id) AS nth FROM chat),
      sides AS (SELECT 'website' AS side, 'w' || doc_id || '-' || k AS key FROM website UNION ALL SELECT 'chat', key FROM ranked WHERE nth <= {TARGET})
      SELECT side, key, md5('{sampling.SEED + 1}:' || key) AS place FROM sides""",
    "mix_report": f"""
      WITH {PAIRS}, {SAMPLES}, {WEBSITE}, {CHAT} SELECT count(*) AS website, {TARGET} AS chat, count(*) + {TARGET} AS total FROM website""",
    "train_convert": f"""
      WITH turns AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || {strip('text')} || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
      ids AS (SELECT *, row_number() OVER (ORDER BY md5('{sampling.SEED}:' || conv_id), conv_id) AS nth, count(*) OVER () AS n FROM turns)
      SELECT conv_id, '<|im_start|>system' || chr(10) || {sql_text(training.SYSTEM)} || '<|im_end|>' || chr(10) || body || '<|im_start|>assistant' || chr(10) AS text,
        CASE WHEN nth <= floor(n * {sampling.TRAIN_SPLIT}::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM ids""",
    "train_json_lines": f"""
      WITH turns AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || {strip('text')} || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
      SELECT conv_id, true AS ascii, '<|im_start|>system' || chr(10) || {sql_text(training.SYSTEM)} || '<|im_end|>' || chr(10) || body || '<|im_start|>assistant' || chr(10) AS text FROM turns""",
    "audit_lines": f"""
      WITH {FIRST_PAIRS}, {ISSUES} SELECT s.conv_id, f.doc_id IS NULL AS invalid, coalesce(duplicate, false) AS duplicate, coalesce(len(issues), 0)::BIGINT AS n_issues
      FROM samples s LEFT JOIN found f ON f.doc_id = s.conv_id""",
    "tolerant_questions": f"""
      WITH {SAMPLES} SELECT DISTINCT lower({strip('texts[1]')}) AS question FROM samples WHERE conv_id % 11 <> 0 AND conv_id % 5 <> 0 AND roles[1] = 'user'""",
    "json_strings": f"WITH {SAMPLES} SELECT conv_id, CASE WHEN conv_id % 7 = 3 THEN false WHEN conv_id % 7 > 3 AND n > 1 THEN true END AS string FROM samples",
    "generation_progress": f"""
      WITH {SAMPLES}, keyed AS (SELECT conv_id, row_number() OVER (PARTITION BY lower({strip('texts[1]')}) ORDER BY conv_id::VARCHAR) AS nth
        FROM samples WHERE {STRUCTURAL} AND conv_id % 4 <> 3 AND lower({strip('texts[1]')}) NOT IN (SELECT lower({strip('texts[1]')}) FROM samples WHERE conv_id % 8 = 0 AND roles[1] = 'user'))
      SELECT doc_id::VARCHAR AS page, (s.conv_id IS NOT NULL)::BIGINT AS attempts, (s.conv_id IS NOT NULL AND s.conv_id % 4 <> 3)::BIGINT AS items, (k.conv_id IS NOT NULL)::BIGINT AS accepted
      FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN samples s ON s.conv_id = doc_id LEFT JOIN keyed k ON k.conv_id = doc_id AND nth = 1""",
    "chat_chunks": """
      WITH words AS (SELECT conv_id * 1000 + turn AS request_id, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant')
      SELECT request_id, array_to_string((CASE WHEN request_id % 7 = 0 AND len(w) > 1 THEN w[1:len(w) - 1] ELSE w END)[1:20], ' ') AS response FROM words""",
    "chat_stops": f"""
      WITH said AS (SELECT conv_id * 1000 + turn AS request_id, text FROM conversations WHERE role = 'assistant' AND text <> ''),
      found AS (SELECT *, least({', '.join(f"nullif(instr(text, {sql_text(x)}), 0)" for x in STOPS)}) AS cut FROM said)
      SELECT request_id, CASE WHEN cut IS NULL THEN text ELSE left(text, cut - 1) END AS response FROM found""",
    "generation_attempts": f"""
      WITH asked AS (SELECT 'doc ' || doc_id AS page FROM documents WHERE length({strip('text')}) >= {generation.MIN_CHARS}),
      drawn AS (SELECT page, k, ('0x' || left(md5(page || ':' || k), 1))::INT AS d FROM asked, range(1, 4) r(k)),
      firsts AS (SELECT page, min(k) FILTER (d >= 10) AS accepted FROM drawn GROUP BY page)
      SELECT page, count(*) AS attempts, count(*) FILTER (d < 4) AS errors, coalesce(any_value(accepted), 0)::BIGINT AS accepted FROM drawn JOIN firsts USING (page) WHERE accepted IS NULL OR k <= accepted GROUP BY page""",
    "chat_histories": """
      WITH asked AS (SELECT conv_id, turn, length(text)::VARCHAR AS said, turn % 3 = 0 AS down FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, said AS tuned_response, 'ok' AS tuned_status, count(*) OVER w - 1 AS tuned_history, CASE WHEN NOT down THEN said END AS base_response,
        CASE WHEN down THEN 'error' ELSE 'ok' END AS base_status, (sum((NOT down)::INT) OVER w - (NOT down)::INT)::BIGINT AS base_history
      FROM asked WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    "chat_accumulate": """
      WITH words AS (SELECT conv_id * 1000 + turn AS request_id, string_split(text, ' ') AS w FROM conversations WHERE role = 'assistant')
      SELECT request_id, array_to_string(CASE WHEN request_id % 7 = 0 AND len(w) > 1 THEN w[1:len(w) - 1] ELSE w END, ' ') AS response FROM words""",
    "chat_context": f"""
      SELECT conv_id, turn, {sql_text('system: ' + chatting.SYSTEM)} || chr(10) || context AS context FROM (
        SELECT conv_id, turn, role, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context
        FROM conversations WHERE role <> 'system') WHERE role = 'user'""",
    "chat_ab": "SELECT conv_id, turn, text AS prompt, model FROM conversations, (VALUES ('tuned'), ('base')) m(model) WHERE role = 'user'",
    "chat_sessions": f"""
      WITH inputs AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN 'Clear' WHEN conv_id % 5 = 0 AND turn = 5 THEN 'EXIT'
        WHEN conv_id % 4 = 0 AND turn = 1 THEN '' ELSE {strip('text')} END AS said FROM conversations),
      marked AS (SELECT *, sum((lower(said) IN ('quit', 'exit'))::INT) OVER w AS quits, sum((lower(said) = 'clear')::INT) OVER w AS session
        FROM inputs WHERE said <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
      SELECT conv_id, turn, said, session::BIGINT AS session FROM marked WHERE quits = 0 AND lower(said) <> 'clear'""",
    "event_sessions": """
      WITH told AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      numbered AS (SELECT *, sum((before IS NULL OR ts > before + INTERVAL 12 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM told)
      SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS events, sum(round(value * 1000)::BIGINT)::BIGINT AS thousandths FROM numbered GROUP BY user_id, session""",
    "event_as_of": """
      SELECT p.event_id, coalesce(c.event_id, -1) AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "event_near": """
      SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.ts BETWEEN e.ts - INTERVAL 20 MINUTE AND e.ts + INTERVAL 40 MINUTE
      WHERE e.event_type = 'error' AND p.event_type = 'purchase'""",
    "lineitem_cube": """
      WITH priced AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS year, l_quantity::BIGINT AS quantity, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
      SELECT l_returnflag, l_linestatus, coalesce(year, -1) AS year, grouping(l_returnflag, l_linestatus, year)::BIGINT AS level, count(*) AS n_rows, sum(quantity)::BIGINT AS quantity, sum(cents)::BIGINT AS cents
      FROM priced GROUP BY CUBE (l_returnflag, l_linestatus, year)""",
    "lineitem_sketches": """
      SELECT year(l_shipdate) AS year, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS parts_close, true AS median_close FROM lineitem GROUP BY 1""",
}
