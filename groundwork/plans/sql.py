"""SQL for each query that SQL expresses; it runs over the same tables and gives the same rows."""

#: Fixed values, written out here once more so that an error in the operators' own lists shows.
NEGATION = "not|never|no|without|cannot|can't|doesn't|don't|didn't|isn't|aren't|wasn't|weren't|fails? to|failed to|nor|neither|rather than|instead of|prevents?|inhibits?|blocks?|suppresses?"
MODALITY = "may|might|could|can|suggests?|suggested|associated with|appears? to|is thought to|is believed to|tends? to|often|sometimes|generally|typically|usually"
ABSOLUTE = "always|never|all|every|invariably|without exception|exclusively"
UNITS = "%|mV|ms|Hz|kHz|nm|µm|um|mm|cm|km|kDa|Da|mM|µM|uM|nM|pM|mg|µg|ug|kg|mL|L|°C|K|years?|months?|days?|weeks?|s|min|h|percent|millivolts?|milliseconds?|seconds?|minutes?|hours?|hertz|nanometers?|micrometers?|millimeters?|centimeters?|millimolar|micromolar|nanomolar|picomolar|degrees?|daltons?|kilodaltons?|milligrams?|micrograms?|millilit(?:er|re)s?|lit(?:er|re)s?|kelvin"

EVENTS = """
e AS (SELECT id, min(seq) AS seq, arg_min(user_id, seq) AS user_id, arg_min(card_id, seq) AS card_id, arg_min(schedule_modified, seq) AS schedule_modified,
  arg_min_null(rating, seq) AS rating, epoch_ms(TRY_CAST(arg_min(reviewed_at, seq) AS TIMESTAMPTZ)) AS at_ms FROM review_events WHERE id IS NOT NULL GROUP BY id)"""


def once(name: str, alias: str) -> str:
    return f"{alias} AS (SELECT DISTINCT ON (id) * FROM {name} WHERE id IS NOT NULL ORDER BY id)"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"


#: White space at either end.
ENDS = r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({collapse(x)}), '[^a-z0-9\s.-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"


def quoted(s: str) -> str:
    return s.replace("'", "''")


def quantities(x: str) -> str:
    pattern = rf"(?i)(-?[0-9]+(?:[.,][0-9]+)?)\s*({quoted(UNITS)})\b"
    return rf"list_transform(regexp_extract_all({collapse(x)}, '{pattern}'), lambda q: replace(regexp_extract(q, '{pattern}', 1), ',', '.') || ':' || lower(regexp_extract(q, '{pattern}', 2)))"


def values(x: str) -> str:
    """Quantities as structs of value and unit."""
    return f"list_transform({quantities(x)}, lambda q: {{'v': CAST(string_split(q, ':')[1] AS DOUBLE), 'u': string_split(q, ':')[2]}})"


def lacking(claim: str, source: str) -> str:
    """How many quantities of ``claim`` (lists of structs) equal none of ``source``."""
    return f"len(list_filter({claim}, lambda x: len(list_filter({source}, lambda y: abs(y.v - x.v) < 1e-9 AND y.u = x.u)) = 0))"


def cue(x: str, alternatives: str) -> str:
    return rf"regexp_matches({x}, '(?i)\b(?:{quoted(alternatives)})\b')"


NO_TERMS = "about above after again also among another because been before being below between both cannot could does doing during each either else even every figure from further have having here however into itself just like made many might more most much must neither number only other over same shall should shown shows since some such than that their them then there these they this those through thus under upon used using very was were what when where which while will with within without would"
CLOZE = r"\{\{c[0-9]+::(.*?)(?:::[^}]*)?\}\}"
DELETION = r"\{\{c[0-9]+::([^{}]*?)(?:::[^{}]*?)?\}\}"
restored = rf"regexp_replace(cloze, '{DELETION}', '\1', 'g')"
KIND = "CASE WHEN kind IN ('text', 'ocr-text') THEN kind WHEN coalesce(normalized_text, '') <> '' THEN 'text' ELSE coalesce(kind, 'blank') END"
PAGES = f"""
pages AS (SELECT document_version_id, page_index, string_agg(raw_text, chr(10) ORDER BY ordinal, id) AS raw_text, string_agg(normalized_text, ' ' ORDER BY ordinal, id) AS normalized_text FROM b GROUP BY ALL)"""

SQL: dict[str, str] = {
    "study_daily_activity": f"""
WITH {EVENTS},
k AS (SELECT e.*, at_ms // 86400000 AS day FROM e WHERE schedule_modified = 1 AND at_ms IS NOT NULL AND card_id IN (SELECT id FROM cards)),
f AS (SELECT user_id, card_id, min(day) AS first FROM k GROUP BY ALL)
SELECT k.user_id, k.day, count(*) AS reviews, count(DISTINCT CASE WHEN k.day = f.first THEN k.card_id END) AS new_cards
FROM k JOIN f USING (user_id, card_id) GROUP BY k.user_id, k.day""",
    "study_review_counts": f"""
WITH {EVENTS}
SELECT user_id, card_id, count(*) AS review_count, count(*) FILTER (schedule_modified = 1) AS schedule_review_count, max(at_ms) FILTER (schedule_modified = 1) AS last_scheduled_ms FROM e GROUP BY ALL""",
    "study_latest_review": f"""
WITH {EVENTS}
SELECT user_id, card_id, seq, rating, at_ms FROM e QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY at_ms DESC NULLS LAST, seq DESC) = 1""",
    "study_history": f"""
WITH {EVENTS}
SELECT user_id, row_number() OVER w AS position, seq, card_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_ms DESC NULLS LAST, seq DESC) QUALIFY position <= 500""",
    "study_replay": f"""
WITH RECURSIVE {EVENTS.strip()},
n AS (SELECT user_id, card_id, rating, at_ms, row_number() OVER (PARTITION BY user_id, card_id ORDER BY at_ms, seq) AS i FROM e WHERE schedule_modified = 1 AND rating IS NOT NULL AND at_ms IS NOT NULL),
s(user_id, card_id, i, repetition, interval_days, ease_factor, last_ms) AS (
  SELECT DISTINCT user_id, card_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(2.5 AS DOUBLE), CAST(NULL AS BIGINT) FROM n
  UNION ALL
  SELECT s.user_id, s.card_id, n.i, CASE WHEN n.rating >= 3 THEN s.repetition + 1 ELSE 0 END,
    CASE WHEN n.rating < 3 THEN 1 WHEN s.repetition = 0 THEN 1 WHEN s.repetition = 1 THEN 6 ELSE CAST(floor(s.interval_days * s.ease_factor + 0.5) AS BIGINT) END,
    floor(greatest(1.3, s.ease_factor + (0.1::DOUBLE - (5 - n.rating) * (0.08::DOUBLE + (5 - n.rating) * 0.02::DOUBLE))) * 100 + 0.5) / 100, n.at_ms
  FROM s JOIN n ON n.user_id = s.user_id AND n.card_id = s.card_id AND n.i = s.i + 1)
SELECT user_id, card_id, repetition, interval_days, ease_factor, last_ms + interval_days * 86400000 AS due_ms FROM s WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY i DESC) = 1""",
    "events_trailing_failures": """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW) AS failures FROM events WHERE event_type = 'error'""",
    "page_text": f"""
WITH {once('source_blocks', 'b')}, {PAGES}
SELECT document_version_id, page_index, coalesce(raw_text, '') AS raw_text, coalesce(normalized_text, '') AS normalized_text FROM pages""",
    "page_kinds": f"""
WITH {once('source_blocks', 'b')},
k AS (SELECT document_version_id, page_index, {KIND} AS kind FROM b),
p AS (SELECT document_version_id, page_index, bool_or(kind IN ('text', 'ocr-text')) AS t, bool_or(kind = 'image-only') AS i FROM k GROUP BY ALL),
x AS (SELECT document_version_id, count(*) AS pages, count(*) FILTER (t) AS text_pages, count(*) FILTER (NOT t AND i) AS unextracted_pages, count(*) FILTER (NOT t AND NOT i) AS blank_pages FROM p GROUP BY ALL),
y AS (SELECT document_version_id, count(*) AS blocks, count(*) FILTER (kind IN ('text', 'ocr-text')) AS text_blocks, count(*) FILTER (kind = 'ocr-text') AS ocr_blocks, count(*) FILTER (kind = 'image-only') AS image_blocks, count(*) FILTER (kind = 'blank') AS blank_blocks FROM k GROUP BY ALL)
SELECT * FROM x JOIN y USING (document_version_id)""",
    "read_report_differences": f"""
WITH {once('source_blocks', 'b')},
k AS (SELECT document_version_id, page_index, bool_or({KIND} IN ('text', 'ocr-text')) AS t FROM b GROUP BY ALL),
p AS (SELECT document_version_id, count(*) FILTER (t) AS stored_text FROM k GROUP BY ALL),
o AS (SELECT document_version_id, count(DISTINCT page_index) AS stored_ocr FROM b WHERE text_source = 'ocr' GROUP BY ALL),
r AS (SELECT DISTINCT document_version_id, CAST(text_pages AS BIGINT) AS said_text, CAST(ocr_pages AS BIGINT) AS said_ocr, CAST(len(list_distinct(coalesce(ocr_readers, []))) AS BIGINT) AS readers FROM read_reports)
SELECT document_version_id, said_text, coalesce(stored_text, 0) AS stored_text, said_ocr, coalesce(stored_ocr, 0) AS stored_ocr, readers, coalesce(said_ocr, -1) = coalesce(stored_ocr, 0) AS ocr_agrees FROM r LEFT JOIN p USING (document_version_id) LEFT JOIN o USING (document_version_id)""",
    "document_paragraphs": f"""
WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{2,}}') AS ps FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) AS part FROM t),
t2 AS (SELECT doc_id, part, regexp_replace(regexp_replace(paragraph, '(?m)[ \\t]+$', '', 'g'), '{ENDS}', '', 'g') AS paragraph FROM p),
k AS (SELECT doc_id, paragraph, part FROM t2 WHERE paragraph <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS paragraph_no, length(paragraph) AS n_chars, CASE WHEN {collapse('paragraph')} = '' THEN 0 ELSE len(string_split({collapse('paragraph')}, ' ')) END AS n_words FROM k""",
    "scope_words": f"""
WITH {once('section_scopes', 's')},
p AS (SELECT id, unnest(pages) AS p FROM s),
w AS (SELECT id, sum(CASE WHEN coalesce({collapse('p.text')}, '') = '' THEN 0 ELSE len(string_split({collapse('p.text')}, ' ')) END) AS n FROM p GROUP BY id)
SELECT s.id AS section_id, CAST(coalesce(len(pages), 0) AS BIGINT) AS pages, CAST(coalesce(n, 0) AS BIGINT) AS n_words FROM s LEFT JOIN w USING (id)""",
    "scope_batches": f"""
WITH RECURSIVE {once('section_scopes', 's')},
p AS (SELECT id, unnest(pages) AS p FROM s WHERE pages IS NOT NULL),
n AS (SELECT id, p.page_number AS page_number, length(coalesce(p.text, '')) AS size, row_number() OVER (PARTITION BY id ORDER BY p.page_number, p.text NULLS FIRST) AS i FROM p WHERE p IS NOT NULL),
g(id, i, page_number, batch, used) AS (
  SELECT id, i, page_number, 0, size FROM n WHERE i = 1
  UNION ALL
  SELECT n.id, n.i, n.page_number, g.batch + CASE WHEN g.used > 0 AND g.used + n.size > 6000 THEN 1 ELSE 0 END, CASE WHEN g.used > 0 AND g.used + n.size > 6000 THEN n.size ELSE g.used + n.size END FROM g JOIN n ON n.id = g.id AND n.i = g.i + 1)
SELECT id AS section_id, page_number, CAST(batch AS INTEGER) AS batch FROM g""",
    "latest_versions": f"""
WITH {once('document_versions', 'v')}
SELECT document_id, id AS version_id, CAST(version AS BIGINT) AS version, lower(trim(name)) AS name, count(*) OVER (PARTITION BY document_id) AS versions FROM v QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version DESC, created_at DESC, id DESC) = 1""",
    "file_formats": """
WITH r AS (SELECT DISTINCT document_version_id, format, regexp_extract(lower(trim(file_name)), '^.+\\.([^.]*)$', 1) AS extension FROM read_reports),
k(extension, detected) AS (VALUES ('pdf', 'pdf'), ('docx', 'docx'), ('pptx', 'pptx'), ('md', 'markdown'), ('markdown', 'markdown'), ('txt', 'text'), ('text', 'text'), ('png', 'image'), ('jpg', 'image'), ('jpeg', 'image'), ('gif', 'image'), ('webp', 'image')),
x(extension, refused) AS (VALUES ('doc', 'legacy office'), ('ppt', 'legacy office'), ('xls', 'legacy office'), ('odt', 'legacy office'), ('odp', 'legacy office'), ('ods', 'legacy office'), ('epub', 'e-book'), ('mobi', 'e-book'), ('azw3', 'e-book'), ('tif', 'image not stored'), ('tiff', 'image not stored'), ('heic', 'image not stored'), ('heif', 'image not stored'), ('svg', 'image not stored'), ('rtf', 'other container'), ('pages', 'other container'), ('key', 'other container'), ('zip', 'other container'), ('html', 'other container'), ('htm', 'other container'))
SELECT document_version_id, extension, detected, refused, detected IS NOT DISTINCT FROM format AS agrees FROM r LEFT JOIN k USING (extension) LEFT JOIN x USING (extension)""",
    "concept_cited_page": f"""
WITH {once('generation_concepts', 'c')}, {once('source_blocks', 'b')},
j AS (SELECT c.id AS concept_id, {collapse('c.source_excerpt')} AS excerpt, b.id AS stored, coalesce({collapse('b.normalized_text')}, '') AS page FROM c LEFT JOIN b ON b.id = c.source_block_id),
v AS (SELECT concept_id, excerpt, page, CASE WHEN coalesce(excerpt, '') = '' THEN 'no_excerpt' WHEN length(excerpt) < 8 THEN 'too_short' WHEN stored IS NULL THEN 'block_missing' WHEN NOT contains(page, excerpt) THEN 'not_in_block' ELSE 'in_block' END AS verdict FROM j)
SELECT concept_id, verdict, CASE WHEN verdict = 'in_block' THEN CAST(length(string_split(page, excerpt)[1]) AS BIGINT) END AS span_start FROM v""",
    "concept_repaired_page": f"""
WITH {once('generation_concepts', 'c')}, {once('source_blocks', 'b')}, {once('section_scopes', 's')}, {PAGES},
j AS (SELECT c.id, c.section_id, {collapse('c.source_excerpt')} AS excerpt, b.id AS stored, coalesce({collapse('b.normalized_text')}, '') AS page FROM c LEFT JOIN b ON b.id = c.source_block_id),
lost AS (SELECT * FROM j WHERE length(excerpt) >= 8 AND (stored IS NULL OR NOT contains(page, excerpt))),
q AS (SELECT document_version_id, page_index, {collapse('normalized_text')} AS page FROM pages),
f AS (SELECT lost.id, q.page_index FROM lost JOIN s ON s.id = lost.section_id JOIN q ON q.document_version_id = s.document_version_id AND q.page_index BETWEEN s.page_start AND greatest(s.page_start, s.page_end) AND contains(q.page, lost.excerpt))
SELECT id AS concept_id, min(page_index) AS page_index FROM f GROUP BY id HAVING count(*) = 1""",
    "citation_violations": f"""
WITH {once('generation_concepts', 'c')}, {once('source_blocks', 'b')}, {once('section_scopes', 's')}, {PAGES},
q AS (SELECT document_version_id, page_index, coalesce({collapse('normalized_text')}, '') AS page FROM pages),
j AS (SELECT c.id, c.page_index, {collapse('c.source_excerpt')} AS excerpt, q.page FROM c LEFT JOIN s ON s.id = c.section_id LEFT JOIN q ON q.document_version_id = s.document_version_id AND q.page_index = c.page_index WHERE coalesce({collapse('c.source_excerpt')}, '') <> '')
SELECT id AS concept_id, page_index, CASE WHEN page IS NULL THEN 'page_missing' ELSE 'excerpt_not_on_page' END AS code FROM j WHERE page IS NULL OR NOT contains(page, excerpt)""",
    "concept_quantities": f"""
WITH {once('generation_concepts', 'c')}, q AS (SELECT id, unnest({quantities('source_excerpt')}) AS quantity FROM c)
SELECT quantity, count(DISTINCT id) AS concepts FROM q GROUP BY quantity""",
    "coverage_by_job": f"""
WITH {once('generation_concepts', 'c')},
n AS (SELECT job_id, count(*) AS found, count(*) FILTER (decision LIKE 'included%') AS included, count(*) FILTER (decision NOT LIKE 'included%') AS excluded, count(card_id) AS created, count(*) FILTER (decision LIKE 'included%' AND card_id IS NULL) AS gaps FROM c GROUP BY job_id),
p AS (SELECT *, CAST(included AS DOUBLE) / found AS p, CAST(found AS DOUBLE) AS m, 1.96::DOUBLE AS z FROM n)
SELECT job_id, found, included, excluded, created, gaps, floor(p * 10000 + 0.5) / 10000 AS share,
  floor(greatest(0.0::DOUBLE, ((p + z * z / (2 * m)) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) * 10000 + 0.5) / 10000 AS low,
  floor(least(1.0::DOUBLE, ((p + z * z / (2 * m)) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) * 10000 + 0.5) / 10000 AS high FROM p""",
    "coverage_by_decision": f"""
WITH {once('generation_concepts', 'c')}
SELECT provider, decision, count(*) AS n, arg_min(label, (created_at, id)) AS first_label FROM c GROUP BY provider, decision""",
    "concept_batches": f"""
WITH {once('generation_concepts', 'c')}, r AS (SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY centrality DESC NULLS LAST, ordinal NULLS FIRST, id) AS r FROM c WHERE decision LIKE 'included%')
SELECT id AS concept_id, (r - 1) // 10 AS batch FROM r WHERE r <= 120""",
    "reply_sizes": f"""
WITH {once('chat_responses', 'r')}
SELECT provider, phase, count(*) AS replies, count(*) FILTER (coalesce(text, '') = '') AS empty, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM r GROUP BY provider, phase""",
    "card_claims": f"""
WITH {once('cards', 'c')}, m AS (SELECT id, claim AS stored, CASE WHEN format = 'cloze' THEN regexp_replace(cloze_text, '{CLOZE}', '\\1', 'g') ELSE concat_ws(chr(10), nullif(question, ''), nullif(answer, '')) END AS claim FROM c)
SELECT id AS card_id, claim, stored IS NOT DISTINCT FROM nullif(claim, '') AS as_stored FROM m""",
    "card_structure": f"""
WITH {once('cards', 'c')}, {once('generation_concepts', 'e')},
j AS (SELECT c.id, format, coalesce({collapse('e.source_excerpt')}, '') AS excerpt, coalesce({collapse('question')}, '') AS question, coalesce({collapse('answer')}, '') AS answer, coalesce({collapse('cloze_text')}, '') AS cloze, coalesce(CAST(cloze_deletions AS JSON), '[]') AS declared FROM c LEFT JOIN e ON e.id = c.concept_id),
k AS (SELECT *, list_transform(CAST(declared AS VARCHAR[]), lambda d: {collapse('d')}) AS ds, list_transform(regexp_extract_all(cloze, '{DELETION}', 1), lambda d: {collapse('d')}) AS made, contains(cloze, '{{{{c1::') AS tagged FROM j)
SELECT id AS card_id, 'question_missing' AS code FROM k WHERE format = 'qa' AND length(question) < 5
UNION ALL SELECT id, 'answer_missing' FROM k WHERE format = 'qa' AND length(answer) < 2
UNION ALL SELECT id, 'quantity_mismatch' FROM k WHERE format = 'qa' AND answer <> '' AND {lacking(values('answer'), values('excerpt'))} > 0
UNION ALL SELECT id, 'negation_mismatch' FROM k WHERE format = 'qa' AND answer <> '' AND {cue('answer', NEGATION)} <> {cue('excerpt', NEGATION)}
UNION ALL SELECT id, 'modality_overstated' FROM k WHERE format = 'qa' AND answer <> '' AND {cue('answer', ABSOLUTE)} AND {cue('excerpt', MODALITY)}
UNION ALL SELECT id, 'cloze_tag_missing' FROM k WHERE format = 'cloze' AND NOT tagged
UNION ALL SELECT id, 'cloze_unparsable' FROM k WHERE format = 'cloze' AND tagged AND len(made) = 0
UNION ALL SELECT id, 'cloze_not_verbatim' FROM k WHERE format = 'cloze' AND tagged AND NOT contains(lower(excerpt), lower({collapse(restored)}))
UNION ALL SELECT id, 'cloze_declaration_mismatch' FROM k WHERE format = 'cloze' AND tagged AND len(list_filter(ds, lambda d: NOT list_contains(made, d))) > 0""",
    "card_similar_claims": f"""
WITH {once('cards', 'c')}, w AS (SELECT DISTINCT id, unnest({words('claim')}) AS w FROM c WHERE claim IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
b AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
SELECT b.a AS id_a, b.b AS id_b FROM b JOIN n x ON x.id = b.a JOIN n y ON y.id = b.b WHERE 2.0 * shared / (x.n + y.n) > 0.85""",
    "card_operation_keys": f"""
WITH {once('cards', 'c')} SELECT id AS card_id, substring(sha256(concat_ws(chr(0), deck_id, id, coalesce(claim, ''))), 1, 40) AS key FROM c""",
    "deck_totals": f"""
WITH {once('cards', 'c')}, t AS (SELECT deck_id, unnest(CAST(CAST(tags AS JSON) AS VARCHAR[])) AS tag FROM c),
g AS (SELECT deck_id, count(DISTINCT tag) AS tags FROM t GROUP BY deck_id),
n AS (SELECT deck_id, count(*) AS cards, count(*) FILTER (format = 'cloze') AS cloze_cards, count(DISTINCT section_id) AS sections FROM c GROUP BY deck_id)
SELECT deck_id, cards, cloze_cards, sections, coalesce(tags, 0) AS tags FROM n LEFT JOIN g USING (deck_id)""",
    "document_terms": f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 3))) AS term FROM documents)
SELECT term, count(*) AS documents FROM t WHERE NOT list_contains(string_split('{NO_TERMS}', ' '), term) GROUP BY term""",
    "place_tree": """
WITH RECURSIVE edges AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
up(ancestor, node, depth) AS (SELECT node, node, CAST(0 AS BIGINT) FROM edges UNION ALL SELECT e.parent, u.node, u.depth + 1 FROM up u JOIN edges e ON e.node = u.ancestor WHERE e.parent IS NOT NULL)
SELECT ancestor, count(*) - 1 AS below, max(depth) AS height FROM up GROUP BY ancestor""",
    "constraints": """
SELECT 'block_without_version' AS "check", count(*) AS n FROM source_blocks WHERE document_version_id IS NOT NULL AND document_version_id NOT IN (SELECT id FROM document_versions WHERE id IS NOT NULL)
UNION ALL SELECT 'scope_without_version', count(*) FROM section_scopes WHERE document_version_id IS NOT NULL AND document_version_id NOT IN (SELECT id FROM document_versions WHERE id IS NOT NULL)
UNION ALL SELECT 'concept_without_block', count(*) FROM generation_concepts WHERE source_block_id IS NOT NULL AND source_block_id NOT IN (SELECT id FROM source_blocks WHERE id IS NOT NULL)
UNION ALL SELECT 'card_without_concept', count(*) FROM cards WHERE concept_id IS NOT NULL AND concept_id NOT IN (SELECT id FROM generation_concepts WHERE id IS NOT NULL)
UNION ALL SELECT 'event_without_card', count(*) FROM review_events WHERE card_id IS NOT NULL AND card_id NOT IN (SELECT id FROM cards WHERE id IS NOT NULL)
UNION ALL SELECT 'block_repeated', count(*) FROM (SELECT id FROM source_blocks GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'card_repeated', count(*) FROM (SELECT id FROM cards GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'event_repeated', count(*) FROM (SELECT id FROM review_events GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'block_kind', count(*) FROM source_blocks WHERE kind IS NOT NULL AND kind NOT IN ('text', 'ocr-text', 'image-only', 'blank')
UNION ALL SELECT 'card_format', count(*) FROM cards WHERE format IS NOT NULL AND format NOT IN ('qa', 'cloze')
UNION ALL SELECT 'event_rating', count(*) FROM review_events WHERE rating NOT BETWEEN 0 AND 5
UNION ALL SELECT 'scan_source', count(*) FROM source_blocks WHERE (kind = 'ocr-text') <> (text_source = 'ocr')""",
}
