"""SQL of the queries that check cards, concepts and replies, ask for study, and measure runs."""

from groundwork.plans.sql import ABSOLUTE, DELETION, ENDS, EVENTS, MODALITY, NEGATION, PAGES, UNITS, collapse, cue, lacking, once, quoted, values, words

#: Fixed values, written out here once more so that an error in the operators' own lists shows.
CONDITION = r"(?i)\b(?:in|at|under|for|within|during|among|when|if|only|except|unless|above|below|over|under|prior to|following)\b[^,.;]{0,60}?\b(?:neurons?|cells?|humans?|patients?|mammals?|organisms?|species|conditions?|temperatures?|pH|concentrations?|adults?|children|males?|females?|vitro|vivo|rest)\b"
OWN_WORDS = "what which when where why how according source passage following does the and for with from that this these those its has have was were are is been being into than then they them their there about because since given stated described term value"
QUANTITY_CUE = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:" + quoted(UNITS.replace("|years?|months?|days?|weeks?", "")) + r")\b"
DEFINITION_CUE = r"(?i)\b(?:is|are|was|were)\s+(?:defined as|known as|called|termed|referred to as|composed of|characterised by|characterized by)\b"
CAUSAL_CUE = r"(?i)\b(?:because|since|due to|owing to|as a result of|therefore|thus|hence|leads to|results in|prevents)\b"
MECHANISM_CUE = r"(?i)\b(?:by |through |via |requires|enables|allows|mediates|depends on|relies on|consists of|comprises)\b"
NOW = 1773576000000
PLAIN_WORDS = "the a an and or but if then than that this these those of in on at to for with from by as is are was were be been being it its into over under between their there which when where while so such may can could would should not no only also both each other more most some any all because since thus hence therefore however rather about across after before during within without through via toward towards one two three they them his her he she we our you your has have had do does did will must very much many same"

JSON_OF = r"""
bare AS (SELECT id, phase, trim(regexp_replace(regexp_replace(text, '(?i)^\s*```(?:json)?', ''), '```\s*$', ''), chr(32) || chr(9) || chr(10) || chr(13)) AS bare FROM r WHERE text IS NOT NULL),
j AS (SELECT id, phase, coalesce(CASE WHEN bare LIKE '{%' THEN TRY_CAST(bare AS JSON) END, TRY_CAST(nullif(regexp_extract(bare, '(?s)(\{.*\})', 1), '') AS JSON)) AS j FROM bare)"""


def restored(x: str) -> str:
    return collapse(f"regexp_replace({x}, '{DELETION}', '\\1', 'g')")


CLAIM = f"CASE WHEN format = 'cloze' THEN {restored('''coalesce(cloze_text, '')''')} ELSE {collapse('''coalesce(question, '') || ' ' || coalesce(answer, '')''')} END"

SUPPORT = rf"""
{once('cards', 'c')}, {once('generation_concepts', 'g')}, {once('source_blocks', 'b')}, {PAGES},
q AS (SELECT document_version_id, page_index, {collapse('normalized_text')} AS page FROM pages),
rows_ AS (SELECT c.id, coalesce({CLAIM}, '') AS claim, coalesce({collapse('g.source_excerpt')}, '') AS excerpt, coalesce(q.page, '') AS page
  FROM c JOIN g ON g.id = c.concept_id LEFT JOIN q ON q.document_version_id = c.document_version_id AND q.page_index = g.page_index),
at_ AS (SELECT *, CASE WHEN excerpt <> '' AND strpos(lower(page), lower(excerpt)) > 0 THEN strpos(lower(page), lower(excerpt)) - 1 END AS pos FROM rows_),
pieces AS (SELECT id, pos, length(excerpt) AS len, unnest(regexp_extract_all(page, '(?:\S[^.!?]*[.!?]+|\S[^.!?]*$) ?')) AS piece, generate_subscripts(regexp_extract_all(page, '(?:\S[^.!?]*[.!?]+|\S[^.!?]*$) ?'), 1) AS i FROM at_ WHERE pos IS NOT NULL),
spans AS (SELECT id, pos, len, i, rtrim(piece) AS text, sum(length(piece)) OVER (PARTITION BY id ORDER BY i) - length(piece) AS s FROM pieces),
marked AS (SELECT *, s + length(text) AS e, s <= pos + len AND s + length(text) >= pos AS hit FROM spans),
ends AS (SELECT id, min(i) FILTER (hit) AS lo, max(i) FILTER (hit) AS hi, list(text ORDER BY i) FILTER (hit) AS sentences FROM marked GROUP BY id),
around AS (SELECT m.id, min(s) AS s, max(e) AS e FROM marked m JOIN ends x ON x.id = m.id WHERE i BETWEEN lo - 1 AND hi + 1 GROUP BY m.id),
k AS (SELECT a.*, coalesce(sentences, []) AS sentences, array_to_string(coalesce(sentences, []), ' ') AS said, CASE WHEN pos IS NULL THEN '' ELSE substring(page, CAST(around.s + 1 AS BIGINT), CAST(around.e - around.s AS BIGINT)) END AS context
  FROM at_ a LEFT JOIN ends USING (id) LEFT JOIN around USING (id)),
f AS (SELECT *, {words('claim')} AS w, {words('said')} AS sw, {cue('claim', NEGATION)} AS negated, {values('claim')} AS qc, {values('said')} AS qs, {values('page')} AS qp FROM k),
d AS (SELECT *, coalesce(list_max(list_transform(sentences, lambda x: CASE WHEN len({words('x')}) = 0 OR len(w) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({words('x')}), list_distinct(w))) / (len(list_distinct({words('x')})) + len(list_distinct(w))) END)), 0.0::DOUBLE) AS closest,
  len(list_filter(sentences, lambda x: {cue('x', NEGATION)})) AS n_negated, {lacking('qc', 'qs')} AS outside, {lacking('qc', 'qp')} AS nowhere,
  len(list_filter(w, lambda t: NOT list_contains(sw, t) AND NOT list_contains(string_split('{OWN_WORDS}', ' '), t))) AS strange FROM f),
v AS (SELECT *, CASE WHEN claim = '' THEN 'claim_empty' WHEN pos IS NULL THEN 'citation_not_in_source' WHEN outside > 0 AND nowhere > 0 THEN 'quantity_mismatch'
  WHEN closest >= 0.6 AND ((NOT negated AND n_negated = len(sentences)) OR (negated AND n_negated = 0)) THEN 'negation_mismatch' END AS against FROM d),
support AS (SELECT id AS card_id, CASE WHEN against IS NULL THEN 'inconclusive' ELSE 'contradicted' END AS verdict,
  coalesce(against, concat_ws(',', CASE WHEN outside > 0 THEN 'quantity_outside_citation' END, CASE WHEN {cue('claim', ABSOLUTE)} AND {cue('said', MODALITY)} THEN 'modality_overstated' END,
    CASE WHEN regexp_matches(said, '{CONDITION}') AND NOT regexp_matches(claim, '{CONDITION}') THEN 'condition_dropped' END, CASE WHEN strange > greatest(3.0, len(w) * 0.2) THEN 'term_not_in_source' END)) AS codes,
  pos IS NOT NULL AS resolved, CAST(pos AS BIGINT) AS span_start, CAST(pos + length(excerpt) AS BIGINT) AS span_end, context FROM v)"""

METRICS = f"""{SUPPORT},
m0 AS (SELECT g.job_id, g.decision IN ('included_central', 'included_eligible') AS eligible, g.card_id, s.verdict, s.codes FROM g LEFT JOIN support s ON s.card_id = g.card_id WHERE g.job_id IS NOT NULL),
m AS (SELECT job_id, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND card_id IS NOT NULL) AS included, count(DISTINCT card_id) AS cards, count(*) FILTER (verdict IS NOT NULL) AS reviewed,
  count(*) FILTER (verdict = 'contradicted') AS unsupported, count(*) FILTER (codes = 'negation_mismatch') AS critical FROM m0 GROUP BY job_id)"""

REPLAY = f"""
WITH RECURSIVE {EVENTS.strip()},
n AS (SELECT user_id, card_id, rating, at_ms, row_number() OVER (PARTITION BY user_id, card_id ORDER BY at_ms, seq) AS i FROM {{source}} AS e WHERE schedule_modified = 1 AND rating IS NOT NULL AND at_ms IS NOT NULL),
s(user_id, card_id, i, repetition, interval_days, ease_factor, last_ms) AS (
  SELECT DISTINCT user_id, card_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(2.5 AS DOUBLE), CAST(NULL AS BIGINT) FROM n
  UNION ALL
  SELECT s.user_id, s.card_id, n.i, CASE WHEN n.rating >= 3 THEN s.repetition + 1 ELSE 0 END,
    CASE WHEN n.rating < 3 THEN 1 WHEN s.repetition = 0 THEN 1 WHEN s.repetition = 1 THEN 6 ELSE CAST(floor(s.interval_days * s.ease_factor + 0.5) AS BIGINT) END,
    floor(greatest(1.3, s.ease_factor + (0.1::DOUBLE - (5 - n.rating) * (0.08::DOUBLE + (5 - n.rating) * 0.02::DOUBLE))) * 100 + 0.5) / 100, n.at_ms
  FROM s JOIN n ON n.user_id = s.user_id AND n.card_id = s.card_id AND n.i = s.i + 1),
done AS (SELECT * FROM s WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY i DESC) = 1)"""

STUDY = f"""
WITH RECURSIVE {EVENTS.strip()}, {once('cards', 'c')},
n AS (SELECT user_id, card_id, rating, at_ms, row_number() OVER (PARTITION BY user_id, card_id ORDER BY at_ms, seq) AS i FROM e WHERE schedule_modified = 1 AND rating IS NOT NULL AND at_ms IS NOT NULL),
s(user_id, card_id, i, repetition, interval_days, ease_factor, last_ms) AS (
  SELECT DISTINCT user_id, card_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(2.5 AS DOUBLE), CAST(NULL AS BIGINT) FROM n
  UNION ALL
  SELECT s.user_id, s.card_id, n.i, CASE WHEN n.rating >= 3 THEN s.repetition + 1 ELSE 0 END,
    CASE WHEN n.rating < 3 THEN 1 WHEN s.repetition = 0 THEN 1 WHEN s.repetition = 1 THEN 6 ELSE CAST(floor(s.interval_days * s.ease_factor + 0.5) AS BIGINT) END,
    floor(greatest(1.3, s.ease_factor + (0.1::DOUBLE - (5 - n.rating) * (0.08::DOUBLE + (5 - n.rating) * 0.02::DOUBLE))) * 100 + 0.5) / 100, n.at_ms
  FROM s JOIN n ON n.user_id = s.user_id AND n.card_id = s.card_id AND n.i = s.i + 1),
schedule AS (SELECT user_id, card_id, last_ms + interval_days * 86400000 AS due_ms FROM s WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY i DESC) = 1),
own AS (SELECT owner_id AS user_id, id AS card_id FROM c WHERE owner_id IS NOT NULL UNION SELECT user_id, card_id FROM e WHERE user_id IS NOT NULL AND card_id IS NOT NULL),
states AS (SELECT own.user_id, own.card_id, coalesce(c.created_at, '') AS created_at, due_ms, CASE WHEN coalesce(c.claim, '') = '' THEN 'suspended' WHEN schedule.card_id IS NULL THEN 'new' WHEN coalesce(due_ms, 0) <= {NOW} THEN 'due' ELSE 'later' END AS state
  FROM own JOIN c ON c.id = own.card_id LEFT JOIN schedule ON schedule.user_id = own.user_id AND schedule.card_id = own.card_id),
k AS (SELECT e.*, at_ms // 86400000 AS day FROM e WHERE schedule_modified = 1 AND at_ms IS NOT NULL AND card_id IN (SELECT id FROM cards)),
f AS (SELECT user_id, card_id, min(day) AS first FROM k GROUP BY ALL),
today AS (SELECT k.user_id, count(*) AS reviews, count(DISTINCT CASE WHEN k.day = f.first THEN k.card_id END) AS new_cards FROM k JOIN f USING (user_id, card_id) WHERE k.day = {NOW} // 86400000 GROUP BY k.user_id),
ranked AS (SELECT states.*, row_number() OVER (PARTITION BY states.user_id, state ORDER BY CASE WHEN state = 'due' THEN coalesce(due_ms, 0) END NULLS FIRST, created_at, card_id) AS r,
  CASE state WHEN 'due' THEN greatest(0, 200 - coalesce(reviews, 0)) WHEN 'new' THEN greatest(0, 20 - coalesce(new_cards, 0)) ELSE 0 END AS room FROM states LEFT JOIN today ON today.user_id = states.user_id)"""

DECISIONS = f"""
{once('generation_concepts', 'c')}, {once('source_blocks', 'b')}, {once('section_scopes', 's')}, {PAGES},
q AS (SELECT document_version_id AS version, page_index, {collapse('normalized_text')} AS page FROM pages),
x AS (SELECT c.id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, c.centrality)) AS centrality, c.section_id, s.id AS stored, s.page_start, s.page_end, c.page_index, coalesce(s.document_version_id, b.document_version_id) AS version, coalesce({collapse('c.source_excerpt')}, '') AS excerpt
  FROM c LEFT JOIN s ON s.id = c.section_id LEFT JOIN b ON b.id = c.source_block_id WHERE coalesce({collapse('c.label')}, '') <> ''),
y AS (SELECT x.*, section_id IS NOT NULL AND stored IS NULL AS outside, coalesce(length(excerpt) >= 8 AND contains(q.page, excerpt), FALSE) AS there FROM x LEFT JOIN q ON q.version = x.version AND q.page_index = x.page_index),
z AS (SELECT y.id, min(q.page_index) AS moved FROM y JOIN q ON q.version = y.version AND q.page_index BETWEEN y.page_start AND greatest(y.page_start, y.page_end) AND contains(q.page, y.excerpt)
  WHERE NOT outside AND NOT there AND length(excerpt) >= 8 GROUP BY y.id HAVING count(*) = 1),
decided AS (SELECT y.id AS concept_id, CASE WHEN outside THEN 'excluded_out_of_scope' WHEN there OR moved IS NOT NULL THEN 'included_eligible' ELSE 'excluded_not_in_source' END AS decision,
  CASE WHEN NOT outside AND NOT there THEN coalesce(moved, page_index) ELSE page_index END AS page_index, centrality FROM y LEFT JOIN z ON z.id = y.id)"""

TEXT = "coalesce(source_excerpt, '')"

SQL: dict[str, str] = {
    "card_support": f"WITH {SUPPORT.strip()} SELECT * FROM support",
    "run_metrics": f"WITH {METRICS.strip()} SELECT * FROM m",
    "quality_gates": f"""
WITH {METRICS.strip()},
p AS (SELECT job_id, 'supported_claims' AS gate, reviewed - unsupported AS k, reviewed AS n, 0.98::DOUBLE AS target FROM m
  UNION ALL SELECT job_id, 'comprehensive_coverage', included, eligible, 0.9::DOUBLE FROM m UNION ALL SELECT job_id, 'critical_errors', critical, reviewed, NULL FROM m),
w AS (SELECT *, CASE WHEN n > 0 THEN floor(CAST(k AS DOUBLE) / n * 10000 + 0.5) / 10000 END AS value, CAST(k AS DOUBLE) / nullif(n, 0) AS x, CAST(n AS DOUBLE) AS d, 1.96::DOUBLE AS z FROM p)
SELECT job_id, gate, CASE WHEN n = 0 THEN 'unmet' WHEN target IS NULL THEN CASE WHEN k = 0 THEN 'pass' ELSE 'fail' END WHEN value >= target THEN 'pass' ELSE 'fail' END AS status,
  CASE WHEN n > 0 THEN k END AS numerator, CASE WHEN n > 0 THEN n END AS denominator, value,
  CASE WHEN n > 0 AND target IS NOT NULL THEN floor(greatest(0.0::DOUBLE, ((x + z * z / (2 * d)) - z * sqrt(x * (1 - x) / d + z * z / (4 * d * d))) / (1 + z * z / d)) * 10000 + 0.5) / 10000 END AS low,
  CASE WHEN n > 0 AND target IS NOT NULL THEN floor(least(1.0::DOUBLE, ((x + z * z / (2 * d)) + z * sqrt(x * (1 - x) / d + z * z / (4 * d * d))) / (1 + z * z / d)) * 10000 + 0.5) / 10000 END AS high FROM w""",
    "card_grounding": f"""
WITH {once('cards', 'c')}, {once('generation_concepts', 'g')},
j AS (SELECT c.id, format, coalesce(question, '') AS question, coalesce(answer, '') AS answer, coalesce(cloze_text, '') AS cloze, lower(coalesce({collapse('g.source_excerpt')}, '')) AS excerpt FROM c LEFT JOIN g ON g.id = c.concept_id),
k AS (SELECT *, {words('answer')} AS w, list_transform(regexp_extract_all(cloze, '{DELETION}', 1), lambda d: {collapse('d')}) AS ds, contains(cloze, '{{{{c1::') AS tagged FROM j),
e AS (SELECT *, CASE WHEN format = 'qa' AND length(regexp_replace(question, '{ENDS}', '', 'g')) < 5 THEN ['question_missing'] ELSE [] END || CASE WHEN format = 'qa' AND length(regexp_replace(answer, '{ENDS}', '', 'g')) < 2 THEN ['answer_missing'] ELSE [] END
  || CASE WHEN format = 'cloze' AND NOT tagged THEN ['cloze_tag_missing'] ELSE [] END || CASE WHEN format = 'cloze' AND tagged AND len(ds) = 0 THEN ['cloze_unparsable'] ELSE [] END AS bad,
  CASE WHEN format = 'qa' AND answer <> '' AND len(w) >= 3 AND len(list_filter(w, lambda t: contains(excerpt, t))) < 0.3 * len(w) THEN ['answer_terms_absent'] ELSE [] END
  || CASE WHEN format = 'cloze' AND tagged THEN list_transform(list_filter(ds, lambda d: d <> '' AND NOT contains(excerpt, lower(d))), lambda d: 'cloze_not_verbatim') ELSE [] END AS warned FROM k)
SELECT id AS card_id, array_to_string(bad || warned, ',') AS codes, len(bad) = 0 AS is_valid, round(greatest(0.0::DOUBLE, 1 - (len(bad) * 0.4::DOUBLE + len(warned) * 0.15::DOUBLE)), 4) AS score FROM e""",
    "card_stored_shapes": f"""
WITH {once('cards', 'c')}, k AS (SELECT *, format = 'qa' AS qa FROM c)
SELECT id AS card_id, 'question_missing' AS code FROM k WHERE qa AND regexp_replace(coalesce(question, ''), '{ENDS}', '', 'g') = ''
UNION ALL SELECT id, 'answer_missing' FROM k WHERE qa AND regexp_replace(coalesce(answer, ''), '{ENDS}', '', 'g') = ''
UNION ALL SELECT id, 'cloze_deletion_missing' FROM k WHERE NOT qa AND NOT contains(coalesce(cloze_text, ''), '{{{{c1::')
UNION ALL SELECT id, 'cloze_deletions_not_recorded' FROM k WHERE NOT qa AND len(coalesce(CAST(CAST(cloze_deletions AS JSON) AS VARCHAR[]), [])) = 0""",
    "card_export_lines": f"""
WITH {once('cards', 'c')}, {once('generation_concepts', 'g')},
j AS (SELECT c.deck_id, c.id, format = 'cloze' AS cloze, coalesce(question, '') AS question, coalesce(answer, '') AS answer, coalesce(cloze_text, '') AS cloze_text, coalesce(explanation, '') AS explanation, coalesce(g.source_excerpt, '') AS excerpt,
  'Page ' || coalesce(CAST(g.page_index AS VARCHAR), '') || ' (' || coalesce(g.section_title, '') || ')' AS page, coalesce(CAST(CAST(tags AS JSON) AS VARCHAR[]), []) AS tags FROM c LEFT JOIN g ON g.id = c.concept_id WHERE c.deck_id IS NOT NULL),
n AS (SELECT *, CASE WHEN explanation <> '' THEN '<small><i>Note: ' || explanation || '</i></small>' ELSE '' END AS note FROM j),
f AS (SELECT deck_id, id, CASE WHEN cloze THEN cloze_text ELSE question END AS front, CASE WHEN cloze THEN note ELSE answer || CASE WHEN note <> '' THEN '<br><br>' || note ELSE '' END END AS back, '<blockquote>' || excerpt || '</blockquote>' AS quote, page, tags FROM n),
l AS (SELECT deck_id, id, replace(replace(front, chr(9), '    '), chr(10), '<br>') || chr(9) || replace(replace(back, chr(9), '    '), chr(10), '<br>') || chr(9) || replace(replace(quote, chr(9), '    '), chr(10), '<br>') || chr(9) || page || chr(9) || array_to_string(list_transform(tags, lambda t: regexp_replace(t, '\\s+', '_', 'g')), ' ') AS line FROM f),
d AS (SELECT DISTINCT deck_id FROM c WHERE deck_id IS NOT NULL)
SELECT deck_id, row_number() OVER (PARTITION BY deck_id ORDER BY id) AS position, line FROM l
UNION ALL SELECT deck_id, CAST(-5 AS BIGINT), '#separator:Tab' FROM d UNION ALL SELECT deck_id, CAST(-4 AS BIGINT), '#html:true' FROM d UNION ALL SELECT deck_id, CAST(-3 AS BIGINT), '#tags column:5' FROM d
UNION ALL SELECT deck_id, CAST(-2 AS BIGINT), '#deck:' || regexp_replace(deck_id, '[^A-Za-z0-9_\\s-]', '', 'g') FROM d UNION ALL SELECT deck_id, CAST(-1 AS BIGINT), '#columns:Front' || chr(9) || 'Back' || chr(9) || 'SourceExcerpt' || chr(9) || 'PageNumber' || chr(9) || 'Tags' FROM d""",
    "card_export_rows": f"""
WITH {once('cards', 'c')},
n AS (SELECT deck_id, id, row_number() OVER (PARTITION BY deck_id ORDER BY id) - 1 AS due, count(*) OVER (PARTITION BY deck_id) AS notes,
  CASE WHEN format = 'cloze' THEN list_transform(list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(cloze_text, ''), '\\{{\\{{c([0-9]+)::', 1), lambda x: CAST(x AS BIGINT)))), lambda x: x > 0), lambda x: x - 1) ELSE [CAST(0 AS BIGINT)] END AS ords,
  CAST('0x' || substring(sha1(regexp_replace(CASE WHEN format = 'cloze' THEN regexp_replace(coalesce(cloze_text, ''), '\\{{\\{{c[0-9]+::(.*?)\\}}\\}}', '\\1', 'g') ELSE coalesce(question, '') END, '<[^>]+>', '', 'g')), 1, 8) AS BIGINT) AS checksum,
  list_filter(list_transform(coalesce(CAST(CAST(tags AS JSON) AS VARCHAR[]), []), lambda t: regexp_replace(regexp_replace(trim(t), '\\s+', '_', 'g'), '[\\x00-\\x1f\\x7f]', '', 'g')), lambda t: t <> '') AS tags FROM c WHERE deck_id IS NOT NULL),
b AS (SELECT *, coalesce(sum(len(ords)) OVER (PARTITION BY deck_id ORDER BY due ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
u AS (SELECT *, unnest(ords) AS ord, generate_subscripts(ords, 1) AS k FROM b)
SELECT deck_id, id AS card_id, CAST(1750000000000 + due + 1 AS BIGINT) AS note_id, CAST(1750000000000 + notes + before + k AS BIGINT) AS row_id, ord, CAST(due AS BIGINT) AS due, checksum, CASE WHEN len(tags) = 0 THEN '' ELSE ' ' || array_to_string(tags, ' ') || ' ' END AS tag_cell FROM u""",
    "study_queue": f"""{STUDY},
a AS (SELECT *, sum(CASE WHEN state = 'due' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS n_due FROM ranked WHERE r <= room)
SELECT user_id, CAST(r + CASE WHEN state = 'new' THEN n_due ELSE 0 END AS BIGINT) AS position, card_id, state FROM a""",
    "study_cram": f"""{STUDY}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE state WHEN 'due' THEN 0 WHEN 'new' THEN 1 ELSE 2 END, r) AS position, card_id FROM ranked WHERE state <> 'suspended'""",
    "study_counts": f"""{STUDY}
SELECT user_id, count(*) FILTER (r <= room) AS eligible, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'due') AS due, count(*) FILTER (state = 'later') AS later, count(*) FILTER (state = 'suspended') AS suspended,
  count(*) FILTER (state = 'new' AND r > room) AS deferred_new, count(*) FILTER (state = 'due' AND r > room) AS deferred_review FROM ranked GROUP BY user_id""",
    "concept_decisions": f"WITH {DECISIONS.strip()} SELECT * FROM decided",
    "concept_central": f"""
WITH {DECISIONS.strip()}
SELECT concept_id, CASE WHEN decision = 'included_eligible' AND coalesce(centrality, 0) < 0.55 THEN 'excluded_secondary_high_yield' WHEN decision = 'included_eligible' THEN 'included_central' ELSE decision END AS decision FROM decided""",
    "concept_formats": f"""
WITH {once('generation_concepts', 'c')},
k AS (SELECT id, kind, {TEXT} AS text, len(list_filter(string_split_regex({collapse(TEXT)}, '\\s+'), lambda w: w <> '')) >= 4 AND length({collapse(TEXT)}) >= 3 AS able FROM c),
t AS (SELECT id, CASE WHEN regexp_matches(text, '{QUANTITY_CUE}') THEN CASE WHEN able THEN 'cloze content_cues_quantity' ELSE 'qa fallback_relational' END
  WHEN regexp_matches(text, '{DEFINITION_CUE}') THEN CASE WHEN able THEN 'cloze content_cues_definition' ELSE 'qa fallback_relational' END
  WHEN regexp_matches(text, '{CAUSAL_CUE}') THEN 'qa content_cues_causal' WHEN regexp_matches(text, '{MECHANISM_CUE}') THEN 'qa content_cues_mechanism'
  WHEN kind IN ('quantity', 'definition') THEN CASE WHEN able THEN 'cloze concept_' || kind ELSE 'qa fallback_relational' END WHEN kind IN ('causal', 'mechanism') THEN 'qa concept_' || kind ELSE 'qa concept_relational' END AS told FROM k)
SELECT id AS concept_id, string_split(told, ' ')[1] AS format, string_split(told, ' ')[2] AS reason FROM t""",
    "concept_unique_page": f"""
WITH {once('generation_concepts', 'c')}, {once('source_blocks', 'b')}, {once('section_scopes', 's')}, {PAGES},
q AS (SELECT document_version_id, page_index, {collapse('normalized_text')} AS page FROM pages),
f AS (SELECT c.id, q.page_index FROM c JOIN s ON s.id = c.section_id JOIN q ON q.document_version_id = s.document_version_id AND q.page_index BETWEEN s.page_start AND greatest(s.page_start, s.page_end) AND contains(q.page, {collapse('c.source_excerpt')}) WHERE length({collapse('c.source_excerpt')}) >= 8)
SELECT id AS concept_id, min(page_index) AS page_index FROM f GROUP BY id HAVING count(*) = 1""",
    "concept_located": f"""
WITH {once('generation_concepts', 'c')}, {once('source_blocks', 'b')}, {once('section_scopes', 's')}, {PAGES},
q AS (SELECT document_version_id, page_index, {collapse('normalized_text')} AS page FROM pages),
a AS (SELECT c.id, s.document_version_id AS v, c.page_index AS p, {collapse('c.source_excerpt')} AS excerpt, q.page FROM c JOIN s ON s.id = c.section_id JOIN q ON q.document_version_id = s.document_version_id AND q.page_index = c.page_index WHERE coalesce({collapse('c.source_excerpt')}, '') <> '' AND contains(q.page, {collapse('c.source_excerpt')})),
h AS (SELECT a.id, arg_min(b.id, (b.ordinal, b.id)) AS block_id FROM a JOIN b ON b.document_version_id = a.v AND b.page_index = a.p AND contains({collapse('b.normalized_text')}, a.excerpt) GROUP BY a.id)
SELECT a.id AS concept_id, block_id, CAST(strpos(page, excerpt) - 1 AS BIGINT) AS span_start, CAST(strpos(page, excerpt) - 1 + length(excerpt) AS BIGINT) AS span_end FROM a LEFT JOIN h ON h.id = a.id""",
    "scope_calls": f"""
WITH RECURSIVE {once('section_scopes', 's')},
z AS (SELECT id, document_version_id AS v, page_start, CAST(coalesce(list_sum(list_transform(list_filter(pages, lambda p: trim(coalesce(p.text, '')) <> ''), lambda p: length(p.text))), 0) AS BIGINT) AS size FROM s WHERE pages IS NOT NULL AND document_version_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY page_start NULLS FIRST, id) AS i FROM z WHERE size > 0),
g(v, i, id, batch, used) AS (SELECT v, i, id, 0, size FROM n WHERE i = 1
  UNION ALL SELECT n.v, n.i, n.id, g.batch + CASE WHEN g.used > 0 AND g.used + n.size > 60000 THEN 1 ELSE 0 END, CASE WHEN g.used > 0 AND g.used + n.size > 60000 THEN n.size ELSE g.used + n.size END FROM g JOIN n ON n.v = g.v AND n.i = g.i + 1)
SELECT id AS section_id, CAST(batch AS INTEGER) AS batch FROM g""",
    "version_chunks": """
WITH r AS (SELECT document_version_id, CAST(max(page_count) AS BIGINT) AS pages FROM read_reports WHERE page_count > 0 GROUP BY document_version_id),
s AS (SELECT *, greatest(1, CAST(ceil(pages / 6.0) AS BIGINT)) AS step FROM r), u AS (SELECT *, unnest(generate_series(1, pages, step)) AS a FROM s)
SELECT document_version_id, CAST((a - 1) // step + 1 AS BIGINT) AS chunk_no, CAST(a AS BIGINT) AS page_start, CAST(least(a + step - 1, pages) AS BIGINT) AS page_end FROM u""",
    "chunk_pages": f"""
WITH {once('section_scopes', 's')},
r AS (SELECT document_version_id AS v, CAST(max(page_count) AS BIGINT) AS pages FROM read_reports WHERE page_count > 0 GROUP BY document_version_id),
t AS (SELECT *, greatest(1, CAST(ceil(pages / 6.0) AS BIGINT)) AS step FROM r), u AS (SELECT *, unnest(generate_series(1, pages, step)) AS a FROM t),
k AS (SELECT v || '#' || CAST((a - 1) // step + 1 AS VARCHAR) AS id, v, a, least(a + step - 1, pages) AS b FROM u),
own AS (SELECT id, unnest(generate_series(CAST(page_start AS BIGINT), CAST(page_end AS BIGINT))) AS page FROM s WHERE page_end >= page_start),
mine AS (SELECT id, v, a, b, unnest(generate_series(a, b)) AS page FROM k)
SELECT id, page FROM own
UNION ALL SELECT id, page FROM mine m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_version_id = m.v AND s.page_start >= m.a AND s.page_end <= m.b AND m.page BETWEEN s.page_start AND s.page_end)""",
    "empty_pages": f"""
WITH {once('source_blocks', 'b')}
SELECT document_version_id, page_index FROM b GROUP BY ALL HAVING max(length(coalesce({collapse('normalized_text')}, ''))) = 0""",
    "block_neighbours": f"""
WITH {once('source_blocks', 'b')},
w AS (SELECT id, [lag(normalized_text, 2) OVER p, lag(normalized_text, 1) OVER p, lead(normalized_text, 1) OVER p, lead(normalized_text, 2) OVER p] AS ts FROM b WINDOW p AS (PARTITION BY document_version_id, page_index ORDER BY ordinal NULLS FIRST, id))
SELECT id, substring(array_to_string(list_filter(list_transform(ts, lambda t: trim(t)), lambda t: t <> ''), ' '), 1, 600) AS context FROM w""",
    "reply_concepts": f"""
WITH {once('chat_responses', 'r')}, {JSON_OF.strip()},
l AS (SELECT id, CAST(json_extract(j, '$.concepts') AS JSON[]) AS l FROM j WHERE phase = 'concepts' AND json_type(j, '$.concepts') = 'ARRAY'),
u AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS position FROM l)
SELECT id AS reply_id, position, trim(c->>'$.label') AS label, c->>'$.kind' AS kind, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(c->>'$.centrality' AS DOUBLE))) AS centrality FROM u
WHERE length(trim(coalesce(c->>'$.label', ''))) BETWEEN 1 AND 300 AND length(trim(coalesce(c->>'$.sourceExcerpt', ''))) BETWEEN 1 AND 4000 AND c->>'$.kind' IN ('definition', 'quantity', 'causal', 'mechanism', 'relational') AND c->>'$.centrality' IS NOT NULL AND c->>'$.pageNumber' IS NOT NULL""",
    "reply_cards": f"""
WITH {once('chat_responses', 'r')}, {JSON_OF.strip()},
l AS (SELECT id, CAST(json_extract(j, '$.cards') AS JSON[]) AS l FROM j WHERE phase = 'cards' AND json_type(j, '$.cards') = 'ARRAY'),
u AS (SELECT id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS position FROM l)
SELECT id AS reply_id, position, trim(c->>'$.conceptId') AS concept_id, c->>'$.format' AS format, nullif(trim(c->>'$.question'), '') AS question, nullif(trim(c->>'$.answer'), '') AS answer, nullif(trim(c->>'$.clozeText'), '') AS cloze_text,
  CAST(least(10, coalesce(json_array_length(c, '$.clozeDeletions'), 0)) AS BIGINT) AS deletions, CAST(least(12, coalesce(json_array_length(c, '$.tags'), 0)) AS BIGINT) AS tags FROM u
WHERE length(trim(coalesce(c->>'$.conceptId', ''))) BETWEEN 1 AND 200 AND c->>'$.format' IN ('qa', 'cloze')""",
    "reply_support": f"""
WITH {once('chat_responses', 'r')}, {JSON_OF.strip()}
SELECT id AS reply_id, CAST(j->>'$.supported' AS BOOLEAN) AS supported, list_transform(coalesce(CAST(json_extract(j, '$.issues') AS VARCHAR[]), [])[1:8], lambda x: substring(x, 1, 200)) AS issues FROM j WHERE phase = 'support' AND json_type(j, '$.supported') = 'BOOLEAN'""",
    "reply_pages": rf"""
WITH {once('chat_responses', 'r')}, {JSON_OF.strip()}
SELECT id AS reply_id, regexp_replace(replace(j->>'$.text', chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS text, CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(j->>'$.confidence' AS DOUBLE))) END AS confidence FROM j WHERE phase = 'page_ocr' AND json_type(j, '$.text') = 'VARCHAR'""",
    "card_export_bundle": f"""
WITH {once('cards', 'c')}
SELECT deck_id, count(*) OVER (PARTITION BY deck_id) AS card_count, id AS card_id, CAST(json_object('id', id, 'format', format, 'question', question, 'answer', answer, 'cloze_text', cloze_text, 'explanation', explanation) AS VARCHAR) AS bundle FROM c WHERE deck_id IS NOT NULL""",
    "study_all_counts": f"""
WITH {EVENTS}
SELECT c.id AS card_id, CAST(count(e.id) AS BIGINT) AS review_count, count(e.id) FILTER (schedule_modified = 1) AS schedule_review_count, max(at_ms) FILTER (schedule_modified = 1) AS last_scheduled_ms
FROM (SELECT DISTINCT id FROM cards WHERE id IS NOT NULL) c LEFT JOIN e ON e.card_id = c.id GROUP BY c.id""",
    "study_undone": f"""{REPLAY.format(source="(SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY at_ms DESC NULLS LAST, seq DESC) > 1)")}
SELECT user_id, card_id, repetition, interval_days, ease_factor, last_ms + interval_days * 86400000 AS due_ms FROM done""",
    "study_next_review": f"""{REPLAY.format(source="e")}
SELECT user_id, card_id, CASE WHEN interval_days < 30 THEN interval_days || ' day' || CASE WHEN interval_days > 1 THEN 's' ELSE '' END ELSE CAST(floor(interval_days / 30.0::DOUBLE + 0.5) AS BIGINT) || ' mo' || CASE WHEN floor(interval_days / 30.0::DOUBLE + 0.5) > 1 THEN 's' ELSE '' END END AS text FROM done""",
    "card_first_evidence": f"""
WITH {once('generation_concepts', 'g')}, f AS (SELECT * FROM g WHERE card_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY page_index NULLS FIRST, ordinal NULLS FIRST, id) = 1)
SELECT c.id AS card_id, f.id AS concept_id, f.page_index, f.section_title FROM (SELECT DISTINCT id FROM cards WHERE id IS NOT NULL) c LEFT JOIN f ON f.card_id = c.id""",
    "card_sections": f"""
WITH {once('cards', 'c')}, {once('section_scopes', 's')}
SELECT c.id AS card_id, c.section_id, s.title, s.page_start, s.page_end FROM c LEFT JOIN s ON s.id = c.section_id""",
    "latest_jobs": f"""
WITH {once('generation_concepts', 'g')}, j AS (SELECT job_id, max(created_at) AS last, count(*) AS concepts FROM g WHERE job_id IS NOT NULL GROUP BY job_id)
SELECT job_id, row_number() OVER (ORDER BY last DESC NULLS LAST, job_id) AS position, last, concepts FROM j QUALIFY position <= 20""",
    "withheld_concepts": f"""
WITH {once('generation_concepts', 'g')}
SELECT job_id, decision, count(*) AS n, arg_min(decision_detail, (ordinal, id)) AS first_detail FROM g WHERE job_id IS NOT NULL AND card_id IS NULL GROUP BY job_id, decision""",
    "section_candidates": f"""
WITH {once('section_scopes', 's')},
p AS (SELECT id, unnest(pages) AS p FROM s WHERE pages IS NOT NULL),
t AS (SELECT id, p.page_number AS page_number, string_split(regexp_replace({collapse('p.text')}, '([!?]|(?:^|[^0-9])\\.) ', '\\1' || chr(10), 'g'), chr(10)) AS ts FROM p WHERE p.text <> ''),
u AS (SELECT id, page_number, unnest(list_filter(ts, lambda x: trim(x) <> '')) AS sentence, generate_subscripts(list_filter(ts, lambda x: trim(x) <> ''), 1) - 1 AS sentence_no FROM t),
k AS (SELECT *, len(string_split_regex(sentence, '\\s+')) AS n, len(list_filter(string_split_regex(regexp_replace(lower(sentence), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains(string_split('{PLAIN_WORDS}', ' '), w))) AS telling FROM u),
m AS (SELECT *, n BETWEEN 8 AND 70 AND telling >= 3 AS strict FROM k),
d AS (SELECT * FROM m WHERE strict OR (n BETWEEN 5 AND 90 AND telling >= 2) QUALIFY row_number() OVER (PARTITION BY id, regexp_replace(lower(sentence), '[^a-z0-9]', '', 'g') ORDER BY strict DESC, page_number NULLS FIRST, sentence_no, sentence) = 1),
w AS (SELECT *, list_transform(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS ws FROM d),
r AS (SELECT *, list_concat(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]), list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]), list_transform(ws, lambda x: [x])) AS runs FROM w),
g AS (SELECT *, list_filter(list_transform(list_filter(runs, lambda z: len(list_filter(z, lambda y: length(y) < 4 OR list_contains(string_split('{PLAIN_WORDS}', ' '), lower(y)))) = 0), lambda z: array_to_string(z, ' ')), lambda z: (length(sentence) - length(replace(lower(sentence), lower(z), ''))) = length(z)) AS terms FROM r),
h AS (SELECT *, list_max(list_transform(terms, lambda z: length(replace(z, ' ', '')))) AS longest FROM g),
f AS (SELECT *, list_filter(terms, lambda z: length(replace(z, ' ', '')) = longest)[1] AS key_term,
  CASE WHEN regexp_matches(sentence, '(?i)\\b(?:is|are|was|were)\\s+(?:defined as|known as|called|termed|referred to as|composed of|characterized by|characterised by|the)\\b') OR regexp_matches(sentence, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(?:mV|ms|Hz|nm|µm|um|mm|cm|kDa|Da|mM|µM|uM|nM|pM|%|°C|s\\b|percent|millivolts?|milliseconds?|seconds?|minutes?|hours?|hertz|nanometers?|micrometers?|millimeters?|centimeters?|millimolar|micromolar|nanomolar|picomolar|degrees?|daltons?|kilodaltons?)') THEN 'definition'
  WHEN regexp_matches(sentence, '(?i)\\b(?:because|since|due to|owing to|as a result of|therefore|thus|hence)\\b') THEN 'causal' WHEN regexp_matches(sentence, '(?i)\\b(?:by|through|via|requires|enables|allows|mediates|depends on|relies on)\\b') THEN 'mechanism' ELSE 'general' END AS kind FROM h)
SELECT id AS section_id, page_number, sentence_no, sentence, strict, kind, key_term, CASE kind WHEN 'definition' THEN 3.0::DOUBLE WHEN 'causal' THEN 2.8::DOUBLE WHEN 'mechanism' THEN 2.4::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN key_term IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM f""",
}
