"""SQL of the queries that SQL can express, for comparison over whole tables. The others are tested by brute force."""

SQL: dict[str, str] = {
    "p2_found": """
WITH s AS (SELECT id, max(pages) AS pages FROM section_scopes WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT id, unnest(pages) AS p FROM s),
t AS (SELECT id, p.page_number AS page_number, length(coalesce(p.text, '')) AS n FROM p WHERE p IS NOT NULL),
lim AS (SELECT item_kind, max(max_chars) AS most FROM split_limits GROUP BY item_kind)
SELECT id AS section_id, CAST(0 AS INTEGER) AS page_number FROM t GROUP BY id HAVING sum(n) > (SELECT most FROM lim WHERE item_kind = 'scope')
UNION
SELECT DISTINCT id, page_number FROM t WHERE n > (SELECT most FROM lim WHERE item_kind = 'page')
""",
    "p5_found": r"""
WITH c AS (SELECT id, max(claim) AS claim FROM cards WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(claim), '[\p{L}\p{N}]+')) AS w FROM c WHERE claim IS NOT NULL),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
b AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
SELECT b.a AS card_id_a, b.b AS card_id_b FROM b JOIN n x ON x.id = b.a JOIN n y ON y.id = b.b WHERE 2.0 * shared / (x.n + y.n) > 0.85
""",
    "p5_classes": r"""
WITH c AS (SELECT id, max(claim) AS claim FROM cards WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(claim), '[\p{L}\p{N}]+'))) AS ws FROM c WHERE claim IS NOT NULL),
k AS (SELECT min(id) AS id, ws FROM s WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT id, unnest(ws) AS w, len(ws) AS n FROM k),
b AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n + b.n) AS n FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id)
SELECT a AS class_id_a, b AS class_id_b FROM b WHERE 2.0 * shared / n > 0.85
""",
}
