"""DuckDB statements the pN_ queries of this subpackage must agree with: plain comparisons of all with all, no index, no sketch.

The packing, the leaks (edits within a stretch) and the subjects (a fitted model) can't be said in SQL; they are tested against brute force and known cases.
"""

from __future__ import annotations


def near(name: str, source: str) -> str:
    """CTEs ``{name}``: pairs (a, b) of near texts of ``source`` (id, t)."""
    return f"""
{name}_o AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS w FROM (SELECT DISTINCT id, t FROM ({source}) WHERE id IS NOT NULL AND t IS NOT NULL)) GROUP BY 1, 2),
{name}_n AS (SELECT id, sum(c) AS n FROM {name}_o GROUP BY 1 HAVING sum(c) >= 8),
{name}_w AS (SELECT o.*, n.n FROM {name}_o o JOIN {name}_n n USING (id)),
{name} AS (SELECT a.id AS a, b.id AS b FROM {name}_w a JOIN {name}_w b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2 HAVING sum(least(a.c, b.c)) * 4 >= 3 * greatest(any_value(a.n), any_value(b.n)))"""


REQUESTS = near("rq", "SELECT task_id AS id, user_request AS t FROM eval_tasks")
TOOLS = near("tp", "SELECT tool_id AS id, array_to_string(list_filter(doc_snippets, lambda x: x IS NOT NULL), ' ') AS t FROM tools")
CROSS = f"""WITH {REQUESTS}, side AS (SELECT DISTINCT task_id, trim(lower(split)) AS split, source FROM eval_tasks WHERE split IS NOT NULL),
cr AS (SELECT a, b FROM rq JOIN side x ON x.task_id = a JOIN side y ON y.task_id = b WHERE starts_with(x.split, 'train') <> starts_with(y.split, 'train'))"""

K = "CASE WHEN {n} <= 3 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 9 THEN 2 WHEN {n} <= 11 THEN 3 ELSE 4 END"
CUT = r"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
BARE = "list_filter({x}, lambda x: x <> 'and')"
DOMAINS = f"""WITH f0 AS (SELECT domain_id AS id, unnest(list_concat([domain_name], coalesce(aliases, []))) AS form FROM domain_list),
f AS (SELECT DISTINCT id, array_to_string(w, '') AS joined, {BARE.format(x="w")} AS w FROM (SELECT id, {CUT.format(x="form")} AS w FROM f0) WHERE len(w) > 0),
v0 AS (SELECT v, contains(v, '.') AS short, {CUT.format(x="v")} AS w FROM (SELECT DISTINCT domain AS v FROM tools WHERE domain IS NOT NULL)),
r AS (SELECT v, short, dropped, array_to_string(w, '') AS joined, {BARE.format(x="w")} AS w FROM (
  SELECT v, short, 0 AS dropped, w FROM v0 WHERE len(w) > 0 UNION ALL SELECT v, short, 1, w[2:] FROM v0 WHERE len(w) > 1 UNION ALL SELECT v, short, 1, w[:-2] FROM v0 WHERE len(w) > 1)),
hit AS (SELECT v, 1 AS step, dropped AS x, 0 AS y, id FROM r JOIN f ON r.joined = f.joined OR r.joined = array_to_string(list_sort(f.w), ' ') OR array_to_string(list_sort(r.w), ' ') = f.joined OR list_sort(r.w) = list_sort(f.w)
  UNION ALL SELECT v, 2, dropped, 0, id FROM r JOIN f ON short AND len(r.w) > 0 AND len(r.w) = len(f.w) AND len(list_filter(range(1, len(r.w) + 1), lambda i: NOT (starts_with(f.w[i], r.w[i])))) = 0),
g AS (SELECT id, joined AS form FROM f UNION SELECT id, array_to_string(list_reverse(w), '') FROM f),
near AS (SELECT v, 3 AS step, levenshtein(joined, form) + dropped AS x, -length(form) AS y, id FROM r JOIN g ON levenshtein(joined, form) <= {K.format(n="length(form)")} AND levenshtein(joined, form) + dropped <= 4 AND (dropped = 0 OR levenshtein(joined, form) <= length(form) // 8) WHERE {K.format(n="length(form)")} > 0),
best AS (SELECT v, id FROM (SELECT v, id, row_number() OVER (PARTITION BY v ORDER BY step, x, y, id) AS k FROM (SELECT * FROM hit UNION ALL SELECT * FROM near)) WHERE k = 1)"""


LETTERS = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
#: One text for each JSON value: its paths with their leaves, in order of the paths; whole numbers without a fraction.
LEAF = "CASE WHEN type IN ('OBJECT', 'ARRAY') THEN type WHEN type IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN 'n' || CASE WHEN atom::VARCHAR::DOUBLE = floor(atom::VARCHAR::DOUBLE) AND abs(atom::VARCHAR::DOUBLE) < 1e15 THEN atom::VARCHAR::DOUBLE::BIGINT::VARCHAR ELSE atom::VARCHAR END ELSE type || atom::VARCHAR END"
SAME = f"""WITH tl AS (SELECT DISTINCT ON (tool_id) * FROM tools WHERE tool_id IS NOT NULL ORDER BY tool_id),
k AS (SELECT tool_id, {LETTERS('tool_name')} AS a, {LETTERS('server_name')} AS b, {LETTERS('tool_purpose')} AS c, CASE WHEN input_schema_raw IS NULL THEN ['-'] WHEN NOT json_valid(input_schema_raw) THEN ['!', input_schema_raw]
  ELSE (SELECT list(fullkey || '=' || {LEAF} ORDER BY fullkey) FROM json_tree(CASE WHEN json_valid(input_schema_raw) THEN input_schema_raw ELSE 'null' END)) END AS j FROM tl),
s AS (SELECT *, min(tool_id) OVER (PARTITION BY a, b, c, j) AS keeper_id, count(*) OVER (PARTITION BY a, b, c, j) AS copies FROM k)"""


def groups(name: str, kind: str) -> str:
    """Classes of equal bags, links between them and the groups they make, of the near pairs ``{name}``."""
    return f"""{name}_e AS (SELECT p.a, p.b, sum(least(x.c, y.c)) = any_value(x.n) AND any_value(x.n) = any_value(y.n) AS same FROM {name} p JOIN {name}_w x ON x.id = p.a JOIN {name}_w y ON y.id = p.b AND y.w = x.w GROUP BY 1, 2),
{name}_b AS (SELECT * FROM {name}_e UNION ALL SELECT b, a, same FROM {name}_e),
{name}_c AS (SELECT a AS id, least(a, coalesce(min(b) FILTER (same), a)) AS class_id FROM {name}_b GROUP BY 1),
{name}_l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM {name}_b p JOIN {name}_c x ON x.id = p.a JOIN {name}_c y ON y.id = p.b WHERE x.class_id <> y.class_id),
{name}_r AS (SELECT DISTINCT class_id AS x, class_id AS y FROM {name}_c UNION SELECT x, b FROM {name}_r JOIN {name}_l ON a = y),
{name}_g AS (SELECT '{kind}' AS kind, id, class_id, group_id, coalesce(links, 0) AS links FROM {name}_c JOIN (SELECT x AS class_id, min(y) AS group_id FROM {name}_r GROUP BY 1) USING (class_id) LEFT JOIN (SELECT a AS class_id, count(*) AS links FROM {name}_l GROUP BY 1) USING (class_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{SAME} SELECT keeper_id, tool_id AS copy_id FROM s WHERE tool_id <> keeper_id",
        "p1_collapsed": f"{SAME} SELECT keeper_id, copies FROM s WHERE tool_id = keeper_id",
        "p4_groups": f"WITH RECURSIVE {REQUESTS}, {TOOLS}, {groups('rq', 'request')}, {groups('tp', 'tool')} SELECT * FROM rq_g UNION ALL SELECT * FROM tp_g",
        "p2_found": f"{CROSS} SELECT a AS task_a, b AS task_b FROM cr",
        "p2_by_split_source": f"""{CROSS}, e AS (SELECT x.task_id FROM (SELECT a AS task_id FROM cr UNION ALL SELECT b FROM cr) x JOIN side USING (task_id) WHERE NOT starts_with(split, 'train')), h AS (SELECT task_id, count(*) AS links FROM e GROUP BY 1)
          SELECT split, source, count(*) AS records, count(links) AS leaked, CAST(coalesce(sum(links), 0) AS BIGINT) AS links FROM side LEFT JOIN h USING (task_id) WHERE NOT starts_with(split, 'train') GROUP BY 1, 2""",
        "p3_found": f"{DOMAINS} SELECT DISTINCT tool_id, coalesce(id, 0) AS domain_id FROM tools LEFT JOIN best ON v = domain WHERE regexp_matches(domain, '[^\\s\\p{{Z}}]')",
        "p3_unmatched": f"{DOMAINS} SELECT domain, count(DISTINCT tool_id) AS records FROM tools WHERE domain NOT IN (SELECT v FROM best) AND regexp_matches(domain, '[^\\s\\p{{Z}}]') GROUP BY 1",
        "p4_found": f"WITH {REQUESTS}, {TOOLS} SELECT 'request' AS kind, a AS id_a, b AS id_b FROM rq UNION ALL SELECT 'tool', a, b FROM tp",
        "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1C-\x1F\x{85}]')) > 2048",
    }
