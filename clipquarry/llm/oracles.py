"""SQL for the queries that SQL can express; the tests compare the others with brute force."""

from __future__ import annotations

from clipquarry.llm.queries import URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"


def _address(url: str) -> str:
    query = f"regexp_extract({url}, '^.*?://[^?#]*([?][^#]*)', 1, 's')"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_path(url)} || {query} END"


def _normal(node: str) -> str:
    path = f"regexp_replace(split_part({node}, '?', 1), '/+$', '')"
    parts = f"string_split(regexp_replace({node}, '^[^?]*[?]?', '', 's'), '&')"
    kept = f"list_filter({parts}, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_\\w*|gclid|fbclid|ref)='))"
    return f"{path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


def _resolved(target: str) -> str:
    scheme = "regexp_extract(url, '^(.*?)://', 1, 's')"
    site = f"{scheme} || '://' || {_host('url')}"
    folder = f"regexp_replace({_path('url')}, '[^/]*$', '')"
    return (
        f"CASE WHEN {target} IS NULL OR {target} = '' OR starts_with({target}, '#') THEN NULL "
        f"WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target} "
        f"WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target} "
        f"WHEN starts_with({target}, '/') THEN {site} || {target} "
        f"WHEN starts_with({target}, '?') THEN {site} || {_path('url')} || {target} "
        f"ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {target} END"
    )


def _attribute(tag: str, value: str, groups: int) -> str:
    found = f"regexp_extract(coalesce(html, ''), '{tag}', 0, 'is')"
    values = [f"nullif(regexp_extract({found}, '{value}', {g}, 'is'), '')" for g in range(1, groups + 1)]
    return f"trim(coalesce({', '.join(values)}))"


def _urls() -> str:
    quote = "[\"'']"
    link = _attribute(
        rf"<link\b[^>]*\brel\s*=\s*{quote}?canonical\b[^>]*>",
        "\\bhref\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))",
        3,
    )
    meta = _attribute(
        rf"<meta\b[^>]*\bhttp-equiv\s*=\s*{quote}?refresh\b[^>]*>",
        rf"\bcontent\s*=\s*{quote}?\s*0*\s*[;,]\s*url\s*=\s*{quote}?([^\"''>\s]+)",
        1,
    )
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    fits = "(n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)"
    return f"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {rules}),
raw AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
seen AS (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS node,
  {_resolved(link)} AS canonical, {_resolved(meta)} AS redirect FROM raw),
told AS (SELECT node AS a, {_address("canonical")} AS b FROM seen
  UNION SELECT node, {_address("redirect")} FROM seen),
ends AS (SELECT a AS node FROM told WHERE a IS NOT NULL UNION SELECT b FROM told WHERE a IS NOT NULL AND b IS NOT NULL),
edges AS (SELECT a, b FROM told WHERE a IS NOT NULL AND b IS NOT NULL
  UNION SELECT node, {_normal("node")} FROM ends),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT a, b FROM both_ways
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
named AS (SELECT a AS node, min(b) AS alias_group FROM reach GROUP BY a),
nodes AS (SELECT node, host, path FROM seen
  UNION SELECT node, {_host("'://' || node")}, {_path("'://' || node")} FROM named),
ruled AS (SELECT host, path, arg_max(rule, (length(rule), verdict = 'allow')) AS rule,
    arg_max(verdict, (length(rule), verdict = 'allow')) AS verdict
  FROM (SELECT DISTINCT n.host, n.path, r.host || r.path AS rule, r.verdict FROM nodes n JOIN rules r ON {fits})
  GROUP BY host, path),
shared AS (SELECT alias_group, max(CASE ruled.verdict WHEN 'allow' THEN 1 ELSE 0 END) AS open
  FROM named JOIN nodes USING (node) JOIN ruled USING (host, path) GROUP BY alias_group)
SELECT seen.page_id, seen.host, seen.path, ruled.rule,
  coalesce(ruled.verdict, CASE shared.open WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict,
  coalesce(named.alias_group, seen.node) AS alias_group
FROM seen LEFT JOIN ruled USING (host, path) LEFT JOIN named USING (node) LEFT JOIN shared USING (alias_group)
"""


def _search() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}'))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
held AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, {terms} AS term FROM docs) GROUP BY doc, term),
sizes AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc),
whole AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, whole GROUP BY term),
impacts AS (SELECT doc, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * documents) // total))) AS impact
  FROM held JOIN sizes USING (doc) JOIN weights USING (term), whole),
asked AS (SELECT item, item_id, term, count(*) AS times
  FROM (SELECT item, item_id, {terms} AS term FROM (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, text FROM benchmark)))
  GROUP BY item, item_id, term),
scores AS (SELECT item, item_id, doc, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item, item_id, doc)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores JOIN docs USING (doc) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_urls": _urls(), "op13_search": _search()}
