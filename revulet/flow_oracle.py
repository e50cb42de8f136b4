"""DuckDB SQL for the queries of flow_queries.py, by the names of oracle.py's CTEs."""

from __future__ import annotations

from .fixtures import READINGS, TEMPLATES
from . import flow_queries as flow
from .functions import fixed
from .operators.gates import LABELS
from .sources import demo
from .oracle import _clean, _FIRST, APP, CTES as BASE, NEWEST, QUERIES as BASE_QUERIES, MINIMUM, SCORE, THEMES, _col, _found, _iso, _list, _q, _rnd, _trend


def _case(c: str, a: str, b: str) -> str:
    return f"(CASE WHEN {c} THEN {a} ELSE {b} END)"


def _over(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 1::DOUBLE ELSE ({a})::DOUBLE / nullif({b}, 0) END)"


def _gate_rows() -> str:
    rows = []
    for benchmark, scopes in fixed.EVALUATION_POLICIES.items():
        for scope, names in scopes.items():
            for name, least in names.items():
                language, label = (_q(name) if scope == s else "NULL" for s in ("language", "label"))
                rows += [f"({_q(benchmark)}, {_q(scope)}, {language}, {label}, {_q(metric)}, {value}::DOUBLE)" for metric, value in least.items()]
    return ", ".join(rows)


_TAGS = ", ".join(f"({_q(t)}, {_q(theme)}, {_q(link)}, {_q(scope)})" for (t, theme), (link, scope) in zip(TEMPLATES, READINGS))
_SAID = {
    "theme": (_found("", [(t, f"len(h.{_col(t)}) > 0") for t in THEMES]), "CASE WHEN i % 50 = 17 THEN ['weather'] WHEN t.theme = '' THEN []::VARCHAR[] ELSE [t.theme] END"),
    "release-link": ("[l.kind]", "[t.link]"),
    "actionability": ("[s.scope]", "[t.scope]"),
}
_P, _R = _over("tp", "tp + fp"), _over("tp", "tp + fn")

CTES = {
    "labelled": " UNION ALL ".join(
        f"""SELECT {_q(b)} AS benchmark, review_id, i, coalesce(h.language, 'unknown') AS language, {said} AS predicted, {expected} AS expected,
      CASE WHEN i % 50 = 23 THEN 'not-json' WHEN i % 50 = 11 THEN 'no-text' WHEN len(list_filter({expected}, lambda x: NOT list_contains({_list(LABELS[b])}, x))) > 0 THEN 'unknown-label' END AS problem
    FROM (SELECT *, review_id::BIGINT AS i FROM hits) h JOIN links l USING ({APP}, review_id) JOIN scopes s USING ({APP}, review_id)
    JOIN (VALUES {_TAGS}) t(sentence, theme, link, scope) ON starts_with(h.body, t.sentence || '. ')"""
        for b, (said, expected) in _SAID.items()
    ),
    "good": "SELECT * FROM labelled WHERE problem IS NULL",
    "label_names": "SELECT * FROM (VALUES " + ", ".join(f"({_q(b)}, {_q(x)})" for b, every in LABELS.items() for x in every) + ") n(benchmark, label)",
    "cells": """SELECT benchmark, language, label, count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM (
      SELECT g.benchmark, language, label, list_contains(predicted, label) AS p, list_contains(expected, label) AS e FROM good g JOIN label_names n ON n.benchmark = g.benchmark) GROUP BY ALL""",
    "example_counts": "SELECT benchmark, language, count(*) AS examples, count(DISTINCT language) AS languages, count(*) FILTER (list_sort(predicted) = list_sort(expected)) AS same FROM good GROUP BY GROUPING SETS ((benchmark, language), (benchmark))",
    "cell_sums": "SELECT benchmark, language, label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cells GROUP BY GROUPING SETS ((benchmark, language), (benchmark), (benchmark, label))",
    "measures": f"""SELECT *, {_P} AS p, {_R} AS r FROM (
      SELECT benchmark, CASE WHEN c.language IS NULL THEN 'overall' ELSE 'language' END AS scope, c.language, NULL::VARCHAR AS label, examples, languages, same, tp, fp, fn
      FROM example_counts c JOIN (SELECT * FROM cell_sums WHERE label IS NULL) s USING (benchmark) WHERE c.language IS NOT DISTINCT FROM s.language
      UNION ALL SELECT benchmark, 'label', NULL, label, tp + fn, NULL, NULL, tp, fp, fn FROM cell_sums WHERE label IS NOT NULL)""",
    "metric_rows": f"""SELECT benchmark, scope, language, label, metric, value FROM (
      SELECT benchmark, scope, language, label, unnest(['examples', 'languages', 'precision', 'recall', 'f1', 'exact']) AS metric,
        unnest([examples::DOUBLE, languages::DOUBLE, {_rnd("p", 3, False)}, {_rnd("r", 3, False)}, {_rnd("CASE WHEN p + r = 0 THEN 1 ELSE 2 * p * r / (p + r) END", 3, False)}, {_rnd("same::DOUBLE / examples", 3, False)}]) AS value
      FROM measures) WHERE value IS NOT NULL""",
    "gate_rows": f"SELECT * FROM (VALUES {_gate_rows()}) g(benchmark, scope, language, label, metric, least)",
    "checked": """SELECT g.benchmark, g.scope, coalesce(m.language, g.language) AS language, coalesce(m.label, g.label) AS label, g.metric, g.least, m.value, coalesce(m.value >= g.least, FALSE) AS passed
      FROM gate_rows g LEFT JOIN metric_rows m ON m.benchmark = g.benchmark AND m.scope = g.scope AND m.metric = g.metric AND (g.language = '*' OR g.language IS NOT DISTINCT FROM m.language) AND (g.label = '*' OR g.label IS NOT DISTINCT FROM m.label)""",
}

QUERIES = {
    "labelled_problems": "SELECT benchmark, problem, count(*) AS lines, min(CASE WHEN problem <> 'not-json' THEN review_id END) AS first_id FROM labelled WHERE problem IS NOT NULL GROUP BY ALL",
    "evaluation_metrics": "SELECT * FROM metric_rows",
    "evaluation_gates": "SELECT * FROM checked",
    "evaluation_status": "SELECT benchmark, count(*) AS gates, count(*) FILTER (NOT passed) AS failed, CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'fail' ELSE 'pass' END AS status FROM checked GROUP BY benchmark",
}


# --- cohorts: the gate's CTEs over reviews whose application is the case -------------------------------

_FRONT = f"CASE WHEN (d // 6) % 2 = 0 THEN {_q(flow.FRONTS[0][0])} ELSE {_q(flow.FRONTS[1][0])} END"
_ANY = " OR ".join(f"len({_col(t)}) > 0" for t in THEMES)
_SCOPES = [s.replace("-", "_") for s in fixed.SCOPES]
_ROWS = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"

COHORT = {
    "raw_base": BASE["raw"],
    "raw": f"SELECT * FROM (SELECT * REPLACE (app_id || '-' || source || '-' || {_FRONT} AS app_id) FROM raw_base) WHERE app_id NOT IN ({_q(flow.DOWN)}, {_q(flow.BROKEN)})",
    "cases": f"""SELECT a || '-' || s || '-' || f AS slug, a AS app_slug, 'App ' || n AS name, 'test' AS category, s AS store, f AS storefront, c AS country, l AS language, u || n AS url
    FROM (SELECT DISTINCT 'app-' || (doc_id % 3) AS a, (doc_id % 3)::VARCHAR AS n FROM documents UNION ALL SELECT {_q(flow.SILENT)}, '99') x, {_ROWS(flow.STORES.items())} y(s, u), {_ROWS(flow.FRONTS)} z(f, c, l)""",
    "covered": f"SELECT r.app_id, count(*) AS complaints, count(*) FILTER ({_ANY}) AS matched FROM ready r JOIN hits h ON h.source = r.source AND h.app_id = r.app_id AND h.app_version = r.current_version AND h.rating <= 3 GROUP BY r.app_id",
    "own_scopes": f"SELECT r.app_id, {', '.join(f'sum(s.count) FILTER (s.scope = {_q(s)})::BIGINT AS {n}' for s, n in zip(fixed.SCOPES, _SCOPES))} FROM ready r JOIN scope_counts s ON s.app_id = r.app_id AND s.app_version = r.current_version GROUP BY r.app_id",
    "own_issues": f"""SELECT k.app_id, string_agg(k.id || ':' || k.count || ':' || k.supported, ',' ORDER BY k.id || ':' || k.count || ':' || k.supported) AS actionable,
      coalesce(string_agg(k.id, ',' ORDER BY k.id) FILTER (k.supported), '') AS supported FROM actionable k JOIN ready r ON r.app_id = k.app_id AND r.current_version = k.app_version GROUP BY k.app_id""",
    "own_violations": "SELECT app_id, string_agg(id || ':' || severity, ',' ORDER BY id || ':' || severity) AS violations FROM all_violations GROUP BY app_id",
    "case_results": f"""SELECT c.slug, c.app_slug, c.store, c.storefront, coalesce(v.status, 'error') AS status,
      CASE WHEN v.status IS NULL THEN CASE c.slug WHEN {_q(flow.DOWN)} THEN 'The store answered 503' WHEN {_q(flow.BROKEN)} THEN 'The answer can''t be read' ELSE 'The sources returned no reviews' END END AS message,
      CASE WHEN v.status IS NOT NULL THEN 200 WHEN c.slug = {_q(flow.DOWN)} THEN 503 ELSE 502 END AS http_status, v.status IS NULL AND c.slug <> {_q(flow.BROKEN)} AS retryable,
      coalesce(a.total, 0) AS fetched_reviews, r.current_version, r.baseline_version, coalesce(r.current_count, 0) AS current_reviews, r.reason,
      CASE WHEN v.status IS NOT NULL THEN greatest(0, {MINIMUM} - coalesce(r.current_count, 0)) ELSE 0 END AS current_missing, CASE WHEN v.status IS NOT NULL THEN greatest(0, {MINIMUM} - coalesce(r.baseline_count, r.candidate_count, 0)) ELSE 0 END AS baseline_missing,
      v.rating_drop, v.negative_share_increase, l.level AS link_level, coalesce(l.linked_count, 0) AS linked_count, coalesce(w.software, 0) AS software_count, coalesce(w.unclear, 0) AS unclear_count, {", ".join(f"w.{n} AS scope_{n}" for n in _SCOPES)},
      coalesce(v.decision, 'observe') AS decision, CASE WHEN v.status = 'fail' THEN coalesce(i.supported, '') ELSE '' END AS issue_ids, coalesce(i.actionable, '') AS actionable, coalesce(m.complaints, 0) AS complaints, coalesce(m.matched, 0) AS matched,
      CASE WHEN m.complaints > 0 THEN {_rnd("m.matched::DOUBLE / nullif(m.complaints, 0)", 3, False)} END AS rate, coalesce(x.violations, '') AS violations
    FROM cases c LEFT JOIN all_verdicts v ON v.app_id = c.slug LEFT JOIN ready r ON r.app_id = c.slug LEFT JOIN anchors a ON a.app_id = c.slug LEFT JOIN link_levels l ON l.app_id = c.slug AND l.app_version = r.current_version
    LEFT JOIN own_scopes w ON w.app_id = c.slug LEFT JOIN own_issues i ON i.app_id = c.slug LEFT JOIN covered m ON m.app_id = c.slug LEFT JOIN own_violations x ON x.app_id = c.slug""",
}
_N = lambda c: f"count(*) FILTER ({c})"
_DONE = "status <> 'error'"
_LEVEL = "coalesce(link_level, 'unknown')"
_COUNTS = ", ".join(
    [f"{_N(f'status = {_q(s)}')} AS {n}" for s, n in (("pass", "passed"), ("fail", "failed"), ("insufficient-data", "insufficient"), ("error", "errors"))]
    + [f"{_N(f'{_DONE} AND {_LEVEL} = {_q(x)}')} AS link_{x}" for x in ("supported", "limited", "none", "unknown")]
    + [f"coalesce(sum(scope_{n}) FILTER ({_DONE}), 0)::BIGINT AS scope_{n}" for n in _SCOPES]
    + [f"{_N(f'{_DONE} AND decision = {_q(x)}')} AS triage_{x.replace('-', '_')}" for x in ("software-regression", "manual-review", "observe")]
)
_DROP = ", ".join(["reason", *(f"scope_{n}" for n in _SCOPES)])
_REASON = "CASE reason WHEN 'partial-source' THEN 'source' WHEN 'current-too-small' THEN 'current' WHEN 'baseline-too-small' THEN 'baseline' WHEN 'no-baseline' THEN 'baseline' ELSE 'unavailable' END"

COHORT_QUERIES = {
    "manifest_cases": "SELECT * FROM cases",
    "cohort_results": f"SELECT * EXCLUDE ({_DROP}) FROM case_results",
    "cohort_roll_up": f"""SELECT *, total - errors AS completed, passed + failed AS decidable, CASE WHEN total - errors > 0 THEN {_rnd("(passed + failed)::DOUBLE / nullif(total - errors, 0)", 3, False)} ELSE 0 END AS decidable_rate,
      CASE WHEN complaints > 0 THEN {_rnd("matched::DOUBLE / nullif(complaints, 0)", 3, False)} END AS coverage_rate FROM (
      SELECT CASE WHEN store IS NOT NULL THEN 'store' WHEN storefront IS NOT NULL THEN 'storefront' ELSE 'all' END AS level, coalesce(store, storefront, 'all') AS name, count(*) AS total, {_COUNTS}, sum(complaints)::BIGINT AS complaints, sum(matched)::BIGINT AS matched
      FROM case_results GROUP BY GROUPING SETS ((store), (storefront), ()))""",
    "cohort_violation_ranks": "SELECT id, cases, row_number() OVER (ORDER BY cases DESC, id)::INTEGER AS rank FROM (SELECT id, count(*) AS cases FROM all_violations GROUP BY id)",
    "cohort_reasons": f"SELECT reason, coalesce(n, 0) AS cases FROM (VALUES ('current'), ('baseline'), ('unavailable'), ('source')) t(reason) LEFT JOIN (SELECT {_REASON} AS reason, count(*) AS n FROM case_results WHERE status = 'insufficient-data' GROUP BY 1) USING (reason)",
}

_GOOGLE, _APPLE = _q(flow.STORES["google-play"]), _q(flow.STORES["apple-app-store"])
_SLUG = "CASE WHEN page_id % 7 = 2 THEN 'Page ' ELSE 'page-' END || page_id"
QUERIES["manifest_problems"] = f"""SELECT rule, subject, count(*) AS n FROM (
  SELECT 'schema-version' AS rule, NULL AS subject FROM pages WHERE page_id % 5 = 4
  UNION ALL SELECT 'limit', '10' FROM pages WHERE page_id % 6 = 5
  UNION ALL SELECT 'too-few-storefronts', '1' FROM pages WHERE page_id % 8 = 7
  UNION ALL SELECT 'slug', {_SLUG} FROM pages WHERE page_id % 7 = 2
  UNION ALL SELECT 'no-name', {_SLUG} FROM pages WHERE page_id % 9 = 3
  UNION ALL SELECT 'repeated-slug', slug FROM (SELECT {_SLUG} AS slug FROM pages) GROUP BY slug HAVING count(*) > 1
  UNION ALL SELECT 'store', {_SLUG} FROM pages WHERE page_id % 4 = 1 AND NOT regexp_matches(url, '^https?://play[.]google[.]com/store/apps/details[?](.*&)?id=[^&#]')
  UNION ALL SELECT 'expected-cases', CASE WHEN page_id % 8 = 7 THEN '2' ELSE '4' END FROM pages WHERE page_id % 10 = 9) GROUP BY ALL"""


# --- fingerprints and embedded reviews ----------------------------------------------------------------

_STRING = lambda x: f"coalesce(to_json({x}::VARCHAR)::VARCHAR, 'null')"
_NUMBER = lambda x: f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::DOUBLE::VARCHAR END"
_REPLY = f"""CASE WHEN d % 5 = 0 THEN '{{"body":' || {_STRING("'Thanks ' || chr(34) || d || chr(34)")} || ',"createdAt":' || CASE WHEN d % 10 = 0 THEN '"2024-03-31T00:00:00.000Z"' ELSE 'null' END || '}}' ELSE 'null' END"""
_FIELDS = [
    ("appId", _STRING("app_id")), ("appVersion", _STRING("app_version")), ("author", _STRING("author")), ("body", _STRING("body")), ("country", _STRING("country")), ("createdAt", _STRING(_iso("created_ms"))),
    ("helpfulCount", _NUMBER("(helpful_count + CASE WHEN d % 6 = 5 THEN 0.1::DOUBLE ELSE 0 END)")), ("language", _STRING("language")), ("rating", _NUMBER("greatest(1, least(5, rating - CASE WHEN d % 4 = 1 THEN 0.25::DOUBLE ELSE 0 END))")),
    ("reply", _REPLY), ("reviewId", _STRING("review_id")), ("source", _STRING("source")), ("sourceUrl", "'null'"), ("title", _STRING("title")), ("updatedAt", _STRING(_iso("updated_ms"))),
]
_RECORD = "'{' || " + " || ',' || ".join(f"{_q(chr(34) + name + chr(34) + ':')} || {value}" for name, value in _FIELDS) + " || '}'"
CTES["records"] = f"SELECT {APP}, created_ms, position, {_RECORD} AS json FROM dedup"
QUERIES["dataset_hashes"] = f"""SELECT source, app_id, review_count, content_hash, tree_hash FROM (
  SELECT {APP}, count(*) AS review_count, CASE WHEN count(*) <= 2000 THEN sha256('[' || string_agg(json, ',' ORDER BY created_ms DESC, position) || ']') END AS content_hash FROM records GROUP BY ALL)
  JOIN (SELECT {APP}, sha256(string_agg(part, ',' ORDER BY hour DESC)) AS tree_hash FROM (
    SELECT {APP}, created_ms // 3600000 AS hour, sha256(string_agg(sha256(json), ',' ORDER BY created_ms DESC, position)) AS part FROM records GROUP BY ALL) GROUP BY {APP}) USING ({APP})"""

_HEAD = """'{"$kind":"Review","id":"' || doc_id || '","title":"t","rating":' || (1 + doc_id % 6) || ',"reviewerName":"user ' || (doc_id % 17) || '","date":"2024-03-01T00:00:00Z"'"""
_WRAP = lambda one, n: f"repeat('{{\"a\":[', ({n})::BIGINT) || {one} || '}}' || repeat(']}}', ({n})::BIGINT)"
_OWN = _HEAD + """ || CASE WHEN doc_id % 10 = 9 THEN '' ELSE ',"contents":' || to_json(text)::VARCHAR END"""
CTES["page_texts"] = f"""SELECT doc_id // 5 AS page, '[' || string_agg({_WRAP(_OWN, "doc_id % 4")} || ',' || {_WRAP(_HEAD + " || ',\"contents\":\"later\"'", "doc_id % 4 + 1 + doc_id % 2")}, ',' ORDER BY doc_id) || ']' AS data FROM documents WHERE text IS NOT NULL GROUP BY 1"""
CTES["page_rows"] = "SELECT page, page % 20 = 5 AS none, page % 20 = 3 AS bad, replace(data, '</', '<_') AS data FROM page_texts"
CTES["page_nodes"] = """SELECT page, j.id, length(regexp_replace(j.fullkey, '[^.\\[]', '', 'g')) AS depth, j.value AS node FROM (SELECT * FROM page_rows WHERE NOT none AND NOT bad) p, json_tree(p.data) j
  WHERE j.type = 'OBJECT' AND json_extract_string(j.value, '$."$kind"') = 'Review'"""
CTES["page_reviews"] = """SELECT *, row_number() OVER (PARTITION BY page ORDER BY depth, id) AS rank FROM (
  SELECT page, id, depth, json_extract_string(node, '$.id') AS review_id, trim(json_extract_string(node, '$.contents')) AS body, json_extract_string(node, '$.rating')::DOUBLE AS rating, json_extract_string(node, '$.reviewerName') AS author, json_extract_string(node, '$.date') AS created_at FROM page_nodes)
  WHERE body <> '' AND rating BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY page, review_id ORDER BY depth, id) = 1"""
QUERIES["embedded_reviews"] = "SELECT page, rank::INTEGER AS rank, review_id, rating, author, created_at, depth::INTEGER AS depth, md5(body) AS body_md5 FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY page ORDER BY depth, id) AS rank FROM page_reviews) WHERE rank <= 3"
QUERIES["embedded_page_status"] = """SELECT page, CASE WHEN none THEN 'no-data' WHEN bad THEN 'invalid-data' WHEN n IS NULL THEN 'no-reviews' ELSE 'ok' END AS status, none OR bad OR n IS NULL AS retryable, coalesce(n, 0) AS reviews
  FROM page_rows LEFT JOIN (SELECT page, least(count(*), 10) AS n FROM page_reviews GROUP BY page) USING (page)"""


# --- the feed -----------------------------------------------------------------------------------------

_PAGE_2 = lambda app: f"page = 2 AND app_id = {_q(app)}"
_NONE = " OR ".join(f"({_PAGE_2(app)})" for app in (flow.HOLE, flow.CLOSED, flow.TORN))
CTES["feed_entries"] = "SELECT (doc_id % 6)::VARCHAR AS app_id, (doc_id // 6 // 50 + 1)::INTEGER AS page, doc_id, text, row_number() OVER (PARTITION BY doc_id % 6, doc_id // 6 // 50 ORDER BY doc_id) - 1 AS place, doc_id % 20 <> 7 AND text <> '' AS fine FROM documents"
CTES["feed_log"] = f"""SELECT app_id, page, CASE WHEN {_NONE} THEN 0 ELSE n END AS entries, CASE WHEN {_NONE} THEN 0 ELSE k END AS kept, CASE WHEN {_PAGE_2(flow.SLOW)} OR {_PAGE_2(flow.HOLE)} THEN 3 ELSE 1 END AS attempts,
  CASE WHEN {_PAGE_2(flow.CLOSED)} THEN 403 WHEN {_PAGE_2(flow.TORN)} THEN 502 ELSE 200 END AS status, FALSE AS retryable, CASE WHEN {_PAGE_2(flow.CLOSED)} THEN 'apple-app-store answered 403.' WHEN {_PAGE_2(flow.TORN)} THEN 'The feed''s answer is no JSON.' END AS error
  FROM (SELECT app_id, page, count(*) AS n, count(*) FILTER (fine) AS k FROM feed_entries GROUP BY ALL)"""
CTES["feed_stops"] = """SELECT app_id, page, reason, total FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed-page' WHEN entries = 0 THEN CASE WHEN total > 0 THEN 'empty-page' ELSE 'empty-feed' END WHEN entries < 50 THEN 'end-of-feed' END AS reason
  FROM (SELECT *, sum(kept) OVER (PARTITION BY app_id ORDER BY page) AS total FROM feed_log))"""
CTES["feed_ends"] = "SELECT app_id, min(page) FILTER (reason IS NOT NULL) AS stop_page, arg_min(reason, page) FILTER (reason IS NOT NULL) AS stop_reason FROM feed_stops GROUP BY app_id"
QUERIES["feed_pages"] = "SELECT * FROM feed_log"
QUERIES["feed_completeness"] = """SELECT 'apple-app-store' AS source, app_id, stop_page, stop_reason, coalesce(stop_reason <> 'end-of-feed', TRUE) AS partial_results, count(*) FILTER (l.entries > 0) AS pages_fetched, max(s.total)::BIGINT AS returned_reviews
  FROM feed_ends JOIN feed_stops s USING (app_id) JOIN feed_log l USING (app_id, page) WHERE stop_page IS NULL OR page <= stop_page GROUP BY ALL"""
QUERIES["feed_reviews"] = f"""SELECT app_id, page, place::INTEGER AS place, doc_id::VARCHAR AS review_id, (doc_id % 5 + 1)::VARCHAR AS rating, 'user ' || (doc_id % 17) AS author, '2024-03-01T00:00:00Z' AS created_at, md5(text) AS body_md5
  FROM feed_entries JOIN feed_ends USING (app_id) WHERE fine AND NOT ({_NONE}) AND (stop_page IS NULL OR page <= stop_page)"""
QUERIES["feed_apps"] = f"SELECT DISTINCT 'apple-app-store' AS source, app_id, CASE WHEN app_id = {_q(flow.HOLE)} THEN 'App ' ELSE 'Name ' END || app_id AS name, 'Maker' AS developer FROM feed_entries"

QUERIES["stream_newest_reviews"] = BASE_QUERIES["dedupe_latest"]

# --- counts by day, findings, comparison --------------------------------------------------------------

_M = 2_592_000_000
CTES["as_of"] = f"SELECT {APP}, anchor - k::BIGINT * 630720000 AS anchor FROM anchors, (VALUES (0), (1), (2), (3), (4)) t(k)"
CTES["as_of_counts"] = f"""SELECT {APP}, anchor, theme, count(*) AS count, count(*) FILTER (age <= {_M}) AS recent_count, count(*) FILTER (age > {_M} AND age <= 2 * {_M}) AS previous_count,
  count(*) FILTER (age <= {_M} AND c) AS recent_complaint_count, count(*) FILTER (age > {_M} AND age <= 2 * {_M} AND c) AS previous_complaint_count
  FROM (SELECT {APP}, anchor, theme, anchor - created_ms AS age, rating <= 3 AND NOT only_asked AS c FROM mentions JOIN as_of USING ({APP})) WHERE age >= 0 GROUP BY ALL"""
QUERIES["trend_as_of"] = f"SELECT *, {_trend('recent_count', 'previous_count')} AS trend_percent, {_trend('recent_complaint_count', 'previous_complaint_count')} AS complaint_trend_percent FROM as_of_counts"
QUERIES["timeline_from_days"] = BASE_QUERIES["timeline_monthly"]
QUERIES["theme_order"] = f"SELECT {APP}, theme, priority_score, row_number() OVER (PARTITION BY {APP} ORDER BY priority_score DESC, count DESC, ordinal)::INTEGER AS rank FROM themes"
_PROBLEM = "WHERE intent = 'problem' AND"
CTES["problem_finds"] = f"""SELECT {APP}, 'trend-' || theme AS id, 'emerging' AS kind, theme AS subject FROM (SELECT * FROM themes {_PROBLEM} recent_complaint_count >= 2 AND complaint_trend_percent > 20 QUALIFY {_FIRST})
  UNION ALL SELECT {APP}, 'pain-' || theme, 'pain', theme FROM (SELECT * FROM themes {_PROBLEM} negative_count >= 2 QUALIFY {_FIRST})"""
CTES["request_finds"] = f"SELECT {APP}, 'feature-demand' AS id, 'opportunity' AS kind, theme AS subject FROM (SELECT * FROM themes WHERE intent = 'request' AND count >= 2 QUALIFY {_FIRST})"
CTES["version_finds"] = f"SELECT {APP}, 'version-' || app_version AS id, 'regression' AS kind, app_version AS subject FROM (SELECT * FROM versions WHERE rank <= 12 AND count >= 3 AND average_rating <= 2.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY {APP} ORDER BY rank) = 1)"
CTES["other_finds"] = f"SELECT {APP} FROM problem_finds UNION SELECT {APP} FROM request_finds UNION SELECT {APP} FROM version_finds"
_CITED = lambda finds, rows, on, order, most: f"SELECT source, app_id, id, kind, review_id, row_number() OVER (PARTITION BY source, app_id, id ORDER BY {order}) AS rank FROM {finds} f JOIN {rows} r USING (source, app_id) WHERE {on} QUALIFY rank <= {most}"
QUERIES["insight_evidence"] = f"""SELECT source, app_id, id, kind, review_id, rank::INTEGER AS rank FROM (
  {_CITED("problem_finds", "mentions", "r.theme = f.subject AND rating <= 3 AND NOT only_asked", f"{SCORE} DESC, {NEWEST}", 4)}
  UNION ALL {_CITED("request_finds", "mentions", "r.theme = f.subject", f"{SCORE} DESC, {NEWEST}", 4)}
  UNION ALL {_CITED("version_finds", "reviews", "r.app_version = f.subject AND rating <= 2", NEWEST, 3)}
  UNION ALL SELECT source, app_id, 'baseline', 'baseline', review_id, row_number() OVER (PARTITION BY source, app_id ORDER BY {NEWEST}) AS rank FROM reviews ANTI JOIN other_finds USING (source, app_id) QUALIFY rank <= 3)"""
CTES["all_pairs"] = f"SELECT DISTINCT {APP}, source AS other_source, 'app-' || ((right(app_id, 1)::INT + 1) % 3) AS other_app_id FROM themes"
CTES["all_gaps0"] = """SELECT p.*, g.ordinal, g.theme, coalesce(a.count, 0) AS primary_count, coalesce(a.share, 0) AS primary_share, coalesce(b.count, 0) AS competitor_count, coalesce(b.share, 0) AS competitor_share
  FROM all_pairs p CROSS JOIN (SELECT DISTINCT ordinal, theme FROM themes) g LEFT JOIN themes a ON a.source = p.source AND a.app_id = p.app_id AND a.theme = g.theme LEFT JOIN themes b ON b.source = p.other_source AND b.app_id = p.other_app_id AND b.theme = g.theme WHERE a.theme IS NOT NULL OR b.theme IS NOT NULL"""
CTES["all_gaps"] = f"SELECT *, {_rnd('competitor_share - primary_share', 3)} AS share_gap FROM all_gaps0"
QUERIES["comparison_opportunities_all"] = """SELECT * EXCLUDE (ordinal, theme, r), 'competitor-' || theme AS id, r::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, app_id ORDER BY abs(share_gap) DESC, ordinal) AS r FROM all_gaps WHERE competitor_count >= 2 AND share_gap >= 0.03::DOUBLE) WHERE r <= 4"""


# --- the demo set, once for every 96 documents --------------------------------------------------------

_TEXT = f"{_list(t for _, t in demo.ROWS)}[i % {len(demo.ROWS)} + 1]"
_STARS = f"[{', '.join(str(r) for r, _ in demo.ROWS)}][i % {len(demo.ROWS)} + 1]"
_CRASH, _CAMERA = "i < 36 AND i % 3 = 0", "i < 36 AND i % 7 = 2 AND i % 3 <> 0"
DEMO = {
    "raw": f"""SELECT i AS d, 0 AS again, {_q(demo.APP["source"])} AS source, app_id, 'demo-' || (i + 1) AS review_id, CASE WHEN i % 12 = 8 THEN 'A thoughtful update' ELSE '' END AS title,
      CASE WHEN {_CAMERA} THEN {_q(demo.CAMERA)} WHEN {_CRASH} THEN {_q(demo.CRASH)} || {_TEXT} ELSE {_TEXT} END AS body, 'en' AS language, ['US', 'GB', 'CA', 'AU'][i % 4 + 1] AS country, 'Sample user ' || (i + 1) AS author,
      (i * 7 % 43)::DOUBLE AS helpful_count, CASE WHEN i < 36 THEN '4.8.0' WHEN i < 68 THEN '4.7.2' ELSE '4.6.9' END AS app_version, {demo.ANCHOR_MS} - i * 155520000 AS created_ms, {demo.ANCHOR_MS} - i * 155520000 AS updated_ms, i AS ordinal,
      CASE WHEN {_CAMERA} OR {_CRASH} THEN 1 WHEN i >= 36 AND i < 68 THEN least(5, {_STARS} + 1) ELSE {_STARS} END::DOUBLE AS rating
    FROM (SELECT 'com.demo.pulse-' || (doc_id // 96) AS app_id, doc_id % 96 AS i FROM documents)""",
    "norm": f"SELECT * EXCLUDE (body), {_clean('body')} AS body FROM raw",
}
DEMO_QUERIES = {"demo_versions": BASE_QUERIES["version_summary"], "demo_verdict": BASE_QUERIES["regression_verdict"]}


# --- the CSV file -------------------------------------------------------------------------------------

_CELL = lambda x: f"(CASE WHEN left({x}, 1) IN ('=', '+', '-', '@') THEN '''' || {x} ELSE {x} END)"
_PLAIN = lambda x: f"regexp_replace({x}::VARCHAR, '[.]0$', '')"
_CELLS = ["source", "app_id", "review_id", _iso("created_ms"), _PLAIN("rating"), "title", "body", "language", "country", "app_version", "author", _PLAIN("helpful_count")]
_LINE = " || ',' || ".join("chr(34) || replace(" + _CELL(f"coalesce({c}, '')") + ", chr(34), chr(34) || chr(34)) || chr(34)" for c in _CELLS)
QUERIES["csv_file_lines"] = f"""SELECT {_LINE} AS line FROM reviews UNION ALL
  SELECT '"source","appId","reviewId","createdAt","rating","title","body","language","country","appVersion","author","helpfulCount"'"""
