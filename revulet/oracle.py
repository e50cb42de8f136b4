"""DuckDB SQL with the same rows as the registered queries, for those that SQL can express.

The SQL is made of one WITH list: records, reviews, words found, themes and so on; each query reads what it needs.
"""

from __future__ import annotations

import re

from .fixtures import ANCHOR, STEP, TEMPLATES
from .functions import fixed
from .functions.text import word_pattern

LETTER = "a-zà-öø-ÿ"
WHITE = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
APP = "source, app_id"
MINIMUM = 5


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _rnd(x: str, digits: int = 0, epsilon: bool = True) -> str:
    power = f"{10**digits}::DOUBLE"
    more = " + 2.220446049250313e-16::DOUBLE" if epsilon else ""
    return f"(floor((({x})::DOUBLE{more}) * {power} + 0.5::DOUBLE) / {power})"


def _share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0::DOUBLE ELSE {_rnd(f'({a})::DOUBLE / nullif({b}, 0)', 3)} END)"


def _trend(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN (CASE WHEN {a} > 0 THEN 100 ELSE 0 END) ELSE {_rnd(f'({a} - {b})::DOUBLE / nullif({b}, 0) * 100')} END)::BIGINT"


def _found(text: str, tests: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN {_q(name)} END" for name, test in tests)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _word(word: str) -> str:
    pattern = word_pattern(word)
    return f"contains(h, {_q(word)})" if pattern is None else f"regexp_matches(h, {_q(pattern.replace(chr(92) + 's', WHITE))})"


def _rules(rules) -> str:
    return _found("p", [(i, f"regexp_matches(p, {_q(pattern.replace(chr(92) + 's', WHITE))}, 'i')") for i, pattern in rules])


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g'))"


def _iso(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


THEMES = list(fixed.THEMES)
REQUESTS = [t for t, (_, intent, _) in fixed.THEMES.items() if intent == "request"]
SCORE = "((6 - rating) * 10 + least(helpful_count, 50) + created_ms / 1e12::DOUBLE)"
NEWEST = "created_ms DESC, position"
KEYWORD = r"[a-z][a-z''-]{2,}|[\x{4e00}-\x{9fff}]{2,6}"


def _col(theme: str) -> str:
    return '"' + theme + '"'


def _only(theme: str) -> str:
    allowed = {"sync": fixed.REQUESTABLE_SYNC, "notifications": fixed.REQUESTABLE_NOTIFICATIONS}.get(theme)
    return "FALSE" if allowed is None else f"(asks AND len({_col(theme)}) > 0 AND len(list_filter({_col(theme)}, lambda x: NOT list_contains({_list(allowed)}, x))) = 0)"


def _mentions() -> str:
    parts = [
        f"SELECT {APP}, review_id, title, body, rating, language, country, app_version, author, helpful_count, created_ms, position, {i} AS ordinal, {_q(t)} AS theme, {_q(fixed.THEMES[t][1])} AS intent, {_col(t)} AS hits, {_only(t)} AS only_asked FROM hits WHERE len({_col(t)}) > 0"
        for i, t in enumerate(THEMES)
    ]
    return " UNION ALL ".join(parts)


def _usable(theme: str) -> str:
    c = _col(theme)
    left = lambda words: f"len(list_filter({c}, lambda x: NOT list_contains({_list(words)}, x))) > 0"
    if theme == "account":
        return left(fixed.AMBIGUOUS_ACCOUNT)
    if theme in ("sync", "notifications"):
        return f"CASE WHEN asks THEN {left(fixed.REQUESTABLE_SYNC if theme == 'sync' else fixed.REQUESTABLE_NOTIFICATIONS)} ELSE len({c}) > 0 END"
    return f"len({c}) > 0"


SOFTWARE = ("stability", "performance", "account", "sync", "notifications")
POLICY = ("pricing", "usability", "privacy")

_index = "(d * 5 + d // 24 + CASE WHEN again = 1 THEN 3 ELSE 0 END) % 16"
CTES = {
    "raw": f"""SELECT d, again,
      CASE WHEN d % 2 = 0 THEN 'google-play' ELSE 'apple-app-store' END AS source, 'app-' || (d % 3) AS app_id, d::VARCHAR AS review_id, '' AS title,
      {_list(t for t, _ in TEMPLATES)}[({_index}) + 1] || '. ' || text AS body, lang AS language,
      ['US', 'GB', 'CA', NULL][d % 4 + 1] AS country, 'user ' || (d % 17) AS author, (d * 7 % 43)::DOUBLE AS helpful_count,
      CASE WHEN d % 3 = 2 AND d < 30 THEN '5.0.0' ELSE ['4.10.0', '4.8.0', '4.7.2', NULL][(d // 6) % 4 + 1] END AS app_version,
      ({ANCHOR} - d * 5400) * 1000 AS created_ms, ({ANCHOR} - d * 5400 + CASE WHEN again = 1 THEN 86400 ELSE 0 END) * 1000 AS updated_ms,
      d + CASE WHEN again > 0 THEN {STEP} ELSE 0 END AS ordinal
    FROM (SELECT doc_id AS d, text, lang, 0 AS again FROM documents UNION ALL SELECT doc_id, text, lang, 1 FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, text, lang, 2 FROM documents WHERE doc_id % 13 = 0)""",
    "norm": f"""SELECT * EXCLUDE (body), {_clean("body")} AS body,
      CASE WHEN d % 3 = 0 AND app_version = '4.10.0' THEN 1 + (d // 24) % 2 ELSE 1 + d * 7 % 5 END::DOUBLE AS rating FROM raw""",
    "dedup": f"SELECT *, min(ordinal) OVER (PARTITION BY {APP}, review_id) AS position FROM norm QUALIFY row_number() OVER (PARTITION BY {APP}, review_id ORDER BY updated_ms DESC, ordinal) = 1",
    "reviews": "SELECT * FROM dedup WHERE body <> ''",
    "hay": f"SELECT *, lower(title || ' ' || body) AS h, trim(regexp_replace(title || ' ' || body, '{WHITE}+', ' ', 'g')) AS p FROM reviews",
    "words": "SELECT *, " + ", ".join(f"{_found('h', [(w, _word(w)) for w in fixed.THEMES[t][2]])} AS {_col(t)}" for t in THEMES) + " FROM hay",
    "hits": "SELECT *, " + " OR ".join(f"len({_col(t)}) > 0" for t in REQUESTS) + " AS asks FROM words",
    "mentions": _mentions(),
    "links": f"SELECT *, CASE WHEN len(ex) > 0 THEN 'explicit' WHEN len(ch) > 0 THEN 'change' ELSE 'none' END AS kind FROM (SELECT *, {_rules(fixed.EXPLICIT_RULES)} AS ex, {_rules(fixed.CHANGE_RULES)} AS ch FROM hay)",
    "scopes0": f"SELECT hits.*, {_rules(fixed.SOFTWARE_RULES)} AS strong, {_rules(fixed.COMMUNITY_RULES)} AS community, {_rules(fixed.SUPPORT_RULES)} AS support, {_rules(fixed.POLICY_RULES)} AS policy0, "
    + f"{_found('h', [(t, _usable(t)) for t in THEMES if t in SOFTWARE])} AS software_themes FROM hits",
    "scopes1": "SELECT *, list_distinct(list_concat(policy0, " + ", ".join(f"list_transform({_col(t)}, lambda w: {_q(f'theme-{t}:')} || w)" for t in [*POLICY, *REQUESTS]) + ")) AS policy FROM scopes0",
    "scopes2": "SELECT *, CASE WHEN len(strong) > 0 THEN 'software' WHEN len(community) > 0 THEN 'community' WHEN len(support) > 0 THEN 'support' WHEN len(policy) > 0 THEN 'product-policy' WHEN len(software_themes) > 0 THEN 'software' ELSE 'unclear' END AS scope FROM scopes1",
    "scopes": f"SELECT scopes2.*, links.kind FROM scopes2 JOIN links USING ({APP}, review_id)",
    "anchors": f"SELECT {APP}, max(created_ms) AS anchor, count(*) AS total FROM reviews GROUP BY ALL",
    "dated": "SELECT mentions.*, anchor - created_ms AS age, total, rating <= 3 AND NOT only_asked AS complaint FROM mentions JOIN anchors USING (source, app_id)",
    "themes0": f"""SELECT {APP}, ordinal, theme, intent, total, count(*) AS count, coalesce(avg(rating), 0) AS average, count(*) FILTER (complaint AND rating <= 2) AS negative_count,
      count(*) FILTER (complaint) AS complaint_count, coalesce(avg(rating) FILTER (complaint), 0) AS complaint_average, count(*) FILTER (only_asked AND rating <= 3) AS request_overlap_count,
      count(*) FILTER (age <= 2592000000) AS recent_count, count(*) FILTER (age > 2592000000 AND age <= 5184000000) AS previous_count,
      count(*) FILTER (complaint AND age <= 2592000000) AS recent_complaint_count, count(*) FILTER (complaint AND age > 2592000000 AND age <= 5184000000) AS previous_complaint_count
    FROM dated GROUP BY ALL""",
    "themes1": f"""SELECT * EXCLUDE (average, complaint_average), {_share('count', 'total')} AS share, {_rnd('average', 2)} AS average_rating, {_share('complaint_count', 'total')} AS complaint_share,
      {_rnd('complaint_average', 2)} AS complaint_average_rating, {_trend('recent_count', 'previous_count')} AS trend_percent, {_trend('recent_complaint_count', 'previous_complaint_count')} AS complaint_trend_percent FROM themes0""",
    "themes2": "SELECT *, intent = 'request' AS r, CASE WHEN intent = 'request' THEN average_rating ELSE complaint_average_rating END AS w FROM themes1",
    "themes": "SELECT *, "
    + _rnd("(CASE WHEN r THEN count ELSE complaint_count END) * (6 - CASE WHEN w = 0 THEN 3::DOUBLE ELSE w END) * (1 + greatest(0, CASE WHEN r THEN trend_percent ELSE complaint_trend_percent END) / 200::DOUBLE)", 1)
    + " AS priority_score FROM themes2",
    "versions0": f"SELECT {APP}, app_version, count(*) AS count, {_rnd('avg(rating)', 2)} AS average_rating, {_share('count(*) FILTER (rating <= 2)', 'count(*)')} AS negative_share, max(created_ms)::BIGINT AS last_seen_ms, min(position) AS fp FROM reviews WHERE app_version IS NOT NULL GROUP BY ALL",
    "versions": f"SELECT *, row_number() OVER (PARTITION BY {APP} ORDER BY list_transform(string_split(app_version, '.'), lambda x: x::INT) DESC, last_seen_ms DESC, fp)::INTEGER AS rank FROM versions0 QUALIFY rank <= 12",
    "signals": f"""SELECT {APP}, app_version, ordinal, theme, intent, count(*) AS count, count(*) FILTER (rating <= 2) AS negative_count, count(*) FILTER (rating <= 3 AND NOT only_asked) AS complaint_count,
      count(*) FILTER (rating <= 3 AND only_asked) AS request_overlap_count, {_share('count(*)', 'any_value(v.count)')} AS share, {_share('count(*) FILTER (rating <= 3 AND NOT only_asked)', 'any_value(v.count)')} AS complaint_share
    FROM mentions JOIN (SELECT {APP}, app_version, count FROM versions0) v USING ({APP}, app_version) GROUP BY ALL""",
    "chosen": f"""SELECT {APP}, arg_min(struct_pack(v := app_version, n := count, a := average_rating, s := negative_share), rank) FILTER (rank = 1) AS c,
      arg_min(struct_pack(v := app_version, n := count, a := average_rating, s := negative_share), rank) FILTER (rank > 1 AND count >= {MINIMUM}) AS b0,
      arg_min(struct_pack(v := app_version, n := count), rank) FILTER (rank > 1) AS k FROM versions GROUP BY ALL""",
    "ready0": f"SELECT a.source, a.app_id, c, k, CASE WHEN c.n >= {MINIMUM} THEN b0 END AS b FROM anchors a LEFT JOIN chosen USING ({APP})",
    "ready": f"""SELECT {APP}, c.v AS current_version, c.n AS current_count, c.a AS current_average_rating, c.s AS current_negative_share, b.v AS baseline_version, b.n AS baseline_count,
      b.a AS baseline_average_rating, b.s AS baseline_negative_share, k.v AS candidate_version, k.n AS candidate_count,
      CASE WHEN c.v IS NULL THEN 'no-version' WHEN c.n < {MINIMUM} THEN 'current-too-small' WHEN b.v IS NULL AND k.v IS NOT NULL THEN 'baseline-too-small' WHEN b.v IS NULL THEN 'no-baseline' END AS reason FROM ready0""",
    "compared": f"SELECT *, {_rnd('baseline_average_rating - current_average_rating', 3)} AS rating_drop, {_rnd('current_negative_share - baseline_negative_share', 3)} AS negative_share_increase FROM ready WHERE reason IS NULL",
    "changes": f"""SELECT s.source, s.app_id, s.theme, s.intent, s.complaint_count AS count, coalesce(o.complaint_count, 0) AS baseline_count, s.complaint_share AS current_share, coalesce(o.complaint_share, 0) AS baseline_share,
      {_rnd('s.complaint_share - coalesce(o.complaint_share, 0)', 3)} AS share_increase
    FROM compared p JOIN signals s ON s.source = p.source AND s.app_id = p.app_id AND s.app_version = p.current_version
    LEFT JOIN signals o ON o.source = p.source AND o.app_id = p.app_id AND o.app_version = p.baseline_version AND o.theme = s.theme""",
    "violations": f"""SELECT {APP}, 1 AS kind_order, 'rating-drop' AS id, CASE WHEN rating_drop >= 0.4::DOUBLE * 1.75::DOUBLE THEN 'high' ELSE 'medium' END AS severity, rating_drop AS value, 0.4::DOUBLE AS threshold, 'stars' AS unit FROM compared WHERE rating_drop > 0.4::DOUBLE
      UNION ALL SELECT {APP}, 2, 'negative-share-increase', CASE WHEN negative_share_increase >= 0.15::DOUBLE * 1.75::DOUBLE THEN 'high' ELSE 'medium' END, negative_share_increase, 0.15::DOUBLE, 'share' FROM compared WHERE negative_share_increase > 0.15::DOUBLE
      UNION ALL SELECT {APP}, 3, 'theme-' || theme, CASE WHEN share_increase >= 0.18::DOUBLE * 1.75::DOUBLE THEN 'high' ELSE 'medium' END, share_increase, 0.18::DOUBLE, 'share' FROM changes WHERE intent <> 'request' AND count >= 3 AND share_increase > 0.18::DOUBLE""",
    "verdicts": f"SELECT ready.*, CASE WHEN reason IS NOT NULL THEN 'insufficient-data' WHEN EXISTS (SELECT 1 FROM violations v WHERE v.source = ready.source AND v.app_id = ready.app_id) THEN 'fail' ELSE 'pass' END AS status FROM ready",
    "pairs": "SELECT * FROM (VALUES ('google-play', 'app-0', 'google-play', 'app-1'), ('google-play', 'app-1', 'apple-app-store', 'app-2')) t(source, app_id, other_source, other_app_id)",
    "gaps0": """SELECT p.*, g.ordinal, g.theme, coalesce(a.count, 0) AS primary_count, coalesce(a.share, 0) AS primary_share, coalesce(b.count, 0) AS competitor_count, coalesce(b.share, 0) AS competitor_share
      FROM pairs p CROSS JOIN (SELECT DISTINCT ordinal, theme FROM themes) g LEFT JOIN themes a ON a.source = p.source AND a.app_id = p.app_id AND a.theme = g.theme
      LEFT JOIN themes b ON b.source = p.other_source AND b.app_id = p.other_app_id AND b.theme = g.theme WHERE a.theme IS NOT NULL OR b.theme IS NOT NULL""",
    "gaps1": f"SELECT *, {_rnd('competitor_share - primary_share', 3)} AS share_gap FROM gaps0",
    "gaps": "SELECT *, row_number() OVER (PARTITION BY source, app_id, other_source, other_app_id ORDER BY abs(share_gap) DESC, ordinal)::INTEGER AS rank FROM gaps1",
    "samples": f"SELECT {APP}, count(*) AS total, {_rnd('coalesce(avg(rating) FILTER (rating <> 0), 0)', 2)} AS average_rating, {_share('count(*) FILTER (rating <= 2)', 'count(*)')} AS negative_share, {_iso('min(created_ms)')} AS first_review_at, {_iso('max(created_ms)')} AS last_review_at FROM reviews GROUP BY ALL",
    "tagged": "SELECT h.*, t.expected FROM hits h JOIN (VALUES " + ", ".join(f"({_q(t)}, {_q(theme)})" for t, theme in TEMPLATES) + r") t(sentence, expected) ON regexp_extract(h.body, '^(.*?)\. ', 1) = t.sentence",
    "examples": "SELECT coalesce(language, 'unknown') AS language, " + _found("", [(t, f"len({_col(t)}) > 0") for t in THEMES]) + " AS predicted, CASE WHEN expected = '' THEN []::VARCHAR[] ELSE [expected] END AS expected FROM tagged",
    "confusion": """SELECT language, label, count(*) FILTER (p AND e) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM (
      SELECT language, label, list_contains(predicted, label) AS p, list_contains(expected, label) AS e FROM (SELECT *, unnest(list_distinct(list_concat(predicted, expected))) AS label FROM examples)) GROUP BY ALL""",
}


def _mining(p: str, rows: str, limit: int) -> dict[str, str]:
    """CTEs <p>_... that mine phrases of rows (source, app_id, review_id, body, rating, created_ms, position,
    app_version): features, candidates, one round of selection after the other, and the issues."""
    letters = LETTER
    cut = lambda k: f"w[1:length(w) - {k}]"
    stem = f"""CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN {cut(3)} || 'y' ELSE
      CASE WHEN length(c) >= 2 AND right(c, 1) BETWEEN 'a' AND 'z' AND right(c, 1) = left(right(c, 2), 1) THEN c[1:length(c) - 1] ELSE c END END"""
    shorter = f"""CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN {cut(3)}
      WHEN length(w) > 4 AND w LIKE '%ed' THEN CASE WHEN regexp_matches({cut(2)}, '(at|iz)$') THEN {cut(2)} || 'e' ELSE {cut(2)} END
      WHEN length(w) > 4 AND w LIKE '%es' THEN {cut(2)} WHEN length(w) > 4 AND w LIKE '%s' THEN {cut(1)} ELSE w END"""
    stop = _list(fixed.PHRASE_STOP_WORDS)
    cjk = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}"
    own = f"{APP}, review_id, rating, created_ms, position, app_version"
    out = {
        "texts": f"SELECT {own}, lower(nfc_normalize(body)) AS t FROM {rows} WHERE rating <= 3 AND body <> ''",
        "words": f"SELECT {own}, unnest(raw) AS label, generate_subscripts(raw, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[{letters}][{letters}''-]{{2,}}') AS raw FROM {p}_texts)",
        "stems": f"SELECT {own}, label, i, {stem} AS feature FROM (SELECT *, {shorter} AS c FROM (SELECT *, regexp_replace(label, '^''+|''+$', '', 'g') AS w FROM {p}_words))",
        "tokens": f"SELECT *, lead(feature) OVER o AS feature2, lead(label) OVER o AS label2 FROM {p}_stems WHERE length(feature) >= 3 AND NOT list_contains({stop}, feature) WINDOW o AS (PARTITION BY {APP}, review_id ORDER BY i)",
        "runs": f"SELECT {own}, unnest(raw) AS run, generate_subscripts(raw, 1) AS j FROM (SELECT *, regexp_extract_all(t, '[{cjk}]{{3,}}') AS raw FROM {p}_texts)",
        "grams": f"SELECT {own}, substr(run, k, g) AS label, j * 1000000 + g * 100000 + k AS i FROM (SELECT *, unnest(range(1, length(run) - g + 2)) AS k FROM (SELECT *, unnest([2, 3]) AS g FROM {p}_runs))",
        "every": f"""SELECT {own}, feature, label, i AS place FROM {p}_tokens
          UNION ALL SELECT {own}, feature || ' ' || feature2, label || ' ' || label2, 1000000000000 + i FROM {p}_tokens WHERE feature2 IS NOT NULL
          UNION ALL SELECT {own}, label, label, 2000000000000 + i FROM {p}_grams WHERE NOT list_contains({stop}, label)""",
        "flat": f"SELECT {own}, feature, min(place) AS place, arg_max(label, place) AS label FROM {p}_every GROUP BY {own}, feature",
        "sizes": f"SELECT {APP}, count(DISTINCT review_id) AS documents FROM {p}_flat GROUP BY {APP} HAVING documents >= 2",
        "counted": f"SELECT {APP}, feature, count(*) AS count, {_rnd('avg(rating)', 2)} AS average_rating, min((-created_ms, position, place)) AS seen FROM {p}_flat WHERE contains(feature, ' ') OR regexp_matches(feature, '[{cjk}]') GROUP BY {APP}, feature",
        "left0": f"""SELECT {APP}, feature, count, average_rating, seen, {_rnd("count * (6 - average_rating) * (ln((documents + 1) / (count + 0.5::DOUBLE)) + 1) * CASE WHEN contains(feature, ' ') THEN 1.35::DOUBLE ELSE 1 END", 3)} AS score
          FROM {p}_counted JOIN {p}_sizes USING ({APP}) WHERE count >= 2 AND count <= greatest(3, ceil(documents * 0.8::DOUBLE))""",
    }
    for k in range(1, limit + 1):
        out[f"best{k}"] = f"SELECT *, {k} AS rank FROM {p}_left{k - 1} QUALIFY row_number() OVER (PARTITION BY {APP} ORDER BY score DESC, count DESC, seen) = 1"
        out[f"common{k}"] = f"""SELECT x.source, x.app_id, x.feature, count(*) AS common FROM {p}_flat x JOIN {p}_flat y ON x.source = y.source AND x.app_id = y.app_id AND x.review_id = y.review_id
          JOIN {p}_best{k} b ON b.source = y.source AND b.app_id = y.app_id AND b.feature = y.feature GROUP BY ALL"""
        out[f"left{k}"] = f"""SELECT l.* FROM {p}_left{k - 1} l JOIN {p}_best{k} b USING ({APP}) LEFT JOIN {p}_common{k} c USING ({APP}, feature)
          WHERE coalesce(c.common, 0)::DOUBLE / least(l.count, b.count) < 0.65::DOUBLE""".replace("USING (source, app_id, feature)", "ON c.source = l.source AND c.app_id = l.app_id AND c.feature = l.feature")
    out["chosen"] = " UNION ALL ".join(f"SELECT * FROM {p}_best{k}" for k in range(1, limit + 1))
    out["items"] = f"SELECT f.*, 'discovered-' || substr(sha256(f.feature), 1, 12) AS id FROM {p}_flat f JOIN {p}_chosen USING ({APP}, feature)"
    out["labels"] = f"SELECT {APP}, feature, label FROM (SELECT {APP}, feature, label, count(*) AS uses, min((-created_ms, position)) AS first FROM {p}_items GROUP BY {APP}, feature, label) QUALIFY row_number() OVER (PARTITION BY {APP}, feature ORDER BY uses DESC, length(label) DESC, first) = 1"
    return {f"{p}_{name}": sql for name, sql in out.items()}


_THEMELESS = " AND ".join(f"len({_col(t)}) = 0" for t in THEMES)
CTES |= {"unthemed": f"SELECT * FROM hits WHERE {_THEMELESS}"}
CTES |= _mining("m", "unthemed", 6)
CTES |= {
    "issues": f"""SELECT {APP}, id, label, feature AS fingerprint, count, {_share("count", "total")} AS share, average_rating, recent_count, previous_count, {_trend("recent_count", "previous_count")} AS trend_percent, score, rank
      FROM (SELECT {APP}, feature, any_value(id) AS id, count(*) FILTER (anchor - created_ms <= 2592000000) AS recent_count, count(*) FILTER (anchor - created_ms > 2592000000 AND anchor - created_ms <= 5184000000) AS previous_count
        FROM m_items JOIN anchors USING ({APP}) GROUP BY {APP}, feature) JOIN m_chosen USING ({APP}, feature) JOIN m_labels USING ({APP}, feature) JOIN anchors USING ({APP})""",
    "issue_changes0": f"""SELECT i.source, i.app_id, i.id, i.label, i.rank, count(*) FILTER (m.app_version = p.current_version) AS count, count(*) FILTER (m.app_version = p.baseline_version) AS baseline_count,
      any_value(p.current_count) AS size, any_value(p.baseline_count) AS size0 FROM issues i JOIN compared p USING ({APP}) JOIN m_items m USING ({APP}, id) GROUP BY ALL""",
    "issue_changes": f"""SELECT {APP}, id, label, rank, count, baseline_count, {_rnd("count::DOUBLE / size", 3)} AS current_share, {_rnd("baseline_count::DOUBLE / size0", 3)} AS baseline_share, {_rnd("count::DOUBLE / size - baseline_count::DOUBLE / size0", 3)} AS share_increase FROM issue_changes0""",
    "all_violations": f"""SELECT * FROM violations UNION ALL SELECT {APP}, 4, id, CASE WHEN baseline_count = 0 THEN 'high' ELSE 'medium' END, share_increase, 0.05::DOUBLE, 'share' FROM issue_changes WHERE count >= 3 AND share_increase > 0.05::DOUBLE""",
    "low_totals": f"SELECT {APP}, app_version, count(*) AS total FROM scopes WHERE rating <= 3 AND app_version IS NOT NULL GROUP BY ALL",
    "known": f"""SELECT {APP}, app_version, 'software-' || theme AS id, 'known-theme' AS kind, label, n AS count, {_share('n', 'total')} AS share, l AS release_linked_count, e AS explicit_release_count, l >= 2 AND e >= 1 AS supported FROM (
      SELECT {APP}, app_version, theme, count(*) AS n, count(*) FILTER (kind <> 'none') AS l, count(*) FILTER (kind = 'explicit') AS e FROM (SELECT *, unnest(software_themes) AS theme FROM scopes WHERE rating <= 3 AND scope = 'software' AND app_version IS NOT NULL) GROUP BY ALL HAVING n >= 2)
      JOIN low_totals USING ({APP}, app_version) JOIN (VALUES {", ".join(f"({_q(t)}, {_q(fixed.THEMES[t][0])})" for t in THEMES)}) x(theme, label) USING (theme)""",
    "unexplained": "SELECT * REPLACE (app_id || ' @ ' || app_version AS app_id) FROM scopes WHERE rating <= 3 AND app_version IS NOT NULL AND scope = 'software' AND len(software_themes) = 0 AND kind = 'explicit'",
}
CTES |= _mining("v", "unexplained", 4)
CTES |= {
    "actionable": f"""SELECT * FROM known UNION ALL SELECT source, split_part(v.app_id, ' @ ', 1), split_part(v.app_id, ' @ ', 2), 'software-discovered-' || substr(sha256(feature), 1, 12), 'discovered', label, count, {_share("count", "total")}, count, count, count >= 2
      FROM v_chosen v JOIN v_labels USING ({APP}, feature) JOIN (SELECT source, app_id || ' @ ' || app_version AS app_id, total FROM low_totals) USING ({APP})""",
    "all_verdicts": f"""SELECT {APP}, status, CASE WHEN status <> 'fail' THEN 'observe' WHEN supported_issues > 0 THEN 'software-regression' ELSE 'manual-review' END AS decision, status = 'fail' AS blocking, reason, current_version, current_count,
      coalesce(baseline_version, candidate_version) AS baseline_version, rating_drop, negative_share_increase, violations, supported_issues FROM (
      SELECT r.*, p.rating_drop, p.negative_share_increase, coalesce(v.n, 0) AS violations, coalesce(a.n, 0) AS supported_issues, CASE WHEN r.reason IS NOT NULL THEN 'insufficient-data' WHEN coalesce(v.n, 0) > 0 THEN 'fail' ELSE 'pass' END AS status
      FROM ready r LEFT JOIN compared p USING ({APP}) LEFT JOIN (SELECT {APP}, count(*) AS n FROM all_violations GROUP BY ALL) v USING ({APP})
      LEFT JOIN (SELECT {APP}, app_version AS current_version, count(*) AS n FROM actionable WHERE supported GROUP BY ALL) a ON a.source = r.source AND a.app_id = r.app_id AND a.current_version = r.current_version)""",
}


def _top(rows: str, keys: str, order: str, count: int, select: str) -> str:
    return f"SELECT {select}, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM {rows}) WHERE rank <= {count}"


def _values(column: str) -> str:
    return f"SELECT {APP}, value, count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {APP} ORDER BY count DESC, seen) AS rank FROM (SELECT {APP}, coalesce(nullif({column}, ''), 'unknown') AS value, count(*) AS count, min((-created_ms, position)) AS seen FROM reviews GROUP BY ALL)) WHERE rank <= 8"


def _metric(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 1::DOUBLE ELSE {_rnd(f'({a})::DOUBLE / nullif({b}, 0)', 4, False)} END)"


_EXCERPT = "CASE WHEN length(body) > 220 THEN substr(body, 1, 217) || '…' ELSE body END"
_JOIN = lambda x: f"array_to_string(list_sort({x}), '|')"
_LINKED = "count(*) FILTER (rating <= 3 AND kind <> 'none')"
_EXPLICIT = "count(*) FILTER (rating <= 3 AND kind = 'explicit')"
_SOFT = "rating <= 3 AND scope = 'software'"
_FIRST = f"row_number() OVER (PARTITION BY {APP} ORDER BY priority_score DESC, count DESC, ordinal) = 1"
_PAGE = "CASE WHEN page_id % 3 = 0 THEN 'https://apps.apple.com/gb/app/x/id' || page_id WHEN page_id % 3 = 1 THEN 'https://play.google.com/store/apps/details?id=com.x' || page_id || '&gl=us&hl=en' ELSE url END"
_APPS = "(VALUES ('google-play', 'app-0', 'crashes later gallery labs'), ('apple-app-store', 'app-1', 'photos')) a(source, app_id, own)"
_GROUP = f"SELECT source, coalesce(source, 'all') AS name, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'insufficient-data') AS insufficient"

CTES |= {
    "link_levels": f"""SELECT {APP}, app_version, count(*) FILTER (rating <= 3) AS low_rating_count, {_EXPLICIT} AS explicit_count, count(*) FILTER (rating <= 3 AND kind = 'change') AS change_count, {_LINKED} AS linked_count,
      {_share(_LINKED, 'count(*) FILTER (rating <= 3)')} AS linked_share, CASE WHEN {_EXPLICIT} >= 2 OR ({_EXPLICIT} >= 1 AND {_LINKED} >= 2) THEN 'supported' WHEN {_LINKED} >= 1 THEN 'limited' ELSE 'none' END AS level FROM links WHERE app_version IS NOT NULL GROUP BY {APP}, app_version""",
    "scope_counts": f"SELECT {APP}, app_version, s AS scope, count(*) FILTER (rating <= 3 AND scope = s) AS count, {_share('count(*) FILTER (rating <= 3 AND scope = s)', 'count(*) FILTER (rating <= 3)')} AS share FROM scopes, (SELECT unnest({_list(fixed.SCOPES)}) AS s) WHERE app_version IS NOT NULL GROUP BY {APP}, app_version, s",
}
_TEXT = lambda x: f"coalesce(to_json({x}::VARCHAR)::VARCHAR, 'null')"
_JSON = " || ',' || ".join(
    f"'\"{name}\":' || {_TEXT(value)}"
    for name, value in [
        ("appId", "app_id"), ("appVersion", "app_version"), ("author", "author"), ("body", "body"), ("country", "country"), ("createdAt", _iso("created_ms")), ("helpfulCount", "printf('%.3f', helpful_count)"),
        ("language", "language"), ("rating", "printf('%.3f', rating)"), ("reviewId", "review_id"), ("source", "source"), ("sourceUrl", "NULL"), ("title", "title"), ("updatedAt", _iso("updated_ms")),
    ]
)
_JSON = f"'{{' || {_JSON} || '}}'"

QUERIES = {
    "normalize_reviews": f"SELECT {APP}, review_id, title, body, rating, language, country, app_version, author, helpful_count, {_iso('created_ms')} AS created, {_iso('updated_ms')} AS updated, ordinal FROM norm",
    "clean_pages_text": f"SELECT page_id, {_clean('html')} AS text FROM pages",
    "parse_page_source_refs": rf"""SELECT page_id, CASE WHEN a <> '' THEN 'apple-app-store' WHEN g <> '' THEN 'google-play' END AS store, CASE WHEN a <> '' THEN a WHEN g <> '' THEN g END AS app_id,
      CASE WHEN a <> '' THEN upper(nullif(regexp_extract(u, '^https?://[^/]+/([A-Za-z]{{2}})/', 1), '')) WHEN g <> '' THEN upper(nullif(regexp_extract(u, '[?&]gl=([^&#]+)', 1), '')) END AS country,
      CASE WHEN a = '' AND g <> '' THEN nullif(regexp_extract(u, '[?&]hl=([^&#]+)', 1), '') END AS language,
      CASE WHEN a <> '' THEN 'https://apps.apple.com/' || lower(coalesce(nullif(regexp_extract(u, '^https?://[^/]+/([A-Za-z]{{2}})/', 1), ''), 'us')) || '/app/id' || a WHEN g <> '' THEN 'https://play.google.com/store/apps/details?id=' || g END AS canonical_url
      FROM (SELECT page_id, u, regexp_extract(u, '^https?://(?:apps|itunes)\.apple\.com/.*/id(\d+)(?:/|[?#]|$)', 1) AS a, regexp_extract(u, '^https?://play\.google\.com/store/apps/details\?(?:[^#]*&)?id=([^&#]+)', 1) AS g FROM (SELECT page_id, {_PAGE} AS u FROM pages))""",
    "dedupe_latest": f"SELECT {APP}, review_id, body, {_iso('updated_ms')} AS updated, ordinal, position FROM dedup",
    "sample_summary": "SELECT * FROM samples",
    "rating_distribution": f"SELECT {APP}, stars, coalesce(n, 0)::BIGINT AS count FROM (SELECT {APP}, unnest([1, 2, 3, 4, 5]) AS stars FROM anchors) LEFT JOIN (SELECT {APP}, rating AS stars, count(*) AS n FROM reviews GROUP BY ALL) USING ({APP}, stars)",
    "timeline_monthly": f"SELECT {APP}, strftime(make_timestamp(created_ms * 1000), '%Y-%m') AS period, count(*) AS count, {_rnd('avg(rating)', 2)} AS average_rating, count(*) FILTER (rating <= 2) AS negative_count FROM reviews GROUP BY {APP}, period QUALIFY row_number() OVER (PARTITION BY {APP} ORDER BY period DESC) <= 12",
    "country_counts": _values("country"),
    "language_counts": _values("language"),
    "theme_hits": "SELECT review_id, theme AS id, unnest(hits) AS hit FROM mentions",
    "theme_confidence": "SELECT review_id, theme AS id, intent, least(0.98::DOUBLE, 0.56::DOUBLE + len(hits) * 0.13::DOUBLE) AS confidence FROM mentions",
    "theme_summary": f"SELECT {APP}, theme, count, share, average_rating, negative_count, complaint_count, complaint_share, complaint_average_rating FROM themes",
    "theme_trend": f"SELECT {APP}, theme, recent_count, previous_count, trend_percent, recent_complaint_count, previous_complaint_count, complaint_trend_percent FROM themes",
    "theme_priority": f"SELECT {APP}, theme, priority_score FROM themes",
    "request_overlap": f"SELECT {APP}, theme, request_overlap_count FROM themes",
    "theme_evidence_top4": _top("mentions", f"{APP}, theme", f"{SCORE} DESC, {NEWEST}", 4, f"{APP}, theme, review_id, rating, {_EXCERPT} AS excerpt"),
    "theme_complaint_evidence": _top("(SELECT * FROM mentions WHERE rating <= 3 AND NOT only_asked)", f"{APP}, theme", f"{SCORE} DESC, {NEWEST}", 4, f"{APP}, theme, review_id"),
    "version_summary": f"SELECT {APP}, app_version, count, average_rating, negative_share, last_seen_ms FROM versions",
    "version_order_top12": f"""SELECT {APP}, app_version, count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {APP} ORDER BY a DESC, b DESC, seen DESC, fp) AS rank FROM (
      SELECT {APP}, (d % 17) || '.' || (d % 5) || CASE WHEN d % 2 = 0 THEN '.0' ELSE '' END AS app_version, d % 17 AS a, d % 5 AS b, count(*) AS count, max(created_ms) AS seen, min(position) AS fp FROM reviews GROUP BY ALL)) WHERE rank <= 12""",
    "version_negative_evidence": _top("(SELECT * FROM reviews WHERE rating <= 2 AND app_version IS NOT NULL)", f"{APP}, app_version", NEWEST, 3, f"{APP}, app_version, review_id"),
    "version_theme_signals": "SELECT * EXCLUDE (ordinal, intent) FROM signals",
    "release_link_kind": f"SELECT review_id, kind, {_JOIN('ex')} AS explicit_hits, {_JOIN('ch')} AS change_hits FROM links",
    "version_release_link": "SELECT * FROM link_levels",
    "release_link_evidence": _top("(SELECT * FROM links WHERE rating <= 3 AND kind <> 'none' AND app_version IS NOT NULL)", f"{APP}, app_version", f"(kind = 'explicit') DESC, {SCORE} DESC, {NEWEST}", 4, f"{APP}, app_version, review_id"),
    "review_scope": f"SELECT review_id, scope AS \"primary\", {_JOIN('list_concat(strong, list_transform(software_themes, lambda t: ' + _q('theme-') + ' || t))')} AS software, {_JOIN('policy')} AS product_policy, {_JOIN('community')} AS community, {_JOIN('support')} AS support, {_JOIN('software_themes')} AS software_themes FROM scopes",
    "version_scope_counts": "SELECT * FROM scope_counts",
    "version_actionability": f"SELECT {APP}, app_version, count(*) FILTER (rating <= 3) AS low_rating_count, count(*) FILTER ({_SOFT}) AS software_count, count(*) FILTER ({_SOFT} AND kind <> 'none') AS release_linked_software_count, count(*) FILTER ({_SOFT} AND kind = 'explicit') AS explicit_release_software_count, {_share(f'count(*) FILTER ({_SOFT})', 'count(*) FILTER (rating <= 3)')} AS software_share FROM scopes WHERE app_version IS NOT NULL GROUP BY {APP}, app_version",
    "scope_evidence": _top("(SELECT *, scope AS category FROM scopes WHERE rating <= 3 AND app_version IS NOT NULL)", f"{APP}, app_version, category", f"{SCORE} DESC, {NEWEST}", 3, f"{APP}, app_version, category, review_id"),
    "actionable_known_issues": "SELECT * FROM known",
    "actionable_issues": "SELECT * FROM actionable",
    "phrase_features_df": f"SELECT {APP}, feature, count(*) AS df FROM m_flat GROUP BY ALL",
    "phrase_candidates": f"SELECT {APP}, feature, count, average_rating, score FROM m_left0",
    "discovered_issues": "SELECT * FROM issues",
    "regression_issue_changes": "SELECT * FROM issue_changes",
    "regression_violations": "SELECT * FROM all_violations",
    "regression_verdict": "SELECT * FROM all_verdicts",
    "keyword_top20": f"""SELECT {APP}, term, count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {APP} ORDER BY count DESC, seen) AS rank FROM (
      SELECT {APP}, term, count(*) AS count, min((-created_ms, position, place)) AS seen FROM (
        SELECT {APP}, review_id, created_ms, position, term, min(i) AS place FROM (SELECT *, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM (SELECT *, regexp_extract_all(lower(body), '{KEYWORD}') AS tokens FROM reviews WHERE rating <= 3)) GROUP BY ALL)
      LEFT JOIN {_APPS} USING (source, app_id) WHERE NOT list_contains({_list(fixed.KEYWORD_STOP_WORDS)}, term) AND NOT list_contains(string_split(coalesce(own, ''), ' '), term) GROUP BY {APP}, term)) WHERE rank <= 20""",
    "app_comparison": "SELECT * EXCLUDE (ordinal) FROM gaps",
    "comparison_opportunities": "SELECT * EXCLUDE (ordinal, rank, theme, r), 'competitor-' || theme AS id, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, app_id, other_source, other_app_id ORDER BY abs(share_gap) DESC, ordinal) AS r FROM gaps WHERE competitor_count >= 2 AND share_gap >= 0.03::DOUBLE) WHERE r <= 4",
    "comparison_rating_gap": f"SELECT p.*, a.average_rating AS primary_rating, b.average_rating AS competitor_rating, {_rnd('a.average_rating - b.average_rating', 2)} AS rating_gap FROM pairs p JOIN samples a USING ({APP}) JOIN samples b ON b.source = other_source AND b.app_id = other_app_id",
    "insights": f"""WITH found AS (
      SELECT {APP}, 1 AS ordinal, 'trend-' || theme AS id, 'emerging' AS kind, CASE WHEN complaint_average_rating <= 2.2::DOUBLE THEN 'high' ELSE 'medium' END AS severity FROM (SELECT * FROM themes WHERE intent = 'problem' AND recent_complaint_count >= 2 AND complaint_trend_percent > 20 QUALIFY {_FIRST})
      UNION ALL SELECT {APP}, 2, 'pain-' || theme, 'pain', CASE WHEN negative_count >= greatest(4, complaint_count * 0.6::DOUBLE) THEN 'high' ELSE 'medium' END FROM (SELECT * FROM themes WHERE intent = 'problem' AND negative_count >= 2 QUALIFY {_FIRST})
      UNION ALL SELECT {APP}, 3, 'version-' || app_version, 'regression', CASE WHEN average_rating <= 2 THEN 'high' ELSE 'medium' END FROM (SELECT * FROM versions WHERE count >= 3 AND average_rating <= 2.8::DOUBLE QUALIFY row_number() OVER (PARTITION BY {APP} ORDER BY rank) = 1)
      UNION ALL SELECT {APP}, 4, 'feature-demand', 'opportunity', 'low' FROM (SELECT * FROM themes WHERE intent = 'request' AND count >= 2 QUALIFY {_FIRST}))
      SELECT * FROM found UNION ALL SELECT {APP}, 5, 'baseline', 'baseline', 'low' FROM anchors ANTI JOIN found USING ({APP})""",
    "regression_versions": "SELECT * FROM ready",
    "regression_metrics": f"SELECT {APP}, rating_drop, negative_share_increase FROM compared",
    "regression_theme_changes": "SELECT * FROM changes",
    "regression_theme_violations": "SELECT * FROM violations",
    "cohort_summary": f"""SELECT level, name, total, passed, failed, insufficient, 0::BIGINT AS errors, total AS completed, passed + failed AS decidable, {_rnd('(passed + failed)::DOUBLE / total', 3, False)} AS decidable_rate FROM (
      SELECT CASE WHEN source IS NULL THEN 'all' ELSE 'store' END AS level, * EXCLUDE (source) FROM ({_GROUP} FROM all_verdicts GROUP BY GROUPING SETS ((source), ()))
      UNION ALL SELECT 'storefront', * EXCLUDE (source) FROM ({_GROUP.replace("source, coalesce(source, 'all')", "'' AS source, 'unknown'")} FROM all_verdicts))""",
    "cohort_violation_counts": "SELECT id, count(*) AS cases FROM all_violations GROUP BY id",
    "cohort_insufficient_reasons": "SELECT reason, count(*) AS cases FROM verdicts WHERE status = 'insufficient-data' GROUP BY reason",
    "cohort_coverage": f"SELECT {APP}, count(*) AS complaints, count(*) FILTER ({' OR '.join(f'len({_col(t)}) > 0' for t in THEMES)}) AS matched, {_share('count(*) FILTER (' + ' OR '.join(f'len({_col(t)}) > 0' for t in THEMES) + ')', 'count(*)')} AS rate FROM hits JOIN (SELECT {APP}, current_version AS app_version FROM ready) USING ({APP}, app_version) WHERE rating <= 3 GROUP BY {APP}",
    "cohort_triage_counts": "SELECT decision, count(*) AS cases FROM all_verdicts GROUP BY decision",
    "cohort_link_levels": "SELECT coalesce(level, 'unknown') AS level, count(*) AS cases FROM ready r LEFT JOIN link_levels l ON l.source = r.source AND l.app_id = r.app_id AND l.app_version = r.current_version GROUP BY 1",
    "cohort_scope_sums": "SELECT scope, sum(count)::BIGINT AS reviews FROM ready r JOIN scope_counts s ON s.source = r.source AND s.app_id = r.app_id AND s.app_version = r.current_version GROUP BY scope",
    "issue_versions": f"SELECT {APP}, id, app_version, count(*) AS count FROM m_items WHERE app_version IS NOT NULL GROUP BY {APP}, id, app_version",
    "issue_evidence": _top("(SELECT i.id, r.* FROM m_items i JOIN reviews r USING (source, app_id, review_id))", f"{APP}, id", f"{SCORE} DESC, {NEWEST}", 4, f"{APP}, id, review_id"),
    "version_theme_evidence": _top("(SELECT * FROM mentions WHERE app_version IS NOT NULL)", f"{APP}, app_version, theme", f"{SCORE} DESC, {NEWEST}", 3, f"{APP}, app_version, theme, review_id"),
    "provenance_hash": f"""SELECT {APP}, sum(n)::BIGINT AS review_count, sha256(string_agg(part, ',' ORDER BY block)) AS content_hash FROM (
      SELECT {APP}, substr(digest, 1, 3) AS block, count(*) AS n, sha256(string_agg(digest, ',' ORDER BY digest)) AS part FROM (SELECT {APP}, sha256({_JSON}) AS digest FROM norm) GROUP BY ALL) GROUP BY {APP}""",
    "classifier_confusion": "SELECT * FROM confusion",
    "classifier_micro_metrics": f"""SELECT level, name, tp, fp, fn, {_metric('tp', 'tp + fp')} AS "precision", {_metric('tp', 'tp + fn')} AS recall, {_metric('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
      SELECT CASE WHEN label IS NOT NULL THEN 'label' WHEN language IS NOT NULL THEN 'language' ELSE 'all' END AS level, coalesce(label, language, 'all') AS name, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM confusion GROUP BY GROUPING SETS ((label), (language), ()))""",
    "classifier_exact_match": f"SELECT coalesce(language, 'all') AS language, count(*) AS examples, count(*) FILTER (list_sort(predicted) = list_sort(expected)) AS exact, {_metric('count(*) FILTER (list_sort(predicted) = list_sort(expected))', 'count(*)')} AS exact_match FROM examples GROUP BY GROUPING SETS ((language), ())",
    "csv_cells_guarded": "SELECT doc_id, CASE WHEN left(c, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, ['=', '+', '-', '@', '\"', ''][doc_id % 6 + 1] || text AS c FROM documents)",
}


def _needed(sql: str, ctes: dict[str, str]) -> list[str]:
    """The names of CTEs that a query reads, directly or not, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+\(*{name}\b", text):
                found.add(name)
                todo.append(ctes[name])
    return [name for name in ctes if name in found]


def _with(sql: str, ctes: dict[str, str]) -> str:
    parts = [f"{name} AS MATERIALIZED ({ctes[name]})" for name in _needed(sql, ctes)]
    if sql.startswith("WITH "):
        head, body = sql[5:].split(")\n      SELECT", 1)
        parts.append(head + ")")
        sql = "SELECT" + body
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def oracle_sql() -> dict[str, str]:
    from . import flow_oracle as flow

    ctes = CTES | flow.CTES
    # The cohort's raw reviews take the place of the others; what is made of them follows in the same order.
    of_cases = {name: sql for name, sql in flow.COHORT.items() if name in ("raw_base", "raw")}
    of_cases |= {name: sql for name, sql in CTES.items() if name != "raw"} | {name: sql for name, sql in flow.COHORT.items() if name not in of_cases}
    of_demo = {name: flow.DEMO.get(name, sql) for name, sql in CTES.items()}
    found = {key: _with(sql, ctes) for key, sql in (QUERIES | flow.QUERIES).items()}
    return found | {key: _with(sql, of_cases) for key, sql in flow.COHORT_QUERIES.items()} | {key: _with(sql, of_demo) for key, sql in flow.DEMO_QUERIES.items()}
