"""Text forms of results: JSON, CSV, Markdown and HTML, and their files."""

from __future__ import annotations

import html
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators.reviews import APP, iso
from . import result
from .gate import Gate

#: FIXED VALUES: formats by name and by file ending; the columns of the CSV form, in order.
FORMATS = {"json": "json", "csv": "csv", "md": "md", "markdown": "md", "html": "html"}
CSV_COLUMNS = ("source", "appId", "reviewId", "createdAt", "rating", "title", "body", "language", "country", "appVersion", "author", "helpfulCount")
BOM = "\ufeff"


def resolve_format(explicit: str | None, path: str | None = None) -> str:
    """The format that is asked for, else that of the file's ending, else json; an unknown one is a ValueError."""
    if explicit:
        if explicit.lower() not in FORMATS:
            raise ValueError(f"Unknown format {explicit}.")
        return FORMATS[explicit.lower()]
    return FORMATS.get(Path(path or "").suffix.lstrip(".").lower(), "json")


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula: an apostrophe goes before = + - @ at its start."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text.rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(reviews: DataFrame) -> DataFrame:
    """The guarded cells of reviews under the CSV form's names, newest first. Whole numbers have no fraction."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    cells = ("source", "app_id", "review_id", iso(F.col("created_at")), number("rating"), "title", "body", "language", "country", "app_version", "author", number("helpful_count"))
    return reviews.orderBy(F.desc("created_at"), "ordinal").select(*(csv_guard(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cells, CSV_COLUMNS, strict=True)))


def write_csv(reviews: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of CSV parts with all cells quoted and CRLF line ends, written by the executors."""
    csv_rows(reviews).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="", nullValue="")


def write_csv_file(reviews: DataFrame, path: str, overwrite: bool = False) -> None:
    """The same bytes as csv_text() in one file, of any number of reviews, which the executors write."""
    from ..sources.csv_file import save

    save(csv_rows(reviews), path, overwrite)


def csv_text(reviews: DataFrame, most: int = 100_000) -> str:
    """One CSV text with a byte order mark, of at most so many reviews (more are a ValueError: use write_csv)."""
    rows = csv_rows(reviews).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"More than {most} reviews do not go into one text.")
    quoted = lambda cells: ",".join('"' + str(c).replace('"', '""') + '"' for c in cells)
    return BOM + "\r\n".join([quoted(CSV_COLUMNS), *map(quoted, rows)]) + "\r\n"


def json_text(value: object) -> str:
    """Indented JSON with a line end; rows are objects."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=lambda x: x.asDict(True) if isinstance(x, Row) else str(x)) + "\n"


def report_json(report: Row) -> str:
    return json_text(report["report"].asDict(True))


def _percent(x: float | None) -> str:
    return f"{int((x or 0) * 100 + 0.5)}%"


def _cited(evidence: list[Row] | None, most: int = 3) -> list[str]:
    """A line for each of the first reviews: stars, version, day, excerpt."""
    out = []
    for e in (x["evidence"] for x in (evidence or [])[:most]):
        version = f" · {escape_markdown(e['app_version'])}" if e["app_version"] else ""
        out.append(f"- {e['rating']:g} stars{version} · {e['created_at']:%Y-%m-%d}: {escape_markdown(e['excerpt'])}")
    return out


def report_markdown(report: Row, gaps: list[Row] | None = None) -> str:
    """Sample, findings, themes, versions and phrases of one application's report; gaps (compare.theme_gaps) add the
    comparison with another application."""
    r = report["report"]
    lines = [f"# Reviews of {report['app_id']}", "", f"{r['sample']['total']} reviews, average {r['sample']['average_rating']}, {_percent(r['sample']['negative_share'])} with one or two stars.", "", "## Findings", ""]
    lines += [f"- **{i['severity']}** {i['statement']}" for i in r["insights"] or []] or ["None."]
    lines += ["", "## Themes", "", "| Theme | Reviews | Share | Complaints | Trend | Priority |", "| --- | ---: | ---: | ---: | ---: | ---: |"]
    lines += [f"| {t['label']} | {t['count']} | {_percent(t['share'])} | {t['complaint_count']} | {t['complaint_trend_percent']:+d}% | {t['priority_score']} |" for t in r["themes"] or []]
    for t in (r["themes"] or [])[:3]:
        lines += ["", f"### {t['label']}", "", *_cited(t["complaint_evidence"] or t["evidence"])]
    lines += ["", "## Repeated phrases without a theme", ""]
    for i in r["discovered_issues"] or []:
        lines += [f"- {escape_markdown(i['label'])}: {i['count']} reviews ({_percent(i['share'])}), average {i['average_rating']}", *("  " + x for x in _cited(i["evidence"], 1))]
    lines += [] if r["discovered_issues"] else ["None."]
    lines += ["", "## Versions", "", "| Version | Reviews | Average | Low ratings | Link to a release | Software reviews |", "| --- | ---: | ---: | ---: | --- | ---: |"]
    lines += [f"| {escape_markdown(v['app_version'])} | {v['count']} | {v['average_rating']} | {_percent(v['negative_share'])} | {v['release_link']['level']} | {v['actionability']['software_count']} |" for v in r["versions"] or []]
    if gaps:
        lines += ["", f"## Against {escape_markdown(gaps[0]['other_app_id'])}", "", "| Theme | Own share | Other share | Gap |", "| --- | ---: | ---: | ---: |"]
        lines += [f"| {g['label']} | {_percent(g['primary_share'])} | {_percent(g['competitor_share'])} | {g['share_gap']:+.3f} |" for g in sorted(gaps, key=lambda g: g["rank"])]
    lines += ["", "## Method", "", "Words and patterns decide; a version's reviews show correlation, not cause.", ""]
    return "\n".join(lines)


def escape_markdown(text: object) -> str:
    """Text that neither forms markup nor notifies anyone."""
    out = html.escape(str(text), quote=False).replace("@", "@\u200b")
    for mark in "|*_`[]":
        out = out.replace(mark, "\\" + mark)
    return out


def report_html(report: Row) -> str:
    """The Markdown form's contents as a page of its own; all values are escaped."""
    r = report["report"]
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    rows = "".join(f"<tr>{cell(t['label'])}{cell(t['count'])}{cell(_percent(t['share']))}{cell(t['complaint_count'])}</tr>" for t in r["themes"] or [])
    found = "".join(f"<li><b>{html.escape(i['severity'])}</b> {html.escape(i['statement'])}</li>" for i in r["insights"] or [])
    name = html.escape(str(report["app_id"]))
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{name}</title></head><body><h1>{name}</h1><p>{r["sample"]["total"]} reviews, average {r["sample"]["average_rating"]}</p><ul>{found}</ul><table><tr><th>Theme</th><th>Reviews</th><th>Share</th><th>Complaints</th></tr>{rows}</table></body></html>\n'


#: Sentences for the gate's reasons and decisions.
REASONS = {
    "partial-source": "The source returned part of the reviews only, so versions can't be compared.",
    "no-version": "No review names a version.",
    "current-too-small": "The newest version has too few reviews.",
    "baseline-too-small": "No earlier version has enough reviews.",
    "no-baseline": "There is no earlier version.",
    None: "The samples are large enough.",
}


def gate_markdown(gate: Gate) -> str:
    """All applications' results: verdict, metrics, release link, scopes, issues and violations with evidence."""
    return "\n".join(_check_markdown(row) for row in result.document(gate).orderBy(*APP).collect())


def _check_markdown(row: Row) -> str:
    r = row["result"]
    lines = [f"## {escape_markdown(row['app_id'])} ({row['source']}): {r['status']}", "", f"{escape_markdown(r['current_version'])} against {escape_markdown(r['baseline_version'])}: {r['decision']}{', blocking' if r['blocking'] else ''}. {REASONS[r['reason']]}", ""]
    if m := r["metrics"]:
        own, old = m["current"], m["baseline"]
        lines += ["| Metric | Current | Baseline | Change | Limit |", "| --- | ---: | ---: | ---: | ---: |"]
        lines += [f"| Average rating | {own['average_rating']} | {old['average_rating']} | {-m['rating_drop']:+.2f} | {-r['policy']['max_rating_drop']:+.2f} |"]
        lines += [f"| One and two stars | {_percent(own['negative_share'])} | {_percent(old['negative_share'])} | {m['negative_share_increase']:+.3f} | {r['policy']['max_negative_share_increase']:+.3f} |", ""]
    if (link := r["release_link"])["available"]:
        lines += [f"Link to a release: {link['level']}; {link['linked_count']} of {link['low_rating_count']} reviews of up to three stars name one or a change ({link['explicit_count']} explicitly).", ""]
    if (scope := r["actionability"])["available"]:
        lines += ["| " + " | ".join(s["scope"] for s in scope["scopes"]) + " |", "|" + " ---: |" * len(scope["scopes"]), "| " + " | ".join(str(s["count"]) for s in scope["scopes"]) + " |", ""]
    for i in r["issues"] or []:
        lines += [f"### {escape_markdown(i['label'])}", "", f"{i['count']} software reviews, {i['release_linked_count']} of a change, {i['explicit_release_count']} of a release{'' if i['supported'] else ' (not supported)'}.", "", *_cited(i["evidence"]), ""]
    for v in r["violations"] or []:
        lines += [f"### {v['severity']}: {escape_markdown(v['title'])}", "", f"{escape_markdown(v['id'])} {v['value']:+.3f} {v['unit']} (limit {v['threshold']})", "", *_cited(v["evidence"]), ""]
    return "\n".join(lines)


def write_text(content: str, path: str | None, force: bool = False) -> None:
    """To a file, which must be new unless force, with the folders on its way; without path to standard output."""
    if path is None:
        print(content, end="")
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w" if force else "x", encoding="utf-8", newline="") as file:
        file.write(content)


def ci_outputs(gate: Gate) -> dict[str, str]:
    """The verdict of a single application as names and values for a continuous integration job."""
    v = gate.verdicts.limit(1).collect()[0]
    return {"status": v.status, "decision": v.decision, "current-version": v.current_version or "", "baseline-version": v.baseline_version or "", "violations": str(v.violations)}
