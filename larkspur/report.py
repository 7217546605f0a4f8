"""A report of answers and charts as one HTML page."""

from __future__ import annotations

import json
from html import escape
from string import Template

PAGE = Template(
    "<!doctype html><html><head><meta charset='utf-8'><title>$title</title></head><body><h1>$title</h1>"
    "<h2>Summary</h2><ul>$summary</ul>$answers<h2>Charts</h2>$charts<h2>Sources</h2><ul>$sources</ul><h2>Caveats</h2><ul>$caveats</ul></body></html>"
)
SUMMARY = 6


def _list(items) -> str:
    return "".join(f"<li>{escape(str(x))}</li>" for x in items)


def _table(rows: list[dict]) -> str:
    if not rows:
        return ""
    head = "".join(f"<th>{escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def render(title: str, answers: list[tuple[str, dict]], charts: list[dict], sources: list[str], caveats: list[str]) -> str:
    parts = []
    for question, a in answers:
        notes = _list([*a["assumptions"], *a["notes"]])
        parts.append(f"<section><h3>{escape(question)}</h3><p>{escape(a['headline'])}</p>{_table(a['rows'])}<ul>{notes}</ul><p><small>{escape(a['provenance'])}</small></p></section>")
    drawn = "".join(f"<figure><figcaption>{escape(c['title'])}</figcaption><pre>{escape(json.dumps(c['spec'], ensure_ascii=False, default=str))}</pre></figure>" for c in charts)
    return PAGE.substitute(title=escape(title), summary=_list(a["headline"] for _, a in answers[:SUMMARY]), answers="".join(parts), charts=drawn, sources=_list(sources), caveats=_list(caveats))
