"""Self-contained HTML pages of profiles, comparisons and audit samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:.2em .6em;border-bottom:1px solid #ddd;text-align:right}td:first-child,th:first-child{text-align:left}svg rect{fill:#468}"


def _cell(v: object) -> str:
    return escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))


def table(rows: Sequence[Mapping], columns: Sequence[str] | None = None) -> str:
    columns = list(columns or (rows[0] if rows else ()))
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def bars(counts: Sequence[float], width: int = 240, height: int = 40) -> str:
    """A histogram as inline SVG."""
    top, step = max([*counts, 1]), width / max(1, len(counts))
    rects = "".join(f'<rect x="{i * step:.1f}" y="{height * (1 - c / top):.1f}" width="{max(step - 1, 0.5):.1f}" height="{height * c / top:.1f}"/>' for i, c in enumerate(counts))
    return f'<svg width="{width}" height="{height}" role="img" aria-label="histogram">{rects}</svg>'


def page(title: str, *parts: str) -> str:
    return f"<!doctype html><html lang=en><meta charset=utf-8><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1>{''.join(parts)}</html>"


def _matrix(pairs: Mapping[tuple[str, str], float | None]) -> str:
    """Correlations as a grid, coloured by sign and strength."""
    names = list(dict.fromkeys(x for p in pairs for x in p))
    both = {**pairs, **{(b, a): r for (a, b), r in pairs.items()}}
    shade = lambda r: "#fff" if r is None else f"rgba({'200,60,40' if r < 0 else '40,90,200'},{abs(r):.2f})"
    cell = lambda a, b: "<td></td>" if a == b else f'<td style="background:{shade(both.get((a, b)))}">{_cell(both.get((a, b)))}</td>'
    return f"<table><tr><th></th>{''.join(f'<th>{escape(n)}</th>' for n in names)}</tr>" + "".join(f"<tr><th>{escape(a)}</th>{''.join(cell(a, b) for b in names)}</tr>" for a in names) + "</table>"


def profile_page(title: str, profile: Mapping, views: Mapping[str, Mapping], pearson: Mapping | None = None, ranks: Mapping | None = None) -> str:
    """Each view's features with their histograms, values and span; correlations of all rows."""
    parts = [table([{"view": n, "rows": v["n"]} for n, v in views.items()])]
    for name, v in views.items():
        rows = [{"feature": f} | {k: s.get(k) for k in ("n", "n_null", "n_zero", "lo", "hi")} | {"mean": s["sum_t"] / s["n"] if s.get("n") else None} for f, s in v["numeric"].items()]
        drawn = "".join(f"<figure><figcaption>{escape(f)}</figcaption>{bars([s['hist'][b] for b in sorted(s['hist'])])}</figure>" for f, s in v["numeric"].items())
        words = "".join(f"<h3>{escape(c)}</h3>{table([{'value': x, 'rows': n} for x, n in counts.most_common(20)])}" for c, counts in v["categorical"].items())
        parts.append(f"<h2>{escape(name)}</h2>{table(rows)}{drawn}{words}")
    for heading, found in (("Correlation", pearson), ("Rank correlation", ranks)):
        parts += [f"<h2>{heading}</h2>{_matrix(found)}"] if found else []
    if profile.get("skipped_features"):
        parts.append(f"<p>Not measured: {escape(', '.join(profile['skipped_features']))}</p>")
    return page(title, *parts)


def comparison_page(title: str, report: Mapping) -> str:
    """A comparison's sections, each under its heading."""
    heads = {"classes": "Classes", "features": "Features", "categorical": "Values", "macro": "Mean over the others", "flips": "Labels that flip", "correlation_drift": "Correlations that drift", "rank_drift": "Rank correlations that drift"}
    return page(title, *(f"<h2>{h}</h2>{table(report[k]) if report[k] else '<p>none</p>'}" for k, h in heads.items()))


def index_page(title: str, entries: Sequence[Mapping]) -> str:
    """A page of links: entries have href and name, and whatever else is shown beside them."""
    shown = [k for k in dict.fromkeys(k for e in entries for k in e) if k not in ("href", "name")]
    head = "".join(f"<th>{escape(k)}</th>" for k in ("page", *shown))
    rows = "".join(f'<tr><td><a href="{escape(str(e["href"]))}">{escape(str(e["name"]))}</a></td>' + "".join(f"<td>{_cell(e.get(k))}</td>" for k in shown) + "</tr>" for e in entries)
    return page(title, f"<table><tr>{head}</tr>{rows}</table>")


def adjudication_page(title: str, rows: Sequence[Mapping], classes: Sequence[str], context: Mapping[str, Sequence[Mapping]] | None = None) -> str:
    """A page on which an analyst picks a class for each flow and saves the verdicts as CSV."""
    options = "".join(f"<option>{escape(c)}</option>" for c in ("", "unknown", *classes))
    items = "".join(f'<section data-uid="{escape(str(r["uid"]))}"><h3>{escape(str(r["uid"]))}</h3>{table([r])}<select>{options}</select>{table((context or {}).get(r["uid"], ())) if context else ""}</section>' for r in rows)
    script = """<button onclick="const q=s=>'"'+s.replaceAll('"','""')+'"';const t=['uid,analyst_class',...[...document.querySelectorAll('section')].map(s=>q(s.dataset.uid)+','+q(s.querySelector('select').value))].join('\\n');const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([t]));a.download='verdicts.csv';a.click()">save</button>"""
    return page(title, items, script)
