"""CSV and HTML of small audit tables."""

from __future__ import annotations

import csv
import html


def write_csv(path: str, rows: list[dict], fields: list[str]) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fields, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)


def table(rows: list[dict], fields: list[str]) -> str:
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(f'{x:,.0f}' if isinstance(x, float) else str(x))}</{tag}>" for x in xs)
    return "<table><tr>" + cells("th", fields) + "</tr>" + "".join(f"<tr>{cells('td', [r.get(f, '') for f in fields])}</tr>" for r in rows) + "</table>"


def bars(title: str, bins: list[tuple[str, int]], width: int = 400) -> str:
    most = max((n for _, n in bins), default=0) or 1
    lines = "".join(f'<text x="0" y="{20 * i + 14}">{html.escape(name)}</text><rect x="140" y="{20 * i + 2}" width="{width * n / most:.0f}" height="15"/><text x="{145 + width * n / most:.0f}" y="{20 * i + 14}">{n:,}</text>' for i, (name, n) in enumerate(bins))
    return f'<h3>{html.escape(title)}</h3><svg width="{width + 240}" height="{20 * len(bins)}">{lines}</svg>'


def report(title: str, sections: list[str]) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(sections)}</body></html>"
