"""The score card: small result tables as one HTML page that refuses to leave out what limits them."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame

#: What every card has to state.
HONESTY = ("instruments", "bars", "costs", "trials", "folds", "data_gaps", "known_limits")


def render(title: str, honesty: dict[str, object], tables: dict[str, DataFrame], most_rows: int = 500) -> str:
    """HTML of a card. A missing statement or a table above `most_rows` is an error, not an omission."""
    missing = [k for k in HONESTY if honesty.get(k) in (None, "")]
    if missing:
        raise ValueError(f"the card does not state: {', '.join(missing)}")
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><dl>"]
    parts += [f"<dt>{html.escape(k)}</dt><dd>{html.escape(str(honesty[k]))}</dd>" for k in HONESTY]
    parts.append("</dl>")
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"table {name} has more than {most_rows} rows")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)


def write(path: str, page: str) -> None:
    draft = f"{path}.draft"
    with open(draft, "w", encoding="utf-8") as out:
        out.write(page)
    os.replace(draft, path)
