"""Final tables and reports for people: CSV with a byte-order mark, XLSX, HTML.  These are small by nature: a row per document of one study."""

from __future__ import annotations

import html
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.schemas import EXPORT_NAMES

#: A final table is read by people; more rows than this belong in Parquet.
MAX_ROWS = 100_000


def with_extras(table: DataFrame, extras: DataFrame) -> DataFrame:
    """Columns of ``extras`` (doc, ...) beside the table's; arrays become text joined by semicolons."""
    fresh = [c for c in extras.columns if c != "doc" and c not in table.columns]
    cells = [F.array_join(c, "; ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in extras.dtypes if c in fresh]
    return table.join(extras.select("doc", *cells), "doc", "left")


def exported(table: DataFrame) -> DataFrame:
    """The shipped column names, in their fixed order, audit columns after them."""
    rest = [c for c in table.columns if c not in EXPORT_NAMES]
    return table.select(*(F.col(c).alias(n) for c, n in EXPORT_NAMES.items() if c in table.columns), *rest)


def write_table(table: DataFrame, folder: str, name: str, *, order_by: str = "doc") -> dict[str, Path]:
    """CSV (UTF-8 with BOM), and XLSX if openpyxl is there; more than ``MAX_ROWS`` rows are refused."""
    rows = exported(table.orderBy(order_by)).limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write Parquet instead")
    out = {"csv": Path(folder) / f"{name}.csv"}
    out["csv"].parent.mkdir(parents=True, exist_ok=True)
    if "evidencia_pagina" in rows:
        rows["evidencia_pagina"] = rows["evidencia_pagina"].astype("Int64")
    rows.to_csv(out["csv"], index=False, encoding="utf-8-sig")
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        return out
    out["xlsx"] = Path(folder) / f"{name}.xlsx"
    rows.to_excel(out["xlsx"], index=False, sheet_name="fichas")
    return out


def write_report(sections: Mapping[str, str | DataFrame], path: str, title: str = "Relatório") -> Path:
    """An HTML page: a heading per section, prose as paragraphs, DataFrames as tables, refused if they have more than ``MAX_ROWS`` rows."""
    parts = [f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, body in sections.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(body, str):
            parts.append(f"<p>{html.escape(body)}</p>")
        else:
            rows = body.limit(MAX_ROWS + 1).toPandas()
            if len(rows) > MAX_ROWS:
                raise ValueError(f"section {name!r} has more than {MAX_ROWS} rows; aggregate it first")
            parts.append(rows.to_html(index=False, na_rep="—"))
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(parts), encoding="utf-8")
    return out
