"""Written forms: spreadsheets, canonical activity files, canonical JSON records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.tabular import guard_cell

#: Columns of a canonical activity file, in order.
ACTIVITY_COLUMNS = ("activity_id", "activity_name", "volume", "measurement", "structure", "edges", "granular_unit")


def workbooks(df: DataFrame) -> DataFrame:
    """(path, content): one XLSX file for each Arrow batch of rows, with a header row and inline strings.

    Nulls leave their cell out. A batch has at most spark.sql.execution.arrow.maxRecordsPerBatch rows, so a file's size is
    bounded. An empty table gives no file.
    """
    names = df.columns

    def run(batches: Iterator) -> Iterator:
        import io
        import uuid
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        def cell(v: object) -> str:
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                return f"<v>{v}</v>"
            return f"<is><t>{escape(str(v))}</t></is>"

        def line(n: int, values: list) -> str:
            cells = "".join(f'<c r="{column(k)}{n}"{"" if isinstance(v, (int, float)) else ' t="inlineStr"'}>{cell(v)}</c>' for k, v in enumerate(values) if v is not None)
            return f'<row r="{n}">{cells}</row>'

        def column(k: int) -> str:
            return (column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            lines = [line(1, names), *(line(n, list(r)) for n, r in enumerate(rows, 2))]
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
                book.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{''.join(lines)}</sheetData></worksheet>")
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.xlsx"]), pa.array([held.getvalue()], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """The JSON text of a row with its keys sorted, without spaces and with nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_activities(rows: DataFrame, path: str) -> None:
    """Canonical activity files below path: the seven columns, nested cells as compact JSON, a comma between cells, line
    feeds, quotes only where needed, cells that a spreadsheet would run as a formula guarded; null is an empty cell.

    An existing path is an error: a result that is written once stays as it is.
    """
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "struct")}
    cells = [F.to_json(c) if c in nested else guard_cell(F.col(c).cast("string")) for c in ACTIVITY_COLUMNS]
    held = rows.select(*(F.coalesce(v, F.lit("")).alias(c) for v, c in zip(cells, ACTIVITY_COLUMNS, strict=True)))
    options = {"header": True, "sep": ",", "escape": '"', "lineSep": "\n", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    held.write.mode("errorifexists").options(**options).csv(path)


def parse_nested(c: Column) -> Column:
    """Compact JSON of a nested cell written as JSON or as a Python literal of lists, mappings, texts and numbers, with
    sorted keys; null for a blank cell, for anything else and beyond three levels."""

    @F.pandas_udf("string")
    def literals(cells):  # noqa: ANN001, ANN202
        import ast
        import json

        def depth(v: object) -> int:
            inner = v.values() if isinstance(v, dict) else v if isinstance(v, list | tuple) else None
            return 0 if inner is None else 1 + max(map(depth, inner), default=0)

        def refuse(word: str) -> None:
            raise ValueError(word)

        def plain(text: str | None) -> str | None:
            for read in (lambda t: json.loads(t, parse_constant=refuse), ast.literal_eval):
                try:
                    value = read(text.strip())
                    fits = isinstance(value, list | dict | tuple) and depth(value) <= 3
                    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False) if fits else None
                except (ValueError, SyntaxError, TypeError, AttributeError, RecursionError, MemoryError):
                    continue
            return None

        return cells.map(plain)

    return literals(c)
