"""Readers and writers: CSV, JSON lines, NPZ archives, snapshots, and a compact text codec."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A CSV with a header, numbers inferred; rows with an empty key (the first column unless
    named) are an error."""
    df = spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')
    return _keyed(df, key or df.columns[0])


def ingest_jsonl(spark: SparkSession, path: str, key: str) -> DataFrame:
    """JSON lines; arrays of numbers become vectors of doubles."""
    df = spark.read.json(path)
    for c, kind in df.dtypes:
        if kind in ("array<bigint>", "array<double>"):
            df = df.withColumn(c, F.col(c).cast("array<double>"))
    return _keyed(df, key)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    check = F.when(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), F.raise_error(F.lit(f"empty key in {key}"))).otherwise(F.col(key))
    return df.withColumn(key, check)


def ingest_npz(spark: SparkSession, path: str) -> DataFrame:
    """(array_name, row_idx, vector): one record for each slice of each member's outer axis."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in z.files:
                        a = np.atleast_1d(z[name])
                        for at in range(0, len(a), 1024):
                            part = a[at : at + 1024].reshape(len(a[at : at + 1024]), -1).astype(float)
                            yield pd.DataFrame({"array_name": name, "row_idx": range(at, at + len(part)), "vector": list(part)})

    return raw.mapInPandas(run, "array_name string, row_idx long, vector array<double>")


def contained(root: str, path: str) -> str:
    """The path inside the root, or an error: nothing may be written outside it."""
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([os.path.realpath(root), full]) != os.path.realpath(root):
        raise PermissionError(f"{path} leaves {root}")
    return full


def emit_csv(df: DataFrame, root: str, path: str, single: bool = False) -> str:
    """CSV with a header and sorted columns, RFC 4180 quoting; a folder of parts unless single."""
    full = contained(root, path)
    out = df.select(*sorted(df.columns))
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(full, header=True, quote='"', escape='"')
    return full


def emit_json(df: DataFrame, root: str, path: str) -> str:
    full = contained(root, path)
    df.write.mode("overwrite").json(full)
    return full


def as_json(df: DataFrame) -> DataFrame:
    """(line): each record as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """A named Parquet copy; reading it later is reading the table as it was."""
    full = contained(root, name)
    df.write.mode("errorifexists").parquet(full)
    return full


def profile(df: DataFrame) -> DataFrame:
    """(field, kind, rows, nulls, distinct, low, high, most_common): one pass of aggregates; the role
    is 'constant', 'interned' (few values), 'arithmetic' (integers that fill their range once) or
    'variable'."""
    row = df.agg(F.count("*").alias("__n"), *[x for c in df.columns for x in (F.count(c).alias(f"{c}|v"), F.approx_count_distinct(c).alias(f"{c}|d"), F.min(c).cast("string").alias(f"{c}|lo"), F.max(c).cast("string").alias(f"{c}|hi"))])
    parts = []
    for c, kind in df.dtypes:
        d, v = F.col(f"`{c}|d`"), F.col(f"`{c}|v`")
        whole = kind in ("int", "bigint", "smallint")
        span = (F.expr(f"try_cast(`{c}|hi` as double)") - F.expr(f"try_cast(`{c}|lo` as double)") + 1) if whole else F.lit(None)
        role = F.when(d <= 1, "constant").when(F.lit(whole) & (F.abs(span - v) < 0.5) & (d > 0.9 * v), "arithmetic").when(d <= F.least(F.lit(256), v / 4), "interned").otherwise("variable")
        parts.append(F.struct(F.lit(c).alias("field"), F.lit(kind).alias("type"), F.col("__n").alias("rows"), (F.col("__n") - v).alias("nulls"), d.alias("distinct"), F.col(f"`{c}|lo`").alias("low"), F.col(f"`{c}|hi`").alias("high"), role.alias("role")))
    return row.select(F.inline(F.array(*parts)))


# -- Compact text codec: a header line of field rules, then one line a record
#
# Rules after a field's name: '@start+step' arithmetic, left out of the lines; '|value' a default,
# written as an empty cell; '&' interned, numbers into the list in the header; '^' difference from
# the line before. Cells are separated by tabs; backslash escapes backslash, tab, newline; '\N' is
# null and '\E' an empty text.

_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n"}


def _cell(v) -> str:
    if v is None:
        return "\\N"
    s = json.dumps(v) if not isinstance(v, str) else "".join(_ESCAPES.get(c, c) for c in v)
    return s if s else "\\E"


def _text(cell: str) -> str:
    out, i = [], 0
    while i < len(cell):
        if cell[i] == "\\":
            out.append({"t": "\t", "n": "\n"}.get(cell[i + 1], cell[i + 1]))
            i += 1
        else:
            out.append(cell[i])
        i += 1
    return "".join(out)


def encode(records: list[dict]) -> str:
    """Records of one shape as text; decode gives them back."""
    fields = list(records[0]) if records else []
    rules, columns = {}, {f: [r.get(f) for r in records] for f in fields}
    for f, v in columns.items():
        whole = all(isinstance(x, int) and not isinstance(x, bool) for x in v)
        step = v[1] - v[0] if whole and len(v) > 1 else None
        texts = all(isinstance(x, str) for x in v)
        common = max(set(map(_cell, v)), key=[_cell(x) for x in v].count)
        if step is not None and all(b - a == step for a, b in zip(v, v[1:])):
            rules[f] = {"rule": "@", "start": v[0], "step": step}
        elif [_cell(x) for x in v].count(common) * 2 > len(v):
            rules[f] = {"rule": "|", "value": v[[_cell(x) for x in v].index(common)], "text": texts}
        elif texts and len(set(v)) * 2 <= len(v):
            rules[f] = {"rule": "&", "list": sorted(set(v))}
        elif whole and len(v) > 1:
            rules[f] = {"rule": "^"}
        else:
            rules[f] = {"rule": "", "text": texts or any(isinstance(x, str) for x in v)}
    lines = [json.dumps({"fields": rules, "rows": len(records)}, ensure_ascii=False)]
    for i in range(len(records)):
        cells = []
        for f, rule in rules.items():
            x, kind = columns[f][i], rule["rule"]
            if kind == "@":
                continue
            if kind == "|":
                cells.append("" if _cell(x) == _cell(rule["value"]) else ("s" if isinstance(x, str) else "j") + _cell(x))
            elif kind == "&":
                cells.append(str(rule["list"].index(x)))
            elif kind == "^":
                cells.append(str(x - (columns[f][i - 1] if i else 0)))
            else:
                cells.append(("s" if isinstance(x, str) else "j") + _cell(x))
        lines.append("\t".join(cells))
    return "\n".join(lines)


def _value(cell: str):
    kind, body = cell[0], cell[1:]
    if body == "\\N":
        return None
    return ("" if body == "\\E" else _text(body)) if kind == "s" else json.loads(body)


def decode(text: str) -> list[dict]:
    head, *lines = text.split("\n")
    shape = json.loads(head)
    rules, out, last = shape["fields"], [], {}
    for i in range(shape["rows"]):
        cells = iter(lines[i].split("\t") if i < len(lines) and lines[i] else [""] * len(rules))
        r = {}
        for f, rule in rules.items():
            kind = rule["rule"]
            if kind == "@":
                r[f] = rule["start"] + i * rule["step"]
                continue
            cell = next(cells)
            if kind == "|":
                r[f] = rule["value"] if cell == "" else _value(cell)
            elif kind == "&":
                r[f] = rule["list"][int(cell)]
            elif kind == "^":
                r[f] = last[f] = int(cell) + last.get(f, 0)
            else:
                r[f] = _value(cell)
        out.append(r)
    return out


def encode_blocks(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """(block): the records of each partition as encoded texts of at most `rows` records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for pdf in batches:
            held += [json.loads(x) for x in pdf.line]
            while len(held) >= rows:
                yield pd.DataFrame({"block": [encode(held[:rows])]})
                held = held[rows:]
        if held:
            yield pd.DataFrame({"block": [encode(held)]})

    whole = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    return whole.mapInPandas(run, "block string")


def decode_blocks(df: DataFrame, schema: str) -> DataFrame:
    """The records of encoded texts, read with the schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf.block:
                yield pd.DataFrame({"line": [json.dumps(r) for r in decode(block)]})

    return df.mapInPandas(run, "line string").select(F.from_json("line", schema).alias("r")).select("r.*")
