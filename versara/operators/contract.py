"""Contracts of answers: shapes of JSON, framing of streams, snapshots and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versara.functions.identity import canonical_json
from versara.operators.stats import upper_median

#: Values that change from one answer to the next and say nothing about it.
VOLATILE = ("timestamp", "storedAt", "generatedAt")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema: type (or a list of types), required, properties (closed unless
    ``additionalProperties`` is true), items, enum."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []

    def is_a(kind: str) -> bool:
        if kind == "null":
            return value is None
        if kind in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
        return isinstance(value, _KINDS[kind])

    if kinds and not any(is_a(k) for k in kinds):
        return [f"{path}: expected {' or '.join(kinds)}, found {type(value).__name__}"]
    out = [f"{path}: {value!r} isn't one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        if not schema.get("additionalProperties", False):
            out += [f"{path}: {k} isn't in the contract" for k in value if k not in known]
        for k, inner in known.items():
            if k in value:
                out += violations(value[k], inner, f"{path}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{i}]")
    return out


def schema_violations(df: DataFrame, schema: dict) -> list[str]:
    """Where a DataFrame's columns differ from a closed contract of names to Spark types."""
    have = dict(df.dtypes)
    return [f"{n}: expected {t}, found {have.get(n, 'nothing')}" for n, t in schema.items() if have.get(n) != t] + [f"{n} isn't in the contract" for n in have if n not in schema]


def frames(text: str) -> list[str]:
    """The top-level JSON objects of a stream, by matching braces outside strings; an unfinished one at the
    end is left out."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, quoted and (c != '"' or escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def redact(value):
    """A value without its volatile fields, at any depth."""
    if isinstance(value, dict):
        return {k: "<redacted>" if k in VOLATILE else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def snapshot(answers: dict[str, DataFrame], most: int = 1000) -> str:
    """Answers as canonical JSON, by request, for comparing before and after; ``most`` rows of each."""
    rows = {name: [redact(json.loads(x)) for x in df.limit(most).toJSON().collect()] for name, df in answers.items()}
    return canonical_json(rows)


def report(cells: DataFrame) -> DataFrame:
    """A markdown table of a probe matrix, line by line: one row per probe, one column per service."""
    names = [r.adapter for r in cells.select("adapter").distinct().orderBy("adapter").collect()]  # the services compared
    wide = cells.groupBy("dimension", "probe").pivot("adapter", names).agg(F.first(F.concat_ws(": ", "verdict", "summary")))
    line: Column = F.concat(F.lit("| "), F.concat_ws(" | ", "probe", *[F.coalesce(F.col(f"`{n}`"), F.lit("–")) for n in names]), F.lit(" |"))
    head = cells.sparkSession.createDataFrame([(0, "", f"| probe | {' | '.join(names)} |"), (1, "", f"|{'---|' * (len(names) + 1)}")], "part int, k string, line string")
    return head.unionByName(wide.select(F.lit(2).alias("part"), F.concat("dimension", "probe").alias("k"), line.alias("line"))).orderBy("part", "k").select("line")


def cpu_summary(samples: DataFrame) -> DataFrame:
    """Exact upper median and maximum of ``cpu_ms`` per path, with the number of samples."""
    return upper_median(samples, "path", "cpu_ms").select("path", "n", "median", F.col("largest").alias("worst"))
