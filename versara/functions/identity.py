"""Identity of corpora: canonical JSON and SHA-256 over contents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

#: The versions that enter a generation's manifest.
VERSIONS = {"schemaVersion": 1, "parserVersion": 3, "normalizationPolicyVersion": 2, "canonicalMetadataVersion": 2}
#: Marks a value that isn't there (as against null, which is kept).
ABSENT = object()


def canonical_json(value) -> str:
    """Keys sorted at every depth, no spaces, arrays in order, nulls kept, absent values left out."""
    if isinstance(value, dict):
        inner = (f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be")) if v is not ABSENT)
        return "{" + ",".join(inner) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical_json(None if v is ABSENT else v) for v in value) + "]"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def sha256_hex(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def revision_id(source: bytes) -> str:
    """Names the source's bytes, and nothing about how they were read."""
    return sha256_hex(source)


def generation_id(manifest: dict) -> str:
    """Names a generation of artifacts: any change of contents, versions or metadata changes it; time never
    enters it."""
    return sha256_hex(canonical_json(manifest))


def manifest(edition: str, revision: str, source: dict, artifacts: list[dict], corpus: dict) -> dict:
    return VERSIONS | {"editionId": edition, "revisionId": revision, "sourceArchive": source, "artifacts": artifacts, "corpus": corpus}


def row_sha256(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def fingerprint(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """One SHA-256 over all rows' digests in key order, as a tree: 4,096 keys make a leaf, 4,096 leaves a
    branch, and the branches the root; no task gathers more than one node's children."""
    level = rows.select(F.col(key).alias("k"), digest.alias("h"))
    for _ in range(2):
        level = _node(level.groupBy(F.expr("k div 4096").alias("k")))
    return _node(level.groupBy()).select(F.col("h").alias("fingerprint"))


def _node(grouped: GroupedData) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct(F.col("k").alias("child"), "h")))
    return grouped.agg(F.sha2(F.concat_ws("", F.transform(children, lambda r: r["h"])), 256).alias("h"))
