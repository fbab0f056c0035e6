"""Raw payload envelopes: one JSON document per file, verified in parallel by content and by name."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields of an envelope by its version.
CONTENT = ["schema_version", "source", "operation", "query", "fields", "rows"]
BODY = {1: [*CONTENT, "content_sha256", "received_at"], 2: [*CONTENT, "content_sha256", "received_at", "envelope_sha256"]}
SCHEMA = "path string, valid boolean, reason string, source string, operation string, query map<string,string>, rows array<map<string,string>>, payload_sha256 string, received_at timestamp"


def canonical(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def files(spark: SparkSession, root: str) -> DataFrame:
    """Envelope files under <root>/<source>/<operation>/: path, content and the order they are processed in."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root).select("path", "content")
    parts = F.split("path", "/")
    return found.withColumns({"source_dir": F.element_at(parts, -3), "operation_dir": F.element_at(parts, -2), "name": F.element_at(parts, -1)})


def _check(path: str, content: bytes) -> tuple[str | None, dict]:
    """(what is wrong, the envelope)."""
    try:
        e = json.loads(content)
    except ValueError:
        return "not JSON", {}
    if not isinstance(e, dict) or e.get("schema_version") not in BODY or set(e) != set(BODY[e["schema_version"]]):
        return "fields", {}
    if not isinstance(e["rows"], list) or any(not isinstance(r, dict) or set(r) != set(e["fields"]) for r in e["rows"]):
        return "row fields", {}
    if canonical(e) != content.strip():
        return "not canonical", {}
    if hashlib.sha256(canonical({k: e[k] for k in CONTENT})).hexdigest() != e["content_sha256"]:
        return "content hash", {}
    if "envelope_sha256" in e and hashlib.sha256(canonical({k: v for k, v in e.items() if k != "envelope_sha256"})).hexdigest() != e["envelope_sha256"]:
        return "envelope hash", {}
    parts = path.split("/")
    if parts[-3] != e["source"] or parts[-2] != e["operation"] or e["content_sha256"] not in parts[-1]:
        return "address", {}
    return None, e


def verify(found: DataFrame) -> DataFrame:
    """One row for each file: valid or the reason, and what is in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                reason, e = _check(path, bytes(content))
                text = {k: str(v) for k, v in (e.get("query") or {}).items()} if e else None
                rows.append((path, reason is None, reason, e.get("source"), e.get("operation"), text, [{k: str(v) for k, v in r.items()} for r in e["rows"]] if e else None, e.get("content_sha256"), pd.Timestamp(e["received_at"]).tz_convert("UTC") if e else None))
            yield pd.DataFrame(rows, columns=["path", "valid", "reason", "source", "operation", "query", "rows", "payload_sha256", "received_at"])

    return found.select("path", "content").mapInPandas(run, SCHEMA)


def audit(verified: DataFrame) -> DataFrame:
    return verified.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("files"))


def raw_rows(verified: DataFrame) -> DataFrame:
    """The rows of valid envelopes as the normalisers take them."""
    good = verified.filter("valid")
    return good.select("path", F.posexplode("rows").alias("row_index", "row"), "operation", "query", "source", "received_at", "payload_sha256")


def latest_payload(verified: DataFrame) -> DataFrame:
    """Of each exact query the payload received last."""
    exact = F.to_json(F.array_sort(F.map_entries("query")))
    order = W.partitionBy("source", "operation", exact).orderBy(F.desc("received_at"), F.desc("payload_sha256"))
    return verified.filter("valid").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
