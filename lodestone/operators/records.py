"""Records of an extraction: payloads of several shapes turned into rows, each with a reason if it is no good."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_quantity

#: The field that tells a type, the required texts of each type, and what else it may have.
TELLS = {"claim_text": "claim", "method_text": "method", "result_text": "result", "dataset_name": "dataset", "metric_name": "metric"}
NEEDED = {"claim": ["claim_text", "normalized_text", "claim_type"], "method": ["method_text"], "result": ["result_text"], "dataset": ["dataset_name"], "metric": ["metric_name"]}
OPTIONAL = {"claim": ["subject", "predicate", "object_value", "unit"], "dataset": ["description"], "metric": ["object_value", "unit"]}
ANCHOR, ORIGIN = "tree_node_id", ["extraction_model", "prompt_version"]
ROW = "at int, record_type string, tree_node_id long, body string, claim_type string, object_value double, unit string, reason string"


def unpack(payload: object) -> list:
    """The records of a text, an object, an object of `records` or a list; ValueError for anything else."""
    for _ in range(3):  # texts may hold texts
        if not isinstance(payload, str):
            break
        payload = json.loads(payload)
    if payload is None:
        return []
    if isinstance(payload, dict):
        payload = payload.get("records", [payload])
    if not isinstance(payload, list):
        raise ValueError("no list of records")
    return payload


def judge(record: object) -> tuple:
    """(type, node, main text, claim type, value, unit, reason) of one record; no reason for a good one."""
    none = (None, None, None, None, None, None)
    if not isinstance(record, dict):
        return *none, "not a record"
    node = record.get(ANCHOR)
    if node in (None, "", 0):
        return *none, ANCHOR
    try:
        node = int(node)
    except (TypeError, ValueError):
        return *none, "not a node id"
    said = record.get("record_type") or record.get("type")
    kind = said if said in NEEDED else next((k for f, k in TELLS.items() if f in record), None)
    if kind is None:
        return None, node, *none[2:], "record type"
    fields = {k: v.strip() if isinstance(v, str) else v for k, v in record.items() if k not in ("record_type", "type", ANCHOR)}
    for name in [*ORIGIN, *NEEDED[kind]]:
        if not isinstance(fields.get(name), str) or not fields[name]:
            return kind, node, *none[2:], name
    strange = sorted(fields.keys() - {*ORIGIN, *NEEDED[kind], *OPTIONAL.get(kind, [])})
    if strange:
        return kind, node, *none[2:], f"unknown {strange[0]}"
    value, unit = fields.get("object_value"), fields.get("unit")
    if isinstance(value, str):
        value, own = split_quantity(value)
        unit = unit or own
    if value is not None and not isinstance(value, (int, float)):
        return kind, node, *none[2:], "object_value"
    return kind, node, fields[NEEDED[kind][0]], fields.get("claim_type"), None if value is None else float(value), unit, None


def read_records(raw: DataFrame, batch: str, payload: str) -> DataFrame:
    """A row for each record of each payload; a payload that can't be read gives one row with no place."""
    kind = raw.schema[batch].dataType.simpleString()
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, text in zip(part[batch], part[payload], strict=True):
                try:
                    rows += [(key, k, *judge(x)) for k, x in enumerate(unpack(text))]
                except ValueError:  # json's errors are of this kind
                    rows.append((key, None, *[None] * 6, "malformed payload"))
            yield pd.DataFrame(rows, columns=[batch, *names]).astype({"at": "Int32", "tree_node_id": "Int64", "object_value": "Float64"})

    return raw.select(batch, payload).mapInPandas(run, f"`{batch}` {kind}, {ROW}")


def within_paper(records: DataFrame, nodes: DataFrame, batch: str) -> DataFrame:
    """Records that cite a node outside of their batch's own (batch, tree_node_id) get a reason as well."""
    own = nodes.select(batch, "tree_node_id").distinct().withColumn("_own", F.lit(True))
    outside = F.col("reason").isin(ANCHOR, "not a node id", "not a record", "malformed payload")
    reason = F.when(F.col("_own").isNull() & ~F.coalesce(outside, F.lit(False)), "outside the paper").otherwise(F.col("reason"))
    return records.join(own, [batch, "tree_node_id"], "left").withColumn("reason", reason).drop("_own").select(batch, *[c.split()[0] for c in ROW.split(", ")])


def stamp(df: DataFrame, **constants: object) -> DataFrame:
    """Every row with the provenance of its run."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in constants.items()])
