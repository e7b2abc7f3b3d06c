"""The relations of the evidence model, derived from the driver's tables.

The same derivations are given twice: as DataFrames, and as SQL views for DuckDB (ROLE_SQL).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_COLUMNS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Room for the lines of an order in their ids; keys up to 9e11 fit into 64 bits, beyond these the product overflows with an error.
LINES = 10_000_000


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def scope(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").cast("long").alias("scope_id"), F.col("n_name").alias("scope_name"), F.col("n_regionkey").cast("long").alias("region_id"))

    @cached_property
    def paper(self) -> DataFrame:
        last = F.col("c_custkey") % 10
        return self.read("customer").select(
            F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"),
            F.when(last <= 6, "parsed").when(last <= 8, "abstract_only").otherwise("failed").alias("parse_status"),
            (F.col("c_custkey") % 3 == 0).alias("is_preprint"), F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def paper_scope(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").cast("long").alias("scope_id"))

    @cached_property
    def claim(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("claim_type"), F.col("o_orderstatus").alias("predicate"),
            F.col("o_totalprice").alias("object_value"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 5 == 1, F.col("o_orderkey") - 1).alias("canonical_claim_id"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Ids number the lines of an order; an order of LINES or more fails instead of taking the ids of the next."""
        at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_COLUMNS))
        return self.read("lineitem").select(
            F.when(at < LINES, F.col("l_orderkey") * LINES + at).otherwise(F.raise_error(F.lit("too many lines in one order")).cast("long")).alias("evidence_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("tree_node_id"), F.col("l_suppkey").alias("paper_id"),
            F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "refutes").otherwise("mentions").alias("stance"),
            (F.col("l_linestatus") == "F").alias("is_direct"), F.col("l_shipdate").alias("created_at"), F.col("l_quantity").alias("quantity"),
        )

    @cached_property
    def score(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("score_id"), F.col("user_id").alias("claim_id"), (F.floor("value") % 101).cast("long").alias("confidence"),
            F.get_json_object("props", "$.k").cast("long").alias("evidence_quality"), F.col("ts").alias("scored_at"),
        )

    @cached_property
    def mention(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("mention_id"), F.col("event_type").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("paper_id"), F.col("ts").alias("created_at"),
            F.floor("value").cast("long").alias("score"), F.col("user_id").alias("author_id"),
        )

    @cached_property
    def observation(self) -> DataFrame:
        return self.read("conversations").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("observation_id"), F.col("role").alias("model"), F.col("text").alias("claim_text"))

    @cached_property
    def section(self) -> DataFrame:
        """A node for each line of a document that is not blank, numbered from 0; three to a parent."""
        lines = self.read("documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("venue"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
        each = lines.select("paper_id", "venue", F.posexplode("lines").alias("node", "body"))
        return each.select("paper_id", "venue", F.col("node").cast("long").alias("node"), F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 3).cast("long")).alias("parent"), "body")


ROLE_SQL = """
scope AS (SELECT n_nationkey::BIGINT AS scope_id, n_name AS scope_name, n_regionkey::BIGINT AS region_id FROM nation),
paper AS (SELECT c_custkey AS paper_id, c_name AS title, c_mktsegment AS venue, CASE WHEN c_custkey % 10 <= 6 THEN 'parsed' WHEN c_custkey % 10 <= 8 THEN 'abstract_only' ELSE 'failed' END AS parse_status,
  c_custkey % 3 = 0 AS is_preprint, c_acctbal AS balance FROM customer),
paper_scope AS (SELECT c_custkey AS paper_id, c_nationkey::BIGINT AS scope_id FROM customer),
claim AS (SELECT o_orderkey AS claim_id, o_custkey AS paper_id, o_orderpriority AS claim_type, o_orderstatus AS predicate, o_totalprice AS object_value, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey - 1 END AS canonical_claim_id FROM orders),
evidence AS (SELECT l_orderkey * 10000000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS evidence_id,
  l_orderkey AS claim_id, l_partkey AS tree_node_id, l_suppkey AS paper_id, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'refutes' ELSE 'mentions' END AS stance,
  l_linestatus = 'F' AS is_direct, l_shipdate AS created_at, l_quantity AS quantity FROM lineitem),
score AS (SELECT event_id AS score_id, user_id AS claim_id, floor(value)::BIGINT % 101 AS confidence, json_extract_string(props, '$.k')::BIGINT AS evidence_quality, ts AS scored_at FROM events),
mention AS (SELECT event_id AS mention_id, event_type AS source, json_extract_string(props, '$.k')::BIGINT AS paper_id, ts AS created_at, floor(value)::BIGINT AS score, user_id AS author_id FROM events),
observation AS (SELECT conv_id AS claim_id, turn AS observation_id, role AS model, text AS claim_text FROM conversations),
section_lines AS (SELECT doc_id AS paper_id, source AS venue, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS body, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS node FROM documents),
section AS (SELECT paper_id, venue, node, CASE WHEN node > 0 THEN (node - 1) // 3 END AS parent, body FROM section_lines)
"""
