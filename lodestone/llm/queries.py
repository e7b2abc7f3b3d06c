"""The registered queries of the corpus operators, by the contracts of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import has_table, table
from .decontaminate import contamination_report
from .html_text import extract_text
from .license_scan import scan_licenses
from .minhash_dedup import near_duplicates
from .mixing import mix
from .packing import pack
from .quality import fitted_quality, quality
from .sharding import shard_by_bytes
from .suffix_dedup import remove_repeats
from .toxicity import held_out, score, train
from .url_filter import judge_urls, rule_table
from .vector_codes import encode
from .whitening import whiten


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fitted_quality(docs, table(spark, sf_dir, "labels")) if has_table(spark, sf_dir, "labels") else quality(docs)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels.where(~held_out("doc_id"))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_mixing": op11_mixing,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}


def _codes_sql(rounds: int) -> str:
    """The rounds of op12 one after the other; all numbers are integers that doubles hold exactly."""
    nearest = "SELECT n, p.part, p.v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT n, p.part, p.v, entry, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) AS d FROM p JOIN b{0} b USING (part)) p GROUP BY 1, 2, 3"
    after = "SELECT part, entry, coalesce(m.v, o.v) AS v FROM b{0} o LEFT JOIN (SELECT part, entry, list(floor(s / k) ORDER BY pos) AS v FROM (SELECT part, entry, pos, sum(c) AS s, count(*) AS k FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM a{0}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry)"
    steps = ",\n        ".join(f"a{k} AS MATERIALIZED ({nearest.format(k)}), b{k + 1} AS MATERIALIZED ({after.format(k)})" for k in range(rounds))
    return f"""
        WITH e AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT n, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS v FROM e, range(8) t(part)),
        b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT n, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 16) USING (n)),
        {steps},
        f AS ({nearest.format(rounds)}),
        c AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY 1),
        h AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS digest FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS pos FROM b{rounds}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM e JOIN c USING (n), h
    """


ORACLE_SQL: dict[str, str] = {
    "op11_mixing": r"""
        WITH d AS (SELECT doc_id, source, row_number() OVER () AS n, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>{}\[\]=\\]')) AS symbols,
            (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
        k AS (SELECT *, CASE WHEN size > 0 THEN -ln(u) / ((CASE WHEN size < 10 THEN 0.5 ELSE 1 END)::DOUBLE * size / (size + 4 * symbols + 1)) ELSE 0 END AS key FROM d),
        s AS (SELECT source, sum(size) AS source_size FROM k GROUP BY 1),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared FROM w),
        l AS (SELECT max(((SELECT sum(size) FROM k) - spent)::DOUBLE / shared) AS level FROM c),
        t AS (SELECT source, source_size::BIGINT AS source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM w, l),
        r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, n ROWS UNBOUNDED PRECEDING) - size AS before FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(round(target - epochs * source_size) - before, 0), size))::BIGINT AS taken, epochs FROM r
    """,
    "op12_vector_codes": _codes_sql(6),
    "op8_url_filter": r"""
        WITH rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM pages),
        m AS (SELECT n, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC, verdict) AS k
            FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.n = m.n AND k = 1
    """,
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS n, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        j AS (SELECT item_id, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p, w FROM i WHERE len(w) > 0),
        known AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM j),
        widths AS (SELECT DISTINCT k FROM known),
        e AS (SELECT n, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, widths WHERE len(w) >= k),
        h AS (SELECT e.n, e.p, e.k, known.item_id FROM e JOIN known ON known.k = e.k AND known.win = array_to_string(e.w[e.p:e.p + e.k - 1], ' ')),
        c AS (SELECT n, count(DISTINCT q) AS n_hit FROM (SELECT n, unnest(range(p, p + k)) AS q FROM h) GROUP BY n),
        t AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item_id::VARCHAR AS item FROM h) GROUP BY n)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (n) LEFT JOIN t USING (n)
    """,
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' ')) END) AS x FROM d),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * k >= 85 * (a.n + b.n - k)),
        e AS MATERIALIZED (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.doc_id WHERE r.root < e.j)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) c USING (doc_id)
    """,
}
