"""Paper metadata of public catalogues as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import inverted_index_text


def arxiv_query(terms: Column, excluded: Column, categories: Column, first: Column, last: Column) -> Column:
    """The search string of a scope: all terms and any category and the date range, and no excluded term."""
    quote = lambda x: F.concat(F.lit('all:"'), x, F.lit('"'))
    stamp = lambda d, open_: F.coalesce(F.date_format(d, "yyyyMMdd"), F.lit(open_))
    wanted = F.array_join(F.transform(terms, quote), " AND ")
    cats = F.when(F.size(categories) > 0, F.concat(F.lit("("), F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR "), F.lit(")")))
    dates = F.when(first.isNotNull() | last.isNotNull(), F.concat(F.lit("submittedDate:["), stamp(first, "19910101"), F.lit("0000 TO "), stamp(last, "29991231"), F.lit("2359]")))
    body = F.concat_ws(" AND ", F.nullif(wanted, F.lit("")), cats, dates)
    return F.concat(body, F.array_join(F.transform(excluded, lambda x: F.concat(F.lit(" ANDNOT "), quote(x))), ""))


def arxiv_atom(spark: SparkSession, path: str) -> DataFrame:
    kind = "id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string>>, `arxiv:doi` string, `arxiv:journal_ref` string, category array<struct<_term:string>>"
    x = spark.read.format("xml").option("rowTag", "entry").schema(kind).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return x.select(
        F.element_at(F.split("id", "/"), -1).alias("arxiv_id"), squeeze(F.col("title")).alias("title"), squeeze(F.col("summary")).alias("abstract"), F.col("published").cast("timestamp").cast("date").alias("published_at"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.col("`arxiv:doi`").alias("doi"), F.col("`arxiv:journal_ref`").alias("venue"),
        F.get(F.filter("link", lambda a: a["_title"] == "pdf"), F.lit(0))["_href"].alias("pdf_url"), F.transform("category", lambda c: c["_term"]).alias("categories"),
    )


def openalex(raw: DataFrame, json_col: str = "value") -> DataFrame:
    kind = "struct<id:string,doi:string,title:string,publication_date:date,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>"
    x = raw.select(F.from_json(json_col, kind).alias("w")).select("w.*")
    return x.select(F.element_at(F.split("id", "/"), -1).alias("openalex_id"), F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "").alias("doi"), "title", inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_date").alias("published_at"), F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"))


def semantic_scholar(raw: DataFrame, json_col: str = "value") -> DataFrame:
    kind = "struct<paperId:string,title:string,abstract:string,venue:string,publicationDate:date,externalIds:struct<DOI:string,ArXiv:string>,authors:array<struct<name:string>>>"
    x = raw.select(F.from_json(json_col, kind).alias("p")).select("p.*")
    return x.select(F.col("paperId").alias("s2_id"), F.col("externalIds.DOI").alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), "title", "abstract", "venue", F.col("publicationDate").alias("published_at"), F.transform("authors", lambda a: a["name"]).alias("authors"))


def crossref_doi(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """The first DOI of an answer, or null."""
    return raw.select(F.from_json(json_col, "struct<message:struct<items:array<struct<DOI:string>>>>").alias("m")).select(F.get(F.col("m.message.items"), F.lit(0))["DOI"].alias("doi"))
