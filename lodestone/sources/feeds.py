"""Community feeds as DataFrames: normalise a payload, keep what is later than the last poll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "source string, external_id string, url string, title string, author string, body string, posted_at timestamp, score bigint, num_comments bigint"


def _item(source: str, external_id: Column, url: Column, title: Column, author: Column, body: Column, posted: Column, score: Column, comments: Column) -> list[Column]:
    return [
        F.lit(source).alias("source"), external_id.cast("string").alias("external_id"), url.alias("url"), title.alias("title"), author.alias("author"), body.alias("body"), posted.alias("posted_at"),
        score.cast("bigint").alias("score"), comments.cast("bigint").alias("num_comments"),
    ]


def since(items: DataFrame, moment: str) -> DataFrame:
    """Items later than the moment; what is late is lost, as with any high-water mark."""
    return items.where(F.col("posted_at") > F.to_timestamp(F.lit(moment)))


def hacker_news(raw: DataFrame, json_col: str = "value", limit: int = 50) -> DataFrame:
    """Stories among the first items of a poll; raw has position and a JSON item."""
    kind = "struct<id:bigint,type:string,url:string,title:string,by:string,text:string,time:bigint,score:bigint,descendants:bigint>"
    x = raw.where(F.col("position") < limit).select(F.from_json(json_col, kind).alias("j")).where("j.type = 'story'").select("j.*")
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string")))
    return x.select(*_item("hackernews", F.col("id"), url, F.col("title"), F.col("by"), F.col("text"), F.timestamp_seconds("time"), F.col("score"), F.col("descendants")))


def hacker_news_lists(raw: DataFrame, json_col: str = "value", limit: int = 50) -> DataFrame:
    """The same of payloads that are lists of items in the order of the front page."""
    each = raw.select(F.posexplode(F.from_json(json_col, "array<string>")).alias("position", "value"))
    return hacker_news(each, limit=limit)


def reddit(raw: DataFrame, json_col: str = "value") -> DataFrame:
    child = "struct<id:string,permalink:string,title:string,author:string,selftext:string,created_utc:double,score:bigint,num_comments:bigint>"
    x = raw.select(F.explode(F.from_json(json_col, f"struct<data:struct<children:array<struct<data:{child}>>>>")["data"]["children"]).alias("c")).select("c.data.*")
    return x.select(*_item("reddit", F.col("id"), F.concat(F.lit("https://www.reddit.com"), F.col("permalink")), F.col("title"), F.col("author"), F.col("selftext"), F.timestamp_seconds("created_utc"), F.col("score"), F.col("num_comments")))


def daily_papers(raw: DataFrame, json_col: str = "value") -> DataFrame:
    kind = "array<struct<publishedAt:string,title:string,numComments:bigint,paper:struct<id:string,title:string,summary:string,upvotes:bigint,publishedAt:string,submittedOnDailyAt:string>>>"
    x = raw.select(F.explode(F.from_json(json_col, kind)).alias("e"))
    p = F.col("e.paper")
    posted = F.coalesce(*(parse_date(c) for c in (F.col("e.publishedAt"), p["submittedOnDailyAt"], p["publishedAt"])))
    return x.select(*_item("hf_daily", p["id"], F.concat(F.lit("https://huggingface.co/papers/"), p["id"]), F.coalesce(F.col("e.title"), p["title"]), F.lit(None).cast("string"), p["summary"], posted, p["upvotes"], F.col("e.numComments")))


def parse_date(text: Column) -> Column:
    """RFC 2822 or ISO 8601 in UTC if no zone is given; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(plain, r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(plain))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds; files that don't parse give none."""
    kind = "guid string, link string, title string, author string, description string, pubDate string"
    x = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(kind).load(path)
    none = F.lit(None)
    return x.select(*_item("rss", F.coalesce("guid", "link"), F.col("link"), F.trim("title"), F.col("author"), F.col("description"), parse_date(F.col("pubDate")), none, none))


def rss_payloads(raw: DataFrame, xml_col: str = "value") -> DataFrame:
    """The same of whole feeds in a column."""
    item = "struct<guid:string,link:string,title:string,author:string,description:string,pubDate:string>"
    feed = F.from_xml(xml_col, f"struct<channel:struct<item:array<{item}>>>", {"ignoreSurroundingSpaces": "false"})
    x = raw.select(F.explode(feed["channel"]["item"]).alias("i")).select("i.*")
    none = F.lit(None)
    return x.select(*_item("rss", F.coalesce("guid", "link"), F.col("link"), F.trim("title"), F.col("author"), F.col("description"), parse_date(F.col("pubDate")), none, none))


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: the page an entry names, its text or summary, and when it came out or was last changed."""
    kind = "id string, title string, link array<struct<_href:string,_rel:string>>, author array<struct<name:string>>, summary string, content string, published string, updated string"
    x = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(kind).load(path)
    page = F.filter("link", lambda a: a["_rel"].isNull() | (a["_rel"] == "alternate"))
    url = F.coalesce(F.get(page, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    none = F.lit(None)
    posted = F.coalesce(parse_date(F.col("published")), parse_date(F.col("updated")))
    return x.select(*_item("rss", F.coalesce("id", url), url, F.trim("title"), F.get("author", F.lit(0))["name"], F.coalesce("content", "summary"), posted, none, none))


def scite_count(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(\d+)\s*[Ss]cites?\b", 1), F.lit("")).cast("bigint")
