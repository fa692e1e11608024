"""News payloads, comment pages and comments as review-shaped rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import text


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON news pages, one per line."""
    return spark.read.schema(f"appid string, {schemas.NEWS_PAGE}").json(path)


def flatten_news(pages: DataFrame) -> DataFrame:
    """One row per news item; whole contents, tags (text or {"tag": ...}) lower-cased."""
    n = pages.select("appid", F.explode("appnews.newsitems").alias("n"))
    tags = F.transform("n.tags", lambda t: F.lower(F.coalesce(_tag_of(t), t)))
    return n.select(
        "appid", F.col("n.gid").alias("gid"), F.coalesce("n.title", F.lit("")).alias("title"),
        F.coalesce("n.url", F.lit("")).alias("url"), F.timestamp_seconds("n.date").alias("published_at"),
        F.coalesce("n.contents", F.lit("")).alias("contents"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )


def _tag_of(t: Column) -> Column:
    return F.when(t.startswith("{"), F.get_json_object(t, "$.tag"))


class _Blocks(HTMLParser):
    """Collects the comment blocks of one page. Only the wanted parts of a block are kept."""

    def __init__(self, block: str, parts: dict[str, tuple[str, ...]]):
        super().__init__(convert_charrefs=True)
        self.block, self.parts = block, parts
        self.stack: list[tuple[str, bool, str | None]] = []
        self.blocks: list[dict] = []
        self.current: dict | None = None

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        opens = self.block in classes
        if opens:
            self.current = {"comment_id": found.get("id") or "", **{p: [] for p in self.parts}}
            self.blocks.append(self.current)
        part = next((p for p, names in self.parts.items() if self.current is not None and set(names) & set(classes)), None)
        if tag not in self.VOID:
            self.stack.append((tag, opens, part))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, opens, _ = self.stack.pop()
                if opens:
                    self.current = None
                if t == tag:
                    break

    def handle_data(self, data):
        if self.current is not None:
            for _, _, part in self.stack:
                if part:
                    self.current[part].append(data.strip())


# The class names of comment pages.
BLOCK_CLASS = "commentthread_comment"
PART_CLASSES = {
    "author": ("commentthread_author_link",),
    "timestamp_raw": ("commentthread_comment_timestamp",),
    "content": ("commentthread_comment_text",),
    "upvotes": ("commentthread_comment_upvotes", "upvote_count"),
}


def extract_comments(pages: DataFrame, block: str = BLOCK_CLASS, parts: dict[str, tuple[str, ...]] = PART_CLASSES,
                     page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per comment block of every page, with its position, parsed time and number of upvotes.

    Pages are parsed in Arrow batches where they lie; nothing is shuffled.
    """
    id_type = pages.schema[page_id].dataType.simpleString()
    names = tuple(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, source in zip(pdf[page_id], pdf[html]):
                parser = _Blocks(block, parts)
                parser.feed(source or "")
                for i, b in enumerate(parser.blocks):
                    rows.append((pid, i, b["comment_id"], *("".join(b[n]) for n in names)))
            yield pd.DataFrame(rows, columns=[page_id, "position", "comment_id", *names])

    schema = f"{page_id} {id_type}, position int, comment_id string, " + ", ".join(f"{n} string" for n in names)
    out = pages.select(page_id, html).mapInPandas(run, schema=schema)
    if "upvotes" in names:
        digits = F.regexp_replace("upvotes", "[^0-9]", "")
        out = out.withColumn("upvotes", F.coalesce(digits.try_cast("int"), F.lit(0)))
    if "timestamp_raw" in names:
        out = out.withColumn("published_at", text.parse_comment_time("timestamp_raw"))
    return out


def text_paragraphs(pages: DataFrame, page_id: str = "page_id", html: str = "html", tag: str = "p") -> DataFrame:
    """Paragraphs without nested markup, by pattern (no Python)."""
    found = F.regexp_extract_all(F.col(html), F.lit(f"<{tag}>([^<]*)</{tag}>"), F.lit(1))
    return pages.select(page_id, F.posexplode(found).alias("position", "content"))


def comments_as_reviews(comments: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Comments in the review layout, source 'event_comment'.

    The time is the comment's own, else ``fallback``; rows with neither and blank comments are dropped. A missing
    id becomes a hash of the content, and the vote is unknown (comments have no thumbs-down).
    """
    body = text.strip_blank("content")
    when = F.coalesce("published_at", fallback) if fallback is not None else F.col("published_at")
    surrogate = F.concat(F.lit("ec_"), F.hex(F.xxhash64("appid", "forum_topic_id", body)))
    out = comments.select(
        "appid", F.coalesce(F.nullif(F.col("comment_id"), F.lit("")), surrogate).alias("review_id"),
        body.alias("review_content"), F.lit(None).cast("boolean").alias("voted_up"), when.alias("ts"),
        F.lit(0.0).alias("playtime_hours"), F.coalesce("upvotes", F.lit(0)).alias("votes_up"),
        F.lit(0).alias("votes_funny"), F.lit("event_comment").alias("source"),
    )
    return out.where("review_content <> '' AND ts IS NOT NULL")
