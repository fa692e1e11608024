"""Announcement comments: pre-filter, labels, chunks and roll-ups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import features, text
from .positions import running_position

ORDER = ["position", "comment_id"]


def is_noise(content: Column | str) -> Column:
    """Too short to carry a signal, or a moderation placeholder (or missing)."""
    body = text.strip_blank(content)
    awaiting = body.rlike("(?i)^" + re.escape(config.AWAITING_PREFIX).replace(r"\ ", " "))
    return body.isNull() | (F.length(body) < config.MIN_COMMENT_CHARS) | awaiting


def prefilter(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Drop noise and exact copies (the first by page order stays); content is trimmed.

    Copies are folded with an aggregate that combines map-side, so one text repeated by a third of all comments
    is no hot task.
    """
    body = comments.where(~is_noise("content")).withColumn("content", text.strip_blank("content"))
    rest = [c for c in body.columns if c not in (*keys, "content", *ORDER)]
    first = body.groupBy(*keys, "content").agg(F.min(F.struct(*ORDER, *rest)).alias("_first"))
    return first.select(*keys, "content", "_first.*").select(*comments.columns)


def prefilter_counts(comments: DataFrame, keys: list[str]) -> DataFrame:
    """Comments per group before the filter, after it, and removed."""
    noise = is_noise("content")
    per_text = comments.groupBy(*keys, text.strip_blank("content").alias("_text")).agg(
        F.count("*").alias("n"), F.max((~noise).cast("int")).alias("kept")
    )
    out = per_text.groupBy(*keys).agg(F.sum("n").alias("n_raw"), F.sum("kept").cast("bigint").alias("n_kept"))
    return out.withColumn("n_removed", F.col("n_raw") - F.col("n_kept"))


def label_comments(kept: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Label and theme of every comment with the native lexicon and keyword rules."""
    scored = features.add_text_features(kept, content="content", lexicon=lexicon)
    return scored.withColumn("theme", text.keyword_topic("review_content_processed"))


def label_stats(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of the labels per group."""
    labels = ("positive", "neutral", "negative")
    out = labelled.groupBy(*keys).agg(
        F.count("*").alias("n_comments"),
        *[F.count_if(F.col("sentiment_label") == v).alias(f"{v}_count") for v in labels],
    )
    n = F.greatest("n_comments", F.lit(1))
    return out.withColumns({f"{v}_pct": F.bround(F.col(f"{v}_count") / n, 4) for v in labels})


def add_chunks(kept: DataFrame, keys: list[str], size: int = config.COMMENT_CHUNK,
               bucket_rows: int = 1000) -> DataFrame:
    """chunk_id = which run of ``size`` comments, in page order, a comment belongs to."""
    bucket = F.floor(F.col("position") / bucket_rows)
    placed = running_position(kept, keys, bucket, ORDER, "_pos")
    return placed.withColumn("chunk_id", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


CHUNK_RESULT = (
    "chunk_id bigint, total bigint, positive bigint, neutral bigint, negative bigint, failed boolean, "
    "themes array<struct<label:string,count:bigint>>, quotes array<struct<text:string,sentiment:string>>"
)


def analyse_chunks(chunked: DataFrame, keys: list[str], analyse: Callable[[list[str]], dict]) -> DataFrame:
    """Run a user function on the texts of every chunk (at most ``size`` rows each).

    ``analyse`` returns {"sentiment": {...counts}, "themes": [...], "quotes": [...]}. A chunk whose call fails or
    returns something else keeps its size and counts nothing.
    """
    key_types = ", ".join(f"{k} {chunked.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        out = {k: pdf[k].iloc[0] for k in keys} | {
            "chunk_id": int(pdf["chunk_id"].iloc[0]), "total": len(pdf), "positive": 0, "neutral": 0, "negative": 0,
            "failed": False, "themes": [], "quotes": [],
        }
        try:
            answer = analyse(pdf["content"].tolist())
            counts = answer.get("sentiment", {})
            out |= {v: int(counts.get(v, 0)) for v in ("positive", "neutral", "negative")}
            out["themes"] = [
                {"label": str(t.get("label", "")), "count": int(t.get("count", 1))} for t in answer.get("themes", [])
            ]
            out["quotes"] = [
                {"text": str(q.get("text", "")), "sentiment": str(q.get("sentiment", ""))}
                for q in answer.get("quotes", [])
            ]
        except Exception:
            out |= {"positive": 0, "neutral": 0, "negative": 0, "failed": True, "themes": [], "quotes": []}
        return pd.DataFrame([out])

    return chunked.select(*keys, "chunk_id", *ORDER, "content").groupBy(*keys, "chunk_id").applyInPandas(
        one, schema=f"{key_types}, {CHUNK_RESULT}"
    )


def apply_labeller(df: DataFrame, text_col: str, out_col: str, classify: Callable[[list[str]], list[str]],
                   valid: tuple[str, ...], fallback: str, batch: int, max_chars: int | None = None) -> DataFrame:
    """Add one label per row from a user function called with batches of whole texts (or of their first ``max_chars``).

    Invalid or missing labels and failed batches become ``fallback``. No shuffle: batches follow the partitions.
    """
    schema = df.withColumn(out_col, F.lit("")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = pdf[text_col].fillna("").str[:max_chars].tolist()
            labels: list[str] = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got = [v if v in valid else fallback for v in classify(part)][: len(part)]
                except Exception:
                    got = []
                labels += got + [fallback] * (len(part) - len(got))
            yield pdf.assign(**{out_col: labels})

    return df.mapInPandas(run, schema=schema)
