"""Review files and landed payloads to canonical rows, and duplicate-free ingest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import text


#: Apps in a batch up to which their list is used to prune the store.
PRUNED_APPS = 1000


def read_csv(spark: SparkSession, paths: str | list[str], line_breaks: bool = False) -> DataFrame:
    """CSV with header. All columns are text, so nothing is inferred.

    Files are split and read in parallel. Files whose quoted fields hold line breaks need ``line_breaks=True``, which reads each
    file in one task.
    """
    return spark.read.csv(paths, header=True, multiLine=line_breaks, quote='"', escape='"', inferSchema=False)


def import_reviews(df: DataFrame, appid: str | None = None) -> DataFrame:
    """Canonical rows from a file in either layout; without ``appid`` the file's own appid column is used."""
    if appid is None and "appid" not in df.columns:
        raise ValueError("the file has no appid column, so appid must be given")
    app = F.lit(appid) if appid is not None else F.col("appid").try_cast("int").cast("string")
    return normalise_legacy(df, app) if "SteamID" in df.columns else normalise_new(df, app)


def _number(df: DataFrame, name: str, default: str, kind: str = "double") -> Column:
    """A text column as a number, ``default`` where it is missing or unreadable."""
    if name not in df.columns:
        return F.expr(f"CAST({default} AS {kind})")
    value = F.col(name).try_cast("double")
    return F.coalesce(value.cast(kind) if kind == "double" else value.try_cast(kind), F.expr(f"CAST({default} AS {kind})"))


def normalise_legacy(df: DataFrame, appid: Column) -> DataFrame:
    """Old export: surrogate id from author and date, midnight UTC times, minutes to hours, lenient numbers.

    Rows without a readable date or with blank content are dropped.
    """
    at_review, played = _number(df, "playtime_at_review", "0"), _number(df, "played_hours", "0")
    minutes = F.when(at_review > 0, at_review).otherwise(played)
    day = F.try_to_timestamp(F.col("review_date"), F.lit("yyyy-MM-dd"))
    language = F.coalesce("language", F.lit("english")) if "language" in df.columns else F.lit("english")
    games = _number(df, "num_games_owned", "-1", "int")
    out = df.select(
        appid.alias("appid"),
        F.substring(F.md5(F.concat_ws("_", "SteamID", "review_date")), 1, 16).alias("review_id"),
        F.coalesce("review_content", F.lit("")).alias("review_content"),
        (_number(df, "voted_up", "0", "int") != 0).alias("voted_up"),
        day.alias("ts"),
        F.bround(minutes / 60, 1).alias("playtime_hours"),
        _number(df, "votes_up", "0", "int").alias("votes_up"),
        _number(df, "votes_funny", "0", "int").alias("votes_funny"),
        games.alias("num_games_owned"),  # text such as "Private Account" is unreadable, hence -1
        _number(df, "num_reviews", "0", "int").alias("num_reviews"),
        at_review.alias("playtime_at_review"),
        _number(df, "steam_purchase", "1", "int").alias("steam_purchase"),
        _number(df, "received_for_free", "0", "int").alias("received_for_free"),
        _number(df, "weighted_vote_score", "0").alias("weighted_vote_score"),
        language.alias("language"),
    )
    return out.where(F.col("ts").isNotNull() & ~text.is_blank("review_content"))


def normalise_new(df: DataFrame, appid: Column) -> DataFrame:
    """Current layout: base columns cast, metadata defaults filled, rows without a time dropped."""
    when = F.col("timestamp") if "timestamp" in df.columns else F.col("ts")
    meta = {
        c: F.coalesce(F.col(c).try_cast(kind), F.expr(d)) if c in df.columns else F.expr(d)
        for (c, d), kind in zip(schemas.META_DEFAULTS.items(), ("int", "int", "double", "int", "int", "double", "string"))
    }
    vote = F.lower(F.col("voted_up").cast("string")).isin("1", "true", "1.0")
    out = df.select(
        appid.alias("appid"), F.col("review_id").cast("string").alias("review_id"), "review_content",
        vote.alias("voted_up"), when.try_cast("timestamp").alias("ts"),
        F.col("playtime_hours").try_cast("double").alias("playtime_hours"),
        F.col("votes_up").try_cast("int").alias("votes_up"), F.col("votes_funny").try_cast("int").alias("votes_funny"),
        *[v.alias(c) for c, v in meta.items()],
    )
    return out.where("ts IS NOT NULL")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages of reviews, one page per line."""
    return spark.read.schema(f"appid string, {schemas.REVIEW_PAGE}").json(path)


def flatten_payloads(pages: DataFrame) -> DataFrame:
    """One canonical row per review of successful pages (columns appid and reviews)."""
    r = pages.where("success = 1").select("appid", F.explode("reviews").alias("r"))
    at_review, forever = F.nullif(F.col("r.author.playtime_at_review"), F.lit(0.0)), F.col("r.author.playtime_forever")
    games = F.coalesce("r.author.num_games_owned", F.lit(0))
    return r.select(
        "appid", F.col("r.recommendationid").alias("review_id"), F.col("r.review").alias("review_content"),
        F.col("r.voted_up").alias("voted_up"), F.timestamp_seconds("r.timestamp_created").alias("ts"),
        F.bround(F.coalesce(at_review, forever, F.lit(0.0)) / 60, 1).alias("playtime_hours"),
        F.coalesce("r.votes_up", F.lit(0)).alias("votes_up"), F.coalesce("r.votes_funny", F.lit(0)).alias("votes_funny"),
        F.when(games > 0, games).otherwise(-1).alias("num_games_owned"),
        F.coalesce("r.author.num_reviews", F.lit(0)).alias("num_reviews"),
        F.coalesce("r.author.playtime_at_review", F.lit(0.0)).alias("playtime_at_review"),
        F.coalesce("r.steam_purchase", F.lit(True)).cast("int").alias("steam_purchase"),
        F.coalesce("r.received_for_free", F.lit(False)).cast("int").alias("received_for_free"),
        F.coalesce("r.weighted_vote_score", F.lit(0.0)).alias("weighted_vote_score"),
        F.coalesce("r.language", F.lit("english")).alias("language"),
    )


def new_rows(batch: DataFrame, existing: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key (the first under ``order``).

    Copies are folded by an aggregate that combines map-side, so a key repeated by a third of the batch is no hot
    task. The anti join reads only the keys of the batch's apps; a list of at most ``PRUNED_APPS`` prunes the store's
    partitions before anything is read.
    """
    apps = batch.select("appid").distinct()
    named = [r["appid"] for r in apps.limit(PRUNED_APPS + 1).collect()]
    known = existing.select(*key)
    known = known.where(F.col("appid").isin(named)) if len(named) <= PRUNED_APPS else known.join(apps, "appid", "left_semi")
    fresh = batch.join(known, key, "left_anti")
    rest = [c for c in batch.columns if c not in key]
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*key, "_first.*").select(*batch.columns)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored rows under the given schema (so the partition key ``007`` stays a text), or none when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def ingest_reviews(batch: DataFrame, path: str) -> int:
    """Append the new reviews to the store (Parquet by appid, sorted by time) and return how many were new."""
    return _ingest(batch, path, ["appid", "review_id"], F.struct("ts", F.xxhash64("review_content")))


def ingest_comments(batch: DataFrame, path: str) -> int:
    """Append new comments; content is trimmed and blank ones are skipped."""
    trimmed = batch.withColumn("content", text.strip_blank("content")).where("content <> ''")
    return _ingest(trimmed, path, ["appid", "forum_topic_id", "comment_id"], F.xxhash64("content"))


def _ingest(batch: DataFrame, path: str, key: list[str], order: Column) -> int:
    spark = batch.sparkSession
    existing = stored(spark, path, batch.schema)
    seen = Observation()
    fresh = new_rows(batch, existing, key, order)
    # Rebalancing makes few files and still splits a hot app (or a hot hour of one) by size.
    within = ["appid", "ts"] if "ts" in batch.columns else ["appid"]
    # Counting comes last: an adaptive plan may drop a counter below an exchange that turned out empty.
    laid_out = fresh.hint("rebalance", "appid").sortWithinPartitions(*within).observe(seen, F.count(F.lit(1)).alias("n"))
    laid_out.write.mode("append").partitionBy("appid").parquet(path)
    return int(seen.get["n"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The review store with columns that older files lack filled with their defaults."""
    infer = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(infer)
    spark.conf.set(infer, "false")  # the partition key is a text, and 007 is not 7
    try:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    finally:
        spark.conf.set(infer, before)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.expr(d)) if c in df.columns else F.expr(d) for c, d in schemas.META_DEFAULTS.items()
    })


def standardise_columns(df: DataFrame, aliases: dict[str, str] = config.COLUMN_ALIASES,
                        zero_filled: tuple[str, ...] = config.ZERO_FILLED) -> DataFrame:
    """Known aliases renamed to the canonical names; missing or NULL counts become 0."""
    names = {a: c for a, c in aliases.items() if a in df.columns and c not in df.columns}
    out = df.withColumnsRenamed(names)
    return out.withColumns({
        c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in out.columns else F.lit(0.0) for c in zero_filled
    })


def read_by_genre(spark: SparkSession, path_glob: str, pattern: str = r"([A-Za-z0-9]+)_[^/]*$",
                  line_breaks: bool = False) -> DataFrame:
    """Many review files at once; the genre comes from the path (by default the file name up to its last part)."""
    df = read_csv(spark, path_glob, line_breaks)
    genre = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return standardise_columns(df.withColumn("genre", genre))
