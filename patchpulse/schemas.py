"""Canonical schemas."""

from __future__ import annotations

REVIEWS = (
    "appid string, review_id string, review_content string, voted_up boolean, ts timestamp, playtime_hours double, "
    "votes_up int, votes_funny int, num_games_owned int, num_reviews int, playtime_at_review double, "
    "steam_purchase int, received_for_free int, weighted_vote_score double, language string"
)
REVIEW_COLUMNS = tuple(part.split()[0] for part in REVIEWS.split(", "))

# Legacy export: every column is text.
LEGACY_COLUMNS = (
    "SteamID", "played_hours", "playtime_at_review", "review_content", "voted_up", "review_date", "votes_up",
    "votes_funny", "num_games_owned", "num_reviews", "steam_purchase", "received_for_free", "weighted_vote_score",
    "language",
)

REVIEW_PAGE = (
    "success int, cursor string, reviews array<struct<recommendationid:string, review:string, voted_up:boolean, "
    "timestamp_created:bigint, votes_up:int, votes_funny:int, steam_purchase:boolean, received_for_free:boolean, "
    "weighted_vote_score:double, language:string, author:struct<playtime_forever:double, playtime_at_review:double, "
    "num_games_owned:int, num_reviews:int>>>"
)
NEWS_PAGE = (
    "appnews struct<appid:string, newsitems:array<struct<gid:string, title:string, url:string, date:bigint, "
    "contents:string, tags:array<string>>>>"
)

# Columns added to the store after its first version, with the value old rows get.
META_DEFAULTS = {
    "num_games_owned": "-1",
    "num_reviews": "0",
    "playtime_at_review": "0D",
    "steam_purchase": "1",
    "received_for_free": "0",
    "weighted_vote_score": "0D",
    "language": "'english'",
}

#: What columns of scored reviews are, as far as it bars them from being features of a model of the risk label.
COLUMN_ROLES = {
    "target": ("risk_score", "risk_label_weak", "risk_level"),
    "id": ("review_id", "doc_id", "author_id"),
    "time": ("ts",),
    "text": ("review_content", "review_content_processed"),
}
