"""Parameters of the operators.

Everything a caller may want to tune is a field of a frozen dataclass or a plain tuple that is passed to the
operator; nothing here is read behind the caller's back.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------------------
# They must equal the published rules for results to agree.
# ---------------------------------------------------------------------------------------------------------
PRE_DAYS = 7
POST_DAYS = 7
LABEL_CUT = 0.2  # compound >= cut is positive, <= -cut negative
RATIO_CUT = 0.05  # cut of the rolling positive/negative shares
DISAGREE_CUT = 0.05
MIN_WINDOW_ROWS = 10
COMMENT_CHUNK = 50
TOPIC_BATCH = 50
MIN_COMMENT_CHARS = 5
ROLLING_HOURS = (24, 48, 72)

TOPIC_LABELS = (
    "performance",
    "gameplay",
    "content",
    "bugs",
    "monetization",
    "graphics",
    "audio",
    "community",
    "other",
)
UPDATE_TAGS = ("patchnotes", "patch_notes")
UPDATE_TITLE_WORDS = ("patch", "update", "fix", "hotfix", "changelog", "maintenance")
AWAITING_PREFIX = "This comment is awaiting analysis"
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")  # rank = position + 1

BUG_WORDS = ("crash", "bug", "freeze", "lag", "fix", "patch")
BALANCE_WORDS = ("op", "overpowered", "nerf", "buff", "meta", "cheater", "toxic")
MONEY_WORDS = ("pay to win", "p2w", "paywall", "microtransaction", "dlc", "money grab")
PERFORMANCE_WORDS = ("fps", "framerate", "performance", "optimization", "graphics")
FIXED_TOXIC_WORDS = ("hate", "stupid", "idiot", "trash", "suck")
# End of fixed values.

TOXIC_WORDS = (*FIXED_TOXIC_WORDS, "worthless", "pathetic", "loser", "disgusting", "moron")

# Default keyword classifier for topics: the first label whose words occur wins.
TOPIC_KEYWORDS = (
    ("performance", ("fps", "lag", "stutter", "framerate", "performance", "loading", "optimization")),
    ("bugs", ("bug", "crash", "glitch", "freeze", "broken", "error")),
    ("monetization", ("paywall", "dlc", "price", "microtransaction", "p2w", "refund", "greedy")),
    ("graphics", ("graphics", "visuals", "resolution", "textures")),
    ("audio", ("music", "sound", "audio", "voice")),
    ("community", ("toxic", "matchmaking", "cheater", "multiplayer", "idiot", "moron", "loser")),
    ("content", ("update", "map", "mission", "story", "content")),
    ("gameplay", ("fun", "gameplay", "balance", "controls", "difficulty", "nerf", "buff")),
)

NEGATION_WORDS = ("not", "no", "never", "none", "cannot", "without", "nothing", "nor")
INTENSIFIER_WORDS = ("very", "really", "extremely", "so", "too", "absolutely", "totally")

# word -> valence on the usual -4..4 scale; callers pass a bigger table for production use.
SENTIMENT_WORDS = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "best": 3.2, "better": 1.9, "brilliant": 2.8,
    "enjoy": 2.2, "excellent": 2.7, "fair": 1.3, "fantastic": 2.6, "favorite": 2.0, "fun": 2.3,
    "good": 1.9, "great": 3.1, "happy": 2.7, "helpful": 1.8, "impressive": 2.3, "like": 1.5,
    "love": 3.2, "nice": 1.8, "perfect": 2.7, "polished": 1.2, "recommend": 1.5, "smooth": 1.1,
    "solid": 1.0, "superb": 3.1, "thanks": 1.9, "win": 2.8, "wonderful": 2.7, "worth": 0.9,
    "angry": -2.3, "annoying": -1.7, "awful": -2.0, "bad": -2.5, "boring": -1.3, "broken": -1.6,
    "clown": -1.2, "crash": -1.7, "dead": -3.3, "disappointing": -2.2, "disgusting": -2.4,
    "dumb": -2.3, "fail": -2.5, "garbage": -2.0, "greedy": -1.9, "hate": -2.7, "horrible": -2.5,
    "idiot": -2.3, "lag": -1.2, "loser": -2.4, "moron": -2.2, "pathetic": -2.7, "poor": -2.1,
    "ruined": -1.9, "scam": -2.7, "scum": -2.5, "stupid": -2.4, "suck": -1.9, "terrible": -2.1,
    "toxic": -2.2, "trash": -1.9, "ugly": -2.3, "unplayable": -2.6, "useless": -1.8, "waste": -1.8,
    "worse": -2.1, "worst": -3.1, "worthless": -1.9,
}
BOOSTER_WORDS = {
    "absolutely": 0.293, "completely": 0.293, "extremely": 0.293, "incredibly": 0.293, "really": 0.293,
    "so": 0.293, "totally": 0.293, "very": 0.293, "barely": -0.293, "kinda": -0.293, "slightly": -0.293,
    "somewhat": -0.293,
}
NEGATOR_WORDS = (
    "not", "never", "none", "cannot", "cant", "can't", "dont", "don't", "doesnt", "doesn't", "didnt",
    "didn't", "isnt", "isn't", "wasnt", "wasn't", "wont", "won't", "without", "nor", "neither", "nothing",
)

COLUMN_ALIASES = {
    "review": "review_content",
    "review_text": "review_content",
    "content": "review_content",
    "app_id": "appid",
    "game_id": "appid",
    "date": "review_date",
    "timestamp_created": "review_date",
    "helpful_votes": "votes_up",
    "votes_helpful": "votes_up",
    "funny_votes": "votes_funny",
    "hours_played": "played_hours",
}
ZERO_FILLED = ("num_games_owned", "num_reviews", "played_hours", "votes_up", "votes_funny", "comment_count")


@dataclass(frozen=True)
class SignalThresholds:
    """Cuts of the per-update risk signals."""

    negative_rise: float = 0.15
    negative_rise_high: float = 0.25
    negative_rise_critical: float = 0.40
    negative_share: float = 0.60
    negative_share_critical: float = 0.75
    volume_factor: float = 3.0
    comment_negative: float = 0.50
    comment_negative_critical: float = 0.70
    divergence: float = 0.20


@dataclass(frozen=True)
class CrisisThresholds:
    """Cuts of the monitoring-window alerts; an update row may carry its own values."""

    negative_sentiment_pct: float = 0.60
    critical_risk_pct: float = 0.05
    monetization_negative_pct: float = 0.30
    volume_factor: float = 3.0
    combined_rows: int = 10


@dataclass(frozen=True)
class RiskWeights:
    """Weights of the row risk score."""

    toxic: float = 1.0
    strong_negative: float = 1.0
    bug: float = 0.8
    balance: float = 0.8
    monetization: float = 0.8
    performance: float = 0.5
    controversial: float = 0.5
    mismatch: float = 0.6
    contradiction: float = 0.3
    negative_cut: float = -0.35


@dataclass(frozen=True)
class LevelCuts:
    """Score cuts of the risk levels."""

    critical: float
    high: float
    medium: float


FIXED_CUTS = LevelCuts(2.5, 1.5, 1.0)
MIXED_CUTS = LevelCuts(3.0, 2.0, 1.0)
WEAK_LABEL_CUT = 1.0

SENSITIVITY_SIGMA = {"low": 3.0, "medium": 2.5, "high": 2.0}
