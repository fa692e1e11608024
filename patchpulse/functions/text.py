"""Text and scalar column functions. All of them are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import config

WHITESPACE_RUN = r"(?U)\s+"
# Every white-space character, for trimming: ``btrim`` looks at the ends only, a pattern at the whole text.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_CHAR = r"[\p{L}\p{N}\p{M}_]"
# The link and tag patterns that are removed, and the entities that occur in practice.
LINK_PATTERN = r"(?U)https?://\S+|www\.\S+"
TAG_PATTERN = r"<[^>]+>"
NAMED_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),  # last, so that "&amp;lt;" becomes "&lt;" and not "<"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blank(c: Column | str) -> Column:
    """Trim every kind of white space (``trim`` removes the space character only)."""
    return F.btrim(_col(c), F.lit(SPACES))


def is_blank(c: Column | str) -> Column:
    """NULL, empty or white space only."""
    return _col(c).isNull() | (strip_blank(c) == "")


def _decode_numeric(c: Column) -> Column:
    """Replace decimal and hexadecimal character references."""
    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)&#(?:\d{1,7}|x[0-9a-f]{1,6});"), F.lit(0)))

    def one(acc: Column, ref: Column) -> Column:
        body = F.regexp_replace(ref, "[&#;]", "")
        digits = F.when(F.lower(body).startswith("x"), F.substring(body, 2, 10)).otherwise(F.hex(body.try_cast("bigint")))
        return F.replace(acc, ref, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))

    return F.when(F.contains(c, F.lit("&#")), F.aggregate(refs, c, one)).otherwise(c)


@F.pandas_udf(StringType())
def _unescape_all(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column | str, every_entity: bool = False) -> Column:
    """Decode HTML entities: numeric ones and the named core set, or every named entity via Arrow batches."""
    if every_entity:
        return _unescape_all(_col(c))
    out = _decode_numeric(_col(c))
    for entity, char in NAMED_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def clean_text(c: Column | str, every_entity: bool = False, lower: bool = True) -> Column:
    """Entities decoded, links and tags dropped, white space collapsed, lower-cased unless told otherwise."""
    out = unescape(c, every_entity)
    out = F.regexp_replace(out, LINK_PATTERN, " ")
    out = F.when(F.contains(out, F.lit("<")), F.regexp_replace(out, TAG_PATTERN, " ")).otherwise(out)
    out = strip_blank(F.regexp_replace(out, WHITESPACE_RUN, " "))
    return F.lower(out) if lower else out


def words(c: Column | str) -> Column:
    """Words separated by white space, without empty ones."""
    return F.filter(F.split(_col(c), WHITESPACE_RUN), lambda w: w != "")


def keyword_pattern(keywords: Iterable[str]) -> str:
    """A case-insensitive whole-word pattern."""
    return r"(?iU)\b(?:" + "|".join(re.escape(k).replace(r"\ ", " ") for k in keywords) + r")\b"


#: The letters outside ASCII that equal an ASCII letter where case is ignored.
FOLDED = "\u0130\u0131\u017f\u212a"


def holds_keyword(c: Column | str, keywords: Iterable[str]) -> Column:
    """Whether any keyword occurs as a whole word. Words are looked for as plain strings first: the pattern runs only over texts that
    hold one of them somewhere, or a letter that lower-casing does not bring to ASCII."""
    keywords = list(keywords)
    matched = _col(c).rlike(keyword_pattern(keywords))
    if not keywords or not all(k.isascii() for k in keywords):
        return matched
    held = [F.contains(F.lower(_col(c)), F.lit(k.lower())) for k in keywords] + [F.contains(_col(c), F.lit(x)) for x in FOLDED]
    return reduce(lambda a, b: a | b, held) & matched


def mentions(c: Column | str, keywords: Iterable[str]) -> Column:
    """1 when any keyword occurs as a whole word, else 0."""
    return F.coalesce(holds_keyword(c, keywords), F.lit(False)).cast("int")


def keyword_count(c: Column | str, keywords: Iterable[str]) -> Column:
    return F.coalesce(F.regexp_count(_col(c), F.lit(keyword_pattern(keywords))), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole with 0.0 where the whole is empty."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------------------------------------
# Exclusion predicates
# ---------------------------------------------------------------------------------------------------------


def is_punctuation_only(c: Column | str) -> Column:
    """No letter, digit or underscore of any script (but not blank)."""
    return ~is_blank(c) & ~_col(c).rlike(WORD_CHAR)


def is_non_english(c: Column | str, min_ascii_share: float = 0.2) -> Column:
    """Few ASCII letters and some Cyrillic, CJK, Arabic or Thai character."""
    text = strip_blank(c)
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]+", ""))
    # The script test comes first: it settles nearly every row in one cheap pass.
    return text.rlike("[Ѐ-ӿ一-鿿؀-ۿ฀-๿]") & (ratio(letters, F.length(text)) < min_ascii_share)


def has_repeated_char(c: Column | str, times: int = 10) -> Column:
    return _col(c).rlike(r"([^\n])\1{%d,}" % (times - 1))


def has_repetitive_words(c: Column | str, min_words: int = 4, min_distinct_share: float = 0.3) -> Column:
    w = words(F.lower(_col(c)))
    return (F.size(w) >= min_words) & (F.size(F.array_distinct(w)) / F.size(w) < min_distinct_share)


def has_many_links(c: Column | str, times: int = 2) -> Column:
    return F.regexp_count(_col(c), F.lit("https?://")) >= times


def is_behavioural_spam(playtime_minutes: Column | str, num_reviews: Column | str) -> Column:
    """Low play time combined with many reviews, or next to no play time; unknown values never match."""
    hours = _col(playtime_minutes) / 60
    n = _col(num_reviews)
    hit = ((hours < 2) & (n > 5)) | (hours < 0.5) | ((n > 50) & (hours < 10))
    return F.coalesce(hit, F.lit(False))


# ---------------------------------------------------------------------------------------------------------
# Text statistics
# ---------------------------------------------------------------------------------------------------------


def char_and_word_stats(processed: str) -> dict[str, Column]:
    """char_count, word_count and avg_word_length (0.0 without words)."""
    w = words(processed)
    letters = F.length(F.regexp_replace(_col(processed), WHITESPACE_RUN, ""))
    return {
        "char_count": F.length(processed),
        "word_count": F.size(w),
        "avg_word_length": ratio(letters, F.size(w)),
    }


def sentence_count(c: Column | str) -> Column:
    """Runs of text ended by sentence punctuation or the end of the text."""
    return F.regexp_count(_col(c), F.lit(r"[^.!?]*[^.!?\s][^.!?]*"))


def syllable_count(c: Column | str) -> Column:
    """Vowel groups, the usual approximation."""
    return F.regexp_count(F.lower(_col(c)), F.lit("[aeiouy]+"))


def readability(c: Column | str) -> dict[str, Column]:
    """Flesch reading ease and Flesch-Kincaid grade; 0.0 for texts without words."""
    n_words, n_sent, n_syll = F.size(words(c)), F.greatest(sentence_count(c), F.lit(1)), syllable_count(c)
    per_sentence, per_word = n_words / n_sent, n_syll / n_words
    return {
        "flesch_reading_ease": F.when(
            n_words > 0, F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word
        ).otherwise(F.lit(0.0)),
        "flesch_kincaid_grade": F.when(
            n_words > 0, F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59)
        ).otherwise(F.lit(0.0)),
    }


def surface_stats(c: str) -> dict[str, Column]:
    """Length, punctuation and reference indicators of the raw text (NULL counts as empty)."""
    text = F.coalesce(F.col(c), F.lit(""))
    length = F.length(text)
    n_question = F.regexp_count(text, F.lit(r"\?"))
    has_url = text.rlike(LINK_PATTERN)
    has_mention = text.rlike(r"@[A-Za-z0-9_]+")
    return {
        "text_length": length,
        "sentence_count": sentence_count(text),
        "exclamation_count": F.regexp_count(text, F.lit("!")),
        "question_count": n_question,
        "uppercase_ratio": ratio(F.regexp_count(text, F.lit(r"\p{Lu}")), length),
        "punctuation_ratio": ratio(F.regexp_count(text, F.lit(r"[.,!?;:]")), length),
        "has_question": (n_question > 0).cast("int"),
        "has_url": has_url.cast("int"),
        "has_mention": has_mention.cast("int"),
        "has_external_reference": (has_url | has_mention).cast("int"),
    }


def complaint_flags(c: str) -> dict[str, Column]:
    """0/1 complaint and toxicity indicators from the default keyword lists."""
    toxic = mentions(c, config.TOXIC_WORDS)
    return {
        "contains_bug_report": mentions(c, config.BUG_WORDS),
        "contains_balance_complaint": mentions(c, config.BALANCE_WORDS),
        "contains_monetization_complaint": mentions(c, config.MONEY_WORDS),
        "mentions_performance": mentions(c, config.PERFORMANCE_WORDS),
        "toxicity_score": toxic * F.lit(0.7),
        "is_toxic": toxic,
    }


def emphasis_counts(c: str) -> dict[str, Column]:
    return {
        "negation_count": keyword_count(c, config.NEGATION_WORDS),
        "intensifier_count": keyword_count(c, config.INTENSIFIER_WORDS),
    }


def keyword_topic(c: Column | str, rules: Iterable[tuple[str, Iterable[str]]] = config.TOPIC_KEYWORDS) -> Column:
    """First label whose keywords occur in the text; 'other' when none does or the text is missing."""
    chosen = None
    for label, keywords in rules:
        hit = holds_keyword(c, keywords)
        chosen = F.when(hit, label) if chosen is None else chosen.when(hit, label)
    return chosen.otherwise(F.lit("other"))


def calendar(ts: Column | str) -> dict[str, Column]:
    """hour, day_of_week (0 = Monday) and is_weekend."""
    t = _col(ts)
    return {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }


def signed_percent(c: Column, digits: int = 1) -> Column:
    """Percentage with sign; ties go to the even digit."""
    return F.format_string(f"%+.{digits}f%%", F.bround(c * 100, digits))


def percent(c: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(c * 100, digits))


def parse_comment_time(c: Column | str) -> Column:
    """``Nov 7, 2024 @ 11:06pm`` as a UTC timestamp; any other form is NULL."""
    pattern = r"(?i)([a-z]{3})\s+(\d{1,2}),\s+(\d{4})\s+@\s+(\d{1,2}):(\d{2})(am|pm)"
    part = [F.regexp_extract(_col(c), pattern, i) for i in range(1, 7)]
    text = F.concat_ws(
        " ", F.initcap(F.lower(part[0])), part[1], part[2], F.concat(part[3], F.lit(":"), part[4]), F.upper(part[5])
    )
    return F.when(_col(c).rlike(pattern), F.try_to_timestamp(text, F.lit("MMM d yyyy h:mm a")))


def word_counts(df: DataFrame, content: str, name: str) -> DataFrame:
    """``df`` with the words (of two characters or more) of each row's text and their counts: an array of (term, tf) sorted by term, made inside the row."""
    words = F.filter(F.split(F.lower(content), r"(?U)\W+"), lambda w: F.length(w) >= 2)
    starts = "filter(transform(_t, (t, i) -> if(i = 0 OR get(_t, i - 1) <> t, i, NULL)), i -> i IS NOT NULL)"
    return df.withColumn("_t", F.array_sort(words)).withColumn("_at", F.expr(starts)).withColumn(name, F.expr(
        "transform(_at, (a, k) -> struct(get(_t, a) AS term, CAST(coalesce(get(_at, k + 1), size(_t)) - a AS BIGINT) AS tf))")).drop("_t", "_at")
