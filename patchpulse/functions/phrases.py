"""Sentiment of texts in their original case: phrases as entries of their own, and emphasis by capitals.

A phrase ("kiss of death", "kind of") counts as one word with its own valence or degree. The phrases form a trie of characters, written as one
regular expression, so a text is cut into phrases and words in a single pass: at each word the longest phrase wins, and its words are not looked at
again. In a text that is partly in capitals, words in capitals count more, degree words included. All other rules are those of ``sentiment``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import is_small
from . import sentiment, text

# Fixed values of the published rules: phrases with their valence, phrases of degree, and the weight of capitals.
PHRASE_VALENCES = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "beating heart": 3.1, "broken heart": -2.9,
}
PHRASE_DEGREES = {"kind of": -0.293, "sort of": -0.293, "just enough": -0.293}
CAPITALS = 0.733
# End of fixed values.

PHRASES = {p: (v, 0.0) for p, v in PHRASE_VALENCES.items()} | {p: (None, b) for p, b in PHRASE_DEGREES.items()}


def trie_pattern(phrases) -> str:
    """An expression for any of the phrases, the longest first; common beginnings are written once."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        arms = [re.escape(ch) + written(node[ch]) for ch in sorted(node) if ch]
        if not arms:
            return ""
        body = arms[0] if len(arms) == 1 and "" not in node else "(?:" + "|".join(arms) + ")"
        return body + "?" if "" in node else body

    return written(root)


def phrase_tokens(cleaned: Column | str, phrases=PHRASES) -> Column:
    """Words and phrases of a cleaned text (single spaces) in order, without punctuation around them (``sentiment.tokens``).

    A phrase may carry punctuation at its ends, not between its words. Without phrases these are the words.
    """
    c = F.col(cleaned) if isinstance(cleaned, str) else cleaned
    marks = "[" + re.escape(text.PUNCTUATION) + "]*"
    pattern = f"(?i)(?<![^ ]){marks}{trie_pattern(phrases)}{marks}(?![^ ])|[^ ]+" if phrases else "[^ ]+"
    return sentiment.trimmed(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def add_cased_sentiment(df: DataFrame, content: str, lexicon: DataFrame | None = None, phrases: dict[str, tuple[float | None, float]] | None = None,
                        buckets: int = 1024) -> DataFrame:
    """``df`` with compound, pos, neu, neg and sentiment_label of the raw text ``content``; its case matters.

    ``phrases`` gives lower-case phrases, words separated by one space, with a valence (None for phrases of degree) and a degree. Null texts
    score 0 like empty ones. The lexicon travels with every task, so its size is bounded (``sentiment.MAX_INDEX_WORDS``). Rows are scored where they are: no shuffle, no Python.
    """
    phrases = PHRASES if phrases is None else phrases
    if lexicon is None:
        index = sentiment._default_index(buckets, phrases)
    else:
        if not is_small(lexicon, sentiment.MAX_INDEX_WORDS):
            raise ValueError(f"a lexicon for texts in their own case has at most {sentiment.MAX_INDEX_WORDS} words")
        rows = [(p, v, float(b), 1.0) for p, (v, b) in phrases.items()]
        own = lexicon.select("word", "valence", "boost", "negation").where(~F.col("word").isin(list(phrases))) if phrases else lexicon
        if phrases:
            own = own.unionByName(df.sparkSession.createDataFrame(rows, "word string, valence double, boost double, negation double"))
        index = sentiment._index_of(own, buckets).scalar()
    out = df.withColumn("_clean", text.clean_text(F.coalesce(F.col(content), F.lit("")), lower=False))
    out = out.withColumns({"_lex": index, "_cased": phrase_tokens("_clean", phrases)}).withColumns({
        "_tok": F.expr("transform(_cased, w -> lower(w))"),
        "_caps": F.expr("transform(_cased, w -> w = upper(w) AND w <> lower(w))"),
    })
    slot = f"get(_lex, CAST(pmod(crc32(w), {buckets}) AS INT))"
    out = out.withColumns({
        "_plain": F.expr(f"transform(_tok, w -> try_element_at({slot}, w))"),
        "_but": F.expr("nullif(CAST(array_position(_tok, 'but') AS INT), 0) - 1"),
    })
    # In a text partly in capitals valences move away from 0, and degrees grow. Elsewhere the second array is empty, its marks are null.
    out = out.withColumn("_hit", F.expr(
        "zip_with(_plain, if(exists(_caps, x -> x) AND exists(_caps, x -> NOT x), _caps, CAST(array() AS ARRAY<BOOLEAN>)), (h, loud) -> "
        f"if(loud, named_struct('v', h.v + signum(h.v) * {CAPITALS}D, 'b', h.b + if(h.b <> 0, {CAPITALS}D, 0D), 'n', h.n), "
        "named_struct('v', h.v, 'b', h.b, 'n', h.n)))"))
    out = sentiment.add_sums(out, "size(_tok)").drop("_lex", "_cased", "_tok", "_caps", "_plain", "_hit", "_but", "_val")
    return sentiment.finish_scores(out, "_clean").drop("_clean")
