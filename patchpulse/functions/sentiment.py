"""Lexicon sentiment after the rules published by Hutto and Gilbert (2014).

A word's valence is shifted by the degree words and flipped by the negations among the three words before it,
text after the first "but" counts more than text before it, and "!" and "?" amplify the sum. The compound
score is ``s / sqrt(s*s + 15)``.

The lexicon is a small hash index that travels as one array value: ``index[hash(word) % buckets]`` is a map of a
handful of words, so a look-up costs the same for sixty words and for ten thousand. Scoring is then a narrow
projection: no shuffle, no Python. Lexicons beyond ``MAX_INDEX_WORDS`` take the relational form, which joins the
exploded words with the table.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..session import broadcast_if_small, is_small, save_table
from . import text

# Fixed values of the published rules.
BOOST_DECAY = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION_STEP = 0.292
QUESTION_STEP = 0.18
QUESTION_MAX = 0.96
ALPHA = 15
# End of fixed values.

MAX_INDEX_WORDS = 100_000
ENTRY = "struct<v:double,b:double,n:double>"


def default_lexicon(spark: SparkSession) -> DataFrame:
    """word, valence, boost, negation of the shipped word lists."""
    rows = [(w, float(v), 0.0, 1.0) for w, v in config.SENTIMENT_WORDS.items()]
    rows += [(w, None, float(b), 1.0) for w, b in config.BOOSTER_WORDS.items()]
    rows += [(w, None, 0.0, NEGATION_FACTOR) for w in config.NEGATOR_WORDS]
    return spark.createDataFrame(rows, "word string, valence double, boost double, negation double")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated word list (word, mean valence, ...) joined with the shipped degree and negation words."""
    own = spark.read.csv(path, sep="\t", schema="word string, valence double", quote="")
    own = own.where("word is not null and valence is not null")
    # Words that differ only in case count as one, with the mean of their valences.
    own = own.groupBy(F.lower("word").alias("word")).agg(F.avg("valence").alias("valence"))
    modifiers = default_lexicon(spark).where("valence is null")
    return own.join(modifiers, "word", "left_anti").selectExpr(
        "word", "valence", "0D as boost", "1D as negation"
    ).unionByName(modifiers)


def _index_of(lexicon: DataFrame, buckets: int) -> DataFrame:
    """One row: array of ``buckets`` maps word -> (valence, boost, negation)."""
    entry = F.struct(F.col("valence").alias("v"), F.col("boost").alias("b"), F.col("negation").alias("n"))
    per_bucket = (
        lexicon.groupBy(F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("k"))
        .agg(F.map_from_entries(F.collect_list(F.struct("word", entry))).alias("m"))
    )
    filled = F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("by_k")
    return per_bucket.agg(filled).select(
        F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda k: F.col("by_k")[k]).alias("lexicon_index")
    )


def _default_index(buckets: int, phrases: dict[str, tuple[float | None, float]] | None = None) -> Column:
    """The shipped lexicon, and phrases with valence and degree, as a constant: no job, no subquery."""
    slots: list[dict] = [{} for _ in range(buckets)]

    def put(word: str, v: float | None, b: float, n: float) -> None:
        slots[zlib.crc32(word.encode()) % buckets][word] = {"v": v, "b": b, "n": n}

    for w, v in config.SENTIMENT_WORDS.items():
        put(w, v, 0.0, 1.0)
    for w, b in config.BOOSTER_WORDS.items():
        put(w, None, b, 1.0)
    for w in config.NEGATOR_WORDS:
        put(w, None, 0.0, NEGATION_FACTOR)
    for p, (v, b) in (phrases or {}).items():
        put(p, v, b, 1.0)
    return F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{ENTRY}>>")


def tokens(processed: Column | str) -> Column:
    """Words of a processed text (single spaces) with surrounding punctuation removed.

    A word of which only one or two characters would be left stays as it is.
    """

    c = F.col(processed) if isinstance(processed, str) else processed
    return trimmed(F.filter(F.split(c, " "), lambda w: w != ""))


def trimmed(kept: Column) -> Column:
    marks = F.lit(text.PUNCTUATION)
    return F.transform(kept, lambda w: F.when(F.length(F.btrim(w, marks)) <= 2, w).otherwise(F.btrim(w, marks)))


def _word_value(entry: str, at: str) -> str:
    """SQL for the valence at position ``at`` after the degree and negation words up to three places before it.

    ``entry`` is a format string that yields the lexicon entry at a position.
    """
    before = ", ".join(
        f"named_struct('b', coalesce({entry.format(f'{at} - {k}')}.b, 0D) * {decay}D, "
        f"'n', coalesce({entry.format(f'{at} - {k}')}.n, 1D))"
        for k, decay in enumerate(BOOST_DECAY, start=1)
    )
    return (
        f"aggregate(array({before}), {entry.format(at)}.v, (acc, p) -> (acc + if(acc < 0, -p.b, p.b)) * p.n)"
    )


def _but_factor(at: str) -> str:
    return f"CASE WHEN _but IS NULL OR {at} = _but THEN 1D WHEN {at} < _but THEN {BEFORE_BUT}D ELSE {AFTER_BUT}D END"


def _sums(n_words: str) -> dict[str, Column]:
    return {
        "_sum": F.expr("aggregate(_val, 0D, (a, v) -> a + v)"),
        "_pos": F.expr("aggregate(_val, 0D, (a, v) -> a + if(v > 0, v + 1, 0D))"),
        "_neg": F.expr("aggregate(_val, 0D, (a, v) -> a + if(v < 0, 1 - v, 0D))"),
        "_zero": F.expr(f"CAST({n_words} - size(filter(_val, v -> v != 0)) AS INT)"),
    }


def add_sentiment(df: DataFrame, processed: str = "review_content_processed",
                  lexicon: DataFrame | None = None, buckets: int = 1024) -> DataFrame:
    """Add compound, pos, neu, neg and sentiment_label computed from the processed text.

    Rows whose text is NULL score 0 like empty texts. A lexicon of more than ``MAX_INDEX_WORDS`` words is joined instead of
    looked up in place; the scores are the same.
    """
    if lexicon is None:
        buckets = 128
        index = _default_index(buckets)
    elif is_small(lexicon, MAX_INDEX_WORDS):
        index = _index_of(lexicon, buckets).scalar()
    else:  # each distinct text is scored once, under a hash of it
        keyed = df.withColumn("_text_id", F.md5(F.coalesce(F.col(processed), F.lit(""))))
        texts = keyed.groupBy("_text_id").agg(F.any_value(F.coalesce(F.col(processed), F.lit(""))).alias("_text"))
        scores = add_sentiment_relational(texts, ["_text_id"], "_text", lexicon)
        return keyed.join(scores.drop("_text"), "_text_id", "left").drop("_text_id")

    out = df.withColumns({"_lex": index, "_tok": tokens(F.coalesce(F.col(processed), F.lit("")))})
    slot = f"get(_lex, CAST(pmod(crc32(w), {buckets}) AS INT))"
    out = out.withColumns({
        "_hit": F.expr(f"transform(_tok, w -> try_element_at({slot}, w))"),
        "_but": F.expr("nullif(CAST(array_position(_tok, 'but') AS INT), 0) - 1"),
    })
    out = add_sums(out, "size(_tok)").drop("_lex", "_tok", "_hit", "_but", "_val")
    return finish_scores(out, processed)


def add_sums(df: DataFrame, n_words: str) -> DataFrame:
    """Values of the words and their sums, from the entries ``_hit`` by position and the position ``_but``."""
    places = "filter(transform(_hit, (h, i) -> if(h.v IS NOT NULL, i, NULL)), i -> i IS NOT NULL)"
    out = df.withColumn(
        "_val", F.expr(f"transform({places}, i -> {_word_value('get(_hit, {})', 'i')} * {_but_factor('i')})")
    )
    return out.withColumns(_sums(n_words))


def emphasis(processed: str) -> Column:
    """What exclamation and question marks add."""
    body = f"coalesce(`{processed}`, '')"
    n_quest = f"length({body}) - length(replace({body}, '?', ''))"
    n_excl = f"least(length({body}) - length(replace({body}, '!', '')), 4)"
    return F.expr(
        f"{n_excl} * {EXCLAMATION_STEP}D + CASE WHEN {n_quest} <= 1 THEN 0D "
        f"WHEN {n_quest} <= 3 THEN ({n_quest}) * {QUESTION_STEP}D ELSE {QUESTION_MAX}D END"
    )


def finish_scores(df: DataFrame, processed: str) -> DataFrame:
    """Turn the per-row sums ``_sum``, ``_pos``, ``_neg`` and the count ``_zero`` into the published scores; ``_emph`` may be given."""
    out = df if "_emph" in df.columns else df.withColumn("_emph", emphasis(processed))
    out = out.withColumns({
        "_s": F.expr("_sum + signum(_sum) * _emph"),
        "_p": F.expr("_pos + if(_pos > _neg, _emph, 0D)"),
        "_n": F.expr("_neg + if(_neg > _pos, _emph, 0D)"),
    })

    def part(x: str) -> Column:
        return F.expr(f"if(_p + _n + _zero > 0, bround({x} / nullif(_p + _n + _zero, 0D), 3), 0D)")

    compound = F.expr(f"bround(_s / sqrt(_s * _s + {ALPHA}), 4) + 0D")
    out = out.withColumn("_scores", F.struct(
        compound.alias("compound"), part("_p").alias("pos"), part("_zero").alias("neu"), part("_n").alias("neg"),
    ))
    # Scores come out of a generator, so that a later filter on them reads the value; pushed below a projection
    # the filter would compute the whole score again, once per mention.
    kept = [c for c in df.columns if c not in ("_sum", "_pos", "_neg", "_zero", "_emph")]
    out = out.select(*kept, F.inline(F.array("_scores")))
    return out.withColumn("sentiment_label", label("compound"))


def label(compound: Column | str, cut: float = config.LABEL_CUT) -> Column:
    """positive / negative / neutral; the cut itself is labelled."""
    c = F.col(compound) if isinstance(compound, str) else compound
    return F.when(c >= cut, "positive").when(c <= -cut, "negative").otherwise("neutral")


def label_code(label_col: Column | str) -> Column:
    """negative 0, neutral 1, positive 2."""
    c = F.col(label_col) if isinstance(label_col, str) else label_col
    return F.when(c == "negative", 0).when(c == "positive", 2).otherwise(1)


def add_sentiment_relational(df: DataFrame, id_cols: list[str], processed: str, lexicon: DataFrame) -> DataFrame:
    """The same scores for lexicons of any size, by joining exploded words with the table.

    Only words of the lexicon are shuffled, as (id, position, entry): a small lexicon goes to the texts, and so do the words of a large one that
    the texts use where these are few. Texts are never shuffled, unless columns of ``df`` that hold them are read from the result.
    """
    base = df.withColumn("_tok", tokens(F.coalesce(F.col(processed), F.lit(""))))
    words_of = base.select(*id_cols, F.posexplode("_tok").alias("i", "word"))
    if not is_small(lexicon):
        lexicon = save_table(lexicon.join(words_of.select("word").distinct(), "word", "left_semi"), "used-words")
    entry = F.struct(F.col("valence").alias("v"), F.col("boost").alias("b"), F.col("negation").alias("n"))
    looked = words_of.join(broadcast_if_small(lexicon), "word").where("boost IS NOT NULL")
    hits = looked.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(F.struct("i", entry))).alias("_hit"))

    places = "filter(array_sort(map_keys(_hit)), i -> try_element_at(_hit, i).v IS NOT NULL)"
    value = f"{_word_value('try_element_at(_hit, {})', 'i')} * {_but_factor('i')}"
    counted = base.withColumns({
        "_n_tok": F.size("_tok"), "_but": F.expr("nullif(CAST(array_position(_tok, 'but') AS INT), 0) - 1"), "_emph": emphasis(processed)}).drop("_tok")
    scored = counted.join(hits, id_cols, "left").withColumn("_val", F.expr(f"coalesce(transform({places}, i -> {value}), array())"))
    scored = scored.withColumns(_sums("_n_tok")).drop("_hit", "_val", "_n_tok", "_but")
    return finish_scores(scored, processed)
