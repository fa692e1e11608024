"""Mixing to target weights: token weights raked to marginals, then documents drawn with calibrated probabilities."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Exponents on natural shares that give the targets: below 1 they favour what is rare.
TEMPERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 12
#: The least share of all tokens to draw. One over the largest ratio falls without bound as a cell gets rarer; below this share the
#: probabilities are calibrated instead. The SQL of the query holds down to here, as it does on every supplied table.
KEEP = 0.45
SEED = "mix"
#: Bytes of the table of cells up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8_000_000
#: The corpus has no topics: the shape of a text stands in for one. Any SQL expression over the columns can take its place.
TOPIC = """CASE WHEN __words < 1 THEN 'empty' WHEN 20 * __bars > __words THEN 'table' WHEN __words < 100 THEN 'short'
     WHEN __words < 1000 THEN 'medium' ELSE 'long' END"""
BARS = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), '|', ''))"

#: Python generates one text for Spark and for the database that checks it; only these parts differ.
SPARK = {"words": r"regexp_count(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')", "unit": "CAST(conv(substr(md5(concat('{seed}:', coalesce(CAST(doc_id AS STRING), ''))), 1, 12), 16, 10) AS BIGINT)"}
CHECK = {"words": r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))", "unit": "CAST('0x' || substr(md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 12) AS BIGINT)"}


def document_sql(dialect: dict[str, str], source: str, topic: str = TOPIC) -> str:
    """Every document with its cell and tokens; null categories count as the empty one."""
    return f"""SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, CAST(__words AS BIGINT) AS tokens
      FROM (SELECT doc_id, source, lang, {dialect["words"]} AS __words, {BARS} AS __bars FROM {source}) w"""


def cells_sql(documents: str, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, goals_too: bool = False) -> str:
    """Cells (source, language, topic) with ``ratio``: raked over natural token weight; ``goals_too`` adds tokens and target shares.

    Each step scales the cells of one category value so that they sum to its target. The cells are a small aggregate of the documents.
    """
    tempers = tempers or TEMPERS
    targets = ", ".join(f"pow(CAST(sum(tokens) OVER (PARTITION BY {c}) AS DOUBLE) / sum(tokens) OVER (), {t}) AS raw_{c}, row_number() OVER (PARTITION BY {c} ORDER BY source, lang, topic) AS no_{c}" for c, t in tempers.items())
    goals = ", ".join(f"raw_{c} / sum(CASE WHEN no_{c} = 1 THEN raw_{c} ELSE 0 END) OVER () AS goal_{c}" for c in tempers)
    q = f"SELECT source, lang, topic, sum(tokens) AS tokens FROM ({documents}) d GROUP BY source, lang, topic HAVING sum(tokens) > 0"
    q = f"SELECT source, lang, topic, tokens, {targets} FROM ({q}) c"
    q = f"SELECT source, lang, topic, tokens, {goals}, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS w FROM ({q}) t"
    keep = ", ".join(f"goal_{c}" for c in tempers)
    for _ in range(rounds):
        for c in tempers:
            q = f"SELECT source, lang, topic, tokens, {keep}, w * goal_{c} / sum(w) OVER (PARTITION BY {c}) AS w FROM ({q}) s"
    more = f", tokens, {keep}" if goals_too else ""
    q = f"SELECT source, lang, topic, w / (CAST(tokens AS DOUBLE) / sum(tokens) OVER ()) AS ratio{more} FROM ({q}) r"
    return f"SELECT source, lang, topic{more}, round(ratio, 9) AS ratio, round(ratio / max(ratio) OVER (), 9) AS probability FROM ({q}) p"


def filled_sql(cells: str, weight: str, name: str, share: float) -> str:
    """``cells`` with ``name`` = min(1, c * weight / tokens), c such that the expected tokens are ``share`` of all.

    Expected tokens are a concave function of c, the least of all its pieces 'the first cells whole, the others by weight'; so c is the
    largest of the solutions of the pieces.
    """
    order = f"ORDER BY {weight} / tokens DESC, source, lang, topic ROWS BETWEEN"
    piece = f"({share} * sum(tokens) OVER () - coalesce(sum(tokens) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum({weight}) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    q = f"SELECT *, {piece} AS __piece FROM ({cells}) f"
    return f"SELECT *, least(1.0D, max(__piece) OVER () * {weight} / tokens) AS {name} FROM ({q}) g"


def calibrated(cells: DataFrame, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, share: float = KEEP) -> DataFrame:
    """Cells with a ``probability`` of at most 1 that draws ``share`` of all tokens.

    Targets above all tokens of a category value become these tokens, and the other values share what is over. Raking to
    them leaves cells at 1 as they are and scales the others; a last step sets the total.
    """
    tempers = tempers or TEMPERS

    def step(q: str) -> None:
        nonlocal cells
        cells = cells.sparkSession.sql(q, cells=cells)

    for c in tempers:
        step(f"SELECT *, CAST(sum(tokens) OVER (PARTITION BY {c}) AS DOUBLE) AS sum_{c} FROM {{cells}}")
        step(f"SELECT * EXCEPT (__piece) FROM ({filled_sql('SELECT * FROM {cells}', f'(goal_{c} * tokens / sum_{c})', f'most_{c}', share)}) h")
    step(f"SELECT * EXCEPT (__piece) FROM ({filled_sql('SELECT * FROM {cells}', '(ratio * tokens)', 'p', share)}) h")
    for _ in range(rounds):
        for c in tempers:
            wanted = f"(most_{c} * sum_{c})"
            scaled = f"CASE WHEN {wanted} <= now THEN p * {wanted} / now WHEN p >= 1 OR now <= whole THEN p ELSE least(1.0D, p * ({wanted} - whole) / (now - whole)) END"
            sums = f"sum(tokens * p) OVER (PARTITION BY {c}) AS now, sum(CASE WHEN p >= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY {c}) AS whole"
            step(f"SELECT * EXCEPT (p, now, whole), {scaled} AS p FROM (SELECT *, {sums} FROM {{cells}}) s")
    goals = ", ".join(f"goal_{c}" for c in tempers)
    step(f"SELECT source, lang, topic, tokens, {goals}, ratio, round(drawn, 9) AS probability FROM ({filled_sql('SELECT * FROM {cells}', '(p * tokens)', 'drawn', share)}) u")
    return cells


def drawn_sql(dialect: dict[str, str], documents: str, cells: str, seed: str = SEED) -> str:
    """Documents with their probability, and whether a hash of the id draws them."""
    unit = dialect["unit"].format(seed=seed)
    return f"""SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, coalesce(c.ratio, 0.0) AS ratio, coalesce(c.probability, 1.0) AS probability,
      {unit} < coalesce(c.probability, 1.0) * 281474976710656 AS sampled
      FROM ({documents}) d LEFT JOIN {cells} c ON c.source = d.source AND c.lang = d.lang AND c.topic = d.topic"""


def oracle(source: str = "documents") -> str:
    documents = document_sql(CHECK, source)
    return f"WITH cells AS ({cells_sql(documents)}) {drawn_sql(CHECK, documents, 'cells')}"


def fitted(docs: DataFrame, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, topic: str = TOPIC) -> DataFrame:
    """The raked cells with tokens and target shares, written to the shared folder; broadcast where they are small."""
    spark = docs.sparkSession
    documents = document_sql(SPARK, "{docs}", topic)
    path = fresh_path(spark, "mix-cells")
    spark.sql(cells_sql(documents, tempers, rounds, True), docs=docs).write.parquet(path)
    cells = spark.read.parquet(path)
    width = F.sum(F.octet_length("source") + F.octet_length("lang") + F.octet_length("topic") + 64)
    width, share = cells.agg(width, F.sum(F.col("tokens") * F.col("probability")) / F.sum("tokens")).first()
    if share is not None and share < KEEP:
        path = fresh_path(spark, "mix-calibrated")
        calibrated(cells, tempers, rounds).write.parquet(path)
        cells = spark.read.parquet(path)
        short = shortfalls(cells, tempers).orderBy(F.desc(F.col("target") - F.col("expected"))).limit(20).collect()
        for r in short:
            logging.getLogger(__name__).warning("mixing: %s %r can have %.4g of the tokens drawn, not %.4g, without repetition", *r)
    return F.broadcast(cells) if (width or 0) <= BROADCAST_BYTES else cells


def shortfalls(cells: DataFrame, tempers: dict[str, float] | None = None) -> DataFrame:
    """(category, value, expected, target) of the values in fitted ``cells`` whose share of the drawn tokens is over 1 % below its target."""
    parts = [
        f"SELECT '{c}' AS category, {c} AS value, sum(tokens * probability) / first(__all) AS expected, first(goal_{c}) AS target FROM c GROUP BY {c}"
        for c in tempers or TEMPERS
    ]
    everything = "SELECT *, sum(tokens * probability) OVER () AS __all FROM {cells}"
    return cells.sparkSession.sql(f"WITH c AS ({everything}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE expected < 0.99D * target", cells=cells)


def mix(docs: DataFrame, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, topic: str = TOPIC, seed: str = SEED) -> DataFrame:
    """Every document with its raking ratio, its probability and whether it is drawn.

    Reads ``doc_id``, ``text``, ``source`` and ``lang``; other columns are ignored. Tokens (runs without ASCII white space) of the whole texts
    are summed by source, language and topic. Iterative proportional fitting scales these cells in turn to target shares of
    sources, languages and topics, natural shares to the power ``tempers``. A cell's ratio is its raked over its natural share; over the
    largest ratio it is the probability of its documents, so expected tokens meet the targets and none is needed twice. Where this would
    draw less than ``KEEP`` of all tokens, as it does when a cell is very rare, probabilities are calibrated to that share: cells that would
    be needed more than once are drawn whole, the others make up for them, and targets out of reach are logged (``shortfalls``).
    A hash of the id draws the same documents on every run. Only SQL functions run.

    Null sources and languages count as the empty name. Null and empty texts have no tokens, a probability of 1 and ratio 0. Repeated ids
    are drawn or left together; an empty table gives none.
    """
    spark = docs.sparkSession
    cells = fitted(docs, tempers, rounds, topic)
    return spark.sql(drawn_sql(SPARK, document_sql(SPARK, "{docs}", topic), "{cells}", seed), docs=docs, cells=cells)


def draw(docs: DataFrame, tempers: dict[str, float] | None = None, rounds: int = ROUNDS, topic: str = TOPIC, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, in one more pass and without moving the texts."""
    spark = docs.sparkSession
    cells = fitted(docs, tempers, rounds, topic).select(F.col("source").alias("__s"), F.col("lang").alias("__l"), F.col("topic").alias("__t"), F.col("probability").alias("__p"))
    keyed = docs.withColumns({"__words": F.expr(SPARK["words"]), "__bars": F.expr(BARS)}).withColumn("__topic", F.expr(topic))
    match = (F.col("__s") == F.coalesce("source", F.lit(""))) & (F.col("__l") == F.coalesce("lang", F.lit(""))) & (F.col("__t") == F.col("__topic"))
    hit = F.expr(f"{SPARK['unit'].format(seed=seed)} < coalesce(__p, 1.0) * 281474976710656")
    return keyed.join(cells, match, "left").where(hit).select(*[keyed[c] for c in docs.columns])
