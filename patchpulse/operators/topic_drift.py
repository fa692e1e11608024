"""Topics of successive periods under stable ids."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import save_table


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """For each row the column that makes the sum of gains greatest, every column used once (shortest augmenting paths).

    ``gain`` is square; here its side is the number of topics.
    """
    n = len(gain)
    row_price, column_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)  # the row that holds a column
    for row in range(n):
        distance, came_from, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        at, via, so_far = row, -1, 0.0
        while True:
            step = so_far - gain[at] - row_price[at] - column_price
            nearer = ~done & (step < distance - 1e-15)
            distance[nearer], came_from[nearer] = step[nearer], via
            via = int(np.argmin(np.where(done, np.inf, distance)))
            done[via], so_far = True, distance[via]
            if owner[via] < 0:
                break
            at = owner[via]
        settled = np.flatnonzero(done & (owner >= 0))
        row_price[row] += so_far
        row_price[owner[settled]] += so_far - distance[settled]
        column_price[done] -= so_far - distance[done]
        while via >= 0:  # move every row on the path to its new column
            before = int(came_from[via])
            owner[via] = owner[before] if before >= 0 else row
            via = before
    out = np.empty(n, int)
    out[owner] = np.arange(n)
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines between the rows of two non-negative matrices (0 for empty rows)."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return unit(a) @ unit(b).T


def topics_over_time(df: DataFrame, content: str, period: Column, n_topics: int = 6, vocab: int = 500, iterations: int = 10,
                     seed: int = 7, n_words: int = 8) -> DataFrame:
    """period, topic, n_rows, similarity, words: the topics of every period's own fit, numbered as the topics of the period before.

    All fits share one vocabulary, so word distributions can be compared. Ids follow from the assignment with the greatest sum of cosines
    between the topics of a period and those of the period before; ``similarity`` is the cosine of a matched pair (NULL in the first period,
    where ids are those of the fit). Only matrices of topics times words reach the driver, one a period; texts stay in Spark. Rows without
    a text, a word of the vocabulary or a period are left out, so there is no row for a period without words. ``n_rows`` counts the rows whose
    strongest topic it is (ties to the lowest number of the fit).
    """
    spark = df.sparkSession
    rows = df.select(period.alias("period"), F.col(content).alias("_text")).where("period IS NOT NULL AND _text IS NOT NULL")
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\W+", minTokenLength=2).transform(rows)
    words = save_table(words.drop("_text"), "topic-words")
    schema = f"period {words.schema['period'].dataType.simpleString()}, topic int, n_rows bigint, similarity double, words array<string>"
    if words.where(F.size("_words") > 0).isEmpty():
        return spark.createDataFrame([], schema)
    counter = CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocab).fit(words)
    counted = counter.transform(words).select("period", "_counts").where(F.array_max(vector_to_array("_counts")) > 0)
    counted = save_table(counted, "topic-counts")
    out, before = [], None
    for (at,) in counted.select("period").distinct().orderBy("period").collect():  # one row a period
        mine = save_table(counted.where(F.col("period") == F.lit(at)), "period-counts")  # every iteration reads this period alone
        model = LDA(k=n_topics, maxIter=iterations, seed=seed, featuresCol="_counts", topicDistributionCol="_dist", optimizer="online",
                    subsamplingRate=1.0).fit(mine)
        topics = model.topicsMatrix().toArray().T
        topics = topics / topics.sum(axis=1, keepdims=True)
        near = None if before is None else cosine(topics, before)
        ids = np.arange(n_topics) if near is None else best_assignment(near)
        strongest = F.expr("array_position(_p, array_max(_p)) - 1")
        sizes = dict(model.transform(mine).select(vector_to_array("_dist").alias("_p")).groupBy(
            strongest.alias("t")).agg(F.count("*")).collect())  # one row a topic
        for t, i in enumerate(ids):
            top = [counter.vocabulary[w] for w in np.argsort(-topics[t], kind="stable")[:n_words]]
            out.append((at, int(i), int(sizes.get(t, 0)), None if near is None else float(near[t, i]), top))
        before = np.empty_like(topics)
        before[ids] = topics
    return spark.createDataFrame(out, schema)
