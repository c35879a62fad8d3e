"""Exemplar search and embedding changes over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.functions.expressions import cosine


def top_exemplars(queries: DataFrame, exemplars: DataFrame, k: int, most_exemplars: int = 10_000) -> DataFrame:
    """query, exemplar, similarity, rank: the k most similar exemplars of each query, not itself; both have id, embedding.

    Exemplars are a reference set: they are broadcast as one matrix after a count has shown that they are at most
    most_exemplars. Each batch of queries is compared by one matrix product and keeps its k best, so nothing is
    shuffled. A vector of zeros has no similarity and comes last; ties go to the smaller exemplar.
    """
    rows = exemplars.select("id", "embedding").orderBy("id").limit(most_exemplars + 1).collect()
    if len(rows) > most_exemplars:
        raise ValueError(f"more than {most_exemplars} exemplars; at most that many are compared with every query")
    ids = np.array([r.id for r in rows], np.int64)
    shared = queries.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r.embedding for r in rows], float).reshape(len(rows), -1))))

    def best(batches):
        names, matrix = shared.value
        for batch in batches:
            for part in (batch.iloc[i : i + 1000] for i in range(0, len(batch), 1000)):
                own = part["query"].to_numpy()
                score = _unit(np.array(part["embedding"].tolist(), float).reshape(len(part), -1)) @ matrix.T if len(names) else np.zeros((len(part), 0))
                score = np.where(np.isnan(score), -2.0, score)
                score[own[:, None] == names[None, :]] = -3.0
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]  # exemplars stand by id, so ties go to the smaller
                taken = np.take_along_axis(score, order, axis=1)
                row, rank = np.nonzero(taken > -3.0)
                value = taken[row, rank]
                yield pd.DataFrame({"query": own[row], "exemplar": names[order[row, rank]], "similarity": pd.Series(value).where(value > -2.0), "rank": rank + 1})

    return queries.select(F.col("id").cast("long").alias("query"), "embedding").filter("embedding is not null").mapInPandas(best, "query long, exemplar long, similarity double, rank int")


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN for rows of zeros."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.full_like(vectors, np.nan), where=length > 0)


def deltas(df: DataFrame, keys: list[str], order: str, embedding: str) -> DataFrame:
    """keys, order, similarity to the row before."""
    before = F.lag(embedding).over(Window.partitionBy(*keys).orderBy(order))
    return df.select(*keys, order, embedding, before.alias("_b")).select(*keys, order, cosine(F.col("_b"), F.col(embedding)).alias("similarity"))
