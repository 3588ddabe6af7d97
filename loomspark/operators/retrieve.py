"""Retrieval by terms: frequencies, TF-IDF weights, sparse cosine, weighted overlap, affinity, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions import text as tx


def document_frequency(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (token, df): number of documents that hold each token."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(docs: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln(N / (1 + df))."""
    n = docs.count()
    return document_frequency(docs).withColumn("idf", F.log(F.lit(n) / (F.col("df") + 1.0)))


#: A token in one of so many documents or more is frequent. With d distinct tokens a document on average there are at
#: most d * FREQUENT such tokens, however many documents there are.
FREQUENT = 1000


def weights(docs: DataFrame) -> DataFrame:
    """(doc_id, token, w): (1 + ln tf) idf for tokens of positive idf.

    Weights of frequent tokens meet their many rows in a join of their own, whose other side has a
    bounded number of rows: adaptive execution broadcasts it where its measured size allows. Only rows
    of rare tokens, of which none is skewed, are left to be joined by token.
    """
    n = docs.count()
    tf = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    # one row a document and token: frequencies come from the same exchange, so texts are split once
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = df.withColumn("idf", F.log(F.lit(n) / (F.col("df") + 1.0))).where("idf > 0")
    if n < 2 * FREQUENT:
        return tf.join(idf, "token").select("doc_id", "token", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    many = F.col("df") >= n // FREQUENT
    common = tf.join(idf.where(many), "token").select("doc_id", "token", "tf", "idf")
    rare = tf.join(idf.where(~many), "token").select("doc_id", "token", "tf", "idf")
    return common.unionByName(rare).select("doc_id", "token", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def top_terms(docs: DataFrame, k: int) -> DataFrame:
    """The k heaviest tokens of each document; ties by token."""
    rounded = weights(docs).select("doc_id", "token", F.round("w", 6).alias("w"))
    order = W.partitionBy("doc_id").orderBy(F.desc("w"), "token")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "rank", "token", "w")


def neighbour_cosine(rows: DataFrame) -> DataFrame:
    """Cosine of each message with the next turn of its conversation, where they share a weighted token.

    ``doc_id`` of ``rows`` is a struct of conv_id and turn.
    """
    w = weights(rows).select("doc_id.conv_id", "doc_id.turn", "token", "w")
    norms = w.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), "token", F.col("w").alias("w2"))
    dot = w.join(after, ["conv_id", "turn", "token"]).groupBy("conv_id", "turn").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"))
    next_norms = norms.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("norm2"))
    joined = dot.join(norms, ["conv_id", "turn"]).join(next_norms, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", F.round(F.col("dot") / (F.col("norm") * F.col("norm2")), 6).alias("cosine"))


def feature_dims(docs: DataFrame) -> DataFrame:
    """Binary dimensions beside the text: file 2.0, tag 1.5, type 1.5."""
    dims = F.array(
        F.struct(F.concat(F.lit("file:"), "source").alias("dim"), F.lit(2.0).alias("w")),
        F.struct(F.concat(F.lit("tag:"), "lang").alias("dim"), F.lit(1.5).alias("w")),
        F.struct(F.lit("type:result").alias("dim"), F.lit(1.5).alias("w")),
    )
    return docs.select("doc_id", F.explode(dims).alias("x")).select("doc_id", "x.dim", "x.w")


def stemmed_idf(freq: DataFrame, n: int) -> DataFrame:
    """(stem, df, idf): frequencies of tokens added up by stem, ln(N / (1 + df))."""
    stems = freq.groupBy(tx.stem(F.col("token")).alias("stem")).agg(F.sum("df").alias("df"))
    return stems.withColumn("idf", F.log(F.lit(n) / (F.col("df") + 1.0)))


def overlap_recall(rows: DataFrame, floor: float = 0.3, least: int = 2) -> DataFrame:
    """Earlier messages of a conversation recalled by shared stems.

    The score adds up the idf of shared stems of positive idf; at least ``least`` must reach ``floor``.
    """
    n = rows.count()
    idf = stemmed_idf(document_frequency(rows.select(F.struct("conv_id", "turn").alias("doc_id"), "text")), n).where("idf > 0").select("stem", "idf")
    terms = rows.select("conv_id", "turn", F.explode(tx.distinctive_terms(F.col("text"))).alias("stem")).join(idf, "stem")
    # pairs meet by strong stems only; what weak ones add is found within the pairs that are left
    strong = terms.where(F.col("idf") >= floor)
    earlier = strong.select("conv_id", F.col("turn").alias("earlier"), "stem")
    pairs = strong.join(earlier, ["conv_id", "stem"]).where("earlier < turn").groupBy("conv_id", "turn", "earlier").agg(F.count(F.lit(1)).alias("distinctive")).where(F.col("distinctive") >= least)
    held = terms.groupBy("conv_id", "turn").agg(F.collect_list(F.struct("stem", "idf")).alias("own"))
    both = pairs.join(held, ["conv_id", "turn"]).join(held.select("conv_id", F.col("turn").alias("earlier"), F.col("own").alias("other")), ["conv_id", "earlier"])
    shared = F.aggregate(F.array_sort(F.array_intersect("own", "other")), F.lit(0.0), lambda a, x: a + x["idf"])
    return both.select("conv_id", "turn", "earlier", F.round(shared, 4).alias("score"), "distinctive")


def affinity(sets: DataFrame, least: int = 1) -> DataFrame:
    """(set_id, item) to (a, b, score): ordered pairs by how often they share a set, over the largest count."""
    one = sets.select("set_id", "item").distinct()
    pairs = one.select("set_id", F.col("item").alias("a")).join(one.select("set_id", F.col("item").alias("b")), "set_id").where("a < b")
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top")).scalar()
    kept = counts.where(F.col("n") >= least).select("a", "b", (F.col("n") / top).alias("score"))
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return kept.select(turned.alias("p"), "score").select("p.a", "p.b", "score")


def best_of(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
