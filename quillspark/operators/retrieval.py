"""Sparse and dense retrieval of rows for a stated set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ranking import ranked
from quillspark.session import broadcast_if_small, cut

#: English words that no query is about.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "with")


#: Letters of words, and of scripts that set no blanks between words.
WORD, UNSPACED = "a-z0-9à-ɏ", "฀-๿຀-໿"
#: Plural endings (the letters before, the ending, what stays of it), tried in this order.
ENDINGS = (("b-df-z0-9à-ɏ", "ies", "y"), ("b-df-np-z0-9à-ɏ", "es", "e"), ("a-rtv-z0-9à-ɏ", "s", ""))
#: Marks the row that holds a document's length.
_LENGTH = "\x00"


def terms(c):
    """Words of Latin text in small letters without plural endings and stop words, ideographs one by one, and each two
    letters in a row of Lao and Thai."""
    low = F.lower(c)
    for before, ending, stays in ENDINGS:
        low = F.regexp_replace(low, f"([{before}]){ending}(?![{WORD}])", f"$1{stays}")
    words = F.filter(F.regexp_extract_all(low, F.lit(f"[{WORD}]+|[一-鿿]"), 0), lambda w: ~w.isin(*STOP))
    return F.concat(words, F.regexp_extract_all(low, F.lit(f"(?=([{UNSPACED}]{{2}}))"), 1))


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents of each query by BM25 (G01): ``query_id, doc_id, score, rank``.

    Texts are read once: of each document its length and its counts of terms of the queries are written, all else stays
    where it is. The terms are broadcast if few. Null and empty texts have no terms. Ties go to the lower doc_id."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    spark = docs.sparkSession
    bags = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("t")).withColumn("len", F.size("t")).where("len > 0")
    few = broadcast_if_small(wanted.select("term").unionByName(spark.createDataFrame([(_LENGTH,)], "term string")).distinct())
    counted = bags.select("doc_id", "len", F.explode(F.array_append("t", F.lit(_LENGTH))).alias("term")).join(few, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = cut(counted, "terms")
    stats = counted.where(F.col("term") == _LENGTH).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    tf = counted.where(F.col("term") != _LENGTH)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", "avg", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # stats is one row
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scores = tf.join(broadcast_if_small(cut(idf, "idf")), "term").join(broadcast_if_small(wanted), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score"))
    return ranked(scores, ["query_id"], [F.desc("score"), F.col("doc_id")]).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of greatest cosine for each query (G02): ``query_id, vec_id, score, rank``. ``queries`` has
    ``query_id, q``; it is a stated set, met with all rows where it is broadcast. Rows of norm 0 or null have no score; a
    row is no neighbour of itself."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    unit = lambda df, i, v: df.select(i, v, F.sqrt(dot(F.col(v), F.col(v))).alias("n")).where("n > 0")
    base = unit(vectors, vec_id, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col("n").alias("nv"))
    asked = unit(queries, "query_id", "q").withColumnRenamed("n", "nq")
    pairs = base.crossJoin(broadcast_if_small(asked, 20_000)).where("vec_id <> query_id")
    scores = pairs.select("query_id", "vec_id", F.round(dot(F.col("v"), F.col("q")) / (F.col("nv") * F.col("nq")), 6).alias("score"))
    return ranked(scores, ["query_id"], [F.desc("score"), F.col("vec_id")]).where(F.col("rank") <= k)
