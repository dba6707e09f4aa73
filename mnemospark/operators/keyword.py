"""Keyword search (K7, K9): BM25 over a text table or a stored index, plus
snippets.

``Postings`` is a stored index: a table of postings ``(term, id, tf, dl)`` in
folders by the term's hash, sorted by term in each file, and beside it the
terms' document frequencies and the corpus totals.  A search reads the folders
of its terms and, by the files' statistics, the row groups that hold them; no
text is read or cut into words again.  Each batch of documents is a part of
its own that a repeated call rewrites; frequencies and totals of the parts
add up.

``bm25_top_k`` searches a table that has no index.  Plan: tags stripped and text tokenised per row (no shuffle); the
tokens are filtered to the query terms before they are exploded, so only
matching tokens become rows and reach the one partial aggregate ``(doc, term) -> tf``.
Document frequency per term is an aggregate of those rows.  Corpus size
and mean length are one global aggregate (two numbers on the driver).
The final ranking is a ``TakeOrderedAndProject`` top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# BM25 parameters and the tokeniser.
BM25_K1 = 1.2
BM25_B = 0.75
TAG_PATTERN = r"<[^>]*>"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SNIPPET_BEFORE = 40
SNIPPET_CHARS = 160


def plain_text(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(h, TAG_PATTERN, " ")


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    import regex
    return sorted({t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t})


def bm25_top_k(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 3,
               html: bool = False) -> DataFrame:
    """K7: the k best documents for ``query``: ``id, score``."""
    terms = query_terms(query)
    if not terms:
        raise ValueError("query has no terms")
    text = plain_text(text_col) if html else F.col(text_col)
    tok = docs.select(id_col, tokens(text).alias("_t"))
    stats = tok.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("avgdl")).first()
    n_docs, avgdl = int(stats["n"]), float(stats["avgdl"] or 0.0)
    if n_docs == 0:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, score double")
    hits = (tok.select(id_col, F.size("_t").alias("dl"), F.explode(F.filter("_t", lambda x: x.isin(terms))).alias("term"))
            .groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    df_t = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _best(hits, df_t, n_docs, avgdl, id_col, k)


def _best(hits: DataFrame, df_t: DataFrame, n_docs: int, avgdl: float, id_col: str, k: int) -> DataFrame:
    """The k best ids of postings ``id, dl, term, tf`` of the query's terms."""
    idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    part = idf * F.col("tf") * F.lit(BM25_K1 + 1) / (F.col("tf") + norm)
    # df_t holds one row per query term: a proven bound for the broadcast.
    scored = (hits.join(F.broadcast(df_t), "term")
              .groupBy(id_col).agg(F.sum(part).alias("score")))
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


#: Folders that the terms are dealt to.
BUCKETS = 64


class Postings:
    """A stored keyword index under a shared path (see the module)."""

    def __init__(self, spark: SparkSession, root: str, id_col: str, buckets: int = BUCKETS):
        self.spark, self.root, self.id_col, self.buckets = spark, root.rstrip("/"), id_col, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, text_col: str, part: str, html: bool = False) -> None:
        """Indexes ``docs`` as ``part`` (letters, digits, ``_ . -``); a part
        of that name is replaced.  Null texts count as documents without
        words.  An id belongs to one part."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", part):
            raise ValueError(f"bad part name {part!r}")
        text = F.coalesce(plain_text(text_col) if html else F.col(text_col), F.lit(""))
        words = docs.select(self.id_col, tokens(text).alias("_t"))
        counted = (words.select(self.id_col, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
                   .groupBy(self.id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))  # a document's words are in one task
                   .withColumn("bucket", self._bucket(F.col("term"))))
        # by range, so that a frequent term's postings are dealt to several tasks
        (counted.repartitionByRange("bucket", "term", self.id_col).sortWithinPartitions("bucket", "term", self.id_col)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/part=p-{part}"))
        stored = self.spark.read.schema(counted.schema).parquet(f"{self.root}/postings/part=p-{part}")
        (stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
         .repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/terms/part=p-{part}"))
        (words.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("_t")), F.lit(0)).alias("words"))
         .write.mode("overwrite").parquet(f"{self.root}/totals/part=p-{part}"))

    def _of(self, table: str, terms: list[str]) -> DataFrame:
        """The rows of ``terms``: their folders only, then their row groups."""
        buckets = [self._bucket(F.lit(t)) for t in terms]
        return (self.spark.read.parquet(f"{self.root}/{table}")
                .filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)))

    def top_k(self, query: str, k: int = 3) -> DataFrame:
        """K7: the k best documents for ``query``: ``id, score``."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("query has no terms")
        totals = self.spark.read.parquet(f"{self.root}/totals").agg(F.sum("docs").alias("n"), F.sum("words").alias("w")).first()
        n_docs = int(totals["n"])
        if not totals["w"]:  # no part has a word
            return self.spark.createDataFrame([], f"{self.id_col} long, score double")
        df_t = self._of("terms", terms).groupBy("term").agg(F.sum("df").alias("df"))
        hits = self._of("postings", terms).select(self.id_col, "dl", "term", "tf")
        return _best(hits, df_t, n_docs, totals["w"] / n_docs, self.id_col, k)


def snippets(top: DataFrame, docs: DataFrame, id_col: str, text_col: str, query: str,
             html: bool = False) -> DataFrame:
    """K9: for each hit, the text around the first occurrence of a query
    term (``SNIPPET_CHARS`` characters starting ``SNIPPET_BEFORE`` before)."""
    terms = query_terms(query)
    text = plain_text(text_col) if html else F.col(text_col)
    d = docs.join(top.select(id_col), id_col, "left_semi").select(id_col, text.alias("_txt"))
    low = F.lower(F.col("_txt"))
    pos = F.array_min(F.filter(F.array(*[F.locate(t, low) for t in terms]), lambda p: p > 0))
    start = F.greatest(F.coalesce(pos, F.lit(1)) - F.lit(SNIPPET_BEFORE), F.lit(1))
    return (top.join(d, id_col)
            .select(id_col, "score", F.coalesce(pos, F.lit(0)).cast("long").alias("first_hit"),
                    "_txt", start.alias("_start"))
            .select(id_col, "score", "first_hit",
                    F.expr(f"substring(_txt, _start, {SNIPPET_CHARS})").alias("snippet")))

