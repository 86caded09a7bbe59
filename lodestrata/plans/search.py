"""Search over documents: terms, phrases, prefixes, ranking and snippets.

An index is a table of postings (term, doc, tf, dl, first, positions) in order of term: its files hold ranges of terms, so
the least and greatest term of each row group prune the scan of a search to the rows of its terms, or of its
prefix.  A term of very many documents is spread over several files.  Beside it stands a row of totals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.sources import store
from lodestrata.sources.lines import spread

TOKEN = r"([\p{L}\p{N}]+)"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def indexed(docs: DataFrame, doc: str, text: str, where: str) -> DataFrame:
    """An index of the documents written to a folder, and read from it.

    ``first`` says whether a document has the least id of those with an equal text; positions count words from 0, dl is
    the number of words. Documents without a text have no postings. A folder that holds a finished index is read only.
    """
    spark = docs.sparkSession
    if not store.exists(spark, f"{where}/totals/_SUCCESS"):
        texts = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")))
        least = texts.groupBy(F.xxhash64("text"), F.crc32("text"), F.length("text")).agg(F.min("doc").alias("doc")).select("doc", F.lit(True).alias("first"))
        post = _postings_of(texts)
        post = post.join(least, "doc", "left").select("term", "doc", "tf", "dl", F.coalesce("first", F.lit(False)).alias("first"), "positions")
        post.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{where}/postings")
        # Texts are split into words once: lengths are sums over the postings.
        words = spark.read.parquet(f"{where}/postings").agg(F.sum("tf").alias("w"), F.sum(F.when(F.col("first"), F.col("tf"))).alias("w_first"))
        n = texts.agg(F.count("*").alias("n")).crossJoin(least.agg(F.count("*").alias("n_first"))).crossJoin(words)  # rows of statistics
        mean = lambda w, n: (F.coalesce(w, F.lit(0)) / F.nullif(n, F.lit(0)))
        n.select("n", mean(F.col("w"), F.col("n")).alias("mean"), "n_first", mean(F.col("w_first"), F.col("n_first")).alias("mean_first")).coalesce(1).write.mode("overwrite").parquet(f"{where}/totals")
    return spark.read.parquet(f"{where}/postings")


_WORD = re.compile(r"[^\W_]+")


def _postings_of(texts: DataFrame) -> DataFrame:
    """(doc, term, dl, tf, positions) of (doc, text) rows. A text's postings are made where it is read: grouping its
    words by an aggregate would shuffle all of them once more."""
    kind = dict(texts.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, held = [], 0
            terms, dl, size, where = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                own: dict[str, list[int]] = {}
                words = _WORD.findall(t.lower())
                for p, w in enumerate(words):
                    if w in own:
                        own[w].append(p)
                    else:
                        own[w] = [p]
                terms += own
                docs += [i] * len(own)
                dl += [len(words)] * len(own)
                for x in own.values():
                    size.append(len(x))
                    where += x
                held += len(words)
                if held >= 1 << 19 or i + 1 == b.num_rows:
                    ends = pa.array([0, *accumulate(size)], pa.int32())
                    positions = pa.ListArray.from_arrays(ends, pa.array(where, pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(docs, pa.int64())), pa.array(terms, pa.string()), pa.array(dl, pa.int32()), pa.array(size, pa.int64()), positions], names=["doc", "term", "dl", "tf", "positions"])
                    docs, terms, dl, size, where, held = [], [], [], [], [], 0

    return texts.mapInArrow(run, f"doc {kind}, term string, dl int, tf bigint, positions array<int>")


def totals(spark: SparkSession, where: str) -> DataFrame:
    """(n, mean, n_first, mean_first): documents with a text and their mean length, of all and of the first of equal texts."""
    return spark.read.parquet(f"{where}/totals")


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def match(post: DataFrame, query: str, every: bool = False) -> DataFrame:
    """(doc) of the documents with any, or all, of the query's terms."""
    ts = terms_of(query)
    hits = post.where(F.col("term").isin(ts)).select("term", "doc")
    if every:
        return hits.groupBy("doc").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(ts)).select("doc")
    return hits.select("doc").distinct()


def phrase(post: DataFrame, words: str) -> DataFrame:
    """(doc) of the documents that have the words one after the other; a word matches whole."""
    ts = re.findall(r"[^\W_]+", words.lower())
    hits = post.where(F.col("term").isin(list(dict.fromkeys(ts)))).select("term", "doc", "positions")
    lead = lambda i: F.transform("positions", lambda p: p - i)
    per = F.array(*[F.when(F.col("term") == t, lead(i)) for i, t in enumerate(ts)])  # where the phrase would begin
    starts = hits.select("doc", F.posexplode(per).alias("i", "at")).where("at IS NOT NULL").select("doc", "i", F.explode("at").alias("at"))
    return starts.groupBy("doc", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(ts)).select("doc").distinct()


def prefix(post: DataFrame, lead: str) -> DataFrame:
    """(doc) of the documents with a word that begins so."""
    return post.where(F.col("term").startswith(lead.lower())).select("doc").distinct()


def bm25(post: DataFrame, total: DataFrame, query: str, once: bool = False) -> DataFrame:
    """(doc, score) of the documents with a term of the query; ``once`` ranks equal texts once, under the least doc."""
    tf = post.where(F.col("term").isin(terms_of(query))).select("term", "doc", "tf", "dl", "first")
    if once:
        tf = tf.where("first")
    n, mean = ("n_first", "mean_first") if once else ("n", "mean")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col(mean)))
    stats = F.broadcast(df.crossJoin(F.broadcast(total)))  # a row per term of the query; total is one row
    return tf.join(stats, "term").groupBy("doc").agg(F.round(F.sum(part), 4).alias("score"))


#: Hits that are fetched, at most.
MOST = 10_000


def top(scored: DataFrame, k: int = MOST) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("doc")).limit(k)


def within(ranked: DataFrame, size: str, most: int) -> DataFrame:
    """The best hits that together stay within a number of bytes; the hits are what top() has bounded."""
    upto = Window.orderBy(F.desc("score"), F.asc("doc")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_sum", F.sum(size).over(upto)).where(F.col("_sum") <= most).drop("_sum")


def cursor(scored: DataFrame, k: int = MOST) -> DataFrame:
    """(position, doc, previous, next) of the k best hits."""
    ranked = Window.orderBy(F.desc("score"), F.asc("doc"))  # one task, over k rows at most
    return top(scored, k).select(F.row_number().over(ranked).alias("position"), "doc", F.lag("doc").over(ranked).alias("previous"), F.lead("doc").over(ranked).alias("next"))


def snippet(text: Column, words: str, around: int = 40) -> Column:
    """The text around the first match."""
    at = F.instr(F.lower(text), words.lower())
    begin = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, begin, at - begin + len(words) + around))


def results(df: DataFrame) -> DataFrame:
    """(filename, sha256, content, link) of hits: the name without the root of the tree, and where the content is served."""
    return df.select(
        F.replace(F.col("filename"), F.lit("extracted/files/"), F.lit("")).alias("filename"), "sha256", F.col("attachment.content").alias("content"),
        F.format_string('<a href="/file/%s">%s</a>', F.col("sha256"), F.col("sha256")).alias("link"),
    )


def viewed(df: DataFrame) -> DataFrame:
    """(sha256, filename) of hits for a viewer, the name as it is."""
    return df.select("sha256", "filename")
