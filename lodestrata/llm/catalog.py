"""The queries of the operators on texts: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import abuse, encoding, language, leak, mail, neardup, packing, pii, truncation
from lodestrata.llm.common import contents, cut, spread, table


def _names(spark: SparkSession, d: str) -> list[str | None]:
    """The list of given names, which is the automaton's dictionary: distinct, and bounded by the names that people have."""
    return [r[0] for r in table(spark, d, "given_names").select("given_name").distinct().collect()]


def _mentions(spark: SparkSession, d: str, masked: bool) -> DataFrame:
    return pii.mentions(contents(spark, d), "sha256", "content", _names(spark, d), masked)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = _mentions(spark, d, False).select("sha256", "found").dropDuplicates(["sha256"])
    return found.select("sha256", F.explode("found").alias("m")).select("sha256", "m.start_at", "m.kind")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d, True).select("sha256", "masked").dropDuplicates(["sha256"])


def p1_remainder(spark: SparkSession, d: str) -> DataFrame:
    """Whether masking left all but the mentions as it was: placeholders and mentions taken out, both texts are equal."""
    texts = contents(spark, d).dropDuplicates(["sha256"])
    both = pii.mentions(texts, "sha256", "content", _names(spark, d)).join(texts, "sha256")
    return pii.remainders(both, "sha256", "content").select("sha256", "same")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(contents(spark, d), "sha256", "content", k=3, t=0.6, min_words=20).select(F.col("a").alias("sha256_a"), F.col("b").alias("sha256_b"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_documents(spark, d), "doc_id", "text")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, whole, fits): whether the pieces of each document with a text make it up, and no container is too full."""
    packs = cut(packing.packed(_documents(spark, d).where("text <> ''"), "doc_id", "text"))
    over = packs.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY)
    pieces = packs.groupBy("doc_id").agg(
        F.count("*").alias("n_pieces"), F.min("start_at").alias("a"), F.max("end_at").alias("b"), F.sum(F.col("end_at") - F.col("start_at") + 1).alias("chars"), F.count("container").alias("placed"),
    )
    full = packs.join(over, "container", "left_semi").select("doc_id").distinct().withColumn("full", F.lit(True))
    every = pieces.join(table(spark, d, "documents").select("doc_id", F.length("text").alias("n_chars")), "doc_id").join(full, "doc_id", "left")
    whole = (F.col("a") == 1) & (F.col("b") == F.col("n_chars")) & (F.col("chars") == F.col("n_chars")) & (F.col("placed") == F.col("n_pieces"))
    return every.select("doc_id", whole.alias("whole"), F.col("full").isNull().alias("fits"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_documents(spark, d), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    texts = encoding.garbled(contents(spark, d), "sha256", "content").select(F.lit("content").alias("field"), "sha256", "restored")
    names = encoding.garbled(spread(table(spark, d, "files").select("sha256", "original_filename")), "sha256", "original_filename", names=True).select(F.lit("original_filename").alias("field"), "sha256", "restored")
    return texts.unionByName(names)


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(contents(spark, d), "sha256", "content", k=3, t=0.6, min_words=20)


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    return contents(spark, d, F.regexp_extract("filename", r"extracted/files/([^/]+)/", 1).alias("source"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts = truncation.truncated(_sourced(spark, d), "sha256", "content", "source").select("sha256", F.lit("content").alias("field"))
    messages = table(spark, d, "leakdata_index").where(F.col("sha256").isNotNull())
    return texts.unionByName(truncation.truncated_messages(messages, "sha256", "message").select("sha256", F.lit("message").alias("field")))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = _sourced(spark, d)
    return truncation.share_by_source(rows, truncation.truncated(rows, "sha256", "content", "source"), "sha256", "source")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    labelled = contents(spark, d, F.col("attachment.language").alias("label"))
    model = language.fitted(labelled, "sha256", "content", "label")
    return language.languages(labelled, "sha256", "content", "label", model)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where(~F.col("label_right")).select("sha256", F.explode("segments").alias("s")).select("sha256", "s.seg_no", "s.lang")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("field", "sha256")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = mail.new_lines(mail.mails(contents(spark, d, "filename")), "sha256", "content")
    return found.select("sha256", F.explode("lines").alias("line_no"))


def p6_new_text(spark: SparkSession, d: str) -> DataFrame:
    return mail.new_lines(mail.mails(contents(spark, d, "filename")), "sha256", "content").select("sha256", "new_text")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    net = abuse.trained(docs, "doc_id", "text", "lang", table(spark, d, "review_labels"), "label")
    return abuse.scores(docs, "doc_id", "text", "lang", net)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), "doc_id", "source", _scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_masked": p1_masked, "p1_remainder": p1_remainder, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_languages": p4_languages, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_new_text": p6_new_text, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_checks": p7_checks, "p8_found": p8_found, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
#: SQL where it can express the operator; the others are tested against brute force, round trips and held-out cases.
SQL: dict[str, str] = {
    "p2_found": f"""WITH one AS (SELECT sha256, min(attachment.content) AS t FROM leakdata_index WHERE attachment.content <> '' AND sha256 IS NOT NULL GROUP BY 1),
    w AS (SELECT sha256, {_WORDS.format('t')} AS ws FROM one), long AS (SELECT * FROM w WHERE len(ws) >= 20),
    s AS (SELECT DISTINCT sha256, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM long),
    n AS (SELECT sha256, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT a.sha256 AS sha256_a, b.sha256 AS sha256_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.sha256 < b.sha256 GROUP BY 1, 2)
    SELECT sha256_a, sha256_b FROM both_ JOIN n x ON x.sha256 = sha256_a JOIN n y ON y.sha256 = sha256_b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9""",
    "p1_remainder": "SELECT DISTINCT sha256, true AS same FROM leakdata_index WHERE sha256 IS NOT NULL AND attachment.content <> ''",
    "p2_groups": f"""WITH RECURSIVE one AS (SELECT sha256, min(attachment.content) AS t FROM leakdata_index WHERE attachment.content <> '' AND sha256 IS NOT NULL GROUP BY 1),
    w AS (SELECT sha256, {_WORDS.format('t')} AS ws FROM one), long AS (SELECT * FROM w WHERE len(ws) >= 20),
    every AS (SELECT DISTINCT sha256, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM long),
    sets AS (SELECT sha256, list(g ORDER BY g) AS st FROM every GROUP BY 1), classes AS (SELECT st, min(sha256) AS chief, count(*) AS size FROM sets GROUP BY 1),
    members AS (SELECT sha256 AS id, chief, size FROM sets JOIN classes USING (st)),
    s AS (SELECT chief, g FROM every JOIN classes ON chief = sha256), n AS (SELECT chief, count(*) AS n FROM s GROUP BY 1),
    both_ AS (SELECT a.chief AS a, b.chief AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chief <> b.chief GROUP BY 1, 2),
    edges AS (SELECT a, b FROM both_ JOIN n x ON x.chief = a JOIN n y ON y.chief = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
    reach AS (SELECT chief AS id, chief AS r FROM classes UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
    least AS (SELECT id AS chief, min(r) AS group_id FROM reach GROUP BY 1), links AS (SELECT a AS chief, count(*) AS n_links FROM edges GROUP BY 1)
    SELECT id, group_id, coalesce(n_links, 0) AS n_links, size - 1 AS n_copies FROM members JOIN least USING (chief) LEFT JOIN links USING (chief) WHERE size > 1 OR n_links IS NOT NULL""",
    "p7_checks": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> ''",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), e AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM eval_items),
    dw AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM d WHERE len(ws) >= 13),
    ew AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM e WHERE len(ws) >= 13)
    SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
