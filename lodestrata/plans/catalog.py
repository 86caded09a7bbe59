"""Queries over the driver's tables, each beside its SQL.

A query reads its whole tables.  Times come out as epoch seconds and ratios rounded, so that
both sides print alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import markup, paths
from lodestrata.operators import dedupe, expand, ingest, lookup, outcome, sinks, summary
from lodestrata.plans import made, search
from lodestrata.sources import files
from lodestrata.sources.lines import json_field, json_text, links, members, parsed, table
from lodestrata.streaming import tail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERM, TERMS, PHRASE, LEAD = "contract", "contract delivery", "of the", "deliver"
VALID = "regexp_full_match(sha256, '[a-f0-9]{64}')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
INDEXED = "attachment.content <> ''"
#: Day that expiry is measured from.
TODAY = "2024-03-20 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Hashes, keys and known rows


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"SELECT sha256, path, coalesce({VALID}, false) AS valid, length(sha256) AS n FROM hash_links")
def hash_validate(s, d):
    return table(s, d, "hash_links").select("sha256", "path", paths.valid_hash(F.col("sha256")).alias("valid"), F.length("sha256").alias("n"))


@query(f"SELECT sha256, min(path) AS path FROM hash_links WHERE {VALID} AND path IS NOT NULL GROUP BY 1")
def dedup_first(s, d):
    links = table(s, d, "hash_links").where(paths.valid_hash(F.col("sha256")) & F.col("path").isNotNull())
    return dedupe.first_wins(links, "sha256", "path")


@query("SELECT sha256(text) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dup_groups(s, d):
    return dedupe.groups(table(s, d, "documents").where("text IS NOT NULL"), F.sha2("text", 256), "doc_id")


@query("SELECT DISTINCT sha256 FROM leakdata_index l WHERE sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.sha256 = l.sha256)")
def anti_seen(s, d):
    return dedupe.unseen(table(s, d, "leakdata_index").where("sha256 IS NOT NULL").select("sha256"), table(s, d, "files"), "sha256").distinct()


@query(f"SELECT id, original_filename, sha256 FROM files WHERE sha256 IN (SELECT sha256 FROM leakdata_index WHERE list_contains(regexp_extract_all(lower(attachment.content), '[\\p{{L}}\\p{{N}}]+'), '{TERM}'))")
def semi_hits(s, d):
    post, _ = _index(s, d, "leakdata_index", "sha256", "attachment.content")
    return dedupe.seen(table(s, d, "files"), search.match(post, TERM).withColumnRenamed("doc", "sha256"), "sha256")


@query("SELECT l.sha256, min(coalesce(f.original_filename, l.filename)) AS name FROM leakdata_index l LEFT JOIN files f ON f.sha256 = l.sha256 WHERE l.sha256 IS NOT NULL GROUP BY 1")
def provenance_lookup(s, d):
    index = table(s, d, "leakdata_index").where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("filename").alias("filename"))
    return index.join(table(s, d, "files").select("sha256", "original_filename"), "sha256", "left").select("sha256", F.coalesce("original_filename", "filename").alias("name"))


@query("SELECT DISTINCT sha256, path FROM hash_links WHERE sha256 = (SELECT min(sha256) FROM files)")
def lookup_by_hash(s, d):
    key = table(s, d, "files").agg(F.min("sha256").alias("sha256"))
    return table(s, d, "hash_links").join(F.broadcast(key), "sha256", "left_semi").select("sha256", "path").distinct()  # one row


@query(
    "SELECT sha256, seq_no, filename, message FROM leakdata_index l WHERE sha256 IS NOT NULL "
    "AND seq_no = (SELECT max(seq_no) FROM leakdata_index m WHERE m.sha256 = l.sha256)"
)
def upsert_last(s, d):
    puts = table(s, d, "leakdata_index").where("sha256 IS NOT NULL").select("sha256", "seq_no", "filename", "message")
    return dedupe.last_wins(puts, "sha256", "seq_no")


@query("SELECT sha256, count(*) AS n, count(DISTINCT path) AS n_paths FROM hash_links GROUP BY 1 HAVING count(*) > 1")
def repeated_links(s, d):
    links = table(s, d, "hash_links")
    pairs = links.groupBy("sha256", "path").agg(F.count("*").alias("c"))  # pre-aggregated, for the hot hash
    return pairs.groupBy("sha256").agg(F.sum("c").alias("n"), F.count("path").alias("n_paths")).where("n > 1")


@query(
    f"""SELECT status, count(*) AS n FROM (SELECT h.sha256, CASE WHEN NOT coalesce({VALID.replace('sha256', 'h.sha256')}, false) THEN 400 WHEN f.sha256 IS NULL THEN 404 ELSE 200 END AS status
    FROM (SELECT DISTINCT sha256 FROM hash_links) h LEFT JOIN files f ON f.sha256 = h.sha256) GROUP BY 1"""
)
def lookup_status(s, d):
    asked = table(s, d, "hash_links").select("sha256").distinct()
    known = table(s, d, "files").select("sha256", F.lit(True).alias("found"))
    status = outcome.lookup_status(paths.valid_hash(F.col("sha256")), F.coalesce("found", F.lit(False)))
    return asked.join(known, "sha256", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# Building documents


@query(f"SELECT seq_no, sha256, CASE WHEN attachment.content_length > 1500 THEN 'too large' ELSE 'ok' END AS outcome FROM leakdata_index WHERE attachment.content_length IS NOT NULL AND {INDEXED}")
def size_gate(s, d):
    index = table(s, d, "leakdata_index").where(INDEXED).select("seq_no", "sha256", F.col("attachment.content_length").alias("length"))
    return outcome.size_gate(index, "length", 1500).select("seq_no", "sha256", "outcome")


@query("SELECT doc_id, substring(text, 1, 2000) AS text FROM documents")
def text_truncate(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 2000).alias("text"))


@query(
    "SELECT seq_no, filename, sha256, mtime, message, length(attachment.content) AS n_chars, octet_length(encode(attachment.content)) AS n_bytes FROM leakdata_index"
)
def document_build(s, d):
    text = F.col("attachment.content")
    return table(s, d, "leakdata_index").select("seq_no", "filename", "sha256", "mtime", "message", F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"))


@query(
    """SELECT outcome, count(*) AS n FROM (SELECT CASE
    WHEN m IN ('to large', 'too large') THEN 'too_large' WHEN regexp_matches(m, '^empty') THEN 'empty' WHEN regexp_matches(m, '^http 4|rejected|unsupported') THEN 'rejected'
    WHEN regexp_matches(m, 'timed out|reset by peer') THEN 'transport' WHEN m = 'ok' THEN CASE WHEN coalesce(length(c), 0) > 0 THEN 'indexed' ELSE 'no_text' END
    WHEN m = '' THEN 'unknown' ELSE 'error' END AS outcome
    FROM (SELECT lower(coalesce(message, '')) AS m, attachment.content AS c FROM leakdata_index)) GROUP BY 1"""
)
def ingest_outcome(s, d):
    out = outcome.outcome(F.col("message"), F.col("attachment.content"))
    return table(s, d, "leakdata_index").groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT seq_no, mtime, CAST(epoch(to_timestamp(mtime)) AS BIGINT) AS seconds, coalesce(CAST(epoch(timestamp) AS BIGINT) = mtime, false) AS same FROM leakdata_index WHERE mtime BETWEEN 0 AND 4102444800")
def epoch_timestamp(s, d):
    index = table(s, d, "leakdata_index").where("mtime BETWEEN 0 AND 4102444800")
    return index.select("seq_no", "mtime", F.unix_timestamp(F.timestamp_seconds("mtime")).alias("seconds"), F.coalesce(F.unix_timestamp("timestamp") == F.col("mtime"), F.lit(False)).alias("same"))


@query("SELECT sha256, to_json({'sha256': sha256, 'message': message, 'mtime': mtime}) AS body FROM leakdata_index WHERE message = 'to large' OR message LIKE 'empty%'")
def json_build(s, d):
    rows = table(s, d, "leakdata_index").where("message = 'to large' OR message LIKE 'empty%'")
    return rows.select("sha256", json_text(sha256=F.col("sha256"), message=F.col("message"), mtime=F.col("mtime")).cast("string").alias("body"))


# Histograms, names and places


@query(
    r"""SELECT regexp_replace(name, '^.*\.', '') AS value, count(*) AS n FROM (SELECT regexp_extract(filename, '([^/]*)$', 1) AS name FROM leakdata_index)
    WHERE regexp_matches(name, '^[^.]+\.') GROUP BY 1 ORDER BY 2 DESC, 1 DESC"""
)
def ext_histogram(s, d):
    return summary.extensions(table(s, d, "leakdata_index"), "filename")


@query("SELECT coalesce(lower(trim(split_part(attachment.content_type, ';', 1))), 'application/octet-stream') AS value, count(*) AS n FROM leakdata_index GROUP BY 1 ORDER BY 2 DESC, 1 DESC")
def mime_histogram(s, d):
    return summary.types(table(s, d, "leakdata_index").select(F.col("attachment.content_type").alias("content_type")), "content_type")


@query(
    rf"""SELECT kind AS value, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, '^\s*(<!doctype html|<html|<head|<body)') THEN 'text/html' WHEN regexp_matches(t, '^\s*<\?xml') THEN 'text/xml'
    WHEN regexp_matches(t, '^(from|return-path|received|message-id|von|de|od) ?:') THEN 'message/rfc822' WHEN regexp_matches(t, '^\s*[\[{{]\s*["\[{{]') THEN 'application/json'
    WHEN contains(t, chr(0)) THEN 'application/octet-stream' ELSE 'text/plain' END AS kind
    FROM (SELECT lower(substring(attachment.content, 1, 256)) AS t FROM leakdata_index WHERE {INDEXED})) GROUP BY 1 ORDER BY 2 DESC, 1 DESC"""
)
def mime_sniff(s, d):
    texts = table(s, d, "leakdata_index").where(INDEXED).select(F.lower(F.substring("attachment.content", 1, 256)).alias("t"))
    return summary.histogram(texts, markup.sniff_text(F.col("t")).otherwise("text/plain"))


_KIND = "coalesce(lower(trim(split_part(attachment.content_type, ';', 1))), 'application/octet-stream')"


@query(
    f"""SELECT seq_no, sha256, CASE
    WHEN {_KIND} IN ('application/octet-stream', 'image/jpeg', 'image/png', 'image/tiff', 'message/rfc822', 'text/csv', 'text/plain', 'text/xml') THEN 'as_is'
    WHEN {_KIND} = 'text/html' THEN 'html_to_pdf'
    WHEN {_KIND} IN ('application/pdf', 'application/x-matlab-data', 'application/quickbooks', 'application/encrypted', 'application/x-wine-extension-ini', 'inode/x-empty',
        'application/x-ole-storage', 'application/x-fpt', 'application/x-ms-shortcut') THEN 'as_is'
    ELSE 'office_to_pdf' END AS route,
    {_KIND} NOT IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff', 'message/rfc822', 'text/csv', 'text/plain', 'text/xml') AS named FROM leakdata_index"""
)
def mime_route(s, d):
    kind = markup.base_type(F.col("attachment.content_type"))
    return table(s, d, "leakdata_index").select("seq_no", "sha256", markup.route(kind).alias("route"), markup.named(kind).alias("named"))


@query("SELECT DISTINCT path FROM hash_links WHERE path IS NOT NULL AND path NOT IN ('done', 'path.txt')")
def path_inventory(s, d):
    return summary.inventory(table(s, d, "hash_links"), "path", "done", "path.txt")


_SUFFIX = r"regexp_extract(regexp_extract(original_filename, '([^/]*)$', 1), '[^/](\.[^./]+)$', 1)"


@query(
    f"SELECT id, concat_ws('/', sha256[1:1], sha256[2:2], sha256 || {_SUFFIX}) AS address, sha256 || lower({_SUFFIX}) AS served FROM files"
)
def content_address(s, d):
    sha, name = F.col("sha256"), F.col("original_filename")
    return table(s, d, "files").select("id", paths.content_address(sha, name).alias("address"), paths.served_name(sha, name).alias("served"))


@query(r"SELECT min(p) AS path FROM (SELECT regexp_replace(path, '^\./', '') AS p FROM hash_links WHERE path IS NOT NULL) WHERE NOT regexp_matches(p, '^(\.gitignore|unpack|done|running|added_urls)$')")
def first_volume(s, d):
    return summary.first_volume(table(s, d, "hash_links"), "path")


@query(r"SELECT id, original_filename FROM files WHERE regexp_matches(lower(original_filename), '\.(zip|gz|7z|gzip|pst|msg)$')")
def filter_archives(s, d):
    return summary.archives(table(s, d, "files"), "original_filename", "zip", "gz", "7z", "gzip", "pst", "msg").select("id", "original_filename")


@query("""SELECT value, split_part(value, '"', 4) AS field FROM log_lines WHERE contains(value, '"status"') AND regexp_matches(value, '"level": "(warn|error)"')""")
def extract_fields(s, d):
    rows = table(s, d, "log_lines").where(F.col("value").contains('"status"') & F.col("value").rlike('"level": "(warn|error)"'))
    return rows.select("value", paths.delimited_field(F.col("value"), '"', 4).alias("field"))


@query("SELECT id, translate(regexp_replace(replace(original_filename, chr(92), '/'), '.*(Export|srv)/', ''), '/', '') AS list_name FROM files")
def url_list_name(s, d):
    slashed = F.replace(F.col("original_filename"), F.lit("\\"), F.lit("/"))
    return table(s, d, "files").select("id", paths.list_name(slashed, ".*(Export|srv)/").alias("list_name"))


@query("SELECT path FROM hash_links WHERE path IS NOT NULL UNION SELECT filename FROM leakdata_index WHERE filename IS NOT NULL ORDER BY 1")
def urls_distinct(s, d):
    a = table(s, d, "hash_links").where("path IS NOT NULL").select("path")
    b = table(s, d, "leakdata_index").where("filename IS NOT NULL").select(F.col("filename").alias("path"))
    return a.union(b).distinct().orderBy("path")


@query("""SELECT replace(filename, 'extracted/files/', '') AS filename, sha256, attachment.content AS content, '<a href="/file/' || sha256 || '">' || sha256 || '</a>' AS link FROM leakdata_index WHERE sha256 IS NOT NULL""")
def result_projection(s, d):
    return search.results(table(s, d, "leakdata_index").where("sha256 IS NOT NULL"))


@query("SELECT name, CASE WHEN length(name) < 25 THEN rpad(name, 25, ' ') ELSE name END AS padded FROM index_catalog")
def name_padded(s, d):
    return table(s, d, "index_catalog").select("name", paths.padded(F.col("name"), 25).alias("padded"))


# Logs, time and stages

_JSON = "CASE WHEN json_valid(value) THEN json_extract_string(value, '$.{}') END"


@query(f"SELECT value, {_JSON.format('level')} AS level, {_JSON.format('component')} AS component, {_JSON.format('status')} AS status FROM log_lines")
def event_json_field(s, d):
    v = F.col("v")
    return parsed(table(s, d, "log_lines")).select("value", *(json_field(v, f"$.{c}").alias(c) for c in ("level", "component", "status")))


@query(
    f"""SELECT component, level, count(*) AS n, count(TRY_CAST({_JSON.format('ms')} AS BIGINT)) AS n_ms, sum(TRY_CAST({_JSON.format('ms')} AS BIGINT)) AS ms
    FROM (SELECT *, {_JSON.format('component')} AS component, {_JSON.format('level')} AS level FROM log_lines) WHERE json_valid(value) GROUP BY 1, 2"""
)
def log_summary(s, d):
    v = F.col("v")
    ms = json_field(v, "$.ms").try_cast("bigint")
    rows = parsed(table(s, d, "log_lines")).where("v IS NOT NULL")
    return rows.groupBy(json_field(v, "$.component").alias("component"), json_field(v, "$.level").alias("level")).agg(F.count("*").alias("n"), F.count(ms).alias("n_ms"), F.sum(ms).alias("ms"))


@query("SELECT value, count(*) AS n FROM log_lines GROUP BY 1 HAVING count(*) > 1")
def log_repeats(s, d):
    return table(s, d, "log_lines").groupBy("value").agg(F.count("*").alias("n")).where("n > 1")


_AT = f"coalesce(TRY_CAST({_JSON.format('ts')} AS TIMESTAMP), make_timestamp(CAST(CASE WHEN TRY_CAST({_JSON.format('ts')} AS DOUBLE) > 1e11 THEN TRY_CAST({_JSON.format('ts')} AS DOUBLE) ELSE TRY_CAST({_JSON.format('ts')} AS DOUBLE) * 1000 END AS BIGINT) * 1000))"


@query(
    f"""SELECT CAST(epoch(date_trunc('day', moment)) AS BIGINT) AS day, count(*) AS n, count_if(level <> 'error') AS n_ok FROM (SELECT {_AT} AS moment, {_JSON.format('level')} AS level FROM log_lines WHERE json_valid(value))
    WHERE moment IS NOT NULL GROUP BY 1"""
)
def uptime_daily(s, d):
    v = F.col("v")
    rows = parsed(table(s, d, "log_lines")).where("v IS NOT NULL").select(tail.event_time(json_field(v, "$.ts")).alias("at"), json_field(v, "$.level").alias("level"))
    return rows.where("at IS NOT NULL").groupBy(F.unix_timestamp(F.date_trunc("day", "at")).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("level") != "error").alias("n_ok"))


@query(
    f"""SELECT stage, count(*) AS n FROM (SELECT CASE WHEN 'ingest' = c AND st = '201' THEN 'finished' WHEN c = 'ingest' THEN 'ingesting' WHEN c = 'unpack' THEN 'extracting' WHEN c IS NOT NULL THEN 'downloaded' ELSE 'waiting' END AS stage
    FROM (SELECT {_JSON.format('component')} AS c, {_JSON.format('status')} AS st FROM log_lines)) GROUP BY 1"""
)
def stage_status(s, d):
    v = F.col("v")
    rows = parsed(table(s, d, "log_lines")).select(json_field(v, "$.component").alias("c"), json_field(v, "$.status").alias("st"))
    flags = {"ingest_done": (F.col("c") == "ingest") & (F.col("st") == "201"), "extracted_done": F.col("c") == "ingest", "unpack": F.col("c") == "unpack", "downloaded": F.col("c").isNotNull()}
    return rows.groupBy(outcome.stage(flags).alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT seq_no, sha256 FROM leakdata_index WHERE put_at >= TIMESTAMPTZ '2024-03-02 00:00:00+00' AND put_at < TIMESTAMPTZ '2024-03-05 00:00:00+00'")
def time_range(s, d):
    return table(s, d, "leakdata_index").where("put_at >= timestamp '2024-03-02 00:00:00' AND put_at < timestamp '2024-03-05 00:00:00'").select("seq_no", "sha256")


@query("SELECT CAST(floor(epoch(put_at) / 86400) * 86400 AS BIGINT) AS day, count(*) AS n FROM leakdata_index WHERE put_at IS NOT NULL GROUP BY 1")
def date_histogram(s, d):
    return table(s, d, "leakdata_index").where("put_at IS NOT NULL").groupBy(F.unix_timestamp(F.date_trunc("day", "put_at")).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_tumbling(s, d):
    out = tail.tumbling(table(s, d, "events").where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "1 hour", "event_type")
    return out.select(F.unix_timestamp("start").alias("hour"), "event_type", "n")


@query(f"SELECT name FROM index_catalog WHERE name LIKE 'logstash-%' AND creation_date < TIMESTAMPTZ '{TODAY}+00' - INTERVAL 2 DAY")
def retention_expired(s, d):
    return outcome.expired(table(s, d, "index_catalog"), "name", "creation_date", "logstash-", TODAY, 2).select("name")


@query(r"SELECT regexp_replace(name, '-[0-9.]+$', '') AS kind, count(*) AS n, count(creation_date) AS n_dated FROM index_catalog WHERE name LIKE 'filebeat-%' OR name LIKE 'logstash-%' GROUP BY 1")
def index_pattern(s, d):
    rows = table(s, d, "index_catalog").where(F.col("name").like("filebeat-%") | F.col("name").like("logstash-%"))
    return rows.groupBy(F.regexp_replace("name", r"-[0-9.]+$", "").alias("kind")).agg(F.count("*").alias("n"), F.count("creation_date").alias("n_dated"))


# Search


@query(f"SELECT doc_id, len({WORDS}) AS n FROM documents WHERE text IS NOT NULL")
def tokenize_count(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(search.tokens(F.col("text"))).alias("n"))


def _index(s, d, name, key, text):
    """(postings, totals) of a table's texts; the index is written once for a session."""
    where = made.once(s, d, f"index-{name}")
    return search.indexed(table(s, d, name).select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc", "text", where), search.totals(s, where)


def _post(s, d):
    return _index(s, d, "documents", "doc_id", "text")[0]


@query(f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def postings_stats(s, d):
    return search.term_stats(_post(s, d))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({WORDS}, ['contract', 'delivery'])")
def search_match_any(s, d):
    return search.match(_post(s, d), TERMS).withColumnRenamed("doc", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({WORDS}, ['contract', 'delivery'])")
def search_match_all(s, d):
    return search.match(_post(s, d), TERMS, every=True).withColumnRenamed("doc", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({WORDS}, ' ') || ' ', ' {PHRASE} ')")
def search_phrase(s, d):
    return search.phrase(_post(s, d), PHRASE).withColumnRenamed("doc", "doc_id")


@query(rf"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}]){LEAD}')")
def search_prefix(s, d):
    return search.prefix(_post(s, d), LEAD).withColumnRenamed("doc", "doc_id")


_BM25 = (
    f"""WITH one AS (SELECT min(doc_id) AS doc, text FROM documents WHERE text IS NOT NULL GROUP BY text), sized AS (SELECT doc, {WORDS} AS ts FROM one),
    total AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM sized),
    tf AS (SELECT doc, len(ts) AS dl, term, count(*) AS tf FROM (SELECT doc, ts, unnest(ts) AS term FROM sized) WHERE term IN ('contract', 'delivery') GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
    SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 4) AS score
    FROM tf JOIN df USING (term) CROSS JOIN total GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000"""
)


@query(_BM25)
def search_bm25_topk(s, d):
    return search.top(search.bm25(*_index(s, d, "documents", "doc_id", "text"), TERMS, once=True))


@query(
    f"SELECT row_number() OVER w AS position, doc, lag(doc) OVER w AS previous, lead(doc) OVER w AS next FROM ({_BM25}) WINDOW w AS (ORDER BY score DESC, doc)"
)
def search_cursor(s, d):
    return search.cursor(search_bm25_topk(s, d))


@query(f"SELECT count(*) AS n FROM documents WHERE list_has_any({WORDS}, ['contract', 'delivery'])")
def hits_total(s, d):
    return search.match(_post(s, d), TERMS).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, substring(text, greatest(1, pos - 40), pos - greatest(1, pos - 40) + {len(PHRASE)} + 40) AS snippet FROM (SELECT doc_id, text, instr(lower(text), '{PHRASE}') AS pos FROM documents) WHERE pos > 0")
def highlight_snippet(s, d):
    return table(s, d, "documents").select("doc_id", search.snippet(F.col("text"), PHRASE).alias("snippet")).where("snippet IS NOT NULL")


@query(
    f"""SELECT seq_no, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(attachment.content, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM leakdata_index WHERE attachment.content_type LIKE 'text/html%' AND {INDEXED}"""
)
def html_text(s, d):
    pages = table(s, d, "leakdata_index").where(f"attachment.content_type LIKE 'text/html%' AND {INDEXED}")
    return pages.select("seq_no", markup.html_text(F.col("attachment.content")).alias("text"))


@query(f"SELECT seq_no, coalesce(attachment.title, trim(regexp_extract(attachment.content, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title FROM leakdata_index WHERE attachment.content_type LIKE 'text/html%' AND {INDEXED}")
def html_title(s, d):
    pages = table(s, d, "leakdata_index").where(f"attachment.content_type LIKE 'text/html%' AND {INDEXED}")
    return pages.select("seq_no", F.coalesce("attachment.title", markup.html_title(F.col("attachment.content"))).alias("title"))


@query("SELECT lang, mime, count(*) AS n, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean FROM documents GROUP BY 1, 2")
def overview(s, d):
    docs = table(s, d, "documents")
    return docs.groupBy("lang", "mime").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 4).alias("mean"))


@query("SELECT source, count(*) AS n, count(DISTINCT sha256) AS n_contents, count_if(coalesce(attachment.content, '') = '') AS n_empty FROM (SELECT *, regexp_extract(filename, 'extracted/files/([^/]+)/', 1) AS source FROM leakdata_index) GROUP BY 1")
def source_overview(s, d):
    rows = table(s, d, "leakdata_index").select(F.regexp_extract("filename", "extracted/files/([^/]+)/", 1).alias("source"), "sha256", (F.coalesce("attachment.content", F.lit("")) == "").alias("empty"))
    # Two steps, so that a hot source is counted by many tasks.
    one = rows.groupBy("source", "sha256").agg(F.count("*").alias("n"), F.count_if("empty").alias("e"))
    return one.groupBy("source").agg(F.sum("n").alias("n"), F.count("sha256").alias("n_contents"), F.sum("e").alias("n_empty"))


# Files, archives and streams: trees and lists written from the index and the log, then read by the sources

_NAME = "CASE WHEN attachment.content_type IS NULL THEN '.' ELSE '' END || seq_no || '.txt'"


@query(f"SELECT {_NAME} AS name, octet_length(encode(attachment.content)) AS length, sha256(attachment.content) AS sha256 FROM leakdata_index WHERE {INDEXED}")
def tree_hashes(s, d):
    found = files.hashed(files.file_tree(s, made.tree(s, d)))
    return found.select(paths.basename(F.col("path")).alias("name"), "length", "sha256")


@query(f"SELECT DISTINCT {_NAME} AS name FROM leakdata_index WHERE {INDEXED} ORDER BY 1")
def tree_names(s, d):
    return files.file_tree(s, made.tree(s, d)).select(paths.basename(F.col("path")).alias("name")).where(~F.col("name").rlike(paths.CONTROL_NAMES)).distinct().orderBy("name")


@query(f"SELECT sha256(attachment.content) AS sha256, string_split(min((seq_no % 64) || '/' || {_NAME}), '/')[2] AS name, min(octet_length(encode(attachment.content))) AS length FROM leakdata_index WHERE {INDEXED} GROUP BY 1")
def ingest_tree(s, d):
    docs = ingest.documents(s, made.tree(s, d))
    return docs.select("sha256", paths.basename(F.col("filename")).alias("name"), F.col("attachment.content_length").alias("length"))


@query(f"SELECT DISTINCT sha256, sha256[1:1] || '/' || sha256[2:2] || '/' || sha256 || '.txt' AS address FROM (SELECT sha256(attachment.content) AS sha256 FROM leakdata_index WHERE {INDEXED})")
def relocated(s, d):
    one = dedupe.first_wins(files.hashed(files.file_tree(s, made.tree(s, d))).select("sha256", "path"), "sha256", "path")
    to = made.folder(s)
    return ingest.relocate(one, to).select("sha256", F.substring("target", len(to) + 2, 1000).alias("address"))


@query(
    f"""SELECT seq_no || '.zip' AS archive, 'text/' || seq_no || '.txt' AS path, octet_length(encode(attachment.content)) AS length, 'ok' AS outcome FROM leakdata_index WHERE {INDEXED}
    UNION ALL SELECT seq_no || '.zip', 'inner.zip/kind.txt', octet_length(encode(coalesce(attachment.content_type, ''))), 'ok' FROM leakdata_index WHERE {INDEXED}"""
)
def archive_members(s, d):
    zips = ingest.with_content(files.file_tree(s, made.tree(s, d, zipped=True)))
    return expand.expanded(zips).select(paths.basename(F.col("archive")).alias("archive"), "path", "length", "outcome")


@query(
    f"""WITH asked AS (SELECT sha256 FROM hash_links UNION SELECT sha256(attachment.content) FROM leakdata_index WHERE {INDEXED}),
    known AS (SELECT sha256(attachment.content) AS sha256, min(octet_length(encode(attachment.content))) AS n FROM leakdata_index WHERE {INDEXED} GROUP BY 1)
    SELECT a.sha256, CASE WHEN NOT coalesce({VALID.replace('sha256', 'a.sha256')}, false) THEN 400 WHEN n IS NULL THEN 404 ELSE 200 END AS status, n FROM asked a LEFT JOIN known k ON k.sha256 = a.sha256"""
)
def bytes_by_hash(s, d):
    found = files.hashed(files.file_tree(s, made.tree(s, d)))
    asked = table(s, d, "hash_links").select("sha256").union(found.select("sha256")).distinct()
    return lookup.served(asked, found).select("sha256", "status", F.octet_length("content").alias("n"))


@query(
    """SELECT component, level, count(*) AS n FROM (SELECT json_extract_string(value, '$.component') AS component, json_extract_string(value, '$.level') AS level FROM log_lines
    WHERE json_valid(value) AND value[1:1] = '{') GROUP BY 1, 2"""
)
def stream_log(s, d):
    lines_, out, mark = made.folder(s), made.folder(s), made.folder(s)
    table(s, d, "log_lines").write.mode("overwrite").text(lines_)
    tail.sink(tail.records(tail.lines(s, lines_, "log")), out, mark).awaitTermination()
    return s.read.parquet(out).groupBy("component", "level").agg(F.count("*").alias("n"))


_PAGE = "'<html>' || chr(10) || '<a href=\"' || path || '\">' || path || '</a>' || chr(10) || '<a href=\"/\">up</a>'"


@query(rf"""SELECT split_part(line, '"', 2) AS link FROM (SELECT unnest(string_split({_PAGE}, chr(10))) AS line FROM hash_links WHERE path IS NOT NULL) WHERE regexp_matches(line, '\.(pdf|zip|eml)</a>')""")
def extract_links(s, d):
    page = F.concat(F.lit('<html>\n<a href="'), "path", F.lit('">'), "path", F.lit('</a>\n<a href="/">up</a>'))
    return links(table(s, d, "hash_links").where("path IS NOT NULL").select(page.alias("page")), "page", r"\.(pdf|zip|eml)")


@query("SELECT value, json_extract_string(value, '$.sha256') AS gid FROM log_lines WHERE json_valid(value) AND json_extract_string(value, '$.sha256') IS NOT NULL")
def rpc_members(s, d):
    answers = table(s, d, "log_lines").withColumn("answer", F.concat(F.lit('{"id": 1, "result": ['), "value", F.lit(', {"gid": null}]}')))
    return members(answers, "answer").select("value", json_field(F.col("item"), "$.sha256").alias("gid")).where("gid IS NOT NULL")


@query("SELECT sha256, filename FROM leakdata_index WHERE sha256 IS NOT NULL")
def result_viewed(s, d):
    return search.viewed(table(s, d, "leakdata_index").where("sha256 IS NOT NULL"))


@query(
    f"""SELECT doc, score FROM (SELECT doc, score, sum(octet_length(encode(text))) OVER (ORDER BY score DESC, doc) AS upto FROM ({_BM25}) JOIN documents ON doc_id = doc) WHERE upto <= 200000"""
)
def search_capped(s, d):
    sized = search_bm25_topk(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.octet_length("text").alias("size")), "doc")
    return search.within(sized, "size", 200_000).select("doc", "score")


@query(
    f"""SELECT sha256, 'DONE' AS setup, CASE WHEN up THEN 'RUNNING' ELSE 'NO DOWNLOAD CONTAINER' END AS urls, CASE WHEN fetched THEN 'DONE' WHEN up THEN 'RUNNING' ELSE 'NOT RUNNING' END AS download,
    CASE WHEN unpacks THEN 'DONE' WHEN fetched THEN 'RUNNING' ELSE 'WAITING FOR FILES' END AS move, CASE WHEN ingests THEN 'DONE' WHEN unpacks THEN 'RUNNING' ELSE 'WAITING FOR FILES' END AS extraction,
    CASE WHEN indexed THEN 'DONE' WHEN ingests THEN 'RUNNING' ELSE 'WAITING FOR FILES' END AS ingest
    FROM (SELECT sha256, coalesce(bool_or(c = 'downloader'), false) AS up, coalesce(bool_or(c = 'downloader' AND level = 'info'), false) AS fetched, coalesce(bool_or(c = 'unpack'), false) AS unpacks, coalesce(bool_or(c = 'ingest'), false) AS ingests,
        coalesce(bool_or(c = 'ingest' AND st = '201'), false) AS indexed
        FROM (SELECT {_JSON.format('sha256')} AS sha256, {_JSON.format('component')} AS c, {_JSON.format('level')} AS level, {_JSON.format('status')} AS st FROM log_lines) WHERE sha256 IS NOT NULL GROUP BY 1)"""
)
def stage_states(s, d):
    rows = parsed(table(s, d, "log_lines")).select(*(json_field(F.col("v"), f"$.{c}").alias(n) for c, n in (("sha256", "sha256"), ("component", "c"), ("level", "level"), ("status", "st")))).where("sha256 IS NOT NULL")
    runs = rows.groupBy("sha256").agg(
        F.bool_or(F.expr("c = 'downloader'")).alias("up"), F.bool_or(F.expr("c = 'downloader' AND level = 'info'")).alias("fetched"), F.bool_or(F.expr("c = 'unpack'")).alias("unpack"),
        F.bool_or(F.expr("c = 'ingest'")).alias("ingest"), F.bool_or(F.expr("c = 'ingest' AND st = '201'")).alias("indexed"),
    )
    c = F.col
    flags = {"setup": F.lit(True), "downloader_up": c("up"), "running": c("up"), "downloaded": c("fetched"), "extract": c("fetched"), "unpack": c("unpack"), "extracted_done": c("ingest"), "ingest_done": c("indexed")}
    return runs.select("sha256", *(state.alias(name) for name, state in outcome.states(flags).items()))


@query(
    """SELECT sha256, seq_no FROM (SELECT sha256, seq_no, message, lag(message) OVER (PARTITION BY sha256 ORDER BY seq_no) AS last, row_number() OVER (PARTITION BY sha256 ORDER BY seq_no) AS i FROM leakdata_index WHERE sha256 IS NOT NULL)
    WHERE i > 1 AND coalesce(last, '') <> 'ok' AND message = 'ok'"""
)
def state_edges(s, d):
    puts = table(s, d, "leakdata_index").where("sha256 IS NOT NULL")
    return outcome.edges(puts, "sha256", "seq_no", F.when(F.col("message") == "ok", "ok").otherwise("not yet"), "not yet", "ok")


@query(
    f"""SELECT sha256, list_filter(list(st ORDER BY value)[1:5], lambda x: x IN (200, 201, 400))[1] AS outcome
    FROM (SELECT value, {_JSON.format('sha256')} AS sha256, TRY_CAST({_JSON.format('status')} AS INT) AS st FROM log_lines) WHERE sha256 IS NOT NULL GROUP BY 1"""
)
def retry_status(s, d):
    rows = parsed(table(s, d, "log_lines")).select("value", json_field(F.col("v"), "$.sha256").alias("sha256"), json_field(F.col("v"), "$.status").try_cast("int").alias("st")).where("sha256 IS NOT NULL")
    return outcome.retried(rows, "sha256", "value", "st")


@query(
    """SELECT 'lines' AS what, count(*) AS n FROM log_lines WHERE trim(value) <> '' UNION ALL SELECT 'links', count(*) FROM hash_links UNION ALL SELECT 'files', count(DISTINCT filename) FROM leakdata_index
    UNION ALL SELECT 'lists', count(*) FROM (SELECT component FROM (SELECT """ + _JSON.format("component") + """ AS component FROM log_lines) GROUP BY 1 HAVING count(*) > 0)"""
)
def counts(s, d):
    lines_ = table(s, d, "log_lines")
    lists = parsed(lines_).groupBy(json_field(F.col("v"), "$.component").alias("component")).count().where("count > 0")
    parts = [("lines", lines_.where(F.trim("value") != "")), ("links", table(s, d, "hash_links")), ("files", table(s, d, "leakdata_index").where("filename IS NOT NULL").select("filename").distinct()), ("lists", lists)]
    one = [df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, df in parts]
    return one[0].union(one[1]).union(one[2]).union(one[3])


@query("SELECT seq_no, strftime(put_at, '%a %b ') || lpad(CAST(day(put_at) AS VARCHAR), 2, ' ') || strftime(put_at, ' %H:%M:%S %Y') AS printed FROM leakdata_index WHERE put_at IS NOT NULL")
def date_text(s, d):
    at = F.col("put_at")
    printed = F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))
    return table(s, d, "leakdata_index").where("put_at IS NOT NULL").select("seq_no", printed.alias("printed"))


@query(
    f"""SELECT CAST(CAST(put_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM (SELECT put_at AT TIME ZONE 'UTC' AS put_at FROM leakdata_index WHERE put_at IS NOT NULL)
    WHERE CAST(put_at AS DATE) >= DATE '2024-03-03' GROUP BY 1"""
)
def partitions_kept(s, d):
    where = made.folder(s)
    days = table(s, d, "leakdata_index").where("put_at IS NOT NULL").select("seq_no", F.date_format("put_at", "yyyy-MM-dd").alias("day"))
    days.repartition("day").write.partitionBy("day").parquet(where)
    sinks.drop_expired(s, where, "day", date(2024, 3, 5), 2)
    return s.read.option("basePath", where).schema("seq_no long, day string").parquet(where).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT regexp_extract(filename, 'extracted/files/([^/]+)/', 1) AS list, filename AS value FROM leakdata_index WHERE filename IS NOT NULL AND regexp_extract(filename, 'extracted/files/([^/]+)/', 1) <> ''")
def lists_written(s, d):
    where = made.folder(s)
    rows = table(s, d, "leakdata_index").where("filename IS NOT NULL").select(F.regexp_extract("filename", "extracted/files/([^/]+)/", 1).alias("list"), "filename").where("list <> ''")
    sinks.lists(rows, "list", "filename", where)
    return s.read.option("basePath", where).schema("value string, list string").text(where).select("list", "value")
