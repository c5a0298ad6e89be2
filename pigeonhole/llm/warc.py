"""WARC revisits: a not-modified capture is joined as of its time to the latest earlier full response of the same URL.

Header work is DataFrame expressions. Captures of one URL are split by day: the latest full response of a day and of the days
before it are looked up apart, so a URL with a third of all captures is spread over its days. Payloads never move; only
record ids do, until the final join to the response itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pigeonhole.functions.json import let

from .common import cut

# Headers that a 304 may update in the stored response (fixed by the HTTP caching standard).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
UNRESERVED = "^[A-Za-z0-9._~-]$"  # characters that mean the same escaped or not


def plain_escapes(c: Column) -> Column:
    """Percent escapes of unreserved characters as those characters, all others in upper case."""
    def piece(x: Column, i: Column) -> Column:
        code, rest = F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30)
        letter = F.char(F.conv(code, 16, 10).cast("int"))
        return F.when(i == 0, x).when(~code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), x)).when(letter.rlike(UNRESERVED), F.concat(letter, rest)).otherwise(F.concat(F.lit("%"), code, rest))
    return F.when(F.contains(c, F.lit("%")), F.array_join(F.transform(F.split(c, "%"), piece), "")).otherwise(c)


def canonical_url(url: str | Column) -> Column:
    """Scheme and a leading www. don't count; the host is lower-case without its scheme's own port (80 also where none is named);
    needless escapes are undone; no fragment; sorted query; no trailing slash."""
    url = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    secure = F.lower(bare).startswith("https://")
    rest = plain_escapes(F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", ""))

    def parts(rest: Column) -> Column:
        named = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
        host = F.regexp_replace(F.when(secure, F.regexp_replace(named, ":443$", "")).otherwise(F.regexp_replace(named, ":80$", "")), "^www\\.", "")
        path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
        query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: p != "")), "&")
        return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return let(rest, parts)


def header_map(block: str | Column) -> Column:
    """``Name: value`` lines as a map with lower-case names; of repeated names the last one counts."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return let(pairs, lambda ps: F.map_from_entries(last(ps)))  # bound once: the lines aren't read again for each other line


def parse_records(raw: DataFrame) -> DataFrame:
    """Columns of WARC records given as text (``record``): type, id, url, date, status, WARC and HTTP headers, payload."""
    warc = F.regexp_extract("record", "(?s)^WARC/[0-9.]+\r?\n(.*?)\r?\n\r?\n", 1)
    http = F.regexp_extract("record", "(?s)\r?\n\r?\n(HTTP/[0-9.]+ .*?)(\r?\n\r?\n|$)", 1)
    headers = raw.select("record", header_map(warc).alias("warc"), http.alias("http")).select(
        "record", "warc", header_map(F.regexp_replace("http", "^[^\n]*\n?", "")).alias("headers"), F.regexp_extract("http", "^HTTP/[0-9.]+ ([0-9]{3})", 1).alias("code"))
    return headers.select(
        F.col("warc")["warc-record-id"].alias("record_id"), F.lower(F.col("warc")["warc-type"]).alias("kind"), F.col("warc")["warc-target-uri"].alias("url"),
        F.try_to_timestamp(F.col("warc")["warc-date"]).alias("fetched"), F.expr("try_cast(code as int)").alias("status"), "headers",
        F.regexp_extract("record", "(?s)\r?\n\r?\nHTTP/.*?\r?\n\r?\n(.*)$", 1).alias("payload"))


def is_full(kind: str = "kind", status: str = "status") -> Column:
    return (F.col(kind) == "response") & F.col(status).between(200, 299)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every revisit of ``record_id, kind, url, fetched, status, headers``, and the response it stands for.

    outcome: ``resolved`` (no validator of both differs and one agrees), ``unchecked`` (no validator in common: the response
    is named, nothing merged), ``changed`` (a validator differs), ``no_response`` (none earlier), ``undated`` (no time or
    URL). Merged headers are the response's with the permitted ones of the revisit. Weak and strong ETags compare alike. Of
    responses at one time the larger record id counts, of those that repeat an id the smallest headers; a response at the very
    time of the revisit isn't earlier, one without a record id is none. Repeated rows are resolved each. No rows give none.
    """
    events = captures.select("record_id", "kind", "status", canonical_url("url").alias("page"), "fetched", "headers", is_full().alias("full"))
    light = events.withColumn("full", F.col("full") & F.col("record_id").isNotNull()).where("page is not null and fetched is not null").select("page", "fetched", "record_id", "full", (F.col("kind") == "revisit").alias("asks")).where("full or asks")
    light = light.withColumn("day", F.to_date("fetched"))
    last = F.struct("fetched", "record_id")
    days = light.where("full").groupBy("page", "day").agg(F.max(last).alias("latest"))
    before = days.select("page", "day", "latest").unionByName(light.where("asks").select("page", "day").distinct(), allowMissingColumns=True)
    before = before.groupBy("page", "day").agg(F.max("latest").alias("latest"))
    carried = before.select("page", "day", F.max("latest").over(Window.partitionBy("page").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # Within a day: the latest full response strictly before; rows of one time see none of each other.
    today = Window.partitionBy("page", "day").orderBy(F.unix_micros("fetched")).rangeBetween(Window.unboundedPreceding, -1)
    asked = light.withColumn("same_day", F.max(F.when(F.col("full"), last)).over(today)).where("asks")
    found = asked.join(carried, ["page", "day"]).select("page", "fetched", F.coalesce("same_day", "carried").alias("r"))
    targets = found.select("page", "fetched", F.col("r.record_id").alias("response_id"), F.col("r.fetched").alias("response_fetched")).distinct()

    revisits = events.where("kind = 'revisit'").select("record_id", "page", "fetched", "headers")
    # A row id may be repeated, at other times or by other pages: the response found is the one of its own page and time.
    own = ["page", "response_fetched", "key"]
    full = (events.where("full").select("page", F.col("fetched").alias("response_fetched"), F.col("record_id").alias("key"), F.array_sort(F.map_entries("headers")).alias("stored"))
            .where("page is not null and response_fetched is not null and key is not null").groupBy(*own).agg(F.map_from_entries(F.min("stored")).alias("stored")))
    # Revisits without a response get keys of their own that no response has, so that they don't meet in one task.
    nowhere = F.concat_ws("-", F.lit("none"), F.xxhash64("page", "fetched", "record_id").cast("string"))
    found = revisits.join(targets, ["page", "fetched"], "left")
    found = found.withColumns({"key": F.coalesce("response_id", nowhere), "page_key": F.when(F.col("response_id").isNotNull(), F.col("page")).otherwise(nowhere)})
    stored = full.select(F.col("page").alias("page_key"), "response_fetched", "key", "stored")
    found = found.withColumn("response_fetched", F.coalesce("response_fetched", F.timestamp_seconds(F.lit(0))))
    rows = found.join(stored, ["page_key", "response_fetched", "key"], "left")
    tag = lambda c: F.regexp_replace(F.col(c)["etag"], "^W/", "")
    modified = lambda c: F.col(c)["last-modified"]
    differs = F.coalesce(tag("headers") != tag("stored"), F.lit(False)) | F.coalesce(modified("headers") != modified("stored"), F.lit(False))
    agrees = F.coalesce(tag("headers") == tag("stored"), F.lit(False)) | F.coalesce(modified("headers") == modified("stored"), F.lit(False))
    outcome = (F.when(F.col("page").isNull() | F.col("fetched").isNull(), "undated").when(F.col("response_id").isNull(), "no_response")
               .when(differs, "changed").when(agrees, "resolved").otherwise("unchecked"))
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    rows = rows.withColumn("outcome", outcome)
    return rows.select("record_id", "page", "fetched", "outcome", F.when(F.col("outcome").isin("resolved", "unchecked", "changed"), F.col("response_id")).alias("response_id"),
                       F.when(F.col("outcome") == "resolved", F.map_from_entries(F.array_sort(F.map_entries(merged)))).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Crawl history of the pages as WARC records: one full response each, and on later days a revisit with its validators,
    one with another entity tag, one without validators, and one before the page was first fetched."""
    start = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 365 as int), 0, 0, cast(page_id % 86400 as int))")
    base = pages.where("page_id is not null").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), start.alias("t"))
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    visits = F.array(*(F.struct(F.lit(n).alias("visit"), F.lit(days).alias("days"), F.lit(kind).alias("kind"), F.lit(note).alias("note"))
                       for n, days, kind, note in ((0, 0, "response", ""), (1, 1, "revisit", "same"), (2, 9, "revisit", "other"), (3, 20, "revisit", "none"), (4, -3, "revisit", "same"))))
    rows = base.withColumn("tag", tag).select("*", F.explode(visits).alias("v")).withColumn("at", F.expr("date_format(t + make_interval(0, 0, 0, v.days, 0, 0, 0), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.col("v.kind"), F.lit("\r\nWARC-Record-ID: "), F.concat_ws("-", F.lpad(F.col("page_id").cast("string"), 12, "0"), F.col("v.visit").cast("string")),
                    F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url"))).otherwise(F.lit("")), F.lit("\r\nWARC-Date: "), F.col("at"), F.lit("\r\n\r\n"))
    etag = F.when(F.col("v.note") == "other", F.concat(F.lit('\r\nETag: "x'), F.col("tag"), F.lit('"'))).when(F.col("v.note") == "none", F.lit("")).otherwise(F.concat(F.lit('\r\nETag: W/"'), F.col("tag"), F.lit('"')))
    full = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nCache-Control: no-cache\r\nETag: \""), F.col("tag"), F.lit('"\r\nContent-Length: '), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), F.col("html"))
    short = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nCache-Control: max-age=60\r\nContent-Length: 0"), etag, F.lit("\r\n\r\n"))
    return rows.select(F.concat(head, F.when(F.col("v.kind") == "response", full).otherwise(short)).alias("record"))


def page_revisits(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC records, parse them and resolve every revisit."""
    captures = cut(parse_records(page_records(pages)).drop("payload"), "captures")
    found = resolve_revisits(captures)
    header = lambda k: F.col("headers")[k].alias(k.replace("-", "_"))
    return found.select("record_id", "page", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "outcome", "response_id", header("etag"), header("cache-control"), header("content-length"), header("content-type"))
