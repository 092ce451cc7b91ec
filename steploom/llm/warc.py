"""WARC records: not-modified revisits get the record and the headers of the response they refer to; its payload stays there.

As-of join: each revisit of profile server-not-modified takes the latest earlier full response of its canonical URL.
The timelines of all URLs are cut into blocks; the last response of each block is carried over the blocks after it. So the
captures of a URL that holds a third of all records are spread over many tasks, and only one row for each URL and block
meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steploom.llm.shared import written

#: Records of one block, about; a block is one task's stretch of sorted records.
BLOCK_RECORDS = 200_000

#: Revisits of one response meet its headers over so many salts at most.
SALTS = 64

#: Fixed: header fields that a 304 response must not change in a stored response (they describe the message or its body).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)

#: Fixed: query parameters that name a session or a campaign, not a page.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|jsessionid|phpsessid|sid|sessionid)$"


def canonical_url(url: Column) -> Column:
    """Scheme, host and port in lower case without ``www.``, default port, user or fragment; http and https are one.

    Query parameters are sorted, without those that name a session or a campaign; a slash at the end of the path goes, and
    with it an empty query. Null or blank: null. What is not a URL is kept as it is, trimmed.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(
        F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).rlike(TRACKING),
    )
    joined = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))
    return F.when(F.trim(url) == "", None).when(host != "", joined).otherwise(plain)


def lower_names(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ in case alone the first in order stays."""
    entries = F.array_sort(F.map_entries(headers))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(named, lambda e: e["key"]))
    first = F.transform(names, lambda n: F.struct(n.alias("key"), F.filter(named, lambda e: e["key"] == n)[0]["value"].alias("value")))
    return F.map_from_entries(first)


def _opaque(tag: Column) -> Column:
    """An entity tag without the mark of a weak one: 304 responses are matched by weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with the permitted fields of the fresh ones put in their place or added."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def resolve_revisits(records: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """``records`` of type revisit, resolved.

    ``records``: ``record_id`` (long), ``kind`` (``response`` or ``revisit``), ``url``, ``captured`` (timestamp), ``status``
    (int), ``headers`` (map of strings). Columns beyond these are ignored, whatever their names.

    Result, one row per revisit: ``record_id``, ``url``, ``captured``, ``refers_to`` (record of the latest earlier response
    with status 200 and the same canonical URL; of equal times that with the largest id; null if none), ``outcome``
    and ``headers`` (merged if resolved, else the revisit's own, names in lower case). A response of the same time is not
    earlier. Outcomes: ``resolved``; ``no_response``; ``etag_differs`` (both have one, weak comparison);
    ``modified_later`` (no entity tag on both sides and the response's Last-Modified text differs); ``no_validator`` (neither kind on
    both sides). A revisit without URL or time has no response. Record ids may repeat on other pages or times: a record is known by id,
    page and time. Repeated rows give repeated results; null headers are empty.
    """
    names = F.coalesce(lower_names(F.col("headers")), F.create_map().cast("map<string,string>"))
    facts = records.select(
        F.col("record_id").cast("long").alias("record_id"),
        "url",
        canonical_url(F.col("url")).alias("page"),
        F.col("captured").cast("timestamp").alias("captured"),
        ((F.lower("kind") == "response") & (F.col("status") == 200)).alias("full"),
        (F.lower("kind") == "revisit").alias("revisit"),
        names.alias("headers"),
    ).filter("full OR revisit")
    facts = facts.filter((F.col("page").isNotNull() & F.col("captured").isNotNull()) | F.col("revisit"))
    slim = facts.select("page", "captured", "record_id", "full").filter(F.col("page").isNotNull() & F.col("captured").isNotNull())
    slim = written(slim.distinct(), "captures")
    blocks = max(1, -(-slim.count() // block_records))
    # Revisits come before responses of their time, so that none is its own answer.
    order = ["page", "captured", "full", "record_id"]
    sorted_rows = slim.repartitionByRange(blocks, *order).select("*", F.spark_partition_id().alias("block"))
    sorted_rows = written(sorted_rows, "capture-blocks")
    in_block = Window.partitionBy("page", "block").orderBy("captured", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    response = F.struct("captured", "record_id")
    here = F.last(F.when(F.col("full"), response), ignorenulls=True).over(in_block)
    ends = sorted_rows.filter("full").groupBy("page", "block").agg(F.max(response).alias("end"))
    all_blocks = sorted_rows.select("page", "block").distinct().join(ends, ["page", "block"], "left")
    before = Window.partitionBy("page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = all_blocks.select("page", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = sorted_rows.withColumn("here", here).filter(~F.col("full")).join(written(carried, "carried"), ["page", "block"])
    answer = F.coalesce("here", "carried")
    answers = found.select(
        F.col("record_id").alias("of"),
        F.col("page").alias("of_page"),
        F.col("captured").alias("at"),
        answer["record_id"].alias("refers_to"),
        answer["captured"].alias("referred"),
        answer.isNotNull().alias("answered"),
    )
    answers = written(answers, "answers")
    revisits = facts.filter("revisit")
    placed = F.col("page").isNotNull() & F.col("captured").isNotNull()
    same = F.col("record_id").eqNullSafe(F.col("of")) & (F.col("page") == F.col("of_page")) & (F.col("captured") == F.col("at"))
    asked = revisits.filter(placed).join(answers, same).select(
        "record_id", "url", "page", "captured", "headers", "refers_to", "referred", "answered",
        F.pmod(F.xxhash64("record_id", "captured"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    # A response may stand there twice with other headers; those that come last as text are taken.
    stored = facts.filter("full").groupBy("record_id", "page", "captured").agg(F.max_by("headers", F.to_json("headers")).alias("stored"))
    stored = stored.toDF("stored_id", "stored_page", "stored_at", "stored")
    # A response goes to each salt that asks for it, so a hot one meets its revisits in many tasks.
    needs = asked.filter("answered").select(F.col("refers_to").alias("n_id"), F.col("page").alias("n_page"), F.col("referred").alias("n_at"), F.col("salt").alias("n_salt")).distinct()
    is_stored = F.col("n_id").eqNullSafe(F.col("stored_id")) & (F.col("n_page") == F.col("stored_page")) & (F.col("n_at") == F.col("stored_at"))
    sent = needs.join(stored, is_stored).select("n_id", "n_page", "n_at", "n_salt", "stored")
    is_asked = F.col("refers_to").eqNullSafe(F.col("n_id")) & (F.col("page") == F.col("n_page")) & (F.col("referred") == F.col("n_at")) & (F.col("salt") == F.col("n_salt"))
    columns = ["record_id", "url", "captured", "headers", "refers_to", "answered", "stored"]
    with_stored = asked.filter("answered").join(sent, is_asked).select(*columns)
    # Revisits without an answer, of which there may be many, pass by the joins.
    nothing = [F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("answered"), F.lit(None).cast("map<string,string>").alias("stored")]
    without = asked.filter(~F.col("answered")).select("record_id", "url", "captured", "headers", *nothing)
    unplaced = revisits.filter(~placed).select("record_id", "url", "captured", "headers", *nothing)
    both = with_stored.unionByName(without).unionByName(unplaced)
    tag, old_tag = _opaque(F.col("headers")["etag"]), _opaque(F.col("stored")["etag"])
    day, old_day = F.trim(F.col("headers")["last-modified"]), F.trim(F.col("stored")["last-modified"])
    outcome = (
        F.when(~F.col("answered"), "no_response")
        .when(tag != old_tag, "etag_differs")
        .when(tag == old_tag, "resolved")
        .when(day != old_day, "modified_later")
        .when(day == old_day, "resolved")
        .otherwise("no_validator")
    )
    return both.select(
        "record_id",
        "url",
        "captured",
        "refers_to",
        outcome.alias("outcome"),
        F.when(outcome == "resolved", merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
