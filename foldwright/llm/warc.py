"""WARC archives: one record per page, written and read as text files, with boundary-chain verification.

Writing: a record's header and payload are one row of a text file whose line separator is CR LF CR LF, which is what
ends a WARC record; so Spark's writer makes the archives, in any store it can reach. Pages of equal payload share one
response record, the others are revisit records without payload.

Reading: the files are split at the magic line that starts a record, by any number of tasks. Each piece is a candidate
record: its offset in the file comes from prefix sums of the pieces' lengths, its successor's offset from its
Content-Length. Payloads may hold the magic line too, so not every candidate is a record. Within a split, chains of
successors are followed by pointer jumping to the first offset outside it; between splits, tables of those exits are
joined with themselves, so that the path from the start of a file to its end takes log2(splits) rounds. Only
candidates reached from the start are records. A record whose payload holds the magic line is put together from its
pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.rows import key_filter, with_maybe
from foldwright.session import cut_lineage, ship_package

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: RFC 4648 base 32, and the digits of conv() to base 32.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1 of a binary column."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least ``least`` bytes that with the largest page_id is the response and the
    others are revisits that refer to it; smaller ones are all responses. A null html is an empty payload. Rows that
    share the largest page_id are all responses; a null page_id counts as the smallest, and pages that have only
    null ids are all responses. Payloads are equal if length and SHA-1 are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", base32_sha1(payload))
    originals = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
    originals = cut_lineage(originals.where("copies > 1").select("payload_digest", "payload_bytes", "original"))
    # only pages that may have copies are shuffled with their payload
    key = F.xxhash64("payload_digest", "payload_bytes")
    marked = with_maybe(rows, key, key_filter(originals.select(key.alias("key"))))
    single = marked.where("not __maybe").withColumn("original", F.lit(None).cast("long"))
    joined = marked.where("__maybe").join(originals, ["payload_digest", "payload_bytes"], "left")
    joined = joined.unionByName(single).drop("__maybe")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def _record_id(page: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the pages as WARC files below path; see plan_records for which are revisits. date is every WARC-Date.

    Every task writes its records to files of its own. Line breaks in a url are percent-encoded. Other columns
    are ignored; an empty table gives no records.
    """
    rows = plan_records(pages, least)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(F.col("record_type") == "response", F.coalesce(F.col("html"), F.lit(""))).otherwise(F.lit(""))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "),
        _record_id("page_id"),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.when(F.col("record_type") == "revisit", F.lit(f"\r\nWARC-Profile: {PROFILE}")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(body) + len(HTTP)).cast("string"),
        F.lit(END + HTTP),
    )
    rows.select(F.concat(header, body).alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, value): what lies between two magic lines, in file order by split and place."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")


def _header(name: str) -> Column:
    """A header's value in a candidate's header lines, null if it is absent."""
    found = F.regexp_extract(F.col("head"), rf"(?m)^{name}: *([^\r\n]*)", 1)
    return F.when(found == "", None).otherwise(found)


def _opened(value: DataFrame) -> DataFrame:
    """Adds a record's fields and its payload, from value: the record without its magic line."""
    rows = value.withColumn("head", F.substring_index("value", END, 1))
    rows = rows.withColumn("block", F.expr("substr(value, length(head) + 5)"))
    rows = rows.withColumn("http", F.when(_header("Content-Type").startswith("application/http"), F.concat(F.substring_index("block", END, 1), F.lit(END))).otherwise(F.lit("")))
    payload = F.expr("substr(block, length(http) + 1, length(block) - length(http) - 4)").cast("binary")
    return rows.withColumns(
        {
            "record_type": _header("WARC-Type"),
            "page_id": F.regexp_extract("head", r"(?m)^WARC-Record-ID: <urn:page:(-?\d+)>", 1).try_cast("long"),
            "refers_to": F.regexp_extract("head", r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)>", 1).try_cast("long"),
            "url": _header("WARC-Target-URI"),
            "declared_digest": F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:(\w+)", 1),
            "declared_bytes": _header("WARC-Payload-Length").try_cast("long"),
            "payload": payload,
        }
    )


FIELDS = ["record_type", "page_id", "refers_to", "url", "declared_digest", "declared_bytes"]


def _positions(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Where each successor stands among the sorted offsets, -1 if it is not there."""
    place = np.searchsorted(at, following)
    there = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == following)
    return np.where(there, place, -1)


def _split_exits(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the candidates of one split: the first offset on each one's chain that is none of the split's."""
    frame = frame.sort_values("at")
    at, leave = frame["at"].to_numpy(), frame["next"].to_numpy().copy()
    jump = _positions(at, leave)
    while (jump >= 0).any():
        inside = jump >= 0
        leave[inside] = leave[jump[inside]]
        jump[inside] = jump[jump[inside]]
    return pd.DataFrame({"file": frame["file"].to_numpy(), "split": frame["split"].to_numpy(), "at": at, "next": leave})


def _split_reached(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one split with the offset of the reached record that each lies in, -1 before the first one."""
    frame = frame.sort_values("at")
    at = frame["at"].to_numpy()
    jump = _positions(at, frame["next"].to_numpy())
    reached = at == frame["entry"].to_numpy()
    while (jump >= 0).any():
        ahead = jump[reached & (jump >= 0)]
        reached[ahead] = True
        jump = np.where(jump >= 0, jump[np.maximum(jump, 0)], -1)
    owner = np.maximum.accumulate(np.where(reached, at, -1))
    return pd.DataFrame({"file": frame["file"].to_numpy(), "split": frame["split"].to_numpy(), "place": frame["place"].to_numpy(), "at": at, "owner": owner})


def _verified(pieces: DataFrame) -> DataFrame:
    """(file, split, place, at, owner) of pieces(file, split, place, size, length): owner is the offset of the record
    that the piece starts (owner = at) or is a part of; null before a file's first record.

    length is a candidate's whole size by its header, null if it has no valid header.
    """
    before = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0)))
    splits = pieces.groupBy("file", "split").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    # the file's first piece has no magic line before it, so its offset is negative and it is no candidate
    at = (F.col("base") + F.col("within") - len(MAGIC)).cast("long")
    found = placed.join(splits, ["file", "split"]).select("file", "split", "place", at.alias("at"), F.coalesce(at + F.col("length"), F.lit(-1)).cast("long").alias("next"))
    found = cut_lineage(found.withColumn("next", F.when(F.col("at") >= 0, F.col("next")).otherwise(F.lit(-1).cast("long"))))
    exits = cut_lineage(found.where("next >= 0").groupBy("file", "split").applyInPandas(_split_exits, "file string, split long, at long, next long"))
    reached = exits.where("at = 0").select("file", "at")
    starts = exits.select("file", F.col("at").alias("next"))
    jump = cut_lineage(exits.select("file", "at", "next").join(starts, ["file", "next"], "left_semi"))
    while not jump.isEmpty():
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = cut_lineage(reached.union(ahead))
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = cut_lineage(jump.join(onward, ["file", "next"]).select("file", "at", F.col("then").alias("next")))
    entries = reached.join(exits.select("file", "split", "at"), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))
    marked = found.join(entries, ["file", "split"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1).cast("long")))
    marked = cut_lineage(marked.groupBy("file", "split").applyInPandas(_split_reached, "file string, split long, place long, at long, owner long"))
    ends = marked.groupBy("file", "split").agg(F.max("owner").alias("latest"))
    carried = ends.withColumn("carried", F.max("latest").over(earlier)).drop("latest")
    owner = F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried"))
    return cut_lineage(marked.join(carried, ["file", "split"]).withColumn("owner", F.when(owner >= 0, owner)).select("file", "split", "place", "at", "owner"))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the WARC files below path: file, offset, record_type, page_id, refers_to, url,
    payload_bytes, payload_digest and, with_payload, payload.

    Only records on the chain that starts at offset 0 of a file are returned; magic lines inside payloads are not
    taken for records, and a record that is cut off by the end of its file is left out. payload_bytes and
    payload_digest are computed from the payload that was read; those of a revisit, which has none, are what its
    header says. A record without a page's id has page_id null. No files give no records.
    """
    ship_package(spark)
    opened = _opened(_pieces(spark, path))
    content = _header("Content-Length").try_cast("long")
    length = F.when(F.instr("value", END) > 0, len(MAGIC) + F.octet_length("head") + len(END) + content + len(END))
    whole = opened.withColumn("size", F.octet_length("value") + len(MAGIC)).withColumn("length", length)
    exact = F.col("length") == F.col("size")
    narrow = whole.select(
        "file", "split", "place", "size", "length", *FIELDS,
        F.when(exact, F.octet_length("payload")).cast("long").alias("payload_bytes"), F.when(exact, base32_sha1(F.col("payload"))).alias("payload_digest"),
    )
    narrow = cut_lineage(narrow)
    marked = _verified(narrow.select("file", "split", "place", "size", "length"))
    sized = cut_lineage(marked.where("owner is not null").join(narrow, ["file", "split", "place"]))
    records = sized.where("at = owner")
    simple = records.where("length = size")
    columns = ["file", F.col("at").alias("offset"), *FIELDS, "payload_bytes", "payload_digest"]
    parts = sized.join(records.where("length > size").select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
    keys = (parts if not with_payload else sized).select("file", "split", "place", "owner", "at")
    out = simple.select(*columns)
    if with_payload or not parts.isEmpty():
        values = _pieces(spark, path).join(keys, ["file", "split", "place"])
        joined = values.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        # the second reading cuts the files as the first did; if the cluster changed in between and it does not, the
        # job stops instead of losing a record
        expected = keys.groupBy("file", "owner").agg(F.count("*").alias("expected"))
        whole_record = F.when(F.size("parts") == F.col("expected"), F.array_join("parts.value", MAGIC))
        stop = F.raise_error(F.lit("the archives were cut in another way when they were read again: run it once more")).cast("string")
        joined = expected.join(joined, ["file", "owner"], "left").select("file", F.col("owner").alias("offset"), F.coalesce(whole_record, stop).alias("value"))
        again = _opened(joined).join(records.select("file", F.col("at").alias("offset"), "length"), ["file", "offset"])
        again = again.where(F.octet_length("value") + len(MAGIC) == F.col("length"))
        again = again.select("file", "offset", *FIELDS, F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "payload")
        out = again if with_payload else out.union(again.drop("payload"))
    revisit = F.col("record_type") == "revisit"
    return out.withColumns(
        {
            "payload_bytes": F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")),
            "payload_digest": F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")),
        }
    ).drop("declared_bytes", "declared_digest")
