"""WARC writing and boundary-chain verification (operator 6).

Writing: every page becomes a WARC/1.1 record. Of pages with equal payloads the
smallest id is a ``response`` with the payload, the others are ``revisit``
records that point at it. Records are plain text in UTF-8, written by Spark's
text writer, one archive file per task.

Reading: a task sees byte ranges of an archive, not records, and a payload may
hold the record magic. The archive is cut at every magic; each cut is only a
candidate. A candidate's header gives the offset at which its successor must
start. Pointer jumping from offset 0 of every file (squaring the successor
table: inside each byte range first, then over a file's ranges) keeps what the
chain reaches. Text behind a magic inside a payload is never reached, and goes
back to the payload it was cut from.

Defined cases: a null html is an empty payload; empty payloads count as equal
payloads; null ids are written as empty and read as null; repeated rows are
records of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paxcast.llm import common

MAGIC = "WARC/1.1\r\n"
MARKS = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648 base32


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of the SHA-1: each five hex digits are four symbols."""
    digest = F.sha1(payload)
    symbols = F.array(*(F.lit(c) for c in ALPHABET))
    out = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        out += [F.get(symbols, F.shiftright(bits, s).bitwiseAND(31)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame) -> DataFrame:
    """One WARC record (text, without its last line feed) per page.

    The smallest id of each payload is found by a partial minimum per digest and
    joined back, so a payload shared by many pages is no hot group.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    firsts = source.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    shared = common.materialise(firsts.where("copies > 1"))
    # At most MARKS numbers say which payloads may be shared; pages that can't
    # be are written where they are read, and only the others are moved.
    marks = F.broadcast(shared.select(bucket.alias("mark")).distinct())
    source = source.withColumn("mark", bucket)
    alone = source.join(marks, "mark", "left_anti").withColumn("copies", F.lit(None).cast("long")).withColumn("first_id", F.lit(None).cast("long"))
    joined = alone.unionByName(source.join(marks, "mark", "left_semi").join(shared, "digest", "left"))
    # A page without an id can't be named by a revisit: it is a response.
    revisit = F.col("copies").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first_id"))
    size = F.octet_length("html")
    url = F.regexp_replace("url", "[\r\n]", " ")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
            F.col("first_id").cast("string"), F.lit(">\r\nX-Payload-Length: "), size.cast("string"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(size.cast("string")), F.lit("\r\n\r\n"))
    return joined.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n\r")).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    records(pages).write.option("lineSep", "\n").text(folder)


CUTS = (
    "file string, block long, rel long, size long, next long, record_type string, id string, url string, refers string, "
    "digest string, full_length string, payload_bytes long, payload_digest string, body_from long, body_length long, value binary")


def fields(head: bytes) -> dict[str, str]:
    """Header lines of a candidate, or nothing if they aren't header lines."""
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return {}
        out[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
    return out


def cut(spark: SparkSession, folder: str, texts: bool = False) -> DataFrame:
    """Every cut of the archives at a magic, read by byte ranges.

    ``rel`` is where the cut's magic stands, counted from the first byte of the
    range's first cut; ``next`` (counted alike) is where its header says that
    the successor starts, null without a header. A candidate whose whole payload
    lies in its cut is digested here, so its text isn't moved again; ``value``
    is null unless ``texts`` are asked for.
    """

    def run(batches):
        at = {}
        for batch in batches:
            rows = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rel = at.get((file, block), 0)
                size = len(value) + len(MAGIC)
                at[file, block] = rel + size
                head, gap, body = value.partition(b"\r\n\r\n")
                got = fields(head) if gap else {}
                length = got.get("Content-Length", "")
                known = length.isascii() and length.isdigit() and len(length) < 19
                row = dict.fromkeys(("next", "payload_bytes", "payload_digest", "body_from", "body_length"))
                if known:
                    n = int(length)
                    row["next"] = rel + len(head) + 4 + n + 4
                    row["body_from"], row["body_length"] = len(head) + 4, n
                    if len(body) >= n:
                        row["payload_bytes"] = n
                        row["payload_digest"] = base64.b32encode(hashlib.sha1(body[:n]).digest()).decode()
                ident, refers = (URN.fullmatch(got.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((
                    file, block, rel - len(MAGIC), size, row["next"], got.get("WARC-Type"), ident and ident[1], got.get("WARC-Target-URI"),
                    refers and refers[1], got.get("WARC-Payload-Digest"), got.get("X-Payload-Length"),
                    row["payload_bytes"], row["payload_digest"], row["body_from"], row["body_length"], value if texts else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), ARROW, strict=True)], names=[f.split()[0] for f in CUTS.split(", ")])

    cuts = spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))
    return cuts.mapInArrow(run, CUTS)


ARROW = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 6, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
URN = re.compile(r"<urn:page:(-?\d*)>")


def placed(cuts: DataFrame) -> DataFrame:
    """Cuts with file offsets ``at`` and ``next`` in place of range offsets.

    Sizes are summed per range first; only the few ranges of a file are ordered.
    """
    ranges = cuts.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")
    ranges = ranges.select("file", "block", before.alias("before"))
    return cuts.join(ranges, ["file", "block"]).select(
        "file", "block", (F.col("rel") + F.col("before")).alias("at"), (F.col("next") + F.col("before")).alias("next")).where("at >= 0")


def exits(links: DataFrame) -> DataFrame:
    """For each candidate the first offset on its chain outside its byte range,
    by pointer jumping inside the range (an array of successors, squared)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at").reset_index(drop=True)
        at, to = frame["at"].to_numpy(np.int64), frame["next"].fillna(-1).to_numpy(np.int64)
        step = successors(at, to)
        for _ in range(len(at).bit_length()):
            step = np.where(step < 0, -1, step)
            step = np.where((step >= 0) & (step[step] >= 0), step[step], step)
        last = np.where(step >= 0, step, np.arange(len(at)))
        return pd.DataFrame({"file": frame["file"], "at": at, "exit": to[last]})

    return links.groupBy("file", "block").applyInPandas(run, "file string, at long, exit long")


def successors(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Index of the candidate that stands at ``to``, or -1."""
    found = np.searchsorted(at, to)
    found = np.minimum(found, len(at) - 1)
    return np.where(at[found] == to, found, -1)


def entries(jump: DataFrame) -> DataFrame:
    """(file, at) where the chain from offset 0 enters each byte range.

    Pointer jumping over ranges: after round k all entries within 2**k ranges of
    the file's start are known; rounds are the logarithm of a file's ranges.
    """
    places = jump.select("file", "at")
    reached = common.materialise(places.where("at = 0"))
    known = reached.count()
    while known:
        ahead = jump.join(reached, ["file", "at"], "left_semi").select("file", F.col("exit").alias("at"))
        reached = common.materialise(reached.union(ahead.join(places, ["file", "at"], "left_semi")).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        onward = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jump = common.materialise(jump.join(onward, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")))
    return reached


def owners(links: DataFrame, reached: DataFrame) -> DataFrame:
    """Each cut with ``owner``, the chain's record that it belongs to: itself, or,
    for a magic inside a payload, the record before it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at").reset_index(drop=True)
        at, to = frame["at"].to_numpy(np.int64), frame["next"].fillna(-1).to_numpy(np.int64)
        real = frame["entry"].fillna(False).to_numpy(bool)
        step = successors(at, to)
        for _ in range(len(at).bit_length() + 1):
            hit = step[real & (step >= 0)]
            real = real.copy()
            real[hit] = True
            step = np.where((step >= 0) & (step[step] >= 0), step[step], -1)
        held = np.maximum.accumulate(np.where(real, np.arange(len(at)), -1))
        owner = np.where(held >= 0, at[held], -1)
        return pd.DataFrame({"file": frame["file"], "block": frame["block"], "at": at, "owner": owner})

    marked = links.join(reached.withColumn("entry", F.lit(True)), ["file", "at"], "left").select("file", "block", "at", "next", "entry")
    found = marked.groupBy("file", "block").applyInPandas(run, "file string, block long, at long, owner long")
    # A payload may run on through whole ranges: their first cuts belong to the
    # last record of an earlier range.
    last = found.groupBy("file", "block").agg(F.max("owner").alias("last"))
    carried = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select("file", "block", carried.alias("carried"))
    return found.join(last, ["file", "block"]).select(
        "file", "at", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")).alias("owner"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records that the chains reach: header fields, payload length and
    digest of the payload as read."""
    cuts = common.materialise(cut(spark, folder).drop("value"))
    links = common.materialise(placed(cuts.select("file", "block", "rel", "size", "next")))
    reached = entries(common.materialise(exits(links)))
    owned = common.materialise(owners(links, reached))
    ranges = cuts.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")
    ranges = ranges.select("file", "block", before.alias("before"))
    at = (F.col("rel") + F.col("before")).alias("at")
    heads = cuts.join(ranges, ["file", "block"]).withColumn("at", at)
    heads = heads.join(owned.where("owner = at").select("file", "at"), ["file", "at"], "left_semi")
    columns = ("record_type", "id", "url", "refers", "digest", "full_length")
    # Records cut by a magic in their payload: the archives are read again, and
    # only these records' texts are gathered.
    torn = heads.where("payload_bytes is null").select("file", F.col("at").alias("owner"), "body_from", "body_length")
    torn = common.materialise(torn)
    if torn.isEmpty():
        return heads.select(*columns, "payload_bytes", "payload_digest")
    pieces = owned.join(torn, ["file", "owner"])
    texts = cut(spark, folder, texts=True).select("file", "block", "rel", "value").join(ranges, ["file", "block"]).select("file", at, "value")
    joined = pieces.join(texts, ["file", "at"]).groupBy("file", "owner", "body_from", "body_length").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = F.aggregate(
        F.expr("slice(parts, 2, size(parts))"), F.get("parts", F.lit(0))["value"],
        lambda text, part: F.concat(text, F.lit(MAGIC).cast("binary"), part["value"]))
    body = F.substring(whole, F.col("body_from").cast("int") + 1, F.col("body_length").cast("int"))
    mended = joined.withColumn("body", body).select(
        "file", F.col("owner").alias("at"), F.octet_length("body").cast("long").alias("mended_bytes"), base32_sha1(F.col("body")).alias("mended_digest"))
    return heads.join(mended, ["file", "at"], "left").select(
        *columns, F.coalesce("payload_bytes", "mended_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "mended_digest").alias("payload_digest"))


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives and give what reading them back says."""
    spark = pages.sparkSession
    folder = folder or common.shared_folder(spark)
    write(pages, folder)
    found = read(spark, folder)
    revisit = F.col("record_type") == "revisit"
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return found.select(
        number("id").alias("page_id"),
        F.when(revisit, number("full_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.when(revisit, number("refers")).alias("refers_to"))
