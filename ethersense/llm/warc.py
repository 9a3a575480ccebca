"""Web archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethersense.session import bounded, materialise, work_path

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEME = "urn:page:"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 8 groups of 20 bits, each 4 letters."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, records: int = 4096, least_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) to ``path``, ``records`` a file at most.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least ``least_bytes``
    the one with the smallest page_id (null last) is a response and the others are revisits of it
    without a block; if rows also share that page_id, one of them is the response. Control characters in a
    url are left out, and one that ends in the magic has its slash escaped; a null url or id gives no such header. Other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    same = ["digest", "bytes"]
    late = F.col("page_id").isNull()
    heads = rows.groupBy(*same, "page_id").agg(F.count("*").alias("n")).groupBy(*same).agg(
        F.min(F.struct(late.alias("late"), "page_id", "n")).alias("head"), F.sum("n").alias("copies")
    ).where((F.col("copies") > 1) & (F.col("bytes") >= least_bytes))
    heads = materialise(heads.select(*same, F.col("head.page_id").alias("head"), F.col("head.n").alias("tied")), "payload-heads")
    rows = rows.join(heads, same, "left")
    first = F.col("page_id").eqNullSafe(F.col("head"))
    revisit = F.col("tied").isNotNull() & ~first
    if not heads.where("tied > 1").isEmpty():  # rows equal in payload and id: one of them is the response
        order = Window.partitionBy(*same).orderBy("url")
        tied = rows.where(F.col("tied").isNotNull() & first & (F.col("tied") > 1)).withColumn("revisit", F.row_number().over(order) > 1)
        clear = rows.where(~(F.col("tied").isNotNull() & first & (F.col("tied") > 1))).withColumn("revisit", revisit)
        rows = clear.unionByName(tied)
    else:
        rows = rows.withColumn("revisit", revisit)
    url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", ""), r"WARC/1\.1$", "WARC%2F1.1")
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _field("WARC-Record-ID", F.concat(F.lit(f"<{SCHEME}"), F.col("page_id").cast("string"), F.lit(">"))),
        _field("WARC-Target-URI", F.when(url != "", url)), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
            _field("WARC-Refers-To", F.concat(F.lit(f"<{SCHEME}"), F.col("head").cast("string"), F.lit(">"))),
            F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string"), F.lit("\r\n"),
        )).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(F.col("revisit"), "0").otherwise(F.col("bytes").cast("string")), F.lit(RECORD_END),
    )
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(head.cast("binary"), block).cast("string").alias("value")
    # the text writer puts out the bytes of a string as they are, and its line end is the end of a record
    rows.select(record).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records).text(path)


def _with_offsets(batches):
    """``local``: the bytes of the same split before each row. A task reads its splits from front to back."""
    total: dict[tuple, int] = {}
    for batch in batches:
        local = []
        for key, n in zip(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()), batch.column("bytes").to_pylist()):
            if key not in total:
                total = {key: 0}
            local.append(total[key])
            total[key] += n
        yield pa.record_batch([*batch.columns, pa.array(local, pa.int64())], names=[*batch.schema.names, "local"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between one magic and the next, and the ``mark`` (a hash) that names such a text in any later scan."""
    text = F.col("value").cast("binary")
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        text.alias("text"), F.sha2(text, 256).alias("mark"),
    )


def _candidates(spark: SparkSession, path: str, keep_blocks: bool) -> tuple[DataFrame, DataFrame]:
    """Every place of the magic in the files, as contents and as links.

    Contents: ``file, split, local`` (where), ``bytes`` (up to the next place), ``mark``, ``head``, ``size``, ``whole``
    (the block ends before the next place), its ``digest`` and, if wanted, ``block``. Links: the same key, ``whole``, ``at``
    (offset in the file) and ``next`` (where the record would end). Offsets are sums of lengths, per split and then per file.
    """
    lines = _lines(spark, path).withColumn("bytes", F.octet_length("text").cast("long") + len(MAGIC))
    lines = lines.mapInArrow(_with_offsets, "file string, split long, text binary, mark string, bytes long, local long")
    head = F.substring_index(F.col("text").cast("string"), RECORD_END, 1)
    length = F.regexp_extract("head", r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1)
    skip = F.octet_length(F.col("head").cast("binary")).cast("long") + len(RECORD_END)
    ended = skip + len(MAGIC) <= F.col("bytes")
    rows = lines.withColumn("head", head).withColumn("skip", skip).withColumn("size", F.when(ended & (length != ""), length.cast("long")))
    rows = rows.withColumn("whole", F.col("bytes") - len(MAGIC) >= F.col("skip") + F.col("size"))
    block = F.substring("text", F.col("skip").cast("int") + 1, F.col("size").cast("int"))
    rows = rows.withColumn("digest", F.when(F.col("whole"), sha1_base32(block)))
    rows = rows.withColumn("block", F.when(F.col("whole"), block) if keep_blocks else F.lit(None).cast("binary"))
    rows = materialise(rows.drop("text"), "archive-candidates")  # the archives hold the texts
    sums = rows.groupBy("file", "split").agg(F.sum("bytes").alias("_sum"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", (F.coalesce(F.sum("_sum").over(before), F.lit(0)) - len(MAGIC)).alias("_before"))
    links = rows.select("file", "split", "local", "skip", "size", "whole").join(sums, ["file", "split"])
    at = F.col("_before") + F.col("local")
    # what stands before the first magic of a file is no record: its place is negative
    links = links.withColumn("at", at).where("at >= 0").select(
        "file", "split", "local", "at", F.coalesce("whole", F.lit(False)).alias("whole"),
        (F.col("at") + len(MAGIC) + F.col("skip") + F.col("size") + len(RECORD_END)).alias("next"),
    )
    return rows, materialise(links, "archive-links")


def _reachable(links: DataFrame) -> DataFrame:
    """``(file, at)`` of the candidates on the chain from the start of their file, by pointer jumping.

    After round i the marked rows are the first 2^i of each chain and every pointer skips 2^i records.
    """
    jump = links.where(F.col("next").isNotNull()).select("file", "at", "next")
    marked = links.where("at = 0").select("file", "at")
    while True:
        hop = jump.select("file", F.col("at"), F.col("next").alias("to"))
        new = marked.join(hop, ["file", "at"]).select("file", F.col("to").alias("at"))
        new = materialise(new.join(links.select("file", "at"), ["file", "at"], "left_semi"), "reached")
        if new.isEmpty():
            return marked
        marked = materialise(marked.union(new), "marked")
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = materialise(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")


def read_archives(spark: SparkSession, path: str, keep_blocks: bool = True) -> DataFrame:
    """Records of uncompressed archives: ``file``, ``at``, ``head`` (text), ``size``, ``digest``, ``block`` (null unless ``keep_blocks``).

    Tasks propose a record at every magic they see; only those on the chain of record ends from the
    start of the file count, so a magic inside a payload is part of that payload. A file that starts with
    something else, or whose chain meets a record without Content-Length, yields the records up to there.
    A last record whose block is cut short is left out. A header line that ends in the magic is not supported.
    """
    rows, links = _candidates(spark, path, keep_blocks)
    real = materialise(_reachable(links).withColumn("real", F.lit(True)), "records")
    marks = materialise(links.join(real, ["file", "at"], "left").withColumn("real", F.coalesce("real", F.lit(False))), "marks")
    key = ["file", "split", "local"]
    done = rows.drop("whole").join(marks.where("real and whole").select(*key, "at"), key).select(
        "file", "at", "head", "size", "digest", "block"
    )
    # records cut by a magic in their payload: their pieces follow them; only these texts are fetched and meet
    start = F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    )
    spots = marks.where("not (real and whole)").withColumn("start", start)
    ends = spots.where("real").select("file", "start", F.col("next").alias("end"))
    spots = spots.join(ends, ["file", "start"]).where("at < end").select(*key, "at", "start")
    spots = materialise(rows.select(*key, "mark", "head", "size", "skip").join(spots, key), "cut-records")
    wanted, _ = bounded(spots.select("mark").distinct())
    texts = _lines(spark, path).select("mark", "text").join(wanted, "mark", "left_semi").dropDuplicates(["mark"])
    pieces = spots.join(texts, "mark").groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("pieces"),
        F.min_by(F.struct("head", "size", "skip"), "at").alias("of"),
    ).select("file", "start", "pieces", F.col("of.head").alias("of_head"), F.col("of.size").alias("of_size"), F.col("of.skip").alias("of_skip"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"].cast("string")), MAGIC).cast("binary")
    cut = pieces.select(
        "file", F.col("start").alias("at"), F.col("of_head").alias("head"), F.col("of_size").alias("size"),
        F.substring(text, F.col("of_skip").cast("int") + 1, F.col("of_size").cast("int")).alias("block"),
    ).where(F.octet_length("block") == F.col("size"))
    cut = cut.withColumn("digest", sha1_base32(F.col("block")))
    return done.unionByName(cut if keep_blocks else cut.withColumn("block", F.lit(None).cast("binary")))


def _header(name: str, pattern: str) -> Column:
    found = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}", 1)
    return F.when(found != "", found)


def archived_pages(spark: SparkSession, path: str, keep_blocks: bool = True) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, block`` (null unless ``keep_blocks``).

    ``payload_digest`` of a response is that of the block read; of a revisit, that its header names.
    """
    rows = read_archives(spark, path, keep_blocks)
    kind = _header("WARC-Type", r"([a-z]+)")
    page = rf"<{SCHEME}(-?[0-9]+)>"
    revisit = F.col("record_type") == "revisit"
    rows = rows.select("head", "block", "digest", "size", kind.alias("record_type"))
    return rows.select(
        _header("WARC-Record-ID", page).cast("long").alias("page_id"),
        F.when(revisit, _header("WARC-Payload-Length", "([0-9]+)").cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, _header("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", F.when(revisit, _header("WARC-Refers-To", page).cast("long")).alias("refers_to"), "block",
    )


def round_trip(pages: DataFrame, records: int = 4096, keep_blocks: bool = True) -> DataFrame:
    """Write ``pages`` to archives below the shared folder and read them back."""
    path = work_path(pages.sparkSession, "archives")
    write_archives(pages, path, records)
    return archived_pages(pages.sparkSession, path, keep_blocks)
