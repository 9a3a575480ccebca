"""Capture files made of the driver's events, for the queries that read captures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethersense import demo
from ethersense.session import work_path

ROWS_PER_FILE = 4000
#: In a damaged folder this record of every file claims a length that no record has.
DAMAGED = 17
_FOLDERS: dict[tuple, str] = {}


def _le32(value: Column) -> Column:
    bits = value.cast("long")
    return F.concat(*[
        F.unhex(F.lpad(F.hex(F.shiftright(bits, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(4)])


def _records(frames: DataFrame, damaged: bool) -> DataFrame:
    """One row per frame with the bytes of its record: even files are pcap, odd ones pcapng."""
    size, us = F.octet_length("frame"), F.col("us")
    bad = F.lit(damaged) & (F.col("packet_index") % ROWS_PER_FILE == DAMAGED)
    pcap = F.concat(
        _le32(F.floor(us / 1_000_000)), _le32(us % 1_000_000), _le32(F.when(bad, 0x7FFFFFFF).otherwise(size)),
        _le32(F.col("original_len")), F.col("frame"),
    )
    pad = F.pmod(-size, F.lit(4))
    total = size + pad + 32
    ng = F.concat(
        _le32(F.lit(6)), _le32(F.when(bad, 13).otherwise(total)), _le32(F.lit(0)), _le32(F.shiftright(us, 32)),
        _le32(us.bitwiseAND(F.lit(0xFFFFFFFF))), _le32(size), _le32(F.col("original_len")), F.col("frame"),
        F.substring(F.lit(b"\0\0\0"), F.lit(1), pad), _le32(total),
    )
    return frames.select("file_no", "packet_index", F.when(F.col("file_no") % 2 == 1, ng).otherwise(pcap).alias("data"))


def write_captures(spark: SparkSession, sf_dir: str, damaged: bool = False) -> str:
    """The byte frames as capture files, written once per application; returns their folder."""
    key = (spark.sparkContext.applicationId, sf_dir, damaged)
    if key in _FOLDERS:
        return _FOLDERS[key]
    folder = work_path(spark, "captures")
    frames = demo.frame_bytes(spark, sf_dir).select(
        F.floor(F.col("packet_index") / ROWS_PER_FILE).alias("file_no"), "packet_index",
        F.coalesce((F.col("timestamp") * 1e6 + 0.5).cast("long"), F.lit(0)).alias("us"), "original_len", "frame",
    )

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        ng = key[0] % 2 == 1
        head = ("0a0d0d0a1c0000004d3c2b1a01000000ffffffffffffffff1c000000" "01000000140000007f0000000000000014000000"
                if ng else "d4c3b2a1020004000000000000000000ffff00007f000000")
        name = f"{folder}/part-{key[0]:08d}.{'pcapng' if ng else 'pcap'}"
        filesystem, inner = fs.FileSystem.from_uri(name)
        filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(inner) as out:
            out.write(bytes.fromhex(head) + b"".join(rows.sort_values("packet_index")["data"]))
        return pd.DataFrame({"path": [name], "packets": [len(rows)]})

    # a file holds a fixed number of rows, so no group can grow
    _records(frames, damaged).groupBy("file_no").applyInPandas(write, "path string, packets long").count()
    _FOLDERS[key] = folder
    return folder


def grow(source: str, target: str, share: float) -> None:
    """Copies the first part of every capture of one folder into another one."""
    from pyarrow import fs

    here, folder = fs.FileSystem.from_uri(source)
    there, inner = fs.FileSystem.from_uri(target)
    there.create_dir(inner, recursive=True)
    for f in here.get_file_info(fs.FileSelector(folder)):
        with here.open_input_file(f.path) as read, there.open_output_stream(f"{inner}/{f.base_name}") as out:
            left = int(f.size * share)
            while left > 0:
                chunk = read.read(min(left, 1 << 20))
                out.write(chunk)
                left -= len(chunk)
