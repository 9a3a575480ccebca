"""Frame bytes to packet records.

The byte offsets depend on each frame's own header, so they are worked out with numpy on whole Arrow
batches; every rule about the decoded fields is a Column expression afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.functions import columns as fn
from ethersense.schemas import RECORDS, conform

# Radiotap fields up to the ones used, as (bit, size, alignment).
RADIOTAP_FIELDS = [
    (0, 8, 8), (1, 1, 1), (2, 1, 1), (3, 4, 2), (4, 2, 1), (5, 1, 1), (6, 1, 1), (7, 2, 2),
    (8, 2, 2), (9, 2, 2), (10, 1, 1), (11, 1, 1), (12, 1, 1),
]
BIT_FLAGS, BIT_RATE, BIT_CHANNEL, BIT_DBM, BIT_DB = 1, 2, 3, 5, 12
FLAG_FCS = 0x10
LINK_RADIOTAP, LINK_DOT11 = 127, 105
RATE_UNIT = 0.5
ONE_ADDRESS_CONTROL = (12, 13)
NO_LAYER = "packet has no 802.11 Dot11 layer"

DECODED = (
    "file_ordinal int, source_file string, packet_index long, timestamp double, original_len int, "
    "packet_len int, radiotap_len int, data_rate double, channel_frequency int, ssi double, "
    "rssi double, frame_type int, frame_subtype int, fc int, sc int, a1 string, a2 string, "
    "a3 string, a4 string, payload_len int, parse_ok boolean"
)
_PASSED = ["file_ordinal", "source_file", "packet_index", "timestamp", "original_len"]


class _Bytes:
    """Bounds-checked gathers from the frames of one batch."""

    def __init__(self, frames: pa.BinaryArray) -> None:
        offsets = np.frombuffer(frames.buffers()[1], dtype=np.int32)
        offsets = offsets[frames.offset: frames.offset + len(frames) + 1].astype(np.int64)
        self.start, self.end = offsets[:-1], offsets[1:]
        data = frames.buffers()[2]
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
            np.zeros(1, np.uint8)

    def fits(self, at: np.ndarray, size: int) -> np.ndarray:
        return (at >= self.start) & (at + size <= self.end)

    def u8(self, at: np.ndarray) -> np.ndarray:
        return self.data[np.clip(at, 0, len(self.data) - 1)].astype(np.int64)

    def u16(self, at: np.ndarray) -> np.ndarray:
        return self.u8(at) | self.u8(at + 1) << 8

    def u32(self, at: np.ndarray) -> np.ndarray:
        return self.u16(at) | self.u16(at + 2) << 16


def _radiotap(b: _Bytes, is_tap: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Header length, validity, and the absolute offset of each used field (-1 when absent)."""
    length = b.u16(b.start + 2)
    valid = is_tap & b.fits(b.start, 8) & (length >= 8) & b.fits(b.start, 1) & (
        b.start + length <= b.end)
    present = b.u32(b.start + 4)
    words = np.ones(len(length), np.int64)
    more = valid & (present >> 31 & 1 == 1)
    while more.any():
        word = b.u32(b.start + 4 + 4 * words)
        inside = more & (8 + 4 * words <= length)
        words = words + inside
        more = inside & (word >> 31 & 1 == 1)
    offsets = {bit: np.full(len(length), -1, np.int64)
               for bit in (BIT_FLAGS, BIT_RATE, BIT_CHANNEL, BIT_DBM, BIT_DB)}
    # captures use a handful of layouts, so each distinct one is walked once per batch
    layouts = np.stack([present & 0x1FFF, words])
    for bits, count in np.unique(layouts[:, valid], axis=1).T:
        rows = valid & (layouts[0] == bits) & (layouts[1] == count)
        at = 4 + 4 * int(count)
        for bit, size, align in RADIOTAP_FIELDS:
            if not bits >> bit & 1:
                continue
            at = (at + align - 1) // align * align
            if bit in offsets:
                inside = rows & (at + size <= length)
                offsets[bit][inside] = b.start[inside] + at
            at += size
    return length, valid, offsets


_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _addresses(b: _Bytes, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Six bytes per row as lower-case colon-separated text; the all-zero address is null."""
    raw = b.data[np.clip(at[:, None] + np.arange(6), 0, len(b.data) - 1)]
    text = np.full((len(at), 17), ord(":"), np.uint8)
    text[:, 0::3] = _DIGITS[raw >> 4]
    text[:, 1::3] = _DIGITS[raw & 15]
    bitmap = np.packbits(valid & raw.any(axis=1), bitorder="little")
    ends = np.arange(len(at) + 1, dtype=np.int32) * 17
    return pa.Array.from_buffers(
        pa.string(), len(at),
        [pa.py_buffer(bitmap.tobytes()), pa.py_buffer(ends.tobytes()),
         pa.py_buffer(text.tobytes())],
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        frames = batch.column("frame").cast(pa.binary()).fill_null(b"")
        link = batch.column("linktype").to_numpy(zero_copy_only=False)
        b = _Bytes(frames)
        tap_len, tap, at = _radiotap(b, link == LINK_RADIOTAP)
        head = np.where(tap, b.start + tap_len, b.start)
        usable = (tap | (link == LINK_DOT11)) & b.fits(head, 2)
        kind = b.u8(head) >> 2 & 3
        sub = b.u8(head) >> 4
        fc = b.u8(head + 1)
        full = (kind == 0) | (kind == 2)
        two = full | ((kind == 1) & ~np.isin(sub, ONE_ADDRESS_CONTROL))
        four = (kind == 2) & (fc & 3 == 3)
        size = np.select([four, full, two], [30, 24, 16], 10)
        ok = usable & (head + size <= b.end)
        flags = np.where(at[BIT_FLAGS] >= 0, b.u8(at[BIT_FLAGS]), 0)
        trailer = np.where(flags & FLAG_FCS, 4, 0)

        def ints(values: np.ndarray, valid: np.ndarray) -> pa.Array:
            return pa.array(values.astype(np.int32), mask=~valid)

        def reals(values: np.ndarray, valid: np.ndarray) -> pa.Array:
            return pa.array(values.astype(np.float64), mask=~valid)

        dbm = b.u8(at[BIT_DBM])
        columns = [batch.column(c) for c in _PASSED] + [
            ints(b.end - b.start, np.ones(len(head), bool)),
            ints(tap_len, tap),
            reals(b.u8(at[BIT_RATE]) * RATE_UNIT, at[BIT_RATE] >= 0),
            ints(b.u16(at[BIT_CHANNEL]), at[BIT_CHANNEL] >= 0),
            reals(b.u8(at[BIT_DB]), at[BIT_DB] >= 0),
            reals(np.where(dbm > 127, dbm - 256, dbm), at[BIT_DBM] >= 0),
            ints(kind, ok), ints(sub, ok), ints(fc, ok),
            ints(b.u16(head + 22), ok & full),
            _addresses(b, head + 4, ok), _addresses(b, head + 10, ok & two),
            _addresses(b, head + 16, ok & full), _addresses(b, head + 24, ok & four),
            ints(np.maximum(b.end - head - size - trailer, 0), ok),
            pa.array(ok),
        ]
        names = [part.split(" ")[0] for part in DECODED.split(", ")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def decode(raw: DataFrame) -> DataFrame:
    """Raw frames to packet records; a frame that cannot be parsed stays, with its error."""
    wanted = raw.select(*_PASSED, "linktype", "frame")
    d = wanted.mapInArrow(_decode, DECODED)
    ok = F.col("parse_ok")
    macs = {i: F.col(f"a{i}") for i in (1, 2, 3, 4)}
    to_ds, from_ds = fn.flag(F.col("fc"), fn.FLAG_TO_DS), fn.flag(F.col("fc"), fn.FLAG_FROM_DS)

    def header(value: Column) -> Column:
        return F.when(ok, value)

    out = d.select(
        "file_ordinal", "timestamp", "source_file", "packet_index", "packet_len",
        F.col("packet_len").alias("capture_len"),
        F.coalesce(fn.non_zero(F.col("original_len")), F.col("packet_len")).alias("original_len"),
        "radiotap_len",
        header(fn.dot11_frame_len(F.col("packet_len"), F.col("radiotap_len")))
        .alias("dot11_frame_len"),
        "payload_len",
        fn.hour_of_day(F.col("timestamp")).alias("hour"),
        "data_rate", "channel_frequency", "ssi", "rssi", "frame_type", "frame_subtype",
        header(to_ds).alias("to_ds"), header(from_ds).alias("from_ds"),
        *[c.alias(f"addr{i}") for i, c in macs.items()],
        header(fn.logical_source(to_ds, from_ds, macs[2], macs[3], macs[4])).alias("source_mac"),
        header(fn.logical_destination(to_ds, from_ds, macs[1], macs[3])).alias("destination_mac"),
        fn.sequence_number(F.col("sc")).alias("sequence_number"),
        header(fn.flag(F.col("fc"), fn.FLAG_RETRY)).alias("retry"),
        header(fn.flag(F.col("fc"), fn.FLAG_PROTECTED)).alias("protected"),
        "parse_ok",
        F.when(~ok, F.lit(NO_LAYER)).alias("parse_error"),
    )
    return conform(out, RECORDS)
