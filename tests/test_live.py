"""Growing captures as a stream, against reading the finished files at once."""

import os
import struct

from ethersense.session import work_path
from ethersense.sources import capture, live
from tests.test_sources import beacon, write_pcap, write_pcapng


def drain(spark, folder, sink, **options):
    """One run over everything that is complete by now."""
    query = live.capture_stream(spark, folder, f"{sink}-cursors", **options).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", f"{sink}-checkpoint").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.schema(capture.RAW_SCHEMA).parquet(sink)


def rows_of(df):
    rows = df.collect()
    return sorted((r["file_ordinal"], r["packet_index"], r["timestamp"], r["original_len"], r["linktype"], bytes(r["frame"])) for r in rows)


def test_half_a_record_waits(spark):
    folder, sink = work_path(spark, "grow"), work_path(spark, "grown")
    os.makedirs(folder)
    packets = [beacon(i, 40 + i % 30) for i in range(60)]
    write_pcap(f"{folder}/a.pcap", packets)
    write_pcapng(f"{folder}/b.pcapng", packets)
    whole = {name: open(f"{folder}/{name}", "rb").read() for name in ("a.pcap", "b.pcapng")}
    # the pcapng file is known by its first bytes, so the stream sees it first
    want = rows_of(capture.read_frames(spark, [f"{folder}/b.pcapng", f"{folder}/a.pcap"]))
    for name in whole:
        os.remove(f"{folder}/{name}")
    counts = []
    for share in (0.0001, 0.3, 0.31, 0.8, 1.0):  # cuts fall inside records
        for name, data in whole.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.write(data[: max(10, int(share * len(data)))])
        counts.append(drain(spark, folder, sink, split_bytes=700).count())
    got = rows_of(spark.read.schema(capture.RAW_SCHEMA).parquet(sink))
    assert got == want and counts == sorted(counts) and counts[0] == 0 < counts[1] < counts[3] < counts[4] == len(want)


def test_damage_in_a_growing_file(spark):
    folder, sink = work_path(spark, "grow"), work_path(spark, "grown")
    os.makedirs(folder)
    packets = [beacon(i) for i in range(60)]
    write_pcap(f"{folder}/a.pcap", packets)
    raw = bytearray(open(f"{folder}/a.pcap", "rb").read())
    at = 24 + sum(16 + len(p) for p in packets[:20])
    raw[at + 8 : at + 12] = b"\xff\xff\xff\x7f"
    for size in (at + 100, at + 400, len(raw)):
        with open(f"{folder}/a.pcap", "wb") as f:
            f.write(raw[:size])
        got = drain(spark, folder, sink)
    assert [bytes(r["frame"]) for r in got.orderBy("packet_index").collect()] == packets[:20] + packets[21:]


def test_follow_keeps_interfaces(tmp_path):
    packets = [beacon(i) for i in range(10)]
    write_pcapng(f"{tmp_path}/x.pcapng", packets)
    data = open(f"{tmp_path}/x.pcapng", "rb").read()
    state, pieces, at = None, [], 0
    while at < len(data):
        at = min(len(data), at + 37)
        open(f"{tmp_path}/y.pcapng", "wb").write(data[:at])
        state, more = live.follow(f"{tmp_path}/y.pcapng", 3, state, at, 100)
        pieces += more
    assert state["at"] == len(data) and state["packets"] == 10
    reader = live.CaptureStreamReader({"path": str(tmp_path), "cursors": f"{tmp_path}/cursors"})
    rows = [row for p in pieces for batch in reader.read(p) for row in batch.to_pylist()]
    assert [r["packet_index"] for r in rows] == list(range(10)) and {r["linktype"] for r in rows} == {127}
    assert [r["frame"] for r in rows] == packets[0::2] + packets[1::2]
    assert {r["timestamp"] for r in rows} == {1000.0 + i for i in range(5)}
    assert struct.unpack("<I", data[:4])[0] == capture.NG_SECTION
