import os
import struct

import pytest
from pyspark.sql import functions as F

from ethersense.schemas import FEATURES
from ethersense.session import work_path
from ethersense.sources import capture, datasets, frames


def beacon(number: int, size: int = 60) -> bytes:
    tap = struct.pack("<BBHIBBHHbB", 0, 0, 18, 0b1000000101110, 0x10, 108, 2412, 0, -48, 32)
    tap += b"\0" * (18 - len(tap))
    head = bytes([0x80, 0x08]) + b"\0\0" + b"\xff" * 6 + bytes([2, 0, 0, 0, 0, number % 256]) * 2
    head += struct.pack("<H", (number % 4096) << 4)
    body = bytes((number * 7 + i) % 256 for i in range(size))
    return tap + head + body + b"FCSX"


def write_pcap(path, packets, order="<", magic=0xA1B2C3D4, unit=10**6):
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 127))
        for i, p in enumerate(packets):
            f.write(struct.pack(order + "IIII", 1000 + i, unit // 2, len(p), len(p) + 5) + p)


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def write_pcapng(path, packets):
    out = b""
    for section, tick in ((0, 6), (1, 9)):  # a second section with nanosecond ticks
        out += block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
        out += block(1, struct.pack("<HHI", 1, 0, 0))
        out += block(1, struct.pack("<HHI", 127, 0, 0) + struct.pack("<HHB3xHH", 9, 1, tick, 0, 0))
        for i, p in enumerate(packets[section::2]):
            ticks = (1000 + i) * 10**tick
            out += block(6, struct.pack("<5I", 1, ticks >> 32, ticks & 0xFFFFFFFF, len(p), len(p))
                         + p)
    with open(path, "wb") as f:
        f.write(out)


@pytest.fixture
def folder(spark):
    path = work_path(spark, "capture-test")
    os.makedirs(f"{path}/sub")
    return path


def test_captures_in_any_split(spark, folder):
    packets = [beacon(i, 40 + i % 50) for i in range(300)]
    write_pcap(f"{folder}/b.pcap", packets)
    write_pcap(f"{folder}/a.PCAP", packets[:50], ">", 0xA1B23C4D, 10**9)
    write_pcapng(f"{folder}/sub/c.pcapng", packets)
    open(f"{folder}/note.txt", "w").write("no capture")
    for size in (97, 1000, 1 << 20):
        out = capture.read_frames(spark, [folder, f"{folder}/missing"], size)
        rows = out.orderBy("file_ordinal", "packet_index").collect()
        by_file = {}
        for r in rows:
            by_file.setdefault(r.source_file.rsplit("/", 1)[1], []).append(r)
        assert [len(v) for v in by_file.values()] == [50, 300, 300]
        assert list(by_file) == ["a.PCAP", "b.pcap", "c.pcapng"]
        assert [bytes(r.frame) for r in by_file["b.pcap"]] == packets
        assert [bytes(r.frame) for r in by_file["c.pcapng"]] == packets[0::2] + packets[1::2]
        assert [r.packet_index for r in by_file["c.pcapng"]] == list(range(300))
        assert by_file["a.PCAP"][3].timestamp == 1003.5
        assert {r.timestamp for r in by_file["c.pcapng"]} == {1000.0 + i for i in range(150)}


def test_misleading_payload_and_cut_file(spark, folder):
    fake = b"".join(struct.pack("<IIII", 5, 5, 20, 20) + b"x" * 20 for _ in range(40))
    packets = [beacon(0) + fake + bytes([i]) for i in range(6)]
    write_pcap(f"{folder}/trap.pcap", packets)
    write_pcap(f"{folder}/cut.pcap", packets)
    os.truncate(f"{folder}/cut.pcap", os.path.getsize(f"{folder}/cut.pcap") - 7)
    for size in (300, 5000):
        out = capture.read_frames(spark, [f"{folder}/trap.pcap", f"{folder}/cut.pcap"], size)
        rows = out.orderBy("file_ordinal", "packet_index").collect()
        assert [bytes(r.frame) for r in rows] == packets + packets[:-1]


def test_decoded_fields_and_bad_frames(spark):
    good = beacon(9)
    rows = [(0, "f", 0, 3600.0, 0, 127, good), (0, "f", 1, None, 500, 127, good[:30]),
            (0, "f", 2, 0.0, 0, 127, b""), (0, "f", 3, 0.0, 0, 105, good[18:]),
            (0, "f", 4, 0.0, 0, 1, good)]
    df = spark.createDataFrame(rows, capture.RAW_SCHEMA)
    out = {r.packet_index: r for r in frames.decode(df).collect()}
    r = out[0]
    assert (r.radiotap_len, r.data_rate, r.channel_frequency, r.ssi, r.rssi) == (
        18, 54.0, 2412, 32.0, -48.0)
    assert (r.frame_type, r.frame_subtype, r.retry, r.protected) == (0, 8, True, False)
    assert r.source_mac == "02:00:00:00:00:09" and r.destination_mac == "ff:ff:ff:ff:ff:ff"
    assert (r.sequence_number, r.payload_len, r.hour) == (9, 60, 1)
    assert r.dot11_frame_len == len(good) - 18 and r.original_len == len(good)
    assert not out[1].parse_ok and out[1].parse_error and out[1].frame_type is None
    assert out[1].radiotap_len == 18 and out[1].original_len == 500
    assert not out[2].parse_ok and out[2].packet_len == 0
    assert out[3].parse_ok and out[3].radiotap_len is None and out[3].payload_len == 64
    assert not out[4].parse_ok


def test_formats_and_drift(spark):
    row = (1704067207.179575, "f'1", 3, 5, 0.0005, -1.5, 2, 0, "aa", None, 10, 11, 12, 13, None,
           True, False)
    df = spark.createDataFrame([row], FEATURES)
    for suffix in ("parquet", "jsonl", "csv"):
        path = work_path(spark, "fmt") + f".{suffix}"
        assert datasets.write_dataset(df, path, FEATURES) == 1
        assert tuple(datasets.read_dataset(spark, path, FEATURES).first()) == row
    line = datasets.arff_rows(df).first()[0]
    assert line == ("1704067207.179575,'f\\'1',3,5,0.0005,-1.5,2,0,'aa',?,10,11,12,13,?,1,0")
    header = datasets.arff_header(df).first()[0].splitlines()
    assert "@ATTRIBUTE timestamp NUMERIC" in header and "@ATTRIBUTE retry NUMERIC" in header
    assert "@ATTRIBUTE channel_frequency STRING" in header
    with pytest.raises(ValueError):
        datasets.write_dataset(df.withColumn("extra", F.lit(1)), work_path(spark, "x"), FEATURES)


def test_float_text(spark):
    values = [0.0, -0.0, 1.5, 1e7, 123456789.125, 1e15, 1e16, 1.5e22, 0.001, 0.00012345678901234567,
              1e-5, 2.5e-7, -1704067207.179575, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(datasets.float_text(F.col("v"))).collect()] == [
        str(v) for v in values]


def test_registry_document(spark):
    from ethersense.operators.labels import mac_targets

    path = work_path(spark, "registry") + ".json"
    with open(path, "w") as f:
        f.write('{"targets": [{"target_id": "p", "mac_addresses": ["AA"], "label": "x"}]}')
    assert mac_targets(datasets.read_registry(spark, path)).first().target_id == "p"


def test_odd_records_lose_nothing(spark, folder):
    """A huge claimed length, an odd sub-second field and unknown block types cost no packet."""
    packets = [beacon(i) for i in range(10)]
    head = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 127)

    def pcap(name, sub, claimed):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(head)
            for i, p in enumerate(packets):
                odd = i == 3
                f.write(struct.pack("<IIII", 1000 + i, sub if odd else i, len(p), claimed if odd else len(p)) + p)

    pcap("claim.pcap", 3, 1 << 30)
    pcap("late.pcap", 5_000_000, 64)
    write_pcapng(f"{folder}/odd.pcapng", packets)
    raw = open(f"{folder}/odd.pcapng", "rb").read()
    strange = struct.pack("<III", 0x80000001, 16, 7) + struct.pack("<I", 16)
    at, ends = 0, []
    while at < len(raw):
        at += struct.unpack_from("<I", raw, at + 4)[0]
        ends.append(at)
    with open(f"{folder}/odd.pcapng", "wb") as f:
        f.write(raw[: ends[5]] + strange + raw[ends[5] :])
    for size in (150, 1 << 20):
        rows = capture.read_frames(spark, [folder], size).groupBy("source_file").count().collect()
        assert [r["count"] for r in rows] == [10, 10, 10]
        assert capture.capture_faults(spark, [folder], size).count() == 0


def test_records_behind_damage_are_read(spark, folder):
    """Damaged lengths, foreign bytes of any size and a cut end: all other records come out, the rest is listed."""
    packets = [beacon(i, 40 + i % 30) for i in range(120)]
    write_pcapng(f"{folder}/bad.pcapng", packets)
    raw = bytearray(open(f"{folder}/bad.pcapng", "rb").read())
    at = 0
    for _ in range(6):
        at += struct.unpack_from("<I", raw, at + 4)[0]
    lost = struct.unpack_from("<I", raw, at + 4)[0]
    raw[at + 4 : at + 8] = struct.pack("<I", 13)
    open(f"{folder}/bad.pcapng", "wb").write(raw)
    write_pcap(f"{folder}/holes.pcap", packets)
    raw = open(f"{folder}/holes.pcap", "rb").read()
    starts = [24]
    for p in packets:
        starts.append(starts[-1] + 16 + len(p))
    junk = b"\xff" * 3001
    broken = bytearray(raw)
    broken[starts[60] + 8 : starts[60] + 12] = b"\xff\xff\xff\x7f"  # one length
    holes = bytes(broken[: starts[30]]) + junk + bytes(broken[starts[30] :])
    open(f"{folder}/holes.pcap", "wb").write(holes[:-9])
    open(f"{folder}/text.pcap", "wb").write(b"no capture at all, just some text in it")
    want = {
        ("bad.pcapng", at, lost, "damaged record"),
        ("holes.pcap", starts[30], len(junk), "damaged record"),
        ("holes.pcap", starts[60] + len(junk), 16 + len(packets[60]), "damaged record"),
        ("holes.pcap", starts[119] + len(junk), 16 + len(packets[119]) - 9, "damaged or cut off to the end"),
        ("text.pcap", 0, 39, "not a capture"),
    }
    for size in (97, 150, 1000, 1 << 20):
        found = capture.capture_faults(spark, [folder], size).collect()
        assert {(r["source_file"].rsplit("/", 1)[1], r["offset"], r["skipped"], r["reason"]) for r in found} == want and len(found) == 5
        rows = capture.read_frames(spark, [folder], size, strict=False).orderBy("file_ordinal", "packet_index").collect()
        by_file = {}
        for r in rows:
            by_file.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(r)
        kept = packets[:60] + packets[61:119]
        assert [bytes(r["frame"]) for r in by_file["holes.pcap"]] == kept
        assert [r["packet_index"] for r in by_file["holes.pcap"]] == list(range(len(kept)))
        ng = packets[0::2] + packets[1::2]
        assert [bytes(r["frame"]) for r in by_file["bad.pcapng"]] == ng[:3] + ng[4:]
        assert {r["linktype"] for r in rows} == {127}
    with pytest.raises(ValueError, match="text.pcap"):
        capture.read_frames(spark, [folder])


def test_order_needs_file_ordinal(spark):
    from ethersense.operators.position import ensure_position

    rows = spark.createDataFrame([("a", 0), ("b", 0)], "source_file string, packet_index long")
    with pytest.raises(ValueError, match="file_ordinal"):
        ensure_position(rows)
