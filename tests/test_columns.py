from pyspark.sql import functions as F

from ethersense.functions import columns as fn
from ethersense.functions.columns import FeatureSettings
from ethersense.operators import filters as flt
from ethersense.operators import labels as lab
from ethersense.operators.filters import FilterSettings
from ethersense.operators.labels import LabelSettings

MACS = "to_ds boolean, from_ds boolean, addr1 string, addr2 string, addr3 string, addr4 string"


def test_address_roles(spark):
    rows = [(t, f, "AA", "bb", "cc", "dd") for t in (False, True) for f in (False, True)]
    df = spark.createDataFrame(rows, MACS)
    a = {i: fn.normalize_mac(F.col(f"addr{i}")) for i in (1, 2, 3, 4)}
    out = df.select(
        "to_ds", "from_ds",
        fn.logical_source(F.col("to_ds"), F.col("from_ds"), a[2], a[3], a[4]).alias("s"),
        fn.logical_destination(F.col("to_ds"), F.col("from_ds"), a[1], a[3]).alias("d"),
    ).collect()
    assert {(r[0], r[1]): (r.s, r.d) for r in out} == {
        (False, False): ("bb", "aa"), (True, False): ("bb", "cc"),
        (False, True): ("cc", "aa"), (True, True): ("dd", "cc"),
    }


def test_mac_normalisation(spark):
    df = spark.createDataFrame(
        [(" AA:BB\t",), ("None",), ("00:00:00:00:00:00",), ("",), (None,)], "m string")
    assert [r[0] for r in df.select(fn.normalize_mac(F.col("m"))).collect()] == [
        "aa:bb", None, None, None, None]


def test_feature_row_falls_back(spark):
    schema = ("timestamp double, source_file string, packet_index long, packet_len int, "
              "dot11_frame_len int, capture_len int, payload_len int, rssi double, "
              "source_mac string, destination_mac string")
    df = spark.createDataFrame(
        [(1.0, "x.pcap", 7, 128, None, 120, 42, -55.0, "aa", "bb")], schema)
    row = fn.feature_rows(df).first()
    assert row.data_size == 120 and row.ssi == -55.0 and row.total_packet_len == 128
    assert row.frame_type is None and row.hour is None


def test_model_features_have_no_macs_by_default(spark):
    assert fn.model_feature_names() == list(fn.MODEL_FEATURES)
    hashed = fn.model_feature_names(FeatureSettings(leakage_debug=True))
    assert hashed[-2:] == ["source_mac_hash", "destination_mac_hash"]
    df = spark.createDataFrame([(5, None, "AA:BB")], "hour int, ssi double, source_mac string")
    plain = df.select(fn.features_struct(df).alias("f")).select("f.*").first().asDict()
    assert sorted(plain) == sorted(fn.MODEL_FEATURES)
    assert plain["hour"] == 5.0 and plain["ssi"] == -1.0 and plain["frame_type"] == "missing"


def test_time_bucket_is_exact(spark):
    values = [(-1.5, 30.0), (29.999, 30.0), (30.0, 30.0), (1.0, 0.1), (0.3, 0.1),
              (1704067199.9999998, 86400.0), (1704067199.9999998, 30.0)]
    for ts, width in values:
        df = spark.createDataFrame([(ts,)], "t double")
        assert df.select(fn.time_bucket(F.col("t"), width)).first()[0] == int(ts // width)


def test_target_probability_fallbacks(spark):
    df = spark.createDataFrame(
        [('{"t": 0.25}', "o", 0.9), ('{"t": "x"}', "t", 0.9), ('{"t":', "t", 0.7), (None, "t", 0.0),
         (None, "t", None), ("", "o", 0.4), ('{"o": 1}', None, 0.4)],
        "j string, c string, p double")
    got = df.select(fn.target_probability(
        fn.parse_probabilities(F.col("j")), F.col("c"), F.col("p"), F.lit("t"))).collect()
    assert [r[0] for r in got] == [0.25, 0.9, 0.7, 1.0, 1.0, 0.0, 0.0]


def test_ap_rule_and_missing_columns(spark):
    df = spark.createDataFrame([(True, False, 2), (True, True, 2), (None, None, 2)],
                               "from_ds boolean, to_ds boolean, frame_type int")
    settings = FilterSettings(include_ap_originated=False)
    assert flt.apply_filters(df, settings).count() == 2
    assert flt.apply_filters(df.drop("from_ds", "to_ds"), settings).count() == 3


def test_null_rules_of_filters(spark):
    df = spark.createDataFrame([(None, None, None, None), (2412, 5.0, -50.0, 100)],
                               "channel_frequency int, timestamp double, rssi double, data_size int")
    def kept(**kw):
        return flt.apply_filters(df, FilterSettings(**kw)).count()
    assert kept(channel_frequency=2412) == 1
    assert kept(start_time=6.0) == 1 and kept(rssi_min=-40.0) == 1 and kept(min_frame_size=101) == 1
    assert kept(start_time=5.0, end_time=5.0, rssi_max=-50.0, min_frame_size=100) == 2
    assert kept(known_targets_only=True) == 0


def test_registry_and_labels(spark):
    registry = lab.registry_frame(spark, [
        {"target_id": "phone", "mac_addresses": ["AA:00", " bb:00 ", None, "00:00:00:00:00:00"]},
        {"target_id": "tv", "mac_addresses": ["bb:00"]},
        {"target_id": "off", "mac_addresses": ["aa:00"], "enabled": False},
    ])
    macs = lab.broadcastable_targets(registry)
    assert {r.mac: r.target_id for r in macs.collect()} == {"aa:00": "phone", "bb:00": "tv"}
    rows = spark.createDataFrame([("Aa:00",), ("cc",), (None,)], "source_mac string")
    def labels(**kw):
        out = lab.assign_labels(rows, macs, LabelSettings(**kw)).collect()
        return sorted((r.source_mac or "", r.label, r.source_target_id) for r in out)
    assert labels() == [("", "other", None), ("Aa:00", "target", "phone"), ("cc", "other", None)]
    assert labels(mode="multiclass_known_targets_only") == [("Aa:00", "phone", "phone")]
    assert labels(mode="per_target_binary", target_id="tv")[1][1] == "other"
    for bad in (dict(mode="per_target_binary"), dict(mode="nonsense")):
        try:
            labels(**bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_target_resolution(spark):
    registry = lab.registry_frame(spark, [
        {"target_id": "b", "mac_addresses": []}, {"target_id": "a", "mac_addresses": []},
        {"target_id": "c", "mac_addresses": [], "enabled": False}])
    multi = LabelSettings(mode="multiclass_with_other")
    assert lab.resolve_targets(multi, registry, explicit=["x", "x", "y"]) == ["x", "y"]
    assert lab.resolve_targets(multi, registry, all_targets=True) == ["a", "b"]
    assert lab.resolve_targets(multi, registry, configured=["q"]) == ["q"]
    assert lab.resolve_targets(multi, registry, configured=["q"], all_targets=False) == ["target"]
    assert lab.resolve_targets(LabelSettings(), registry) == ["target"]
    for settings in (LabelSettings(), multi):
        try:
            lab.resolve_targets(settings, None, all_targets=True)
            raise AssertionError("no error")
        except ValueError:
            pass
