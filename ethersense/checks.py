"""Registered queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethersense import demo
from ethersense.functions import columns as fn
from ethersense.functions.columns import FeatureSettings
from ethersense.operators import calibrate as cal
from ethersense.operators import evaluate as ev
from ethersense.operators import filters as flt
from ethersense.operators import inspect as ins
from ethersense.operators import labels as lab
from ethersense.operators import learn, ranking, sampling, trees
from ethersense.operators import windows as win
from ethersense.operators.filters import FilterSettings
from ethersense.operators.labels import LabelSettings
from ethersense.operators.position import add_position
from ethersense.plans import jobs
from ethersense.schemas import FEATURES, PREDICTIONS, RECORDS
from ethersense.session import materialise, work_path
from ethersense.sources import capture, datasets, frames, live
from ethersense.streaming import presence as stream
from ethersense.streaming import windows as flushing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


RAW, REC, FEAT, LABELLED = (
    "WITH " + demo.DUCK_RAW, "WITH " + demo.DUCK_RECORDS, "WITH " + demo.DUCK_FEATURES,
    "WITH " + demo.DUCK_LABELLED,
)
BIN, MULTI = "WITH " + demo.DUCK_BINARY, "WITH " + demo.DUCK_MULTI
TARGETS = ["t_a", "t_b"]

# --- scalar functions ------------------------------------------------------------------------


@query("normalize_mac", RAW + """
SELECT packet_index, nullif(lower(trim(' ' || device || ' ')), '00:00:00:00:00:00') AS device_mac,
       nullif(lower(trim(peer)), '00:00:00:00:00:00') AS peer_mac FROM frames""")
def _(spark, sf):
    return demo.raw_frames(spark, sf).select(
        "packet_index",
        fn.normalize_mac(F.concat(F.lit(" "), "device", F.lit(" "))).alias("device_mac"),
        fn.normalize_mac(F.col("peer")).alias("peer_mac"),
    )


@query("logical_addresses", REC + """
SELECT packet_index,
       CASE WHEN fc & 2 <> 0 THEN CASE WHEN fc & 1 <> 0 THEN n4 ELSE n3 END ELSE n2 END
         AS source_mac,
       CASE WHEN fc & 1 <> 0 THEN n3 ELSE n1 END AS destination_mac FROM norm""")
def _(spark, sf):
    a = {i: fn.normalize_mac(F.col(f"addr{i}")) for i in (1, 2, 3, 4)}
    to_ds, from_ds = fn.flag(F.col("fc"), fn.FLAG_TO_DS), fn.flag(F.col("fc"), fn.FLAG_FROM_DS)
    return demo.raw_frames(spark, sf).select(
        "packet_index",
        fn.logical_source(to_ds, from_ds, a[2], a[3], a[4]).alias("source_mac"),
        fn.logical_destination(to_ds, from_ds, a[1], a[3]).alias("destination_mac"),
    )


@query("frame_family", RAW + """
SELECT packet_index,
       CASE frame_type WHEN 0 THEN 'management' WHEN 1 THEN 'control' WHEN 2 THEN 'data' END
         AS family,
       CASE k % 6 WHEN 0 THEN 'management' WHEN 1 THEN 'control' WHEN 2 THEN 'data'
                  WHEN 3 THEN 'extension' ELSE 'unknown' END AS code_family FROM frames""")
def _(spark, sf):
    return demo.raw_frames(spark, sf).select(
        "packet_index",
        fn.frame_family(F.col("frame_type")).alias("family"),
        fn.frame_family(F.col("k") % 6).alias("code_family"),
    )


@query("fc_flags", RAW + """
SELECT packet_index, fc & 1 <> 0 AS to_ds, fc & 2 <> 0 AS from_ds, fc & 8 <> 0 AS retry,
       fc & 64 <> 0 AS protected, sc >> 4 AS sequence_number FROM frames""")
def _(spark, sf):
    fc = F.col("fc")
    return demo.raw_frames(spark, sf).select(
        "packet_index",
        fn.flag(fc, fn.FLAG_TO_DS).alias("to_ds"),
        fn.flag(fc, fn.FLAG_FROM_DS).alias("from_ds"),
        fn.flag(fc, fn.FLAG_RETRY).alias("retry"),
        fn.flag(fc, fn.FLAG_PROTECTED).alias("protected"),
        fn.sequence_number(F.col("sc")).alias("sequence_number"),
    )


@query("frame_lengths", REC + """
SELECT packet_index, packet_len, capture_len, original_len, dot11_frame_len, payload_len
FROM records""")
def _(spark, sf):
    return demo.make_records(spark, sf).select(
        "packet_index", "packet_len", "capture_len", "original_len", "dot11_frame_len",
        "payload_len",
    )


@query("hour_of_day", REC + " SELECT packet_index, hour FROM records")
def _(spark, sf):
    return demo.make_records(spark, sf).select("packet_index", "hour")


@query("data_size_modes", REC + """
SELECT packet_index, coalesce(dot11_frame_len, capture_len, packet_len) AS by_frame,
       coalesce(payload_len, dot11_frame_len, capture_len, packet_len) AS by_payload,
       coalesce(packet_len, capture_len) AS by_packet, coalesce(capture_len, packet_len)
         AS by_capture,
       coalesce(radiotap_len, dot11_frame_len) AS by_other FROM records""")
def _(spark, sf):
    df = demo.make_records(spark, sf)
    modes = {"by_frame": "dot11_frame_len", "by_payload": "payload_len",
             "by_packet": "packet_len", "by_capture": "capture_len", "by_other": "radiotap_len"}
    return df.select(
        "packet_index", *[fn.data_size(df, mode).alias(name) for name, mode in modes.items()]
    )


FEATURE_LIST = (
    "timestamp, source_file, packet_index, hour, data_rate, ssi, frame_type, frame_subtype, "
    "source_mac, destination_mac, data_size, total_packet_len, dot11_frame_len, payload_len, "
    "channel_frequency, retry, protected"
)


@query("feature_rows", FEAT + f" SELECT {FEATURE_LIST} FROM feats")
def _(spark, sf):
    return demo.features(spark, sf).select(*FEATURE_LIST.split(", "))


@query("model_features", FEAT + """
SELECT packet_index,
       coalesce(hour, -1.0)::DOUBLE AS hour, (hour IS NULL)::INT AS hour__missing,
       coalesce(data_rate, -1.0)::DOUBLE AS data_rate,
       (data_rate IS NULL)::INT AS data_rate__missing,
       coalesce(ssi, -1.0)::DOUBLE AS ssi, (ssi IS NULL)::INT AS ssi__missing,
       coalesce(frame_type::VARCHAR, 'missing') AS frame_type,
       (frame_type IS NULL)::INT AS frame_type__missing,
       coalesce(frame_subtype::VARCHAR, 'missing') AS frame_subtype,
       (frame_subtype IS NULL)::INT AS frame_subtype__missing,
       coalesce(data_size, -1.0)::DOUBLE AS data_size,
       (data_size IS NULL)::INT AS data_size__missing FROM feats""")
def _(spark, sf):
    df = demo.features(spark, sf)
    parts = fn.model_feature_columns(df, FeatureSettings(missing_indicators=True))
    return df.select("packet_index", *[c.alias(name) for name, c in parts.items()])


@query("mac_hash", FEAT + """
SELECT packet_index,
       coalesce(substr(sha256(lower(source_mac)), 1, 16), 'missing') AS source_mac_hash,
       coalesce(substr(sha256(lower(destination_mac)), 1, 16), 'missing') AS destination_mac_hash
FROM feats""")
def _(spark, sf):
    df = demo.features(spark, sf)
    parts = fn.model_feature_columns(df, FeatureSettings(leakage_debug=True))
    return df.select("packet_index", *[
        parts[n].alias(n) for n in ("source_mac_hash", "destination_mac_hash")])


@query("prediction_json", REC + """,
p AS (SELECT *, round((CASE WHEN user_id < 10 THEN 40 ELSE 0 END + 0.6::DOUBLE * k)
                      / 100.0::DOUBLE, 4) AS p,
             coalesce(dot11_frame_len, capture_len, packet_len) AS data_size,
             coalesce(ssi, rssi) AS signal
      FROM records WHERE parse_ok)
SELECT packet_index,
       '{"data_rate":' || coalesce(data_rate, -1.0)::DOUBLE || ',"data_size":'
         || coalesce(data_size, -1)::DOUBLE || ',"frame_subtype":"' ||
         coalesce(frame_subtype::VARCHAR, 'missing') || '","frame_type":"' ||
         coalesce(frame_type::VARCHAR, 'missing') || '","hour":' || coalesce(hour, -1)::DOUBLE ||
         ',"ssi":' || coalesce(signal, -1.0)::DOUBLE || '}' AS features_json,
       '{"other":' || round(1 - p, 4) || ',"target":' || p || '}' AS probabilities_json
FROM p""")
def _(spark, sf):
    scored = demo._scored(spark, sf)
    df = fn.feature_rows(scored.withColumn("frame_pos", F.col("p")))  # p rides along
    return df.select(
        "packet_index",
        F.to_json(fn.features_struct(df)).alias("features_json"),
        fn.map_json(F.create_map(
            F.lit("target"), F.col("frame_pos"), F.lit("other"),
            F.round(1 - F.col("frame_pos"), 4),
        )).alias("probabilities_json"),
    )


@query("target_probability", BIN + " SELECT packet_index, prob AS p FROM target_rows")
def _(spark, sf):
    preds = demo.binary_predictions(spark, sf)
    return win.per_target(preds, ["target"], keep=["packet_index"]).select("packet_index", "p")


@query("resolve_prediction", BIN + """,
r AS (SELECT *, packet_index % 7 = 0 AS bare,
             CASE WHEN packet_index % 5 <> 0 THEN predicted_class END AS given FROM preds)
SELECT packet_index,
       coalesce(given, CASE WHEN bare THEN '__none__'
                            WHEN score > round(1 - score, 4) THEN 'target' ELSE 'other' END)
         AS predicted_class,
       CASE WHEN bare THEN NULL
            WHEN given = 'target' THEN score WHEN given = 'other' THEN round(1 - score, 4)
            ELSE greatest(score, round(1 - score, 4)) END AS confidence FROM r""")
def _(spark, sf):
    preds = demo.binary_predictions(spark, sf)
    eid = F.col("packet_index")
    full = F.create_map(
        F.lit("target"), F.col("score"), F.lit("other"), F.round(1 - F.col("score"), 4))
    probs = F.when(eid % 7 == 0, F.lit(None).cast("map<string,double>")).otherwise(full)
    given = F.when(eid % 5 != 0, F.col("predicted_class"))
    df = preds.select("packet_index", probs.alias("m"), given.alias("g"))
    resolved = fn.resolve_prediction(F.col("g"), F.col("m"))
    return df.select(
        "packet_index", resolved.alias("predicted_class"),
        fn.resolve_confidence(resolved, F.col("m")).alias("confidence"),
    )


# --- filters ---------------------------------------------------------------------------------


@query("parse_ok_filter", REC + " SELECT packet_index FROM records WHERE parse_ok")
def _(spark, sf):
    return flt.parse_ok(demo.records(spark, sf)).select("packet_index")


@query("known_targets", LABELLED + """
SELECT packet_index FROM looked WHERE source_target_id IS NOT NULL""")
def _(spark, sf):
    return flt.known_targets(demo.features(spark, sf), demo.targets(spark)).select("packet_index")


@query("family_filter", FEAT + """
SELECT packet_index FROM feats WHERE frame_type IS NULL OR frame_type NOT IN (0, 1)""")
def _(spark, sf):
    df = demo.features(spark, sf)
    settings = FilterSettings(include_management=False, include_control=False)
    return df.where(flt.family_allowed(df, settings)).select("packet_index")


AP_SQL = "(coalesce(source_mac = '02:00:00:00:00:0e', false) OR (from_ds AND NOT to_ds))"


@query("ap_filter", FEAT + f" SELECT packet_index FROM feats WHERE NOT {AP_SQL}")
def _(spark, sf):
    df = demo.features(spark, sf)
    return df.where(~flt.ap_originated(df, demo.AP_MACS)).select("packet_index")


@query("channel_filter", FEAT + " SELECT packet_index FROM feats WHERE channel_frequency = 2437")
def _(spark, sf):
    df = demo.features(spark, sf)
    return df.where(flt.on_channel(df, 2437)).select("packet_index")


START, END = "2024-01-05T00:00:00", 1704844800.0


@query("time_filter", FEAT + """
SELECT packet_index FROM feats
WHERE timestamp IS NULL OR timestamp BETWEEN 1704412800.0 AND 1704844800.0""")
def _(spark, sf):
    df = demo.features(spark, sf)
    return df.where(flt.in_time_range(df, START, END)).select("packet_index")


@query("signal_filter", REC + """
SELECT packet_index FROM records
WHERE coalesce(rssi, ssi) IS NULL OR coalesce(rssi, ssi) BETWEEN -90 AND -40""")
def _(spark, sf):
    df = demo.records(spark, sf)
    return df.where(flt.in_signal_range(df, -90, -40)).select("packet_index")


@query("size_filter", REC + """
SELECT packet_index FROM records
WHERE coalesce(nullif(dot11_frame_len, 0), packet_len) IS NULL
   OR coalesce(nullif(dot11_frame_len, 0), packet_len) >= 70""")
def _(spark, sf):
    df = demo.records(spark, sf)
    return df.where(flt.large_enough(df, 70)).select("packet_index")


@query("frame_filter", LABELLED + f"""
SELECT packet_index FROM looked
WHERE source_target_id IS NOT NULL AND (frame_type IS NULL OR frame_type <> 1) AND NOT {AP_SQL}
  AND channel_frequency = 2437
  AND (timestamp IS NULL OR timestamp BETWEEN 1704412800.0 AND 1706400000.0)
  AND (ssi IS NULL OR ssi BETWEEN -100 AND 60)
  AND (coalesce(nullif(data_size, 0), dot11_frame_len) IS NULL
       OR coalesce(nullif(data_size, 0), dot11_frame_len) >= 45)""")
def _(spark, sf):
    settings = FilterSettings(
        known_targets_only=True, include_control=False, include_ap_originated=False,
        ap_macs=demo.AP_MACS, channel_frequency=2437, start_time=START, end_time=1706400000.0,
        rssi_min=-100, rssi_max=60, min_frame_size=45,
    )
    return flt.apply_filters(demo.features(spark, sf), settings, demo.targets(spark)).select(
        "packet_index")


@query("max_packets", REC + """
SELECT packet_index, frame_pos FROM
  (SELECT packet_index, row_number() OVER (ORDER BY packet_index) - 1 AS frame_pos
   FROM records WHERE parse_ok) WHERE frame_pos < 500""")
def _(spark, sf):
    rows = add_position(flt.parse_ok(demo.records(spark, sf)), below=500)
    return flt.first_rows(rows, 500).select("packet_index", "frame_pos")


# --- registry, labels ------------------------------------------------------------------------

DATA_REGISTRY = """WITH users AS (SELECT DISTINCT user_id FROM events),
reg AS (
  SELECT user_id, 't_' || (user_id // 10) AS target_id, (user_id // 10) % 5 <> 2 AS enabled,
         unnest(['02:00:00:00:' || printf('%02x', user_id // 256) || ':'
                   || printf('%02x', user_id % 256),
                 '02:00:00:09:' || printf('%02x', (user_id // 10) % 256) || ':00']) AS mac,
         unnest([0, 1]) AS mac_ordinal
  FROM users
)
"""


@query("registry_macs", DATA_REGISTRY + """
SELECT mac, arg_max(target_id, user_id * 10 + mac_ordinal) AS target_id FROM reg
WHERE enabled GROUP BY mac""")
def _(spark, sf):
    return lab.mac_targets(demo.data_registry(spark, sf)).select("mac", "target_id")


@query("enabled_targets", DATA_REGISTRY + " SELECT DISTINCT target_id FROM reg WHERE enabled")
def _(spark, sf):
    return lab.enabled_targets(demo.data_registry(spark, sf))


@query("target_lookup", LABELLED + " SELECT packet_index, source_target_id FROM looked")
def _(spark, sf):
    return lab.lookup_targets(demo.features(spark, sf), demo.targets(spark)).select(
        "packet_index", "source_target_id")


def _label_query(name: str, settings: LabelSettings, expression: str) -> None:
    sql = LABELLED + f"""
SELECT packet_index, source_target_id, '{settings.mode}' AS label_mode, label FROM
  (SELECT *, {expression} AS label FROM looked) WHERE label IS NOT NULL"""

    @query(name, sql)
    def _(spark, sf):
        return demo.labelled(spark, sf, settings).select(
            "packet_index", "source_target_id", "label_mode", "label")


_label_query("label_binary", demo.BINARY,
             "CASE WHEN source_target_id = 't_a' THEN 'target' ELSE 'other' END")
_label_query("label_any_target", LabelSettings(),
             "CASE WHEN source_target_id IS NOT NULL THEN 'target' ELSE 'other' END")
_label_query("label_per_target", LabelSettings(mode="per_target_binary", target_id="t_b"),
             "CASE WHEN source_target_id = 't_b' THEN 'target' ELSE 'other' END")
_label_query("label_multiclass_known", LabelSettings(mode="multiclass_known_targets_only"),
             "source_target_id")
_label_query("label_multiclass_other", demo.MULTI, "coalesce(source_target_id, 'other')")

# --- inspection ------------------------------------------------------------------------------


@query("capture_summary", REC + """
SELECT count(*) AS packets_scanned, count(*) FILTER (parse_ok) AS parse_successes,
       count(*) FILTER (NOT parse_ok) AS parse_failures,
       count(*) FILTER (protected) AS protected_frame_count,
       string_agg(DISTINCT channel_frequency::VARCHAR, ',' ORDER BY channel_frequency::VARCHAR)
         AS channel_frequencies,
       count(DISTINCT source_mac) AS source_mac_count,
       count(DISTINCT destination_mac) AS destination_mac_count,
       count(*) FILTER (NOT parse_ok) / count(*)::DOUBLE AS parse_failure_rate FROM records""")
def _(spark, sf):
    return ins.capture_summary(demo.records(spark, sf))


@query("family_counts", REC + """,
names AS (SELECT * FROM (VALUES ('management', 0), ('control', 1), ('data', 2), ('extension', 3),
                                ('unknown', 9)) AS t(family, code))
SELECT family, count(records.event_id) AS frames FROM names
LEFT JOIN records ON coalesce(records.frame_type, 9) = code GROUP BY family""")
def _(spark, sf):
    return ins.family_counts(demo.records(spark, sf))


@query("field_coverage", REC + """
SELECT field, present, total - present AS missing, present / total::DOUBLE AS coverage FROM (
  SELECT 'data_rate' AS field, count(data_rate) AS present, count(*) AS total FROM records
  UNION ALL SELECT 'channel_frequency', count(channel_frequency), count(*) FROM records
  UNION ALL SELECT 'rssi_or_ssi', count(coalesce(rssi, ssi)), count(*) FROM records)""")
def _(spark, sf):
    return ins.field_coverage(demo.records(spark, sf))


@query("mac_counts", REC + """
SELECT side, mac, count(*) AS frames FROM (
  SELECT 'source' AS side, source_mac AS mac FROM records
  UNION ALL SELECT 'destination', destination_mac FROM records) WHERE mac IS NOT NULL
GROUP BY side, mac""")
def _(spark, sf):
    return ins.address_counts(demo.records(spark, sf)).orderBy("side", F.desc("frames"), "mac")


@query("target_matches", LABELLED + """
SELECT coalesce(source_target_id, '__all__') AS target_id, count(*) AS frames
FROM looked WHERE source_target_id IS NOT NULL
GROUP BY GROUPING SETS ((source_target_id), ())""")
def _(spark, sf):
    return ins.target_matches(demo.records(spark, sf), demo.targets(spark))


@query("capture_warnings", REC + f""",
f AS (SELECT count(*) AS scanned, count(*) FILTER (parse_ok) AS parsed, count(data_rate) AS with_rate,
             count(coalesce(rssi, ssi)) AS with_signal, count(*) FILTER (protected) AS protected_frames,
             count(*) FILTER (source_mac = '02:ff:ff:ff:ff:ff') AS matched FROM records)
SELECT rule, warning FROM (
  SELECT 2 AS rule, '{ins.NONE_PARSED}' AS warning, scanned > 0 AND parsed = 0 AS raised FROM f
  UNION ALL SELECT 3, '{ins.MANY_FAILED}', (scanned - parsed) / scanned::DOUBLE >= 0.2 FROM f
  UNION ALL SELECT 4, '{ins.NO_RATE}', scanned > 0 AND with_rate = 0 FROM f
  UNION ALL SELECT 5, '{ins.NO_SIGNAL}', scanned > 0 AND with_signal = 0 FROM f
  UNION ALL SELECT 6, '{ins.NO_PROTECTED}', parsed > 0 AND protected_frames = 0 FROM f
  UNION ALL SELECT 7, '{ins.NO_TARGET}', parsed > 0 AND matched = 0 FROM f) WHERE raised""")
def _(spark, sf):
    """All records against a registry that knows none of their addresses."""
    nobody = lab.broadcastable_targets(lab.registry_frame(spark, [
        {"target_id": "t_x", "mac_addresses": ["02:ff:ff:ff:ff:ff"]}]))
    facts = ins.warning_facts(demo.records(spark, sf), nobody)
    return ins.capture_warnings(facts, file_count=1, has_enabled_targets=True)


@query("device_candidates", REC + """
SELECT row_number() OVER (ORDER BY count(*) DESC, source_mac) AS rank, source_mac AS mac,
       count(*) AS frames
FROM records WHERE source_mac IS NOT NULL GROUP BY source_mac""")
def _(spark, sf):
    return ins.device_candidates(demo.records(spark, sf))


LABEL_MULTI = LABELLED + """,
labelled AS (SELECT *, coalesce(source_target_id, 'other') AS label FROM looked)"""
LABEL_BIN = LABELLED + """,
labelled AS (SELECT *, CASE WHEN source_target_id = 't_a' THEN 'target' ELSE 'other' END AS label
             FROM looked)"""


@query("class_distribution", LABEL_MULTI + """
SELECT label, count(*) AS label_count FROM labelled GROUP BY label""")
def _(spark, sf):
    return ev.class_distribution(demo.labelled(spark, sf, demo.MULTI))


@query("severe_skew", LABEL_MULTI + """,
d AS (SELECT label, count(*) AS c FROM labelled GROUP BY label)
SELECT count(*) AS classes, min(c) AS smallest, max(c) AS largest,
       count(*) >= 2 AND max(c) / min(c)::DOUBLE >= 10 AS severe_skew FROM d""")
def _(spark, sf):
    return ev.severe_skew(ev.class_distribution(demo.labelled(spark, sf, demo.MULTI)))


def _rank_part(name: str, text: str) -> str:
    return f"SELECT '{name}' AS feature, coalesce({text}, 'missing') AS v, label FROM labelled"


@query("feature_rank", LABEL_BIN + ", long AS (" + " UNION ALL ".join([
    _rank_part("hour", "hour::VARCHAR"), _rank_part("data_rate", "printf('%.3g', data_rate)"),
    _rank_part("ssi", "printf('%.3g', ssi)"), _rank_part("frame_type", "frame_type::VARCHAR"),
    _rank_part("frame_subtype", "frame_subtype::VARCHAR"),
    _rank_part("data_size", "data_size::VARCHAR")]) + """),
c AS (SELECT feature, v, label, count(*) AS n FROM long GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS nx,
             sum(n) OVER (PARTITION BY feature, label) AS ny,
             sum(n) OVER (PARTITION BY feature) AS total FROM c)
SELECT feature, round(sum(n / total::DOUBLE * log2(n::DOUBLE * total / (nx::DOUBLE * ny))), 9)
  AS score FROM m GROUP BY feature""")
def _(spark, sf):
    return ranking.feature_rank(demo.labelled(spark, sf)).withColumn("score", F.round("score", 9))


# --- evaluation ------------------------------------------------------------------------------

PAIRS = """,
pairs AS (SELECT ground_truth AS truth, predicted_class AS predicted, count(*) AS n FROM preds
          GROUP BY ALL),
names AS (SELECT truth AS label FROM pairs UNION SELECT predicted FROM pairs),
dense AS (SELECT a.label AS truth, b.label AS predicted, coalesce(p.n, 0) AS n
          FROM names a CROSS JOIN names b LEFT JOIN pairs p
            ON p.truth = a.label AND p.predicted = b.label),
sums AS (SELECT l.label, sum(n) FILTER (truth = l.label)::BIGINT AS support,
                sum(n) FILTER (predicted = l.label)::BIGINT AS assigned,
                sum(n) FILTER (truth = l.label AND predicted = l.label)::BIGINT AS tp
         FROM names l CROSS JOIN dense GROUP BY l.label),
rated AS (SELECT *, coalesce(tp / nullif(assigned, 0)::DOUBLE, 0) AS precision,
                 coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM sums),
classes AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
            FROM rated),
headline AS (
  SELECT coalesce(max(precision) FILTER (label = 'target'),
                  sum(precision * support) / sum(support)) AS precision,
         coalesce(max(recall) FILTER (label = 'target'), sum(recall * support) / sum(support))
           AS recall,
         coalesce(max(f1) FILTER (label = 'target'), sum(f1 * support) / sum(support)) AS f1
  FROM classes),
matthews AS (
  SELECT (sum(tp)::DOUBLE * sum(support) - sum(support::DOUBLE * assigned))
           / nullif(sqrt((sum(support)::DOUBLE ** 2 - sum(support::DOUBLE ** 2))
                 * (sum(support)::DOUBLE ** 2 - sum(assigned::DOUBLE ** 2))), 0) AS mcc
  FROM classes)"""
CURVE = """,
s AS (SELECT score, count(*) FILTER (ground_truth = 'target') AS pos,
             count(*) FILTER (ground_truth <> 'target') AS neg FROM preds GROUP BY score),
ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p,
                  sum(neg) OVER () AS q FROM s WINDOW w AS (ORDER BY score DESC)),
auc AS (SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(q)) AS roc_auc,
               sum(pos * (tp / (tp + fp)::DOUBLE)) / max(p) AS pr_auc FROM ranked)"""


@query("confusion_matrix", MULTI + PAIRS + " SELECT truth, predicted, n FROM dense")
def _(spark, sf):
    return ev.confusion_matrix(ev.pair_counts(demo.multi_predictions(spark, sf)))


@query("confusion_wide", MULTI + PAIRS + """
SELECT truth, sum(n) FILTER (predicted = 'other')::BIGINT AS other,
       sum(n) FILTER (predicted = 't_a')::BIGINT AS t_a,
       sum(n) FILTER (predicted = 't_b')::BIGINT AS t_b
FROM dense GROUP BY truth""")
def _(spark, sf):
    pairs = ev.pair_counts(demo.multi_predictions(spark, sf))
    return ev.confusion_wide(pairs, ["other", "t_a", "t_b"])


@query("per_class_metrics", MULTI + PAIRS + """
SELECT label, precision, recall, f1, support FROM classes""")
def _(spark, sf):
    pairs = ev.pair_counts(demo.multi_predictions(spark, sf))
    return ev.per_class(pairs).select("label", "precision", "recall", "f1", "support")


@query("primary_metrics", MULTI + PAIRS + """
SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM headline""")
def _(spark, sf):
    classes = ev.per_class(ev.pair_counts(demo.multi_predictions(spark, sf)))
    return ev.headline(classes).select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("mcc", MULTI + PAIRS + " SELECT round(mcc, 9) AS mcc FROM matthews")
def _(spark, sf):
    classes = ev.per_class(ev.pair_counts(demo.multi_predictions(spark, sf)))
    return ev.matthews(classes).select(F.round("mcc", 9).alias("mcc"))


@query("classification_metrics", BIN + PAIRS + CURVE + """
SELECT sum(n)::BIGINT AS n_examples,
       round(sum(n) FILTER (truth = predicted) / sum(n)::DOUBLE, 9) AS accuracy,
       max(round(h.precision, 9)) AS precision, max(round(h.recall, 9)) AS recall,
       max(round(h.f1, 9)) AS f1, max(round(m.mcc, 9)) AS mcc,
       max(round(a.roc_auc, 9)) AS roc_auc, max(round(a.pr_auc, 9)) AS pr_auc
FROM pairs CROSS JOIN headline h CROSS JOIN matthews m CROSS JOIN auc a""")
def _(spark, sf):
    out = ev.classification_metrics(demo.binary_predictions(spark, sf), score="score")
    return out.select("n_examples", *[
        F.round(c, 9).alias(c)
        for c in ("accuracy", "precision", "recall", "f1", "mcc", "roc_auc", "pr_auc")])


@query("metrics_document", BIN + PAIRS + """,
cells AS (SELECT t.label AS truth, p.label AS predicted, coalesce(n, 0)::BIGINT AS n
          FROM classes t CROSS JOIN classes p LEFT JOIN pairs ON pairs.truth = t.label AND pairs.predicted = p.label),
lines AS (SELECT truth, '[' || string_agg(n::VARCHAR, ',' ORDER BY predicted) || ']' AS line FROM cells GROUP BY truth)
SELECT (SELECT string_agg(label, ',' ORDER BY label) FROM classes) AS labels,
       (SELECT '[' || string_agg(line, ',' ORDER BY truth) || ']' FROM lines) AS matrix,
       c.label, round(c.precision, 9) AS precision, round(c.recall, 9) AS recall, round(c.f1, 9) AS f1,
       c.support::BIGINT AS support
FROM classes c""")
def _(spark, sf):
    doc = ev.metrics_document(demo.binary_predictions(spark, sf), score="score")
    return doc.select(
        F.array_join("labels", ",").alias("labels"), F.to_json("confusion_matrix.matrix").alias("matrix"),
        F.explode("per_class").alias("label", "m"),
    ).select("labels", "matrix", "label", *[F.round(f"m.{c}", 9).alias(c) for c in ("precision", "recall", "f1")], "m.support")


@query("roc_auc", BIN + CURVE + " SELECT round(roc_auc, 9) AS roc_auc FROM auc")
def _(spark, sf):
    ranked = ev.ranked_scores(ev.score_table(demo.binary_predictions(spark, sf)))
    return ev.areas(ranked).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("pr_auc", BIN + CURVE + " SELECT round(pr_auc, 9) AS pr_auc FROM auc")
def _(spark, sf):
    ranked = ev.ranked_scores(ev.score_table(demo.binary_predictions(spark, sf)))
    return ev.areas(ranked).select(F.round("pr_auc", 9).alias("pr_auc"))


@query("roc_points", BIN + CURVE + """
SELECT score AS threshold, fp / q::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM ranked""")
def _(spark, sf):
    return ev.roc_points(ev.ranked_scores(ev.score_table(demo.binary_predictions(spark, sf))))


@query("pr_points", BIN + CURVE + """
SELECT score AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / p::DOUBLE AS recall
FROM ranked""")
def _(spark, sf):
    return ev.pr_points(ev.ranked_scores(ev.score_table(demo.binary_predictions(spark, sf))))


# --- presence windows ------------------------------------------------------------------------

STATE = """CASE WHEN frame_count < 5 THEN 'uncertain'
     WHEN positive_prediction_ratio >= 0.5 AND (mean_probability >= 0.5 OR max_probability >= 0.8)
       THEN 'present'
     WHEN positive_prediction_ratio < 0.5 AND mean_probability < 0.5 AND max_probability < 0.8
       THEN 'absent' ELSE 'uncertain' END AS state"""
STATS = """count(*) AS frame_count, round(sum(prob) / count(*), 12) AS mean_probability,
         max(prob) AS max_probability, sum(hit::INT) / count(*)::DOUBLE
           AS positive_prediction_ratio, sum(truth::INT)::BIGINT AS truth_count"""
ROLLING = f""",
frame_w AS (
  SELECT target_id, 'frame_count' AS window_type, pos // 100 AS window_seq,
         (pos // 100 * 100)::DOUBLE AS window_start,
         (pos // 100 * 100 + count(*) - 1)::DOUBLE AS window_end, {STATS}
  FROM target_rows GROUP BY target_id, pos // 100),
time_w AS (
  SELECT target_id, 'time' AS window_type, floor(timestamp / 21600)::BIGINT AS window_seq,
         floor(timestamp / 21600) * 21600 AS window_start,
         floor(timestamp / 21600) * 21600 + 21600 AS window_end, {STATS}
  FROM target_rows WHERE timestamp IS NOT NULL GROUP BY target_id, floor(timestamp / 21600)),
rolling AS (SELECT *, {STATE} FROM (SELECT * FROM frame_w UNION ALL SELECT * FROM time_w))"""
REPLAY = f""",
buckets AS (
  SELECT pos, floor(timestamp / 21600)::BIGINT AS tb,
         lag(floor(timestamp / 21600)::BIGINT) OVER (ORDER BY pos) AS prev
  FROM preds WHERE timestamp IS NOT NULL),
marked AS (SELECT pos, tb, sum((tb IS DISTINCT FROM prev)::INT) OVER (ORDER BY pos) - 1 AS island
           FROM buckets),
islands AS (
  SELECT target_id, 'time' AS window_type, island::BIGINT AS window_seq,
         (tb * 21600)::DOUBLE AS window_start, (tb * 21600 + 21600)::DOUBLE AS window_end, {STATS},
         island = (SELECT max(island) FROM marked) AS final_window
  FROM target_rows JOIN marked USING (pos) GROUP BY target_id, island, tb),
replay AS (SELECT *, {STATE} FROM (
  SELECT *, frame_count < 100 AS final_window FROM frame_w UNION ALL BY NAME
  SELECT * FROM islands)),
changes AS (SELECT * FROM (
  SELECT *, lag(state) OVER (PARTITION BY target_id, window_type ORDER BY window_seq) AS before
  FROM replay) WHERE state IS DISTINCT FROM before)"""
PRESENCE = ["window_start", "window_end", "target_id", "frame_count", "mean_probability",
            "max_probability", "positive_prediction_ratio", "state", "window_type"]
PRESENCE_SQL = ", ".join(PRESENCE)


def _presence(preds, targets, kinds=(win.FRAME_COUNT, win.TIME)):
    return win.presence_windows(preds, targets, demo.WINDOWS, kinds)


@query("presence_time_windows", BIN + ROLLING + f"""
SELECT {PRESENCE_SQL} FROM rolling WHERE window_type = 'time'""")
def presence_time_windows(spark, sf):
    return _presence(demo.binary_predictions(spark, sf), ["target"], [win.TIME]).select(*PRESENCE)


@query("presence_frame_windows", BIN + ROLLING + f"""
SELECT {PRESENCE_SQL} FROM rolling WHERE window_type = 'frame_count'""")
def _(spark, sf):
    return _presence(
        demo.binary_predictions(spark, sf), ["target"], [win.FRAME_COUNT]).select(*PRESENCE)


@query("presence_rolling", BIN + ROLLING + f" SELECT {PRESENCE_SQL} FROM rolling")
def _(spark, sf):
    return _presence(demo.binary_predictions(spark, sf), ["target"]).select(*PRESENCE)


@query("presence_multitarget", MULTI + ROLLING + f" SELECT {PRESENCE_SQL} FROM rolling")
def _(spark, sf):
    return _presence(demo.multi_predictions(spark, sf), TARGETS).select(*PRESENCE)


@query("presence_state", MULTI + ROLLING + """
SELECT target_id, window_type, state, count(*) AS windows FROM rolling GROUP BY ALL""")
def _(spark, sf):
    return _presence(demo.multi_predictions(spark, sf), TARGETS).groupBy(
        "target_id", "window_type", "state").agg(F.count(F.lit(1)).alias("windows"))


@query("presence_replay", MULTI + ROLLING + REPLAY + f"""
SELECT {PRESENCE_SQL}, window_seq, final_window FROM replay""")
def _(spark, sf):
    out = win.replay_windows(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS)
    return out.select(*PRESENCE, "window_seq", "final_window")


@query("presence_changes", MULTI + ROLLING + REPLAY + """
SELECT target_id, window_type, window_seq, state FROM changes""")
def _(spark, sf):
    out = win.replay_windows(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS)
    return win.state_changes(out).select("target_id", "window_type", "window_seq", "state")


@query("presence_text", BIN + ROLLING + """
SELECT window_type, target_id, window_start,
       window_type || ' target=' || target_id || ' state=' || state || ' frames=' || frame_count
       || ' mean=' || printf('%.3f', mean_probability) || ' max=' ||
       printf('%.3f', max_probability) || ' positive_ratio=' ||
       printf('%.3f', positive_prediction_ratio) AS line FROM rolling""")
def _(spark, sf):
    out = _presence(demo.binary_predictions(spark, sf), ["target"])
    return out.select("window_type", "target_id", "window_start", win.event_text(out).alias("line"))


@query("presence_summary", MULTI + ROLLING + """,
t AS (SELECT *, row_number() OVER (PARTITION BY target_id, window_type ORDER BY window_seq) AS r
      FROM rolling)
SELECT target_id, window_type, count(*) AS row_count,
       count(*) FILTER (state = 'present') AS present_rows,
       count(*) FILTER (state = 'absent') AS absent_rows,
       count(*) FILTER (state = 'uncertain') AS uncertain_rows, 0::BIGINT AS unknown_rows,
       string_agg(state, ',' ORDER BY window_seq) FILTER (r <= 120) AS timeline
FROM t GROUP BY target_id, window_type""")
def _(spark, sf):
    return ins.presence_summary(_presence(demo.multi_predictions(spark, sf), TARGETS))


# --- sampling and splitting ------------------------------------------------------------------

HASHED = LABEL_MULTI + """,
hashed AS (SELECT *, md5('42-0-' || packet_index) AS digest,
                  row_number() OVER (ORDER BY packet_index) - 1 AS pos FROM labelled),
counts AS (SELECT label, count(*) AS c FROM labelled GROUP BY label)"""


@query("sample_percent", HASHED + f"""
SELECT packet_index FROM hashed
WHERE ('0x' || substr(digest, 1, 12))::BIGINT < {int(0.3 * 16**12)}""")
def _(spark, sf):
    return sampling.sample_percent(demo.labelled(spark, sf, demo.MULTI), 30.0).select(
        "packet_index")


@query("sample_k", HASHED + """
SELECT packet_index FROM hashed ORDER BY digest LIMIT 200""")
def _(spark, sf):
    return sampling.sample_k(demo.labelled(spark, sf, demo.MULTI), 200).select("packet_index")


@query("balance_down", HASHED + """
SELECT packet_index, label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest) AS r FROM hashed)
WHERE r <= (SELECT min(c) FROM counts)""")
def _(spark, sf):
    return sampling.downsample(demo.labelled(spark, sf, demo.MULTI)).select(
        "packet_index", "label")


@query("balance_up", HASHED + """,
draws AS (SELECT label, c, unnest(range((SELECT max(c) FROM counts) - c)) AS d FROM counts),
times AS (SELECT label,
                 ('0x' || substr(md5('42-' || label || '-' || d), 1, 12))::BIGINT % c AS r,
                 count(*) AS n FROM draws GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest) - 1 AS r FROM hashed)
SELECT packet_index, ranked.label, unnest(range(coalesce(n, 0) + 1)) AS copy
FROM ranked LEFT JOIN times ON times.label = ranked.label AND times.r = ranked.r""")
def _(spark, sf):
    return sampling.upsample(demo.labelled(spark, sf, demo.MULTI)).select(
        "packet_index", "label", "copy")


@query("class_weights", HASHED + """
SELECT packet_index, label,
       (SELECT sum(c) FROM counts) / ((SELECT count(*) FROM counts) * c)::DOUBLE AS sample_weight
FROM hashed JOIN counts USING (label)""")
def _(spark, sf):
    return sampling.class_weights(demo.labelled(spark, sf, demo.MULTI)).select(
        "packet_index", "label", "sample_weight")


@query("split_chronological", HASHED + """
SELECT packet_index, pos < floor((SELECT count(*) FROM hashed)::DOUBLE * 0.9) AS is_train
FROM hashed""")
def _(spark, sf):
    return sampling.chronological_split(demo.labelled(spark, sf, demo.MULTI), 0.9).select(
        "packet_index", "is_train")


@query("split_holdout", HASHED + """
SELECT packet_index, row_number() OVER (ORDER BY digest) - 1
         < floor((SELECT count(*) FROM hashed)::DOUBLE * 0.9) AS is_train FROM hashed""")
def _(spark, sf):
    return sampling.shuffled_split(demo.labelled(spark, sf, demo.MULTI), 0.9).select(
        "packet_index", "is_train")


FRACTIONS = [0.01, 0.1, 0.5, 0.9]
FRACTION_SQL = HASHED + """,
cuts AS (SELECT f AS train_fraction,
                floor((SELECT count(*) FROM hashed)::DOUBLE * f)::BIGINT AS train_rows,
                (SELECT count(*) FROM hashed) AS total
         FROM (VALUES (0.01::DOUBLE), (0.1), (0.5), (0.9)) AS v(f))"""


@query("split_fractions", FRACTION_SQL + """
SELECT train_fraction, train_rows, total - train_rows AS test_rows FROM cuts""")
def _(spark, sf):
    return sampling.fraction_cuts(demo.labelled(spark, sf, demo.MULTI), FRACTIONS)


# --- calibration -----------------------------------------------------------------------------

SWEEP = ROLLING + """,
grid AS (
  SELECT ((i - 2) * 7 + (j - 2)) * 5 + (m - 5) AS candidate_index,
         i / 10.0::DOUBLE AS r, j / 10.0::DOUBLE AS me, m / 10.0::DOUBLE AS mx
  FROM range(2, 9) AS a(i) CROSS JOIN range(2, 9) AS b(j) CROSS JOIN range(5, 10) AS c(m)),
judged AS (
  SELECT candidate_index, r, me, mx, target_id, window_type, truth_count >= 1 AS truth,
         frame_count >= 5 AND positive_prediction_ratio >= r
           AND (mean_probability >= me OR max_probability >= mx) AS present
  FROM rolling CROSS JOIN grid),
counted AS (
  SELECT candidate_index, r, me, mx, coalesce(target_id, '__all__') AS target_id,
         coalesce(window_type, '__all__') AS window_type,
         count(*) FILTER (present AND truth) AS tp, count(*) FILTER (present AND NOT truth) AS fp,
         count(*) FILTER (NOT present AND NOT truth) AS tn,
         count(*) FILTER (NOT present AND truth) AS fn
  FROM judged GROUP BY GROUPING SETS ((candidate_index, r, me, mx, target_id, window_type),
                                      (candidate_index, r, me, mx))),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision,
              coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
              (tp::DOUBLE * tn - fp::DOUBLE * fn) /
                nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc
       FROM counted),
sweep AS (
  SELECT CASE WHEN target_id = '__all__' THEN 'global' ELSE 'target_window' END AS scope,
         target_id, window_type, candidate_index, r AS present_ratio_threshold,
         me AS mean_probability_threshold, mx AS max_probability_threshold,
         tp + fp + tn + fn AS window_count, tp + fp + tn + fn AS support,
         tp + fn AS positive_support, tn + fp AS truth_absent_windows, tp AS true_positive,
         fp AS false_positive, tn AS true_negative, fn AS false_negative,
         precision, recall,
         coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, mcc,
         'f1' AS objective,
         coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS objective_score
  FROM pr),
best AS (
  SELECT *, row_number() OVER (ORDER BY objective_score DESC, coalesce(mcc, -1) DESC,
                               false_positive, recall DESC, candidate_index) AS place
  FROM sweep WHERE scope = 'global')"""
ROUNDED = {"precision", "recall", "f1", "mcc", "objective_score"}
SWEEP_LIST = ", ".join(
    f"round({c}, 9) AS {c}" if c in ROUNDED else c for c in cal.CALIBRATION_COLUMNS)
CAL = cal.CalibrationSettings()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(c, 9).alias(c) if c in ROUNDED else F.col(c) for c in cal.CALIBRATION_COLUMNS])


def _calibration(spark, sf):
    return cal.calibrate(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS, CAL)


@query("calibration_windows", MULTI + ROLLING + """
SELECT target_id, window_type, window_start, window_end, frame_count, mean_probability,
       max_probability, positive_prediction_ratio, truth_count, truth_count >= 1 AS truth_present
FROM rolling""")
def _(spark, sf):
    return cal.calibration_windows(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS)


@query("calibration_sweep", MULTI + SWEEP + f" SELECT {SWEEP_LIST} FROM sweep")
def _(spark, sf):
    windows = cal.calibration_windows(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS)
    return _rounded(cal.sweep(windows, demo.WINDOWS, CAL))


@query("calibration_best", MULTI + SWEEP + f" SELECT {SWEEP_LIST} FROM best WHERE place = 1")
def _(spark, sf):
    return _rounded(_calibration(spark, sf)[2])


@query("calibration_top10", MULTI + SWEEP + f" SELECT {SWEEP_LIST} FROM best WHERE place <= 10")
def _(spark, sf):
    return _rounded(cal.top_candidates(_calibration(spark, sf)[1]))


@query("calibration_warnings", MULTI + SWEEP + f""",
w AS (SELECT count(*) AS n, count(*) FILTER (truth_count >= 1) AS yes FROM rolling)
SELECT 2 AS rule, '{cal.SYNTHETIC}' AS warning
UNION ALL SELECT 3, '{cal.SPARSE}' FROM w WHERE n < 5
UNION ALL SELECT 4, '{cal.SKEWED}' FROM w WHERE least(yes, n - yes) / n::DOUBLE < 0.1
UNION ALL SELECT 5, '{cal.RESIDUAL}' FROM best
  WHERE place = 1 AND (false_positive > 0 OR false_negative > 0)""")
def _(spark, sf):
    stats, _results, best = _calibration(spark, sf)
    return cal.calibration_warnings(stats, best, synthetic=True)


@query("truth_coverage", MULTI + """
SELECT count(*) AS row_count, count(*) FILTER (ground_truth IS NULL) AS missing_truth,
       count(*) > 0 AND count(*) FILTER (ground_truth IS NULL) = 0 AS usable FROM preds""")
def _(spark, sf):
    return cal.truth_coverage(demo.multi_predictions(spark, sf))


@query("threshold_grid", MULTI + SWEEP + """
SELECT candidate_index, r AS present_ratio_threshold, me AS mean_probability_threshold,
       mx AS max_probability_threshold,
       count(*) FILTER (positive_prediction_ratio >= r) AS reaching_windows
FROM rolling CROSS JOIN grid GROUP BY ALL""")
def _(spark, sf):
    windows = cal.calibration_windows(demo.multi_predictions(spark, sf), TARGETS, demo.WINDOWS)
    cells = cal.window_cells(windows, demo.WINDOWS, CAL)
    grid = cal.threshold_grid(spark, demo.WINDOWS, CAL)
    names = ["candidate_index", "present_ratio_threshold", "mean_probability_threshold",
             "max_probability_threshold"]
    return cells.crossJoin(F.broadcast(grid)).groupBy(*names).agg(
        F.sum(F.when(F.col("ri") > F.col("i"), F.col("n")).otherwise(0)).alias("reaching_windows"))


# --- sources and sinks -----------------------------------------------------------------------

DEC = "WITH " + demo.DUCK_DECODED
DECODED_LIST = [f.name for f in RECORDS.fields if f.name not in ("file_ordinal", "source_file")]


@query("decode_frames", DEC + f" SELECT {', '.join(DECODED_LIST)} FROM decoded")
def _(spark, sf):
    return frames.decode(demo.frame_bytes(spark, sf)).select(*DECODED_LIST)


@query("parse_failures", DEC + """
SELECT packet_index, parse_error, packet_len, radiotap_len FROM decoded WHERE NOT parse_ok""")
def _(spark, sf):
    records = frames.decode(demo.frame_bytes(spark, sf))
    return records.where(~F.col("parse_ok")).select(
        "packet_index", "parse_error", "packet_len", "radiotap_len")


CAPTURED = [c for c in DECODED_LIST if c not in ("packet_index", "timestamp", "hour")]


@query("ingest_captures", DEC + f"""
SELECT (packet_index // 4000)::INT AS file_ordinal, packet_index % 4000 AS packet_index,
       round(coalesce(timestamp, 0), 6) AS timestamp, coalesce(hour, 0) AS hour,
       {', '.join(CAPTURED)} FROM decoded""")
def _(spark, sf):
    from fixtures.captures import write_captures

    records = capture.ingest(spark, [write_captures(spark, sf)], split_bytes=1 << 16)
    return records.select(
        "file_ordinal", "packet_index", F.round("timestamp", 6).alias("timestamp"), "hour",
        *CAPTURED)


@query("stream_captures", DEC + f"""
SELECT (packet_index // 4000)::INT AS file_ordinal, packet_index % 4000 AS packet_index,
       round(coalesce(timestamp, 0), 6) AS timestamp, coalesce(hour, 0) AS hour,
       {', '.join(CAPTURED)} FROM decoded""")
def _(spark, sf):
    """Captures that grow while a stream follows them; the first look ends inside a record."""
    from fixtures.captures import grow, write_captures

    whole, growing, folder = write_captures(spark, sf), work_path(spark, "growing"), work_path(spark, "followed")
    for share in (0.37, 1.0):
        grow(whole, growing, share)
        raw = live.capture_stream(spark, growing, f"{folder}/cursors", split_bytes=1 << 18)
        frames.decode(raw).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True).start(f"{folder}/records").awaitTermination()
    return spark.read.parquet(f"{folder}/records").select(
        "file_ordinal", "packet_index", F.round("timestamp", 6).alias("timestamp"), "hour", *CAPTURED)


@query("capture_faults", DEC + """,
sizes AS (SELECT packet_index, packet_index // 4000 AS file_no, CASE WHEN packet_index // 4000 % 2 = 0 THEN 16 + packet_len
            ELSE 32 + (packet_len + 3) // 4 * 4 END AS size FROM decoded),
placed AS (SELECT *, CASE WHEN file_no % 2 = 0 THEN 24 ELSE 48 END + sum(size) OVER (
             PARTITION BY file_no ORDER BY packet_index) - size AS start FROM sizes)
SELECT 'fault' AS kind, file_no::INT AS file_ordinal, start::BIGINT AS position, size::BIGINT AS amount, 'damaged record' AS reason
FROM placed WHERE packet_index % 4000 = 17
UNION ALL SELECT 'records', file_no, min(i), count(*), NULL FROM (
  SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY packet_index) - 1 AS i FROM placed WHERE packet_index % 4000 <> 17)
GROUP BY file_no""")
def _(spark, sf):
    """One damaged record in every file: what was skipped, and how many records came out around it."""
    from fixtures.captures import write_captures

    folder = write_captures(spark, sf, damaged=True)
    faults = capture.capture_faults(spark, [folder], split_bytes=1 << 16)
    found = capture.read_frames(spark, [folder], split_bytes=1 << 16).groupBy("file_ordinal").agg(
        F.min("packet_index").alias("position"), F.count(F.lit(1)).alias("amount"))
    return faults.select(
        F.lit("fault").alias("kind"), "file_ordinal", F.col("offset").alias("position"), F.col("skipped").alias("amount"), "reason",
    ).unionByName(found.select(
        F.lit("records").alias("kind"), "file_ordinal", "position", "amount", F.lit(None).cast("string").alias("reason")))


@query("inspect_captures", DEC + """
SELECT 'capture_files' AS stage, count(DISTINCT packet_index // 4000) AS row_count FROM decoded
UNION ALL SELECT 'packets_scanned', count(*) FROM decoded
UNION ALL SELECT 'dot11_frames', count(*) FILTER (parse_ok) FROM decoded""")
def _(spark, sf):
    from fixtures.captures import write_captures

    folder = work_path(spark, "inspected")
    return jobs.inspect_captures(spark, [write_captures(spark, sf)], folder, demo.targets(spark)).manifest


FEATURE_NAMES = [f.name for f in FEATURES.fields]


def _stored_features(spark, sf, suffix):
    path = work_path(spark, "features") + f".{suffix}"
    datasets.write_dataset(demo.features(spark, sf).select(*FEATURE_NAMES), path, FEATURES)
    return path


@query("read_formats", FEAT + f"""
SELECT f.format, feats.* FROM (SELECT {FEATURE_LIST} FROM feats) AS feats
CROSS JOIN (VALUES ('parquet'), ('jsonl'), ('csv')) AS f(format)""")
def _(spark, sf):
    parts = [
        datasets.read_dataset(spark, _stored_features(spark, sf, suffix), FEATURES)
        .withColumn("format", F.lit(suffix))
        for suffix in ("parquet", "jsonl", "csv")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("csv_typing", RAW + """,
cells AS (SELECT packet_index, CASE packet_index % 6 WHEN 0 THEN '' WHEN 1 THEN 'TRUE'
            WHEN 2 THEN k::VARCHAR WHEN 3 THEN value::VARCHAR WHEN 4 THEN event_type
            ELSE 'false' END AS cell
          FROM frames JOIN (SELECT event_id AS e, value, event_type FROM events)
            ON e = packet_index)
SELECT packet_index,
       CASE packet_index % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'int'
            WHEN 3 THEN 'float' WHEN 4 THEN 'string' ELSE 'bool' END AS kind,
       CASE packet_index % 6 WHEN 1 THEN true WHEN 5 THEN false END AS as_bool,
       TRY_CAST(nullif(cell, '') AS DOUBLE) AS as_double FROM cells""")
def _(spark, sf):
    ev_ = demo.events(spark, sf)
    turn = F.col("event_id") % 6
    k = F.regexp_extract("props", "[0-9]+", 0)
    cell = (
        F.when(turn == 0, "").when(turn == 1, "TRUE").when(turn == 2, k)
        .when(turn == 3, F.col("value").cast("string")).when(turn == 4, F.col("event_type"))
        .otherwise("false")
    )
    path = work_path(spark, "cells") + ".csv"
    ev_.select(F.col("event_id").alias("packet_index"), cell.alias("cell")).write.csv(
        path, header=True)
    cells = spark.read.schema("packet_index long, cell string").csv(path, header=True)
    return cells.select(
        "packet_index", datasets.csv_kind(F.col("cell")).alias("kind"),
        datasets.csv_value(F.col("cell"), T.BooleanType()).alias("as_bool"),
        datasets.csv_value(F.col("cell"), T.DoubleType()).alias("as_double"),
    )


@query("write_roundtrip", FEAT + """
SELECT f.format, count(*) AS written, count(*) AS read_back, sum(data_size)::BIGINT AS total_size
FROM feats CROSS JOIN (VALUES ('parquet'), ('jsonl'), ('csv'), ('arff')) AS f(format)
GROUP BY f.format""")
def _(spark, sf):
    rows = demo.features(spark, sf).select(*FEATURE_NAMES)
    out = None
    for suffix in ("parquet", "jsonl", "csv", "arff"):
        path = work_path(spark, "roundtrip") + f".{suffix}"
        written = datasets.write_dataset(rows, path, FEATURES)
        if suffix == "arff":
            lines = spark.read.text(f"{path}/data")
            size = F.split("value", ",")[FEATURE_NAMES.index("data_size")].try_cast("int")
            back = lines.select(size.alias("data_size"))
        else:
            back = datasets.read_dataset(spark, path, FEATURES)
        one = back.agg(
            F.count(F.lit(1)).alias("read_back"), F.sum("data_size").alias("total_size")
        ).select(F.lit(suffix).alias("format"), F.lit(written).alias("written"), "read_back",
                 "total_size")
        out = one if out is None else out.unionByName(one)
    return out


@query("arff_rows", FEAT + """
SELECT coalesce(timestamp::VARCHAR, '?') || ',''' || source_file || ''',' || packet_index || ',' ||
       coalesce(hour::VARCHAR, '?') || ',' || coalesce(data_rate::VARCHAR, '?') || ',' ||
       coalesce(ssi::VARCHAR, '?') || ',' || coalesce(frame_type::VARCHAR, '?') || ',' ||
       coalesce(frame_subtype::VARCHAR, '?') || ',' || coalesce('''' || source_mac || '''', '?')
       || ',' || coalesce('''' || destination_mac || '''', '?') || ',' ||
       coalesce(data_size::VARCHAR, '?') || ',' || coalesce(total_packet_len::VARCHAR, '?') || ','
       || coalesce(dot11_frame_len::VARCHAR, '?') || ',' || coalesce(payload_len::VARCHAR, '?')
       || ',' || coalesce(channel_frequency::VARCHAR, '?') || ',' ||
       coalesce(retry::INT::VARCHAR, '?') || ',' || coalesce(protected::INT::VARCHAR, '?')
       AS value FROM feats""")
def _(spark, sf):
    return datasets.arff_rows(demo.features(spark, sf).select(*FEATURE_NAMES))


# --- learners --------------------------------------------------------------------------------

FAST = learn.LearnerSettings(chunks=3, n_models=3)


def _trainable(spark, sf):
    """Feature rows with a label that the model features can explain, apart from every 10th row."""
    rows = demo.features(spark, sf)
    strong = (F.coalesce("ssi", F.lit(-99.0)) > -60) & (F.coalesce("frame_type", F.lit(2)) == 2)
    flipped = F.col("packet_index") % 10 == 0
    return rows.withColumn("label", F.when(strong != flipped, "target").otherwise("other"))


def _rule_model() -> trees.Model:
    """A fixed three-level tree."""
    t = trees.Tree()
    t.nodes = {
        0: trees.Node("ssi", trees.NUMBER, -60.0, None, 1, 2),
        1: trees.Node(weights={"other": 30.0, "target": 10.0}, depth=1),
        2: trees.Node("data_size", trees.NUMBER, 50.0, None, 3, 4, depth=1),
        3: trees.Node("frame_type", trees.CODE, None, "2", 5, 6, depth=2),
        4: trees.Node(weights={"other": 1.0, "target": 3.0}, depth=2),
        5: trees.Node(weights={"target": 5.0}, depth=3),
        6: trees.Node(weights={"other": 2.0, "target": 2.0}, depth=3),
    }
    t.next_id = 7
    return trees.Model("adaptive_hoeffding_tree", list(fn.MODEL_FEATURES), ["other", "target"], [t])


RULE_LEAF = """CASE WHEN coalesce(ssi, -1) <= -60 THEN 1
     WHEN coalesce(data_size, -1) > 50 THEN 4 WHEN frame_type = 2 THEN 5 ELSE 6 END"""


RULE_PREDS = f"""
leafed AS (SELECT *, {RULE_LEAF} AS leaf FROM feats),
p AS (SELECT *, CASE leaf WHEN 1 THEN 0.25::DOUBLE WHEN 4 THEN 0.75 WHEN 5 THEN 1.0 ELSE 0.5 END
        AS pt FROM leafed),
rule_preds AS (
  SELECT timestamp, packet_index, 'unknown' AS label_mode,
         CASE WHEN pt > 0.5 THEN 'target' ELSE 'other' END AS predicted_class, greatest(pt, 1 - pt) AS confidence,
         NULL::VARCHAR AS ground_truth, source_mac, destination_mac,
         '{{"data_rate":' || coalesce(data_rate, -1.0)::DOUBLE || ',"data_size":'
         || coalesce(data_size, -1)::DOUBLE || ',"frame_subtype":"' ||
         coalesce(frame_subtype::VARCHAR, 'missing') || '","frame_type":"' ||
         coalesce(frame_type::VARCHAR, 'missing') || '","hour":' || coalesce(hour, -1)::DOUBLE ||
         ',"ssi":' || coalesce(ssi, -1.0)::DOUBLE || '}}' AS features_json,
         '{{"other":' || (1 - pt) || ',"target":' || pt || '}}' AS probabilities_json, pt,
         row_number() OVER (ORDER BY packet_index) - 1 AS pos
  FROM p)"""
PREDICTION_LIST = ", ".join(f.name for f in PREDICTIONS.fields)
RULE_TARGETS = """,
target_rows AS (SELECT pos, timestamp, 'target' AS target_id, pt AS prob, pt > 0.5 AS hit, false AS truth FROM preds)"""
RULE_ALL = FEAT + "," + RULE_PREDS


@query("score_rule_model", LABEL_BIN + f""",
leafed AS (SELECT *, {RULE_LEAF} AS leaf FROM labelled),
p AS (SELECT *, CASE leaf WHEN 1 THEN 0.25::DOUBLE WHEN 4 THEN 0.75 WHEN 5 THEN 1.0 ELSE 0.5 END
        AS pt FROM leafed)
SELECT packet_index, CASE WHEN pt > 0.5 THEN 'target' ELSE 'other' END AS predicted_class,
       greatest(pt, 1 - pt) AS confidence, label AS ground_truth,
       '{{"other":' || (1 - pt) || ',"target":' || pt || '}}' AS probabilities_json FROM p""")
def _(spark, sf):
    return trees.classify(demo.labelled(spark, sf), _rule_model()).select(
        "packet_index", "predicted_class", "confidence", "ground_truth", "probabilities_json")


@query("tree_node_stats", LABEL_BIN + f"""
SELECT 0 AS member, {RULE_LEAF} AS leaf, label, coalesce(frame_type::VARCHAR, 'missing')
         AS frame_type, coalesce(frame_subtype::VARCHAR, 'missing') AS frame_subtype,
       count(*) AS n, sum(1.0::DOUBLE) AS w, sum(coalesce(data_size, -1)::DOUBLE) AS sx_data_size,
       sum(coalesce(data_size, -1)::DOUBLE ** 2) AS sxx_data_size,
       min(coalesce(ssi, -1)) AS lo_ssi, max(coalesce(ssi, -1)) AS hi_ssi
FROM labelled GROUP BY ALL""")
def _(spark, sf):
    rows = demo.labelled(spark, sf)
    inputs = trees.model_inputs(rows, FeatureSettings())
    chunk = rows.select(
        "label", F.lit(1.0).alias("weight"), *[c.alias(n) for n, c in inputs.items()])
    return learn.leaf_cells(chunk, _rule_model()).select(
        "member", "leaf", "label", "frame_type", "frame_subtype", "n", "w", "sx_data_size",
        "sxx_data_size", "lo_ssi", "hi_ssi")


_CUTS = learn.poisson_cuts()
_LADDER = "CASE " + " ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(_CUTS)) + (
    f" ELSE {len(_CUTS)} END")


@query("bag_weights", FEAT + f""",
u AS (SELECT file_ordinal, packet_index, m AS member,
             ('0x' || substr(md5('42.' || (m // 4) || '-0-' || packet_index), 1 + 8 * (m % 4), 8)
             )::BIGINT AS u
      FROM feats CROSS JOIN (SELECT unnest(range(10))::INT AS m))
SELECT file_ordinal, packet_index, member, ({_LADDER})::DOUBLE AS weight FROM u""")
def _(spark, sf):
    return learn.bag_weights(demo.features(spark, sf), 10)


def _train_query(name: str, model_id: str) -> None:
    @query(name)
    def _(spark, sf):
        model, _rows = learn.train(_trainable(spark, sf), model_id, settings=FAST)
        return trees.node_table(spark, model)


_train_query("train_hoeffding", "adaptive_hoeffding_tree")
_train_query("train_leveraging_bag", "leveraging_bag")
_train_query("train_oza_boost", "oza_boost")
_train_query("train_oza_adwin", "oza_boost_adwin")


# --- one chunk in SQL ------------------------------------------------------------------------

ONE_CHUNK = learn.LearnerSettings(chunks=1)
_NUMBERS = ("data_rate", "data_size", "hour", "ssi")


def _below(z: str) -> str:
    """Share of a normal distribution below ``z``, by the same approximation as the learner's."""
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = (f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE"
            f" + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))")
    tail = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {poly})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def _entropy(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END"


def _stump_sql(members: str, weight: str) -> str:
    """The trees after one chunk: every member is a leaf that was tested once, and split if the bound allows it.

    ``members`` is a FROM item with the column ``member``; ``weight`` the weight of a row for a member.
    """
    s = ONE_CHUNK
    values = ", ".join(f"('{n}', coalesce(w.{n}, -1)::DOUBLE)" for n in _NUMBERS)
    codes = ", ".join(f"('{n}', coalesce(w.{n}::VARCHAR, 'missing'))" for n in ("frame_type", "frame_subtype"))
    return FEAT + f""",
trainable AS (SELECT *, CASE WHEN (coalesce(ssi, -99) > -60 AND coalesce(frame_type, 2) = 2) <> (packet_index % 10 = 0)
                             THEN 'target' ELSE 'other' END AS label FROM feats),
w AS (SELECT t.*, m.member, {weight} AS w FROM trainable t CROSS JOIN {members}),
totals AS (SELECT member, label, sum(w) AS w FROM w GROUP BY ALL),
leafs AS (SELECT member, sum(w) AS total, sum({_entropy('w')}) AS total_wlw, count(*) AS labels FROM totals GROUP BY member),
moments AS (SELECT w.member, w.label, v.feature, sum(w.w) AS w, sum(w.w * v.x) / sum(w.w) AS mean, sum(w.w * v.x * v.x) / sum(w.w) AS square,
              min(v.x) FILTER (w.w > 0) AS lo, max(v.x) FILTER (w.w > 0) AS hi
            FROM w, LATERAL (VALUES {values}) AS v(feature, x) GROUP BY ALL),
ranged AS (SELECT *, min(lo) OVER (PARTITION BY member, feature) AS low, max(hi) OVER (PARTITION BY member, feature) AS high FROM moments),
steps AS (SELECT *, low + (high - low) * i / {s.cut_points + 1} AS threshold FROM ranged, range(1, {s.cut_points + 1}) AS r(i) WHERE w > 0 AND high > low),
scaled AS (SELECT *, (threshold - mean) / greatest(sqrt(greatest(square - mean * mean, 0)), 1e-9) AS z FROM steps),
sides AS (
  SELECT member, feature, 'number' AS kind, threshold, NULL::VARCHAR AS code, label, w AS t,
         w * CASE WHEN threshold < lo THEN 0 WHEN threshold >= hi THEN 1 ELSE {_below('z')} END AS l FROM scaled
  UNION ALL
  SELECT member, feature, 'code', NULL, code, label, sum(l) OVER (PARTITION BY member, feature, label), l FROM (
    SELECT w.member, v.feature, v.code, w.label, sum(w.w) AS l FROM w, LATERAL (VALUES {codes}) AS v(feature, code) GROUP BY ALL)),
options AS (SELECT member, feature, kind, threshold, code, sum(l) AS lw, sum({_entropy('l')}) AS left_wlw,
              sum({_entropy('greatest(t - l, 0)')} - ({_entropy('t')})) AS shift,
              coalesce(sum(l) FILTER (label = 'other'), 0) AS left_other, coalesce(sum(l) FILTER (label = 'target'), 0) AS left_target
            FROM sides GROUP BY ALL),
judged AS (SELECT o.*, total, ((log2(total) * total - total_wlw) - (log2(lw) * lw - left_wlw)
             - (log2(total - lw) * (total - lw) - (total_wlw + shift))) / total AS gain
           FROM options o JOIN leafs USING (member) WHERE lw >= {s.min_branch} * total AND total - lw >= {s.min_branch} * total),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (
           PARTITION BY member, feature ORDER BY gain DESC, coalesce(threshold, 0) DESC, coalesce(code, '') DESC) = 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY gain DESC, feature DESC) AS rank,
                 lead(gain) OVER (PARTITION BY member ORDER BY gain DESC, feature DESC) AS second FROM best),
roots AS (SELECT l.member, b.*EXCLUDE (member, total), l.total, coalesce(b.gain > 0 AND l.total >= {s.grace_weight} AND (
            b.gain - greatest(coalesce(second, 0), 0) > bound OR bound < {s.tie}), false) AS split
          FROM (SELECT *, sqrt(log2(greatest(labels, 2)) ** 2 * ln(1 / {s.delta}::DOUBLE) / (2 * total)) AS bound FROM leafs) l
          LEFT JOIN (SELECT * FROM ranks WHERE rank = 1) b USING (member)),
sums AS (SELECT member, coalesce(sum(w) FILTER (label = 'other'), 0) AS other, coalesce(sum(w) FILTER (label = 'target'), 0) AS target
         FROM totals GROUP BY member),
nodes AS (
  SELECT member, 0 AS node_id, CASE WHEN split THEN feature END AS feature, CASE WHEN split THEN threshold END AS threshold,
         CASE WHEN split THEN code END AS code, CASE WHEN split THEN 1 END AS "left", CASE WHEN split THEN 2 END AS "right",
         other, target FROM roots JOIN sums USING (member)
  UNION ALL SELECT member, 1, NULL, NULL, NULL, NULL, NULL, left_other, left_target FROM roots WHERE split
  UNION ALL SELECT member, 2, NULL, NULL, NULL, NULL, NULL, greatest(other - left_other, 0), greatest(target - left_target, 0)
  FROM roots JOIN sums USING (member) WHERE split)
SELECT member::INT AS member, node_id::INT AS node_id, feature, round(threshold, 6) AS threshold, code, "left"::INT AS "left", "right"::INT AS "right",
       round(other, 4) AS other, round(target, 4) AS target FROM nodes"""


def _stump_query(name: str, model_id: str, members: str, weight: str, attach=None) -> None:
    @query(name, _stump_sql(members, weight))
    def _(spark, sf):
        """The trees after all rows as one chunk."""
        rows = _trainable(spark, sf)
        rows = rows if attach is None else attach(rows)
        model, _rows = learn.train(rows, model_id, settings=ONE_CHUNK, weight=None if attach is None else "sample_weight")
        return _node_rows(spark, model)


def _node_rows(spark, model) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.try_element_at("weights", F.lit(c)), F.lit(0.0)), 4).alias(c)
    return trees.node_table(spark, model).select(
        "member", "node_id", "feature", F.round("threshold", 6).alias("threshold"), "code", "left", "right", share("other"), share("target"))


_TEN = "(SELECT unnest(range(10)) AS member) m"
_DRAW = ("(SELECT " + _LADDER + " FROM (SELECT ('0x' || substr(md5('42.' || (m.member // 4) || '-0-' || t.packet_index),"
         " 1 + 8 * (m.member % 4)::INT, 8))::BIGINT AS u))::DOUBLE")
_stump_query("train_hoeffding_chunk", "adaptive_hoeffding_tree", "(SELECT 0 AS member) m", "1.0::DOUBLE")
_stump_query("train_leveraging_chunk", "leveraging_bag", _TEN, _DRAW)
_stump_query("train_boost_chunk", "oza_boost", _TEN, "1.0::DOUBLE")
_stump_query("train_boost_adwin_chunk", "oza_boost_adwin", _TEN, "1.0::DOUBLE")
_stump_query(
    "train_weighted_chunk", "adaptive_hoeffding_tree", "(SELECT 0 AS member) m",
    "(SELECT count(*) FROM trainable)::DOUBLE / (2 * (SELECT count(*) FROM trainable o WHERE o.label = t.label))", sampling.class_weights)


def _small_model(spark, sf):
    return learn.train(_trainable(spark, sf), "adaptive_hoeffding_tree", settings=FAST)


@query("train_online")
def _(spark, sf):
    weighted = sampling.class_weights(_trainable(spark, sf))
    model, rows = learn.train(
        weighted, "adaptive_hoeffding_tree", settings=FAST, weight="sample_weight")
    return trees.node_table(spark, model).where(F.col("feature").isNull()).select(
        F.lit(rows).alias("train_examples"), "node_id", "weights")


@query("model_roundtrip", _stump_sql(_TEN, _DRAW))
def _(spark, sf):
    """A trained model, stored and loaded again."""
    model, _rows = learn.train(_trainable(spark, sf), "leveraging_bag", settings=ONE_CHUNK)
    path = work_path(spark, "model")
    trees.save_model(spark, model, path)
    return _node_rows(spark, trees.load_model(spark, path))


@query("classify_frames", RULE_ALL + f" SELECT {PREDICTION_LIST} FROM rule_preds")
def _(spark, sf):
    return trees.classify(demo.features(spark, sf), _rule_model()).select(
        *[f.name for f in PREDICTIONS.fields])


@query("classify_dataset", RULE_ALL + f" SELECT {PREDICTION_LIST} FROM rule_preds")
def _(spark, sf):
    """The model is stored and loaded, the dataset and its predictions too."""
    path = work_path(spark, "model")
    trees.save_model(spark, _rule_model(), path)
    source = _stored_features(spark, sf, "parquet")
    return jobs.classify_dataset(
        spark, source, work_path(spark, "predictions") + ".parquet", trees.load_model(spark, path)
    ).select(*[f.name for f in PREDICTIONS.fields])


def _in_three_files(rows: DataFrame) -> DataFrame:
    """Rows of one file dealt to three, each with packet indexes of its own."""
    size = rows.agg(F.max("packet_index")).first()[0] // 3 + 1
    number = F.floor(F.col("packet_index") / size).cast("int")
    return rows.drop("frame_pos").withColumn("file_ordinal", number).withColumn(
        "source_file", F.concat(F.lit("part-"), number.cast("string"))
    ).withColumn("packet_index", F.col("packet_index") % size)


@query("presence_stored_dataset", RULE_ALL + ", preds AS (SELECT * FROM rule_preds)" + RULE_TARGETS + ROLLING + f"""
SELECT {PRESENCE_SQL} FROM rolling""")
def _(spark, sf):
    """Three capture files, stored as features, classified into stored predictions, then windows in file order."""
    source = work_path(spark, "features") + ".jsonl"
    rows = _in_three_files(demo.features(spark, sf)).select(*FEATURE_NAMES, "file_ordinal")
    datasets.write_dataset(rows, source, FEATURES)
    preds = jobs.classify_dataset(spark, source, work_path(spark, "predictions") + ".parquet", _rule_model())
    return _presence(preds, ["target"]).select(*PRESENCE)


@query("presence_replay_features", RULE_ALL + ", preds AS (SELECT * FROM rule_preds)" + RULE_TARGETS + ROLLING + REPLAY + f"""
SELECT r.{PRESENCE_SQL.replace(', ', ', r.')}, r.window_seq, r.final_window, c.window_seq IS NOT NULL AS is_change
FROM replay r LEFT JOIN changes c ON c.target_id = r.target_id AND c.window_type = r.window_type AND c.window_seq = r.window_seq""")
def _(spark, sf):
    """Stored features, scored and replayed in file order, with the changes of state."""
    source = work_path(spark, "features") + ".parquet"
    rows = _in_three_files(demo.features(spark, sf)).select(*FEATURE_NAMES, "file_ordinal")
    datasets.write_dataset(rows, source, FEATURES)
    preds = trees.classify(datasets.read_dataset(spark, source), _rule_model())
    events = materialise(win.replay_windows(preds, ["target"], demo.WINDOWS), "replayed")
    keys = ["target_id", "window_type", "window_seq"]
    changes = win.state_changes(events, stored=True).select(*keys, F.lit(True).alias("is_change"))
    return events.join(changes, keys, "left").select(
        *PRESENCE, "window_seq", "final_window", F.coalesce("is_change", F.lit(False)).alias("is_change"))


@query("eval_holdout")
def _(spark, sf):
    metrics, _preds = jobs.evaluate_holdout(
        sampling.chronological_split(_trainable(spark, sf), 0.9), "adaptive_hoeffding_tree",
        settings=FAST)
    return _shown(metrics)


def _shown(metrics: DataFrame) -> DataFrame:
    """A metrics document with its nested parts as JSON text."""
    nested = ("labels", "per_class", "confusion_matrix")
    return metrics.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in metrics.columns])


@query("eval_prequential")
def _(spark, sf):
    _model, preds = learn.prequential(
        _trainable(spark, sf), "adaptive_hoeffding_tree", settings=FAST)
    return _shown(jobs.prediction_metrics(preds))


@query("comparison_plan", FRACTION_SQL + """
SELECT model_id, train_fraction, train_rows, total - train_rows AS test_rows FROM cuts
CROSS JOIN (VALUES ('adaptive_hoeffding_tree'), ('leveraging_bag'), ('oza_boost'),
                   ('oza_boost_adwin')) AS m(model_id)""")
def _(spark, sf):
    return jobs.comparison_plan(
        demo.labelled(spark, sf, demo.MULTI), list(learn.MODEL_MAPPINGS), FRACTIONS)


@query("compare_models")
def _(spark, sf):
    results = jobs.compare_models(
        _trainable(spark, sf), list(learn.MODEL_MAPPINGS), FRACTIONS, settings=FAST)
    return jobs.top_by_f1(results)


@query("pipeline_prepare", LABEL_MULTI + """,
numbered AS (SELECT row_number() OVER (ORDER BY packet_index) - 1 AS pos FROM labelled
             WHERE frame_type IS NULL OR frame_type <> 1)
SELECT 'records' AS stage, count(*) AS row_count FROM records
UNION ALL SELECT 'features', count(*) FROM feats
UNION ALL SELECT 'labels', count(*) FROM numbered
UNION ALL SELECT 'train', floor(count(*)::DOUBLE * 0.9)::BIGINT FROM numbered
UNION ALL SELECT 'test', count(*) - floor(count(*)::DOUBLE * 0.9)::BIGINT FROM numbered""")
def _(spark, sf):
    out = jobs.prepare(
        demo.records(spark, sf), demo.targets(spark), work_path(spark, "prepared"),
        filters=FilterSettings(include_control=False), labels=demo.MULTI)
    return out.manifest


@query("pipeline_train_eval")
def _(spark, sf):
    rows = sampling.chronological_split(_trainable(spark, sf), 0.9)
    return jobs.train_eval(
        spark, rows, work_path(spark, "run"), "adaptive_hoeffding_tree", ["target"],
        windows=demo.WINDOWS, settings=FAST).manifest


# --- streaming -------------------------------------------------------------------------------


def _landed(spark, sf, preds, consume) -> None:
    """Land the rows in two slices of file order; run the consumer after each."""
    landing = work_path(spark, "landing")
    size = preds.agg(F.max("packet_index")).first()[0] + 1
    for low, high in ((0, size * 2 // 5), (size * 2 // 5, size)):
        preds.where(F.col("packet_index").between(low, high - 1)).write.mode("append").parquet(
            landing)
        consume(stream.landing_stream(spark, landing, preds.schema))


def _landed_until_end(spark, sf, preds, consume) -> None:
    """As ``_landed``, with an end marker behind the last row."""
    landing = work_path(spark, "landing")
    schema = T.StructType([*preds.schema.fields, T.StructField(flushing.END_OF_STREAM, T.BooleanType())])
    size = preds.agg(F.max("packet_index")).first()[0] + 1
    for low, high in ((0, size * 2 // 5), (size * 2 // 5, size)):
        preds.where(F.col("packet_index").between(low, high - 1)).write.mode("append").parquet(landing)
        consume(stream.landing_stream(spark, landing, schema))
    flushing.mark_end(spark, landing)
    consume(stream.landing_stream(spark, landing, schema))


def _replayed(spark, sf, targets, preds):
    engine = stream.ReplayEngine(spark, targets, demo.WINDOWS, work_path(spark, "replay-state"))
    _landed(spark, sf, preds, engine.run)
    engine.finish()
    return engine


@query("stream_replay", MULTI + ROLLING + REPLAY + f"""
SELECT {PRESENCE_SQL}, window_seq, final_window FROM replay""")
def _(spark, sf):
    engine = _replayed(spark, sf, TARGETS, demo.multi_predictions(spark, sf))
    return engine.events().select(*PRESENCE, "window_seq", "final_window")


@query("stream_frame_windows", BIN + ROLLING + f"""
SELECT {PRESENCE_SQL} FROM rolling WHERE window_type = 'frame_count'""")
def _(spark, sf):
    engine = _replayed(spark, sf, ["target"], demo.binary_predictions(spark, sf))
    return engine.events().where(F.col("window_type") == "frame_count").select(*PRESENCE)


@query("stream_multitarget", MULTI + ROLLING + REPLAY + """
SELECT target_id, window_type, state, count(*) AS windows, sum(frame_count)::BIGINT AS frames
FROM replay GROUP BY ALL""")
def _(spark, sf):
    engine = _replayed(spark, sf, TARGETS, demo.multi_predictions(spark, sf))
    return engine.events().groupBy("target_id", "window_type", "state").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("frame_count").alias("frames"))


@query("stream_changes", MULTI + ROLLING + REPLAY + """
SELECT target_id, window_type, window_seq, state FROM changes""")
def _(spark, sf):
    engine = _replayed(spark, sf, TARGETS, demo.multi_predictions(spark, sf))
    return engine.changes().select("target_id", "window_type", "window_seq", "state")


@query("stream_time_windows", BIN + ROLLING + f"""
SELECT {PRESENCE_SQL} FROM rolling WHERE window_type = 'time'""")
def _(spark, sf):
    """Windows that the watermark closes, and at the end those that are still open."""
    sink = flushing.WindowSink(spark, ["target"], demo.WINDOWS, "3600 seconds",
                               work_path(spark, "time-windows"))
    _landed_until_end(spark, sf, demo.binary_predictions(spark, sf), sink.run)
    return sink.windows().select(*PRESENCE)


@query("stream_window_changes", MULTI + ROLLING + """,
ordered AS (SELECT target_id, window_type, window_seq, state,
                   lag(state) OVER (PARTITION BY target_id ORDER BY window_seq) AS before FROM rolling WHERE window_type = 'time')
SELECT target_id, window_type, window_seq, state FROM ordered WHERE state IS DISTINCT FROM before""")
def _(spark, sf):
    """Windows and their changes as two stateful steps of one query."""
    sink = flushing.WindowSink(spark, TARGETS, demo.WINDOWS, "3600 seconds", work_path(spark, "changes"), changes=True)
    _landed_until_end(spark, sf, demo.multi_predictions(spark, sf), sink.run)
    return sink.windows().select("target_id", "window_type", "window_seq", "state")


@query("stream_classify", RULE_ALL + f" SELECT {PREDICTION_LIST} FROM rule_preds")
def _(spark, sf):
    sink = stream.ClassifySink(spark, _rule_model(), work_path(spark, "live"))
    _landed(spark, sf, demo.features(spark, sf), sink.run)
    return sink.predictions().select(*[f.name for f in PREDICTIONS.fields])


LIVE = RULE_ALL + """, preds AS (
  SELECT * FROM rule_preds WHERE pos < (SELECT (max(packet_index) + 1) * 3 // 5 FROM feats))""" + RULE_TARGETS + ROLLING + REPLAY


@query("presence_live", LIVE + f"""
SELECT 'event' AS kind, {PRESENCE_SQL}, window_seq, final_window FROM replay
UNION ALL SELECT 'change', NULL, NULL, target_id, NULL, NULL, NULL, NULL, state, window_type, window_seq, NULL FROM changes
UNION ALL SELECT 'prediction', timestamp, NULL, predicted_class, pos, confidence, NULL, NULL, NULL, NULL, NULL, NULL FROM preds""")
def _(spark, sf):
    """Landed feature rows, scored, windowed and watched for changes in one stream, up to a number of packets."""
    rows = demo.features(spark, sf)
    most = (rows.agg(F.max("packet_index")).first()[0] + 1) * 3 // 5
    engine = stream.LiveEngine(
        spark, _rule_model(), ["target"], demo.WINDOWS, work_path(spark, "live-state"), max_packets=most)
    _landed(spark, sf, rows, engine.run)
    engine.finish()

    def told(kind, rows):
        return rows.withColumn("kind", F.lit(kind))

    preds = engine.predictions().select(
        F.col("timestamp").alias("window_start"), F.col("predicted_class").alias("target_id"),
        F.col("packet_index").alias("frame_count"), F.col("confidence").alias("mean_probability"))
    changes = engine.changes().select("target_id", "window_type", "window_seq", "state")
    events = told("event", engine.events().select(*PRESENCE, "window_seq", "final_window"))
    return events.unionByName(told("change", changes), True).unionByName(told("prediction", preds), True)
