"""N-gram Jaccard join: rare-first prefixes, length, position and suffix filters, one check per pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ethersense.llm.linking import link_components, maybe_member, membership
from ethersense.llm.names import free_name
from ethersense.llm.textwork import mix64, pieces, row_shingles, signed, text_bytes
from ethersense.session import bounded, discard, materialise

#: Counters of the frequency sketch: a fixed 4 MB however large the corpus is.
SKETCH_BITS = 20
SKETCH_BLOCK = 1024
#: Parts of the hash space that the suffix filter counts.
SUFFIX_PARTS = 64
#: Words of 64 bits that mark which parts of the hash space a set has shingles in.
MARKS = 4


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _node(hashes: np.ndarray) -> int:
    """Identity of a shingle set."""
    if not len(hashes):
        return 0
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return int(signed(mix64(np.array([mix64(hashes + place * np.uint64(0x9E3779B97F4A7C15)).sum()]) ))[0])


def _profile(hashes: np.ndarray) -> bytes:
    """How many shingles fall into each part of the hash space."""
    part = ((hashes >> np.uint64(8)) & np.uint64(SUFFIX_PARTS - 1)).astype(np.int64)
    return np.bincount(part, minlength=SUFFIX_PARTS).astype("<u4").tobytes()


def _marks(hashes: np.ndarray) -> np.ndarray:
    """One bit per part of the hash space, set where a shingle falls into it."""
    bits = np.zeros(64 * MARKS, bool)
    bits[((hashes >> np.uint64(20)) % np.uint64(64 * MARKS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _survey(k: int):
    """Per row its set size, identity and profile; per task one frequency sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in pieces(batches, "text"):
            sets = row_shingles(*text_bytes(batch.column("text")), k)
            full = [s for s in sets if len(s)]
            if full:
                counts += np.bincount(_bucket(np.concatenate(full)), minlength=len(counts))
            yield pa.record_batch([
                pa.array([False] * len(sets)), batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()),
                pa.array([_profile(s) for s in sets], pa.binary()),
            ], names=["is_sketch", "doc_id", "n", "node", "data"])
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        busy = np.flatnonzero(blocks.any(axis=1))
        if len(busy):
            yield pa.record_batch([
                pa.array([True] * len(busy)), pa.nulls(len(busy), pa.int64()), pa.array(busy, pa.int64()),
                pa.nulls(len(busy), pa.int64()), pa.array([blocks[i].astype("<i8").tobytes() for i in busy], pa.binary()),
            ], names=["is_sketch", "doc_id", "n", "node", "data"])

    return run


def _add_blocks(batches):
    """Sum the sketches' blocks while they stream by; holds one sketch at most."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            part = np.frombuffer(data, "<i8")
            total[block] = total[block] + part if block in total else part
    if total:
        yield pa.record_batch([
            pa.array(list(total), pa.int64()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary()),
        ], names=["block", "data"])


def _prefixes(k: int, percent: int, sketch):
    """The rare-first prefix of each row's set: fewest counted first, ties by hash."""

    def run(batches):
        counts = np.frombuffer(sketch.value, "<i8")
        for batch in pieces(batches, "text"):
            keys, nodes, sizes, places, marks = [], [], [], [], []
            for s in row_shingles(*text_bytes(batch.column("text")), k):
                n = len(s)
                if not n:
                    continue
                often = counts[_bucket(s)]
                length = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, often))[:length]
                place = np.flatnonzero(often[order] > 1)  # counted once: no other row can have it
                keys.append(s[order[place]])
                places.append(place)
                sizes.append(np.full(len(place), n))
                nodes.append(np.full(len(place), _node(s)))
                marks.append(np.broadcast_to(_marks(s), (len(place), MARKS)))
            if keys:
                marked = np.concatenate(marks)
                yield pa.record_batch([
                    pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(nodes).astype(np.int64)),
                    pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(marked[:, i])) for i in range(MARKS)],
                ], names=["key", "node", "n", "pos", *[f"m{i}" for i in range(MARKS)]])

    return run


def _same_profile(percent: int):
    """Suffix filter: sets whose part counts differ by more than the allowed symmetric difference fail."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SUFFIX_PARTS).astype(np.int64) for c in ("x", "y"))
            total = x.sum(1) + y.sum(1)
            need = -(-percent * total // (100 + percent))
            keep = np.abs(x - y).sum(1) <= total - 2 * need
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _check(k: int, percent: int):
    """Jaccard similarity of both texts' shingle sets, in whole numbers."""

    def run(batches):
        for batch in pieces(pieces(batches, "x"), "y"):
            left = row_shingles(*text_bytes(batch.column("x")), k)
            right = row_shingles(*text_bytes(batch.column("y")), k)
            keep = []
            for s, t in zip(left, right):
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spot(nodes: np.ndarray, ids: pa.Array) -> np.ndarray:
    """One number for a set and a row id (null as 0), for a membership map."""
    own = np.asarray(pc.fill_null(ids, 0)).astype(np.int64).view(np.uint64)
    return signed(mix64(nodes.view(np.uint64) + mix64(own)))


def _spots(batches):
    """A number for each set with its row id, and one for the row id alone."""
    for batch in batches:
        nodes, ids = np.asarray(batch.column("node")), batch.column("doc_id")
        both = np.concatenate([_spot(nodes, ids), _spot(np.zeros(len(nodes), np.int64), ids)])
        yield pa.record_batch([pa.array(both)], names=["spot"])


def _with_node(k: int, likely):
    """Sets and texts, less the rows that surely are none of the ``likely`` spots; only rows of likely ids are cut into shingles."""

    def owned(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            kept = batch.filter(pa.array(maybe_member(likely, _spot(np.zeros(len(ids), np.int64), ids))))
            if kept.num_rows:
                yield kept

    def run(batches):
        for batch in pieces(owned(batches), "text"):
            sets = row_shingles(*text_bytes(batch.column("text")), k)
            nodes = np.array([_node(s) for s in sets], np.int64)
            keep = pa.array(maybe_member(likely, _spot(nodes, batch.column("doc_id"))))
            yield pa.record_batch([pa.array(nodes).filter(keep), batch.column("text").filter(keep)], names=["node", "text"])

    return run


def _node_of(k: int):
    """Identity of each text's shingle set, 0 without words."""

    @F.pandas_udf(LongType())
    def run(text: pd.Series) -> pd.Series:
        batch = pa.record_batch([pa.array(text, pa.string())], names=["text"])
        found = [_node(s) for b in pieces(iter([batch]), "text") for s in row_shingles(*text_bytes(b.column("text")), k)]
        return pd.Series(found, dtype="int64")

    return run


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Two rows link when ``100 * |A and B| >= percent * |A or B|`` for their distinct ``words``-word shingles.
    A row with fewer words has its whole word sequence as one shingle. Null, empty and blank texts have no
    shingle and link with nothing: their component is their own id. Equal sets are one node, so
    copies and repeated rows share a component. Null ids count last: a component of only such rows is null.

    The prefix order is any global order; here the counts of a fixed-size sketch over all rows, then the hash.
    Shingles and sets are told apart by 64-bit hashes.
    """
    sets, first = _linked_sets(docs, words, percent)
    least = first.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = first.join(least, "component").select("node", "component_id")
    return sets.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _linked_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, node, data)`` per row, and ``(node, doc_id, component)`` per set with its smallest id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = materialise(
        docs.mapInArrow(_survey(words), "is_sketch boolean, doc_id long, n long, node long, data binary"),
        "shingle-survey", ("is_sketch",),
    )
    sets = survey.where(~F.col("is_sketch")).select("doc_id", "n", "node", "data")
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64).reshape(-1, SKETCH_BLOCK)
    blocks = survey.where("is_sketch").select(F.col("n").alias("block"), "data").repartition("block")
    for row in blocks.mapInArrow(_add_blocks, "block long, data binary").collect():
        counts[row["block"]] = np.frombuffer(row["data"], "<i8")
    sketch = spark.sparkContext.broadcast(counts.astype("<i8").tobytes())

    marks = [f"m{i}" for i in range(MARKS)]
    prefixes = materialise(
        docs.mapInArrow(_prefixes(words, percent, sketch), "key long, node long, n int, pos int, " + ", ".join(f"{m} long" for m in marks)), "prefixes"
    )
    keyed = prefixes.select("key", "node", F.struct("n", "pos", *marks).alias("meta"))

    def passes(x: Column, y: Column) -> Column:
        n, m, i, j = x["n"].cast("long"), y["n"].cast("long"), x["pos"], y["pos"]
        length = (100 * n >= percent * m) & (100 * m >= percent * n)
        # with an overlap of at least need, the first n - need + 1 and m - need + 1 shingles share one
        need = F.ceil(percent * (n + m) / (100 + percent) - 1e-9)
        prefix = (i <= n - need) & (j <= m - need)
        most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
        # a part that only one set marks holds a shingle that the other lacks
        lacks = sum((F.bit_count(x[m].bitwiseAND(F.bitwise_not(y[m]))) for m in marks), F.lit(0)) <= n - need
        lacked = sum((F.bit_count(y[m].bitwiseAND(F.bitwise_not(x[m]))) for m in marks), F.lit(0)) <= m - need
        return length & prefix & (most >= need) & lacks & lacked

    profile = sets.where("n > 0").groupBy("node").agg(
        F.min("data").alias("data"), F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("has_null")
    )
    profile = materialise(profile, "profiles")

    def verify(pairs: DataFrame) -> DataFrame:
        x = profile.select(F.col("node").alias("a"), F.col("data").alias("x"))
        y = profile.select(F.col("node").alias("b"), F.col("data").alias("y"))
        pairs = materialise(
            pairs.join(x, "a").join(y, "b").mapInArrow(_same_profile(percent), "a long, b long"), "pairs"
        )
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = materialise(ids.join(profile, "node").select("node", "doc_id"), "pair-nodes")
        # the first row of a set stands for it; rows without an id are looked through as a whole
        likely = membership(ids.mapInArrow(_spots, "spot long"))
        texts = docs.mapInArrow(_with_node(words, likely), "node long, text string")
        wanted, _ = bounded(ids.select("node"))
        texts = materialise(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "pair-texts")
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        found = materialise(pairs.join(x, "a").join(y, "b").mapInArrow(_check(words, percent), "a long, b long"), "verified")
        discard(pairs, ids, texts)
        return found

    parts = link_components(keyed, passes, verify, stored=[prefixes])
    return sets, profile.select("node", "doc_id").join(parts, "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("component")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the first by (doc_id, set), null ids last.

    Texts without words all stay. Of rows equal in id and set one stays; rows that share an id, or have none,
    but whose texts do not hang together are kept apart.
    """
    sets, linked = _linked_sets(docs, words, percent)
    rows = sets.where("n > 0").groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "rows")
    first = rows.join(linked.select("node", "component"), "node").groupBy("component").agg(F.min(order).alias("first"))
    node, first_node, first_id, count = (free_name(docs, x) for x in ("_node", "_first_node", "_first_id", "_rows"))
    first = materialise(first.select(
        F.col("first.node").alias(first_node), F.col("first.doc_id").alias(first_id), F.col("first.rows").alias(count)
    ), "first-rows")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(~blank).withColumn(node, _node_of(words)(F.col("text").cast("string"))).join(
        first, (F.col(node) == F.col(first_node)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first_id))
    )
    many = rows.where(F.col(count) > 1).dropDuplicates([node])
    kept = rows.where(F.col(count) == 1).unionByName(many).select(*docs.columns)
    return docs.where(blank).unionByName(kept)
