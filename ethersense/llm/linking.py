"""Groups of rows that share keys and pass a test, without listing all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.llm.components import connected_components
from ethersense.session import discard, materialise

#: Bits of a membership map: a fixed 8 MB however many values there are.
MAP_BITS = 26
_MAP_BLOCK = 1 << 13
#: Rows of a key that its others are tested against in one round, and most such rounds.
LEADERS = 16
ROUNDS = 3
#: A round takes part in keys, and goes on, where it may save more than so many tests a row.
TESTS_A_ROW = 4
#: No round follows one in which no more than one candidate in so many was a link.
RARE = 32


def membership(values: DataFrame) -> Broadcast:
    """A bit map of the one long column of ``values``, well mixed hashes, for ``maybe_member``.

    Its size is fixed. Values beyond its capacity only make more of the others pass, so it may thin out rows ahead
    of an exact join but replaces none.
    """
    blocks = (1 << MAP_BITS) // 8 // _MAP_BLOCK

    def mark(batches):
        bits = np.zeros(1 << MAP_BITS, bool)
        for batch in batches:
            bits[_map_place(np.asarray(batch.column(0)))] = True
        packed = np.packbits(bits, bitorder="little").reshape(blocks, _MAP_BLOCK)
        busy = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(busy), pa.array([packed[i].tobytes() for i in busy], pa.binary())], names=["block", "bits"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                part = np.frombuffer(bits, np.uint8)
                total[block] = total[block] | part if block in total else part
        yield pa.record_batch(
            [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "bits"]
        )

    schema = "block long, bits binary"
    packed = np.zeros((blocks, _MAP_BLOCK), np.uint8)
    for row in values.mapInArrow(mark, schema).repartition("block").mapInArrow(add, schema).collect():
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return values.sparkSession.sparkContext.broadcast(packed.tobytes())


def _map_place(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def maybe_member(found: Broadcast, values: np.ndarray) -> np.ndarray:
    """False for values that are surely not in the map."""
    place = _map_place(values)
    bits = np.frombuffer(found.value, np.uint8)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def link_components(
    keyed: DataFrame,
    passes: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame], DataFrame],
    repeated: bool = False,
    stored: Iterable[DataFrame] = (),
    pairs: DataFrame | None = None,
    others: int = 0,
) -> DataFrame:
    """``(node, component)`` of the nodes linked with another one.

    ``keyed`` has ``key``, ``node`` and a struct ``meta``; two nodes are candidates when they share a key
    and ``passes(meta, meta)`` holds. ``verify`` takes distinct pairs ``(a, b)`` and keeps the linked ones.
    ``repeated`` says that ``keyed`` may have equal rows. The tables ``stored`` are removed once ``keyed`` has been read.

    The candidates ``pairs`` ``(a, b)`` are of the ``others`` rows left out of ``keyed`` and tested along with its first. First every node is tested against one other, the smallest that leads one of its keys; that joins most of a
    large group of copies with one test a row. Up to ``ROUNDS`` rounds follow over keys whose nodes hang together only in part,
    as in a large group of near copies, while much is left to join in them (``_open_rows``). In each, every node of such a key is
    tested against at most ``LEADERS`` others of other components, one of each
    hash class, with other classes in each round; so the group grows together with few tests a node. The rows of other keys,
    of which most candidates are no links, wait. At last the nodes outside the component that has most of their key's nodes are tested
    against all rows of other components. Links inside a component that already hangs together change no
    component, so the result equals that of testing all pairs.
    """
    shared = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    shared = materialise(shared.select("key"), "shared-keys")
    likely = membership(shared)

    def thin(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe_member(likely, np.asarray(batch.column("key")))))

    rows = keyed.mapInArrow(thin, keyed.schema).join(shared, "key")
    rows = materialise(rows.distinct() if repeated else rows, "keyed")
    discard(shared, *stored)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    head = rows.groupBy("key").agg(F.min(F.struct("node", "meta")).alias("lead"))
    single = rows.join(head, "key").where((F.col("node") != F.col("lead.node")) & passes(F.col("meta"), F.col("lead.meta")))
    single = single.groupBy("node").agg(F.min("lead.node").alias("other"))
    tested = ordered(single)
    tested = materialise(tested if pairs is None else tested.union(pairs.select("a", "b").distinct()).distinct(), "pairs")
    links = materialise(verify(tested).select("a", "b"), "linked")
    rows, most = _open_rows(rows, connected_components(links))
    wide, total, much = rows, None, F.col("joint") > TESTS_A_ROW
    for turn in range(ROUNDS):
        work = most.agg(F.sum("n").alias("rows"), F.sum(F.when(much, F.col("joint") * F.col("n"))).alias("tests")).first()
        total = (work["rows"] or 0) + others if total is None else total
        if (work["tests"] or 0) <= TESTS_A_ROW * total:
            break
        draw = F.xxhash64("node", F.lit(turn))
        open_rows = wide.where(much).select("key", "node", "meta", "part")
        lead = open_rows.groupBy("key", F.pmod(draw, F.lit(LEADERS)).alias("class")).agg(
            F.min_by(F.struct("node", "meta", "part"), F.struct(draw, "node")).alias("lead")
        )
        near = open_rows.join(lead, "key").where((F.col("part") != F.col("lead.part")) & passes(F.col("meta"), F.col("lead.meta")))
        more = near.groupBy("node", "class").agg(F.min("lead.node").alias("other"))
        more = materialise(ordered(more).join(tested, ["a", "b"], "left_anti"), "pairs")
        joined = materialise(verify(more).select("a", "b"), "linked")
        old, links = links, materialise(links.union(joined), "linked")
        rare = joined.count() * RARE <= more.count()
        discard(old, joined, most)
        tested = tested.union(more)
        old, (wide, most) = wide, _open_rows(open_rows, connected_components(links))
        if old is not rows:
            discard(old)
        if rare:
            break
    discard(most)
    if wide is not rows:
        discard(wide)
        rows, most = _open_rows(rows, connected_components(links))
        discard(most)
    stored_rows, rows = rows, rows.drop("joint")
    other = rows.where("part <> head_part").select(
        "key", F.col("node").alias("a"), F.col("meta").alias("a_meta"), F.col("part").alias("a_part")
    )
    second = other.join(rows, "key").where(
        (F.col("part") != F.col("a_part"))
        & ((F.col("part") == F.col("head_part")) | (F.col("a") < F.col("node")))
        & passes(F.col("a_meta"), F.col("meta"))
    ).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    second = materialise(second.join(tested, ["a", "b"], "left_anti"), "pairs")
    discard(stored_rows)
    last = materialise(verify(second).select("a", "b"), "linked")
    found = connected_components(links.union(last))
    discard(second, links, last)
    return found


def _open_rows(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their component of the keys whose nodes lie in several, and these keys; stored ``rows`` and ``parts`` go.

    The second is ``(key, n, head_part, joint)``: the rows of a key, its component with most of them, and the rows outside it times
    the share of rows that hang together with another one of the key: about how many tests of each row a further round may save.
    Where next to no candidates are links it is small, however many there are. The rows carry the last two.
    """
    part = parts.select("node", F.col("component").alias("part"))
    named = rows.select("key", "node", "meta").join(part, "node", "left").select(
        "key", "node", "meta", F.coalesce("part", "node").alias("part")
    )
    named = materialise(named, "named")
    discard(rows, parts)
    sizes = named.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.sum("m").alias("n"), F.max(F.struct("m", "part")).alias("head"), F.count("*").alias("parts")
    )
    n, outside = F.col("n"), F.col("n") - F.col("head.m")
    keys = sizes.where("parts > 1").select("key", "n", F.col("head.part").alias("head_part"), (outside * (n - F.col("parts")) / n).alias("joint"))
    keys = materialise(keys, "apart-keys")
    kept = materialise(named.join(keys.select("key", "head_part", "joint"), "key"), "keyed")
    discard(named)
    return kept, keys
