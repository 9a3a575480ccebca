"""Conversation structure repair by an auction for shortest paths.

A conversation's cheapest repair is a shortest path through a lattice of (rows consumed, what the roles so far allow)
with the arcs Delete, Insert, Keep and Rerole at whole costs. The auction holds a price for every node, none above an
arc's cost plus the price at its end, and a path from the origin: where the last node's price is below its best arc it
is raised and the path contracts, where it equals it the path extends. Once the path arrives, the prices on it are exact
distances, and an arc is tight (part of a cheapest repair) where cost and end price add up to the price. The trace takes
the first tight arc in ASCII order of the initials; an end whose price is not yet exact is made the origin of another
auction first, which either confirms the arc or lifts the price above it. Many lattices are worked on at once in numpy.

Long conversations are cut into blocks of ``BLOCK`` lattice rows wherever Spark's range partitions put them. A block's
costs from each entry to each exit, 4 by 4, join in groups of up to ``FAN`` blocks, level by level; the end prices come
back down the same way, so that every block is traced on its own. Only the SHA-256 of a repaired conversation, which has
no parallel form, is fed by one task row after row, without holding them.

* ``conv_id`` and ``turn`` are whole numbers. Null ``conv_id`` rows form one conversation, returned as null. A null role or
  text counts as one space, as null ids and turns do in the hashed key; null turns come first and take no part in ``gaps``.
* Rows of one turn are ordered by role and text (after damage); repeated rows stand beside each other and are worked on
  as one row with a count. A null turn gives equal rows the same way.
* A role that begins with none of ``s``, ``u``, ``a`` (or is empty) is never kept. Initials are case-sensitive.
* Empty and blank texts must be deleted. A conversation without rows after damage gives zeros, an empty audit and the
  hash of nothing; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.session import materialise

BLOCK = 64
FAN_BITS = 6
#: Conversations that are worked on at once, and the bytes of text kept for them.
TOGETHER, HELD_BYTES = 512, 1 << 23
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
LABELS = "DIKR"
_D, _I, _K, _R = range(4)
_TURNS_TO = np.array([2, 2, 3, 2])  # where an inserted or re-roled row leads
_KEEPS = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by role s, u, a, other
_ROLE = {"s": 0, "u": 1, "a": 2}
_NAME = {2: "user", 3: "assistant"}
INF = np.int64(1) << np.int64(60)
END_PRICES = (0, 4, 2, 0)  # inserts that complete the last pair
END_LABELS = ("", "II", "I", "")


class Lattices:
    """Several lattices side by side: arcs ``to``, ``cost`` (4 a node), ``price``, which prices are exact, sinks."""

    def __init__(self, to: np.ndarray, cost: np.ndarray, price: np.ndarray, sink: np.ndarray) -> None:
        self.to, self.cost, self.price, self.sink = to, cost, price, sink
        self.exact = sink | (price >= INF)
        self._stack = np.empty(len(price), np.int64)

    def settle(self, origins: np.ndarray, floor: np.ndarray) -> None:
        """Auctions from one origin in each of several lattices until the origins' prices are exact.

        ``floor`` is the first node of each origin's lattice; a path has no more nodes than its lattice."""
        todo = ~self.exact[origins]
        at, base = origins[todo], floor[todo]
        depth = np.zeros(len(at), np.int64)
        self._stack[base] = at
        while len(at):
            offers = self.cost[at] + self.price[self.to[at]]
            best = offers.argmin(axis=1)
            least = offers[np.arange(len(at)), best]
            tight = self.price[at] == least
            raised = ~tight
            self.price[at[raised]] = least[raised]
            depth = np.where(tight, depth + 1, np.maximum(depth - 1, 0))
            out = np.flatnonzero(tight)
            self._stack[base[out] + depth[out]] = self.to[at[out], best[out]]
            at = self._stack[base + depth]
            there = tight & self.exact[at]
            if there.any():
                ends = np.flatnonzero(there)
                sizes = depth[ends]
                heads = np.cumsum(sizes) - sizes
                steps = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
                self.exact[self._stack[np.repeat(base[ends], sizes) + steps]] = True
                left = ~there
                at, base, depth = at[left], base[left], depth[left]

    def trace(self, origins: np.ndarray, floor: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The least label string of a cheapest path from each origin, and the sink it ends in."""
        at = origins.copy()
        self.settle(at, floor)
        who, what = [], []
        lanes = np.flatnonzero(~self.sink[at] & (self.price[at] < INF))
        while len(lanes):
            here = at[lanes]
            tight = self.cost[here] + self.price[self.to[here]] == self.price[here][:, None]
            first = tight.argmax(axis=1)
            there = self.to[here, first]
            sure = self.exact[there]
            if not sure.all():
                self.settle(there[~sure], floor[lanes[~sure]])
            who.append(lanes[sure])
            what.append(first[sure])
            at[lanes[sure]] = there[sure]
            lanes = lanes[~self.sink[at[lanes]]]
        if not who:
            return [""] * len(at), at
        who, what = np.concatenate(who), np.concatenate(what)
        letters = np.frombuffer(LABELS.encode(), np.uint8)[what[np.argsort(who, kind="stable")]].tobytes().decode()
        ends = np.cumsum(np.bincount(who, minlength=len(at)))
        return [letters[b - n : b] for b, n in zip(ends.tolist(), np.bincount(who, minlength=len(at)).tolist())], at


def row_lattices(codes: list, ends: np.ndarray) -> tuple[Lattices, np.ndarray, np.ndarray]:
    """Lattices of rows with end prices ``ends`` (4 each); returned with each one's first and last four nodes.

    A code below 0 is that many rows which must be deleted; others are role + 4 if the row is truncated."""
    sizes = np.array([len(c) for c in codes], np.int64)
    rows = np.concatenate([np.asarray(c, np.int64) for c in codes]) if sizes.sum() else np.empty(0, np.int64)
    lane = np.repeat(np.arange(len(codes)), sizes)
    layer = np.arange(len(rows)) + lane
    first = 4 * (np.cumsum(sizes + 1) - sizes - 1)
    last = first + 4 * sizes
    layers = int(sizes.sum()) + len(codes)
    forced = rows < 0
    late = np.where(forced, 0, rows >> 2)
    role = np.where(forced, 3, rows & 3)
    state = np.arange(4)
    to = np.repeat(np.arange(4 * layers).reshape(layers, 4, 1), 4, axis=2)
    cost = np.full((layers, 4, 4), INF)
    nxt = 4 * (layer + 1)[:, None]
    to[layer, :, _D], cost[layer, :, _D] = nxt + state, np.where(forced, -3 * rows, 3)[:, None]
    to[layer, :, _I], cost[layer, :, _I] = 4 * layer[:, None] + _TURNS_TO, 2
    keeps = _KEEPS[role]
    to[layer, :, _K] = nxt + np.maximum(keeps, 0)
    cost[layer, :, _K] = np.where(keeps >= 0, late[:, None], INF)
    to[layer, :, _R] = nxt + _TURNS_TO
    cost[layer, :, _R] = np.where(forced, INF, 2 + late)[:, None]

    def after(values: np.ndarray) -> np.ndarray:  # sum of a row's value and those after it in its lattice
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[np.cumsum(sizes)][lane] - upto[:-1]

    open_to = ends < INF
    reach = np.zeros((layers, 4), bool)
    systems = after((role == 0).astype(np.int64)) > 0
    pair = (open_to[:, 2] | open_to[:, 3])[lane]
    reach[layer, 0] = open_to[lane, 0] | pair | (open_to[lane, 1] & systems)
    reach[layer, 1] = open_to[lane, 1] | pair
    reach[layer, 2] = reach[layer, 3] = pair
    price = np.full((layers, 4), INF)
    least = ends.min(axis=1)
    price[layer] = (after(np.where(forced, -3 * rows, late)) + least[lane])[:, None]  # what the rows cost at least
    price[~reach] = INF
    sink = np.zeros((layers, 4), bool)
    price[last // 4], sink[last // 4] = ends, True
    return Lattices(to.reshape(-1, 4), cost.reshape(-1, 4), price.reshape(-1), sink.reshape(-1)), first, last


def block_costs(codes: list) -> np.ndarray:
    """Cheapest cost of each block from every entry to every exit, ``INF`` where there is no way."""
    ends = np.where(np.eye(4, dtype=bool), 0, INF)
    graph, first, _ = row_lattices([c for c in codes for _ in range(4)], np.tile(ends, (len(codes), 1)))
    for entry in range(4):
        graph.settle(first + entry, first)
    found = graph.price[first[:, None] + np.arange(4)].reshape(len(codes), 4, 4)  # block, exit, entry
    return found.transpose(0, 2, 1)


def block_traces(codes: list, ends: np.ndarray) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """Prices, labels and exits of each block from every entry, given the prices at its end."""
    graph, first, last = row_lattices([c for c in codes for _ in range(4)], np.repeat(ends, 4, axis=0))
    origins = first + np.tile(np.arange(4), len(codes))
    labels, at = graph.trace(origins, first)
    shape = (len(codes), 4)
    exits = np.where(graph.price[origins] < INF, at - last, -1).reshape(shape)
    return graph.price[origins].reshape(shape), [labels[4 * i : 4 * i + 4] for i in range(len(codes))], exits


def repairs(codes: list) -> list[tuple[int, str]]:
    """Cost and labels of whole conversations."""
    graph, first, last = row_lattices(codes, np.tile(np.array(END_PRICES, np.int64), (len(codes), 1)))
    labels, at = graph.trace(first, first)
    return [(int(p), text + END_LABELS[e]) for p, text, e in zip(graph.price[first], labels, (at - last).tolist())]


def chain_lattices(chains: list, ends: np.ndarray) -> tuple[Lattices, np.ndarray, np.ndarray]:
    """Lattices whose layers are blocks with known costs between entries and exits."""
    sizes = np.array([len(c) for c in chains], np.int64)
    costs = np.concatenate([np.asarray(c, np.int64).reshape(-1, 4, 4) for c in chains])
    lane = np.repeat(np.arange(len(chains)), sizes)
    layer = np.arange(len(costs)) + lane
    first = 4 * (np.cumsum(sizes + 1) - sizes - 1)
    last = first + 4 * sizes
    layers = int(sizes.sum()) + len(chains)
    to = np.repeat(np.arange(4 * layers).reshape(layers, 4, 1), 4, axis=2)
    cost = np.full((layers, 4, 4), INF)
    to[layer] = 4 * (layer + 1)[:, None, None] + np.arange(4)
    cost[layer] = costs
    sink = np.zeros((layers, 4), bool)
    sink[last // 4] = True
    reach = np.zeros((layers, 4), bool)
    reach[last // 4] = ends < INF
    to, cost, reach = to.reshape(-1, 4), cost.reshape(-1, 4), reach.reshape(-1)
    while True:
        more = reach | ((cost < INF) & reach[to]).any(axis=1)
        if (more == reach).all():
            break
        reach = more
    least = costs.reshape(len(costs), 16).min(axis=1)
    upto = np.concatenate([[0], np.cumsum(least)])
    price = np.full((layers, 4), INF)
    price[layer] = (upto[np.cumsum(sizes)][lane] - upto[:-1] + ends.min(axis=1)[lane])[:, None]
    price[last // 4] = ends
    price = price.reshape(-1)
    price[~reach] = INF
    return Lattices(to, cost, price, sink.reshape(-1)), first, sizes


def chain_costs(chains: list) -> np.ndarray:
    """As ``block_costs``, for chains of blocks."""
    ends = np.where(np.eye(4, dtype=bool), 0, INF)
    graph, first, _ = chain_lattices([c for c in chains for _ in range(4)], np.tile(ends, (len(chains), 1)))
    for entry in range(4):
        graph.settle(first + entry, first)
    return graph.price[first[:, None] + np.arange(4)].reshape(len(chains), 4, 4).transpose(0, 2, 1)


def chain_prices(chains: list, ends: np.ndarray) -> list[np.ndarray]:
    """Prices behind each block of each chain, given the prices at the chain's end."""
    graph, first, sizes = chain_lattices(chains, ends)
    for k in range(int(sizes.max())):
        some = sizes > k
        for entry in range(4):
            graph.settle(first[some] + 4 * k + entry, first[some])
    return [graph.price[f + 4 : f + 4 + 4 * n].reshape(n, 4) for f, n in zip(first.tolist(), sizes.tolist())]


class Conversation:
    """What is known of one conversation's rows so far: counts, and the lattice rows not yet handed on."""

    def __init__(self, key: tuple) -> None:
        self.key = key
        self.sub = 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first_initial = self.initial = None
        self.first_turn = self.turn = None
        self.turns = 0
        self.cut()

    def cut(self) -> None:
        self.codes: list[int] = []
        self.rows: list[tuple[int, str, str]] = []
        self.held = 0

    def add(self, turn, role: str, text: str, n: int, is_first: bool, blank: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.initial is None:
            self.first_initial = initial
        elif self.initial + initial not in LEGAL:
            self.counts[3] += 1
        self.initial = initial
        if n > 1 and initial + initial not in LEGAL:
            self.counts[3] += n - 1
        if turn is not None:
            if self.turn is None:
                self.first_turn = turn
            self.turns += self.turn != turn
            self.turn = turn
        if blank:
            self.counts[0] += n
        elif is_first:
            self.counts[1] += n - 1
            self.counts[2] += truncated
            self.rows.append((len(self.codes), role, text))
            self.held += len(text)
            self.codes.append(_ROLE.get(initial, 3) + 4 * bool(truncated))
            n -= 1
        else:
            self.counts[1] += n
        if n:
            self.codes.append(-n)


def outputs(codes: list[int], labels: str, state: int) -> Iterator[tuple[str, int, str | None]]:
    """``(initials, lattice row or -1, new role or None)`` per step; several initials where rows go together."""
    row = 0
    for label in labels:
        if label == "I":
            state = int(_TURNS_TO[state])
            yield "I", -1, _NAME[state]
            continue
        code = codes[row]
        if label == "D":
            yield "D" * -code if code < 0 else "D", row, ""
        elif label == "K":
            state = int(_KEEPS[code & 3, state])
            yield "K", row, None
        else:
            state = int(_TURNS_TO[state])
            yield "R", row, _NAME[state]
        row += 1


SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_STORED = (
    f"kind string, no_conv boolean, {SCHEMA}, part int, sub long, i int, role string, text string, first_initial string, "
    "last_initial string, first_turn long, last_turn long, turns long, codes array<long>, costs array<long>"
)
_FIELDS = pa.schema([
    ("kind", pa.string()), ("no_conv", pa.bool_()), ("conv_id", pa.int64()), *[(x, pa.int64()) for x in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("part", pa.int32()), ("sub", pa.int64()), ("i", pa.int32()), ("role", pa.string()), ("text", pa.string()),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("turns", pa.int64()), ("codes", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())),
])


def _batch(rows: list[dict], fields: pa.Schema = _FIELDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=fields)


def _finished(c: Conversation, cost: int, labels: str) -> dict:
    kept = {i: (role, text) for i, role, text in c.rows}
    audit, lines = [], []
    for initials, row, name in outputs(c.codes, labels, 0):
        audit.append(initials)
        if name is None:
            lines.append("%s:%s" % kept[row])
        elif name:
            lines.append(f"{name}:{kept[row][1] if row >= 0 else ''}")
    gaps = c.turn - c.first_turn + 1 - c.turns if c.turn is not None else 0
    return _result(c.key, gaps, c.counts, cost, "".join(audit), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _result(key: tuple, gaps: int, counts: list[int], cost: int, audit: str, digest: str) -> dict:
    return {
        "kind": "done", "no_conv": key[0], "conv_id": None if key[0] else key[1], "gaps": gaps, "blank": counts[0],
        "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "audit": audit, "repaired_sha256": digest,
    }


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows of a range partition: whole short conversations are repaired, others become blocks and rows.

    The first and the last conversation of a partition may go on in its neighbours, so they count as long."""
    short: list[Conversation] = []
    blocks: list[dict] = []
    out: list[dict] = []
    now: Conversation | None = None
    edge, part, held = True, 0, 0

    def block(c: Conversation) -> None:
        place = {"no_conv": c.key[0], "conv_id": c.key[1], "part": part, "sub": c.sub}
        out.extend({"kind": "row", **place, "i": i, "role": role, "text": text} for i, role, text in c.rows)
        blocks.append({
            "kind": "block", **place, "i": -1, "blank": c.counts[0], "duplicate": c.counts[1], "truncated": c.counts[2],
            "illegal": c.counts[3], "first_initial": c.first_initial, "last_initial": c.initial, "first_turn": c.first_turn,
            "last_turn": c.turn, "turns": c.turns, "codes": c.codes,
        })
        c.sub += 1
        c.cut()

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if short:
            out.extend(_finished(c, *r) for c, r in zip(short, repairs([c.codes for c in short])))
            short.clear()
        if blocks:
            for b, costs in zip(blocks, block_costs([b["codes"] for b in blocks])):
                out.append(b | {"costs": costs.reshape(-1).tolist()})
            blocks.clear()
        held = 0
        if out:
            yield _batch(out)
            out.clear()

    def close(c: Conversation, edge: bool) -> int:
        if edge or c.sub:
            block(c)
        else:
            short.append(c)
        return c.held

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for no_conv, conv, turn, role, text, n, is_first, blank, truncated, part in zip(*columns):  # noqa: B007
            if now is None or now.key != (no_conv, conv):
                if now is not None:
                    held += close(now, edge)
                    edge = False
                now = Conversation((no_conv, conv))
                if len(short) >= TOGETHER or len(blocks) >= TOGETHER or held > HELD_BYTES:
                    yield from flush()
            if n:
                now.add(turn, role, text, n, is_first, blank, truncated)
                if len(now.codes) >= BLOCK or now.held > HELD_BYTES:
                    held += now.held
                    block(now)
                    if held > HELD_BYTES:
                        yield from flush()
    if now is not None:
        close(now, True)
    yield from flush()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage with ``n`` (how often each stands there; 0 keeps the id of a dropped row) and its faults.

    A kind of damage by ``crc32(conv_id:turn) % 20``: 0 drops, 1 empties, 2 removes ``[.!?]``, 3 repeats, 4 makes a user's row."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        conv.isNull().alias("no_conv"), F.coalesce(conv, F.lit(0)).alias("conv_id"), turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), kind.alias("kind"),
    )
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "no_conv", "conv_id", (gone | F.col("turn").isNull()).alias("no_turn"),
        F.when(gone, 0).otherwise(F.coalesce("turn", F.lit(0))).cast("long").alias("turn"),
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Equal rows counted, first occurrences marked, in order of conversation and turn over range partitions."""
    place = ["no_conv", "conv_id", "no_turn", "turn", "role", "digest"]
    counted = rows.groupBy(*place).agg(F.sum("n").alias("n"), F.any_value("text").alias("text"))
    firsts = rows.where("n > 0").groupBy("no_conv", "conv_id", "role", "digest").agg(
        F.max("no_turn").alias("no_turn"), F.min(F.when(~F.col("no_turn"), F.col("turn"))).alias("turn")
    )
    firsts = firsts.select(
        *[F.when(F.col("no_turn"), F.lit(0)).otherwise(F.col("turn")).cast("long").alias(c) if c == "turn" else F.col(c) for c in place],
        F.lit(True).alias("is_first"),
    )
    end = F.rtrim("text", F.lit(BLANKS))
    order = ["no_conv", "conv_id", F.col("no_turn").desc(), "turn", "role", "text"]
    joined = counted.join(firsts, place, "left")
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "no_conv", "conv_id", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "text", "n",
        F.col("is_first").isNotNull().alias("is_first"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?") & (end != "")).alias("truncated"), F.spark_partition_id().alias("part"),
    )


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of each group of blocks beside its blocks."""
    for batch in batches:
        if batch.num_rows:
            chains = [[c["costs"] for c in group] for group in batch.column("blocks").to_pylist()]
            costs = [c.reshape(-1).tolist() for c in chain_costs(chains)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], [*batch.schema.names, "costs"])


_PRICED = "no_conv boolean, conv_id long, part int, sub long, ends array<long>"


def _price_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices behind each block of each group, from the prices behind the group."""
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("blocks").to_pylist()
        found = chain_prices([[c["costs"] for c in g] for g in groups], np.array(batch.column("ends").to_pylist(), np.int64))
        rows = [
            (no_conv, conv, c["part"], c["sub"], ends.tolist())
            for no_conv, conv, g, prices in zip(batch.column("no_conv").to_pylist(), batch.column("conv_id").to_pylist(), groups, found)
            for c, ends in zip(g, prices)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
            ["no_conv", "conv_id", "part", "sub", "ends"],
        )


def end_prices(blocks: DataFrame) -> DataFrame:
    """The prices behind every block: costs joined upwards in groups of neighbours, prices handed back down."""
    top = blocks.agg(F.max("sub"), F.max("part")).first()
    level, stack = blocks.select("no_conv", "conv_id", "part", "sub", "costs"), []
    for column, most in (("sub", top[0] or 0), ("part", top[1] or 0)):
        while most:
            group = {"part": F.col("part"), "sub": F.col("sub")} | {column: F.shiftright(column, FAN_BITS)}
            grouped = level.groupBy("no_conv", "conv_id", *[e.cast("int" if n == "part" else "long").alias(f"_{n}") for n, e in group.items()]).agg(
                F.sort_array(F.collect_list(F.struct("part", "sub", "costs"))).alias("blocks")  # up to 2**FAN_BITS of them
            ).withColumnsRenamed({"_part": "part", "_sub": "sub"})
            schema = f"{_PRICED.replace('ends array<long>', '')} blocks array<struct<part int, sub long, costs array<long>>>, costs array<long>"
            level = materialise(grouped.mapInArrow(_join_blocks, schema), "conversation-level")
            stack.append(level)
            most >>= FAN_BITS
    keys = ["no_conv", "conv_id", "part", "sub"]
    priced = level.select(*keys, F.lit(list(END_PRICES)).cast("array<long>").alias("ends"))
    for level in reversed(stack):
        groups = level.select(*keys, "blocks").join(priced, keys)
        priced = materialise(groups.mapInArrow(_price_blocks, _PRICED), "conversation-prices")
    return priced


_LONG = (
    "no_conv boolean, conv_id long, part int, sub long, i int, role string, text string, blank long, duplicate long, truncated long, "
    "illegal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long, codes array<long>, "
    "prices array<long>, labels array<string>, exits array<int>"
)


def _trace_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.array(batch.column("ends").to_pylist(), np.int64)
        prices, labels, exits = block_traces(batch.column("codes").to_pylist(), ends)
        more = [pa.array(prices.tolist(), pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int32()))]
        kept = batch.drop_columns(["ends"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, "prices", "labels", "exits"])


class _Long:
    """A long conversation, block after block: counts, audit and the running hash."""

    def __init__(self, key: tuple) -> None:
        self.key, self.counts, self.gap_turns, self.first, self.last, self.initial = key, [0] * 4, 0, None, None, None
        self.state, self.cost, self.audit, self.hash, self.begun, self.part = 0, None, [], hashlib.sha256(), False, None
        self.steps: Iterator = iter(())

    def line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun = True

    def advance(self, row: int, role: str | None = None, text: str = "") -> None:
        """Takes steps up to the one that settles lattice row ``row`` (-1: all that are left of the block)."""
        for initials, at, name in self.steps:
            self.audit.append(initials)
            if at < 0:
                self.line(name, "")
            elif at == row:
                if name != "":
                    self.line(role if name is None else name, text)
                return

    def block(self, b: dict) -> None:
        self.advance(-1)
        if self.cost is None:
            self.cost = b["prices"][0]
        if self.part != b["part"]:  # counts run on from block to block of a partition, and begin anew in the next
            if self.part is not None:
                self.close_part()
            self.part = b["part"]
            if self.initial is not None and b["first_initial"] is not None:
                self.counts[3] += self.initial + b["first_initial"] not in LEGAL
            if self.last is not None and b["first_turn"] is not None:
                self.gap_turns -= self.last == b["first_turn"]
            if self.first is None:
                self.first = b["first_turn"]
        self.latest = b
        self.steps = outputs(b["codes"], b["labels"][self.state], self.state)
        self.state = b["exits"][self.state]

    def close_part(self) -> None:
        b = self.latest
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += b[name]
        self.gap_turns += b["turns"]
        self.initial = b["last_initial"] if b["last_initial"] is not None else self.initial
        if self.first is None:
            self.first = b["first_turn"]
        self.last = b["last_turn"] if b["last_turn"] is not None else self.last

    def end(self) -> dict:
        self.advance(-1)
        self.close_part()
        for _ in END_LABELS[self.state]:
            self.state = int(_TURNS_TO[self.state])
            self.audit.append("I")
            self.line(_NAME[self.state], "")
        gaps = self.last - self.first + 1 - self.gap_turns if self.last is not None else 0
        done = _result(self.key, gaps, self.counts, self.cost, "".join(self.audit), self.hash.hexdigest())
        return {k: v for k, v in done.items() if k not in ("kind", "no_conv")}


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and rows of long conversations in order: audit, counts and hash of each."""
    fields = pa.schema([_FIELDS.field(name) for name in (
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])
    now, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["no_conv"], row["conv_id"]
            if now is None or now.key != key:
                if now is not None:
                    done.append(now.end())
                now = _Long(key)
            if row["i"] < 0:
                now.block(row)
            else:
                now.advance(row["i"], row["role"], row["text"])
        if done:
            yield _batch(done, fields)
            done = []
    if now is not None:
        yield _batch([now.end()], fields)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` with its faults after damage, the cheapest repair and its hash, see ``SCHEMA``."""
    stored = materialise(ordered_rows(damaged(conversations)).mapInArrow(_cut_up, _STORED), "conversations")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    keys = ["no_conv", "conv_id", "part", "sub"]
    blocks = stored.where("kind = 'block'")
    shown = [c.split()[0] for c in _LONG.split(", ")]
    known = blocks.select(*shown[:-3], "costs").drop("costs").join(end_prices(blocks), keys)
    traced = known.select(*shown[:-3], "ends").mapInArrow(_trace_blocks, _LONG)
    rows = stored.where("kind = 'row'").select(*[F.col(c) if c in stored.columns else F.lit(None).alias(c) for c in shown])
    long = traced.unionByName(rows).repartition("no_conv", "conv_id").sortWithinPartitions(*keys, "i")
    return stored.where("kind = 'done'").select(*columns).unionByName(long.mapInArrow(_put_together, SCHEMA))
