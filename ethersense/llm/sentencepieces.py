"""SentencePiece segmentations sampled without replacement, and their decoding.

Gumbel top-k over the lattice of pieces: every segmentation has its log-probability plus Gumbel noise, and
the ``k`` largest are the sample. They are found from the top: a set of segmentations carries the maximum of its
noisy scores, the best set is opened at its next piece, and the sets beside the chosen piece go back to
the agenda with maxima below that of their parent.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethersense.llm.textwork import mix64, pieces

SPACE = "▁"
#: Parts of a text that no piece crosses: a line end, or spaces with what follows them.
_UNIT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_CHAR = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1


class _Pieces:
    """The model's pieces with log-weights, by hash of their code points.

    A unigram model has log-probabilities. A BPE model has merge ranks; they become Zipf log-weights
    ``-sharpness * ln(rank + 1)``. A character that is no piece is its UTF-8 bytes, below all pieces.
    """

    def __init__(self, path: str, sharpness: float) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        names, ids, scores = [], [], []
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                names.append(piece), ids.append(i), scores.append(self.model.get_score(i))
        scores = np.array(scores)
        if (scores[np.abs(scores) < 1e8] == np.round(scores[np.abs(scores) < 1e8])).all():  # ranks, not log-probabilities
            order = np.argsort(np.argsort(-scores, kind="stable"))
            scores = -sharpness * np.log(order + 1.0)
        self.names, self.ids, self.scores = names, np.array(ids), scores
        self.lowest = float(scores.min()) - 10.0
        self.longest = max(map(len, names))
        #: The bytes that each id stands for; control and unknown ids stand for none.
        self.spelling = np.full(n, b"", object)
        self.spelling[self.ids] = [x.encode() for x in names]
        for value, i in enumerate(self.bytes.tolist()):
            if i:
                self.spelling[i] = bytes([value])
        # by length: hashes of all beginnings of pieces, and the piece that each is, or -1
        number = {x: i for i, x in enumerate(names)}
        self.starts: list[tuple[np.ndarray, np.ndarray]] = []
        for length in range(1, self.longest + 1):
            begun = sorted({x[:length] for x in names if len(x) >= length})
            h = self.hashes(begun, length)
            order = np.argsort(h)
            self.starts.append((_Lookup(h[order]), np.array([number.get(x, -1) for x in begun], np.int64)[order]))

    @staticmethod
    def hashes(texts: list[str], length: int) -> np.ndarray:
        if not texts:
            return np.empty(0, np.uint64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(-1, length).astype(np.uint64)
        h = np.zeros(len(texts), np.uint64)
        for i in range(length):
            h = (h + codes[:, i] + np.uint64(1)) * _CHAR
        return h


@lru_cache(maxsize=2)
def _load(path: str, sharpness: float) -> _Pieces:
    return _Pieces(path, sharpness)


class _Lookup:
    """Where a hash stands among sorted ones, by its first bits."""

    BITS = 17

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.append(values, np.uint64(_WORD))
        head = (values >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.first = np.searchsorted(head, np.arange(1 << self.BITS)).astype(np.int32)
        self.longest = int(np.bincount(head).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted value, or -1."""
        at = self.first[(wanted >> np.uint64(64 - self.BITS)).astype(np.int64)]
        found = np.full(len(wanted), -1)
        for i in range(self.longest):
            place = np.minimum(at + i, len(self.values) - 1)
            found[self.values[place] == wanted] = i
        return np.where(found >= 0, at + found, -1)


class _Lattice:
    """The lattices of some units side by side. State = character; edge = piece from a state.

    ``first_id`` and ``ids_of`` (its ids), ``to`` (next state, or -1 at the unit's end),
    ``log_p`` (log of the chance of the edge given its state), ``below`` (chance summed over the
    state's edges before this one) of each edge; edges ``first[s]:first[s + 1]`` leave state ``s``.
    """

    def __init__(self, model: _Pieces, units: list[str]) -> None:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(size) - size
        left = np.repeat(self.start + size, size) - np.arange(len(codes))
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        source, width, piece = [], [], []
        single = np.zeros(len(codes), bool)
        for length in range(1, model.longest + 1):
            inside = left[alive] >= length
            alive, h = alive[inside], h[inside]
            h = (h + codes[alive + length - 1] + np.uint64(1)) * _CHAR
            table, index = model.starts[length - 1]
            at = table.find(h)
            grow = np.flatnonzero(at >= 0)
            alive, h, found = alive[grow], h[grow], index[at[grow]]
            hit = np.flatnonzero(found >= 0)
            source.append(alive[hit])
            width.append(np.full(len(hit), length))
            piece.append(found[hit])
            if length == 1:
                single[alive[hit]] = True
            if not len(alive):
                break
        lone = np.flatnonzero(~single)
        source.append(lone)
        width.append(np.ones(len(lone), np.int64))
        piece.append(-1 - codes[lone].astype(np.int64))
        source, width, piece = (np.concatenate(x).astype(np.int64) for x in (source, width, piece))
        weight = np.where(piece >= 0, model.scores[np.maximum(piece, 0)], model.lowest)
        # mass of all ways from a state to the unit's end, the states nearest to the end first
        wide = model.longest + 1
        order = np.argsort((left[source] * len(codes) + source) * wide + width)  # all different
        source, width, piece, weight = source[order], width[order], piece[order], weight[order]
        beta = np.zeros(len(codes) + 1)
        ends = left[source] == width
        depth = np.flatnonzero(np.diff(left[source], prepend=-1))
        for a, b in zip(depth.tolist(), [*depth[1:].tolist(), len(source)]):
            value = weight[a:b] + np.where(ends[a:b], 0.0, beta[source[a:b] + width[a:b]])
            heads = np.flatnonzero(np.diff(source[a:b], prepend=-1))
            beta[source[a:b][heads]] = np.logaddexp.reduceat(value, heads)
        order = np.argsort(source * wide + width)
        source, width, piece, weight, ends = (x[order] for x in (source, width, piece, weight, ends))
        # ids of an edge: its piece, or the bytes of its character
        spelled = {c: model.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(-1 - piece[piece < 0]).tolist()}
        self.ids_of = [spelled.get(c) for c in (-1 - piece[piece < 0]).tolist()]
        self.spelled = np.cumsum(piece < 0) - 1
        self.first_id = np.where(piece >= 0, model.ids[np.maximum(piece, 0)], 0)
        self.first_id[piece < 0] = [x[0] for x in self.ids_of]
        self.plain = np.ones(len(piece), bool)
        self.plain[piece < 0] = [len(x) == 1 for x in self.ids_of]
        self.to = np.where(ends, -1, source + width)
        self.log_p = np.minimum(0.0, weight + np.where(ends, 0.0, beta[np.minimum(source + width, len(codes))]) - beta[source])
        self.first = np.searchsorted(source, np.arange(len(codes) + 1))
        chance = np.exp(self.log_p)
        total = np.cumsum(chance)
        base = (total - chance)[self.first[:-1]]
        within = total - base[source]
        self.below = (within - chance) / within[self.first[1:] - 1][source]
        self.below[self.first[:-1]] = 0.0

    def draw(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The last edge of each state whose chances before it sum up to no more than ``u``; long pieces are the
        likely ones, so the search goes down from the last edge."""
        at = self.first[state + 1] - 1
        high = np.flatnonzero(self.below[at] > u)
        while len(high):
            at[high] -= 1
            high = high[self.below[at[high]] > u[high]]
        return at


def _uniform(seed: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    """Numbers in (0, 1) by counter: the same for the same seed and place in any run."""
    x = mix64(seed + a.astype(np.uint64) * _STEP + np.uint64(b * int(_SPREAD) & (2**64 - 1)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _uniform_one(seed: int, a: int, b: int) -> float:
    """``_uniform`` of single numbers."""
    x = (seed + a * int(_STEP) + b * int(_SPREAD)) & _WORD
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
    x ^= x >> 31
    return ((x >> 11) + 0.5) / 2.0**53


def _paths(lattice: _Lattice, unit: np.ndarray, seed: np.ndarray, salt: int):
    """One random path through every unit occurrence: its edges in order, and where each occurrence begins."""
    state, who, step = lattice.start[unit], np.arange(len(unit)), 0
    edges, owners = [], []
    count = np.zeros(len(unit), np.int64)
    while len(who):
        e = lattice.draw(state, _uniform(seed[who], np.full(len(who), step), salt))
        edges.append(e)
        owners.append(who)
        count[who] += 1
        go = lattice.to[e] >= 0
        who, state = who[go], lattice.to[e][go]
        step += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(begin[-1], np.int64)
    for i, (e, w) in enumerate(zip(edges, owners)):
        flat[begin[w] + i] = e
    return flat, begin


def _open(prefix: np.ndarray, log_p: np.ndarray, ceiling, seed: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Noisy maxima of the sets beside each edge of a path, all below ``ceiling``.

    ``prefix`` is the log-chance of the path before the edge. A set of mass m has Gumbel(log m) as maximum;
    given that it is below the ceiling c it is ``-log(exp(-c) + exp(-log m) * Exp(1))``. Every entry is computed on its
    own, so paths of several rows may stand side by side.
    """
    mass = -np.expm1(log_p)
    beside = np.log(np.maximum(mass, 0.0) + 1e-300)
    beside[mass < 1e-12] = -np.inf
    noise = -np.log(_uniform(seed, place, salt))
    return -np.logaddexp(-ceiling, np.log(noise) - (prefix + beside))


class _Start:
    """Of every row its best segmentation, with the maxima of the sets beside it."""

    def __init__(self, lattice: _Lattice, path: tuple[np.ndarray, np.ndarray], bounds: list[int], seeds: np.ndarray) -> None:
        flat, begin = path
        edges = begin[np.array(bounds)]
        size = np.diff(edges)
        self.flat, self.edges = flat, edges.tolist()
        self.log_p = lattice.log_p[flat]
        row = np.repeat(np.arange(len(size)), size)
        words = seeds.view(np.uint64)
        self.top = -np.log(-np.log(_uniform(words, np.zeros(len(words)), 1)))
        # sums of a row never run through its neighbours
        self.before = [np.concatenate([[0.0], np.cumsum(self.log_p[a:b])]) for a, b in zip(self.edges, self.edges[1:])]
        prefix = np.concatenate([b[:-1] for b in self.before]) if len(flat) else np.empty(0)
        self.opened = _open(prefix, self.log_p, self.top[row], words[row], np.arange(len(flat)) - edges[:-1][row], 2)


def _draw_one(lattice: _Lattice, state: int, u: float) -> int:
    at = int(lattice.first[state + 1]) - 1
    while lattice.below[at] > u:
        at -= 1
    return at


def _sample_row(
    lattice: _Lattice, fresh: list[tuple], units: tuple[int, int], seed: int, k: int, start: _Start | None = None, i: int = 0
):
    """The ``k`` best noisy segmentations of one row: (edges, log-probability, noisy score), and the next score."""
    u0, u1 = units
    if start is None:
        start = _Start(lattice, fresh[0], [u0, u1], np.array([seed & _WORD], np.uint64).view(np.int64))

    def fresh_path(r: int, frm: int) -> np.ndarray:
        flat, begin = fresh[r]
        return flat[begin[frm] : begin[u1]]

    seed &= _WORD
    lo, hi = start.edges[i], start.edges[i + 1]
    first, before, top = start.flat[lo:hi], start.before[i], float(start.top[i])
    paths = [(first, before[-1], top)]
    # agenda: per path the maxima of the sets beside its edges; chosen: edges taken out of a set
    agenda = [(first, before, start.opened[lo:hi])]
    chosen: dict[tuple[int, int], list[int]] = {}
    for r in range(1, k + 1):
        best = max(range(len(agenda)), key=lambda i: agenda[i][2].max() if len(agenda[i][2]) else -np.inf)
        edges, before, score = agenda[best]
        if not len(score) or not np.isfinite(score.max()):
            return paths, -np.inf
        at = int(score.argmax())
        top = float(score[at])
        if r == k:
            return paths, top
        taken = chosen.setdefault((best, at), [int(edges[at])])
        state = int(np.searchsorted(lattice.first, edges[at], side="right")) - 1
        options = [e for e in range(int(lattice.first[state]), int(lattice.first[state + 1])) if e not in taken]
        mass = np.exp(lattice.log_p[options])
        u = _uniform_one(seed, r, 3)
        edge = options[min(int(np.searchsorted(np.cumsum(mass), u * mass.sum(), side="right")), len(options) - 1)]
        taken.append(edge)
        rest = [e for e in options if e != edge]
        # what is left beside this edge stays in the agenda below the score just taken
        if rest:
            log_mass = float(np.log(np.exp(lattice.log_p[rest]).sum() + 1e-300))
            noise = -np.log(_uniform_one(seed, r, 4))
            score[at] = -np.logaddexp(-top, np.log(noise) - (before[at] + log_mass))
        else:
            score[at] = -np.inf
        # finish the unit piece by piece, then go on with fresh paths of the later units
        tail = [edge]
        while lattice.to[tail[-1]] >= 0:
            tail.append(_draw_one(lattice, int(lattice.to[tail[-1]]), _uniform_one(seed, len(tail) - 1, 100 + r)))
        unit = u0 + int(np.count_nonzero(lattice.to[edges[:at]] < 0))
        path = np.concatenate([edges[:at], tail, fresh_path(r, unit + 1)]).astype(np.int64)
        log_p = lattice.log_p[path[at:]]
        before_new = np.concatenate([before[: at + 1], before[at] + np.cumsum(log_p)])
        opened = np.full(len(path), -np.inf)
        later = len(path) - at - 1
        opened[at + 1 :] = _open(
            before_new[at + 1 : -1], log_p[1:], top, np.full(later, np.uint64(seed)), np.arange(later), 10 + r)
        paths.append((path, before_new[-1], top))
        agenda.append((path, before_new, opened))
    return paths, -np.inf


def _log_inclusion(gap: float) -> float:
    """Logarithm of ``1 - exp(-exp(gap))``, also where that is no double above zero."""
    if gap < -30:
        return gap  # exp(gap) / 2 less, below the precision of a double
    rate = float(np.exp(min(gap, 50.0)))
    return float(np.log(-np.expm1(-rate))) if rate < 0.7 else float(np.log1p(-np.exp(-rate)))


def _ids_of(lattice: _Lattice, edges: np.ndarray) -> np.ndarray:
    ids = lattice.first_id[edges]
    longer = np.flatnonzero(~lattice.plain[edges])
    if not len(longer):
        return ids
    parts, at = [], 0
    for i in longer.tolist():
        parts += [ids[at:i], lattice.ids_of[lattice.spelled[edges[i]]]]
        at = i + 1
    return np.concatenate([*parts, ids[at:]])


def decode_ids(model: _Pieces, ids: np.ndarray) -> str:
    """The text of a list of ids: pieces joined, byte pieces as UTF-8, spaces for the space mark, less
    the one that encoding puts in front."""
    text = b"".join(model.spelling[ids].tolist()).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _encode_rows(path: str, k: int, sharpness: float, keep_ids: bool):
    def run(batches):
        model = _load(path, sharpness)
        for batch in pieces(batches, "text", 1 << 22):  # the more text, the fewer distinct units in proportion
            texts = [t or "" for t in batch.column("text").to_pylist()]
            seeds = np.asarray(batch.column("seed"))
            shown, bounds = [], [0]
            for t in texts:
                shown += _UNIT.findall(model.model.normalize(t)) if t else []
                bounds.append(len(shown))
            numbers = {x: i for i, x in enumerate(dict.fromkeys(shown))}
            units = np.fromiter(map(numbers.__getitem__, shown), np.int64, len(shown))
            rows: list[tuple] = []
            if len(units):
                lattice = _Lattice(model, list(numbers))
                size = np.diff(bounds)
                row = np.repeat(np.arange(len(texts)), size)
                place = (np.arange(len(units)) - np.repeat(np.array(bounds[:-1]), size)).astype(np.uint64)
                seed = mix64(mix64(seeds.view(np.uint64))[row] + place * _STEP)
                fresh = [_paths(lattice, units, seed, r) for r in range(k)]
                start = _Start(lattice, fresh[0], bounds, seeds)
            for i, t in enumerate(texts):
                if bounds[i] == bounds[i + 1]:
                    rows.append((i, 1, np.empty(0, np.int64), 0.0, 1.0, True, 0.0))
                    continue
                found, bar = _sample_row(lattice, fresh, (bounds[i], bounds[i + 1]), int(seeds[i]), k, start, i)
                for s, (edges, log_p, _) in enumerate(found):
                    ids = _ids_of(lattice, edges)
                    gap = log_p - bar
                    inclusion = float(-np.expm1(-np.exp(min(gap, 50.0)))) if np.isfinite(bar) else 1.0
                    log_inclusion = _log_inclusion(gap) if np.isfinite(bar) else 0.0
                    rows.append((i, s + 1, ids, float(log_p), inclusion, decode_ids(model, ids) == t, log_inclusion))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([
                batch.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64()),
                pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.bool_()),
                pa.array([r[2] if keep_ids else None for r in rows], pa.list_(pa.int64())), pa.array([r[6] for r in rows], pa.float64()),
            ], names=["doc_id", "sample", "n_pieces", "log_prob", "inclusion", "ids_crc32", "decoded", "ids", "log_inclusion"])

    return run


def sample_segmentations(
    docs: DataFrame, model: str, k: int = 2, sharpness: float = 1.0, seed: int = 3, keep_ids: bool = True,
    key: Column | None = None,
) -> DataFrame:
    """``doc_id, sample, n_pieces, log_prob, inclusion, ids_crc32, decoded, ids, log_inclusion`` per sampled segmentation.

    Each row of ``docs`` (``doc_id``, ``text``) gives its ``k`` segmentations of the largest Gumbel-perturbed
    log-probability, best first, all different; fewer if its lattice has fewer. ``inclusion`` is the chance of
    a segmentation to be above the ``k + 1``-th perturbed value; it is 0 for long texts, where only its logarithm
    ``log_inclusion`` can be told apart. ``decoded`` says that the ids decode to the
    text again. Null and empty texts give one empty segmentation. The noise depends on ``key`` (default:
    doc_id and text) and ``seed`` only, so rows equal in both agree. Other columns are ignored.
    """
    row_key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")) if key is None else F.xxhash64(F.lit(seed), key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key.alias("seed"))
    return rows.mapInArrow(
        _encode_rows(model, k, sharpness, keep_ids),
        "doc_id long, sample int, n_pieces long, log_prob double, inclusion double, ids_crc32 long, decoded boolean, ids array<long>, log_inclusion double",
    )
