"""Language identification with language-bitmask n-gram filters.

Learning counts the n-grams (2 to 4 letters, word edges count as one) of all labelled texts per language. A language
*contains* an n-gram that makes up at least ``RARE`` of its n-grams of that order, and at least ``SHARE`` of what it makes up
in the language where it is most frequent, which drops words quoted from elsewhere. So a language contains at
most ``1 / RARE`` n-grams of an order, however large the corpus is.

The Bloom filters of all languages lie in one bit-sliced table: a word per position whose bit ``l`` belongs to language
``l``. The AND of an n-gram's positions is the set of all languages that contain it. A text is decided by the
count of its n-grams per language, less the false positives that the filter's fill lets expect.

* Letters are those of Unicode in lower case; marks count as part of a word. Other characters are word edges.
* Texts without letters, empty and null ones, are ``und`` with score 0; so is every text if nothing was learned. The score
  is the corrected share of the text's n-grams that the language contains. Ties go to the smaller language value.
* Rows without label or text teach nothing; an empty label is a label. Repeated rows count as often as they stand there.
* A run of more than ``LONG`` letters counts as several words.
* The result columns replace columns of the same names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethersense.llm.textwork import U64, mix64, pieces, signed

ORDERS = (2, 3, 4)
RARE = 2.0**-14
SHARE = 1 / 16
POSITIONS = 1 << 20
HASHES = 4
WORD_BITS = 63
MAX_LANGUAGES = 4 * WORD_BITS
LONG = 1 << 20
UNKNOWN = "und"
_HELD = 1 << 21
_BASE = U64(0x9E3779B97F4A7C15)
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """By code point: 2 letter, 1 mark, 0 anything else."""
    if not _KINDS:
        kinds = np.zeros(0x110000, np.uint8)
        kinds[[c for c in range(0x110000) if chr(c).isalpha()]] = 2
        kinds[[c for c in range(0x300, 0xE01F0) if unicodedata.category(chr(c))[0] == "M"]] = 1
        _KINDS.append(kinds)
    return _KINDS[0]


def _parts(text: str) -> Iterator[np.ndarray]:
    """Code points of a text, long texts in parts that end between words."""
    kinds = _kinds()
    at = 0
    while at < len(text):
        codes = np.frombuffer(text[at : at + LONG].lower().encode("utf-32-le"), np.uint32)
        if at + LONG < len(text):
            edges = np.flatnonzero(kinds[codes] == 0)
            if len(edges):  # end behind the last edge; the raw slice is found by its tail
                tail = len(codes) - int(edges[-1]) - 1
                step = LONG - tail
                if step > 0 and len(codes) == LONG:
                    codes = codes[: len(codes) - tail]
                    yield codes
                    at += step
                    continue
        yield codes
        at += LONG


def grams(texts: list, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Hashes and rows of all n-grams, one array an order, and which rows have a letter; bounded parts at a time."""
    kinds = _kinds()
    held, rows, size = [], [], 0
    edge = np.zeros(1, np.uint32)
    lettered = np.zeros(len(texts), bool)

    def turn() -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        codes = np.concatenate([*held, edge])
        owner = np.repeat(np.array([*rows, rows[-1] if rows else 0]), [*[len(h) for h in held], 1])
        kind = kinds[codes]
        lettered[np.unique(owner[kind == 2])] = True
        codes = np.where(kind > 0, codes, 0)
        kept = codes > 0
        kept[1:] |= codes[:-1] > 0
        kept[0] = True
        codes, owner = codes[kept].astype(U64), owner[kept]
        found, whose = [], []
        for n in orders:
            width = max(0, len(codes) - n + 1)
            good = np.ones(width, bool)
            for i in range(1, n - 1):
                good &= codes[i : i + width] > 0
            at = np.flatnonzero(good)
            h = np.full(len(at), U64(n))
            for i in range(n):
                h = h * _BASE + codes[at + i]
            found.append(mix64(h))
            whose.append(np.where(codes[at] > 0, owner[at], owner[at + 1] if n > 1 else owner[at]))
        held.clear()
        rows.clear()
        return found, whose, lettered

    for row, text in enumerate(texts):
        for codes in _parts(text or ""):
            held += [edge, codes]
            rows += [row, row]
            size += len(codes) + 1
            if size >= LONG:
                yield turn()
                size = 0
    yield turn()


def _positions(h: np.ndarray) -> Iterator[np.ndarray]:
    first = (h & U64(POSITIONS - 1)).astype(np.int64)
    step = ((h >> U64(32)) & U64(POSITIONS - 1)).astype(np.int64) | 1
    for i in range(HASHES):
        yield (first + i * step) & (POSITIONS - 1)


@dataclass
class LanguageModel:
    """Languages in order of their bits, the sliced filters (one row per ``WORD_BITS`` languages), false positive rates."""

    languages: list[str]
    filters: np.ndarray
    false_rates: np.ndarray

    def containing(self, h: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bitmask of the languages that contain it (or seem to), per filter word."""
        masks = [np.full(len(h), -1, np.int64) for _ in self.filters]
        for at in _positions(h):
            for mask, words in zip(masks, self.filters):
                mask &= words[at]
        return masks

    def decide(self, texts: list) -> tuple[list[str], np.ndarray]:
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        lettered = np.zeros(len(texts), bool)
        for found, whose, letters in grams(texts):
            lettered = letters
            for h, rows in zip(found, whose):
                total += np.bincount(rows, minlength=len(texts))
                for word, mask in enumerate(self.containing(h)):
                    for bit, column in enumerate(range(word * WORD_BITS, min((word + 1) * WORD_BITS, len(self.languages)))):
                        hits[:, column] += np.bincount(rows, (mask >> bit) & 1, len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share = hits / np.maximum(total, 1)[:, None]
        share = np.clip((share - self.false_rates) / (1 - self.false_rates), 0, 1)
        best = share.argmax(axis=1)
        score = np.where(lettered, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], score


def _merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _count_grams(languages: list[str]):
    place = {name: i for i, name in enumerate(languages)}
    names = ["lang", "n_letters", "gram", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, order), found in held.items():
                keys, counts = found[0]
                for a in range(0, len(keys), 1 << 16):
                    k, n = keys[a : a + (1 << 16)], counts[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), lang, np.int32)), pa.array(np.full(len(k), order, np.int32)), pa.array(signed(k)), pa.array(n)], names
                    )
            held.clear()

        for batch in batches:
            for piece in pieces(iter([batch]), "text"):
                langs = np.array([place[x] for x in piece.column("lang").to_pylist()], np.int32)
                for found, whose, _ in grams(piece.column("text").to_pylist()):
                    for order, h, rows in zip(ORDERS, found, whose):
                        own = langs[rows]
                        for lang in np.unique(own).tolist():
                            keys, counts = np.unique(h[own == lang], return_counts=True)
                            held.setdefault((lang, order), []).append((keys, counts.astype(np.int64)))
                            size += len(keys)
                if size > _HELD:
                    for key, found in held.items():
                        held[key] = [_merge(found)]
                    size = sum(len(found[0][0]) for found in held.values())
                    if size > _HELD // 2:
                        yield from flush()
                        size = 0
        for key, found in held.items():
            held[key] = [_merge(found)]
        yield from flush()

    return count


def learn_languages(docs: DataFrame, label: str = "lang", text: str = "text") -> LanguageModel:
    """Filters of the labelled rows. At most ``MAX_LANGUAGES`` different labels; the driver receives those and, per filter
    word, no more than ``POSITIONS`` positions."""
    rows = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    words = -(-len(languages) // WORD_BITS)
    filters = np.zeros((words, POSITIONS), np.int64)
    if languages:
        counts = rows.mapInArrow(_count_grams(languages), "lang int, n_letters int, gram long, n long")
        found = _contained(counts).toArrow()
        filters[found["word"].to_numpy(), found["position"].to_numpy()] = found["mask"].to_numpy()
    fill = np.array([((filters[i // WORD_BITS] >> (i % WORD_BITS)) & 1).mean() for i in range(len(languages))])
    return LanguageModel(languages, filters, fill**HASHES)


def _contained(counts: DataFrame) -> DataFrame:
    """``(word, position, mask)``: the bits that the n-grams of all languages set."""
    counts = counts.groupBy("lang", "n_letters", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "n_letters").agg(F.sum("n").alias("total"))  # languages times orders
    share = F.col("n") / F.col("total")
    often = counts.join(F.broadcast(totals), ["lang", "n_letters"]).select("lang", "gram", share.alias("share")).where(F.col("share") >= RARE)
    top = often.groupBy("gram").agg(F.max("share").alias("top"))
    kept = often.join(top, "gram").where(F.col("share") >= SHARE * F.col("top"))
    first = F.col("gram").bitwiseAND(F.lit(POSITIONS - 1))
    step = F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(POSITIONS - 1)).bitwiseOR(F.lit(1))
    bits = F.element_at(F.lit([1 << i for i in range(WORD_BITS)]).cast("array<long>"), (F.col("lang") % WORD_BITS + 1).cast("int"))
    places = F.array(*[(first + i * step).bitwiseAND(F.lit(POSITIONS - 1)) for i in range(HASHES)])
    return kept.select(
        F.floor(F.col("lang") / WORD_BITS).cast("int").alias("word"), bits.alias("bit"), F.explode(places).alias("position")
    ).groupBy("word", "position").agg(F.bit_or("bit").alias("mask"))


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, to: tuple[str, str] = ("_lang", "_lang_score")
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with the language and its score in the columns ``to``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in to]
    place = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(to[0], "string").add(to[1], "double")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*(str(i) for i in range(place)), "text"]
            named = pa.RecordBatch.from_arrays(batch.columns, names)
            for piece in pieces(iter([named]), "text"):
                found, score = shared.value.decide(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:place], pa.array(found, pa.string()), pa.array(score, pa.float64())], [*keep, *to]
                )

    read = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    return read.mapInArrow(decide, schema)
