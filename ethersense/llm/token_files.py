"""Token files: frequency-ranked ids in byte-aligned variable length with separate control bytes."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethersense.llm.textwork import pieces
from ethersense.session import materialise, work_path

#: Words remembered by a task, so that each is tokenized once or a few times. As many again are kept from before:
#: a word that comes back is taken over from them, so only those not seen for so long are forgotten.
REMEMBERED = 400_000
BLOCK_TOKENS = 1 << 16
#: Lengths of the four values that a control byte describes, and of all four.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words:
    """Token ids (as bytes, four each) of white-space separated words, as the tokenizer gives them inside a text.

    The tokenizer drops white space and never merges across it. A word of Latin letters is one piece of its
    pre-tokenizer, so the model alone tells its ids; closing punctuation is a piece of its own.
    """

    CLOSING = ".,;:!?|$%&#*()[]{}\""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, ord("İ")) if chr(c).isalpha()}
        # lower-case letters, and what else there is; each with those remembered before
        self.letters: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.others: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    @staticmethod
    def _remembered(part: str, memory: tuple[dict[str, bytes], dict[str, bytes]], tokenize) -> bytes:
        now, before = memory
        ids = now.get(part)
        if ids is None:
            ids = before.get(part)
            if ids is None:
                ids = _packed(tokenize(part))
            if len(now) >= REMEMBERED:
                before.clear()
                before.update(now)
                now.clear()
            now[part] = ids
        return ids

    def _model_ids(self, low: str) -> list[int]:
        return [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(self.shown))]

    def _text_ids(self, part: str) -> list[int]:
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def find(self, words: list[str]) -> list[bytes]:
        out, known, closing = [], self.letters[0].get, self.CLOSING
        for word in words:
            core = word.rstrip(closing)
            ids = known(core.lower()) if core.isascii() else None
            if ids is None:
                # below U+0130 lower case is one letter for one letter and letters are composed
                if core.isalpha() and (core.isascii() or max(core) < "İ"):
                    ids = self._remembered(core.lower(), self.letters, self._model_ids)
                else:
                    out.append(self._remembered(word, self.others, self._text_ids))
                    continue
            if len(core) < len(word):
                ids += self._remembered(word[len(core) :], self.others, self._text_ids)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text; null counts as empty. Every word is looked up once for all its places."""
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        cuts = np.asarray(parts.offsets)
        coded = parts.values.dictionary_encode()
        found = self.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids, head, place = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, np.asarray(coded.indices)
        size = size[place]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.arange(end[-1]) + np.repeat(head[place] - end[:-1], size)]
        cuts = end[cuts - cuts[0]].tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


_words: dict[str, _Words] = {}


def _tokenize(path: str, end_id: int):
    def run(batches):
        words = _words.get(path)
        if words is None:
            words = _words[path] = _Words(path)
        end = np.array([end_id], "<u4")
        for batch in pieces(batches, "text", 1 << 23):
            out = []
            for ids in words.encode(batch.column("text")):
                ids = np.concatenate([ids, end])
                narrow = int(ids.max()) < 65536
                out.append(ids.astype("<u2").tobytes() + b"\2" if narrow else ids.tobytes() + b"\4")
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return run


def _ids(data: bytes) -> np.ndarray:
    """Ids of a stored row; its last byte tells the width."""
    return np.frombuffer(data, "<u2" if data[-1] == 2 else "<u4", (len(data) - 1) // data[-1]).astype(np.uint32)


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column("ids").to_pylist():
            found = np.bincount(_ids(data))
            if len(found) > len(total):
                total, found = found.astype(np.int64), total
            total[: len(found)] += found
    used = np.flatnonzero(total)
    if len(used):
        yield pa.record_batch([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (2 bits of length a value, four values a byte) and the values' low bytes."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    filled = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    filled[: len(values)] = size - 1
    control = (filled.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    kept = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``, by table lookup of the control bytes."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    value = np.zeros(n, np.uint32)
    for i in range(4):
        value |= np.where(size > i, raw[np.minimum(start + i, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * i)
    return value


def _encode(rank):
    """Blocks of whole documents in the order they come in."""

    def block(number: int, ids: list, rows: list[np.ndarray]):
        control, data = pack(np.concatenate(rows))
        return pa.record_batch([
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(r) for r in rows]], pa.list_(pa.int64())),
            pa.array([control], pa.binary()), pa.array([data], pa.binary()),
        ], names=["block", "doc_ids", "lengths", "control", "data"])

    def run(batches):
        table = rank.value
        number, ids, rows, total = 0, [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids.append(doc_id)
                rows.append(table[_ids(data)])
                total += len(rows[-1])
                if total >= BLOCK_TOKENS:
                    yield block(number, ids, rows)
                    number, ids, rows, total = number + 1, [], [], 0
        if ids:
            yield block(number, ids, rows)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Tokenize ``docs`` (``doc_id``, ``text``) and write them to ``path`` in ascending order of doc_id.

    A document is its ids without special tokens, then ``end_id``; null counts as empty. Null ids come first,
    rows that share an id in the order of their ids' bytes. ``path/ranks`` lists the token ids by falling
    frequency in the corpus (ties by id), ``path/blocks`` has blocks of whole documents whose ranks are
    stored by ``pack``; ``part`` and ``block`` give their order. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(docs.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, ids binary"), "tokens")
    counts = tokens.mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    listed = counts.orderBy(F.col("n").desc(), "id").collect()  # at most the vocabulary
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(listed)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    table = np.zeros(max([r["id"] for r in listed], default=0) + 1, np.uint32)
    for i, r in enumerate(listed):
        table[r["id"]] = i
    rank = spark.sparkContext.broadcast(table)
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(_encode(rank), "block long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    blocks.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` per document, from the files of ``write_token_files``.

    ``start`` counts the ids of all documents before; ``ids`` is null unless ``keep_ids``.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    names = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = np.array(batch.column("lengths")[row].as_py(), np.int64)
                ids = names.value[unpack(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), int(lengths.sum()))]
                end = np.cumsum(lengths)
                docs = [ids[e - n : e] for n, e in zip(lengths, end)]
                base = batch.column("base")[row].as_py()
                yield pa.record_batch([
                    batch.column("doc_ids")[row].values, pa.array(base + end - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                    pa.array([d.astype(np.int64) for d in docs] if keep_ids else [None] * len(docs), pa.list_(pa.int64())),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    size = blocks.select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    sums = size.groupBy("part").agg(F.sum("n").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sums = sums.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = size.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "part").select(
        "part", "block", (F.col("_before") + F.col("_in")).alias("base")
    )
    return blocks.join(base, ["part", "block"]).select("doc_ids", "lengths", "control", "data", "base").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Write token files below the shared folder and read them back."""
    path = work_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, keep_ids)
