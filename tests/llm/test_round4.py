"""What earlier rounds left on disk or did twice: shuffle files, shingles of rows that no pair needs, words tokenized again."""

import os
import random
import tempfile
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ethersense.llm import edits, line_dedup, linking, ngram_join, queries, token_files
from ethersense.llm.linking import MAP_BITS, _map_place
from ethersense.session import CLEANUP, materialise, shared_dir


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {x for x in names if x.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    setting, before = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    stored = materialise(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s")).orderBy("s"), "sums")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP, None) == setting
    assert stored.count() == 100 and stored.agg(F.sum("s")).first()[0] == 9_999 * 5_000


def test_only_rows_of_wanted_ids_are_cut_into_shingles(monkeypatch):
    texts = [f"word{i} and some more of them {i}" for i in range(200)] + [None, "null id one two three"]
    ids = [*range(200), 200, None]
    rows = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    nodes = [ngram_join._node(s) for s in ngram_join.row_shingles(*ngram_join.text_bytes(rows.column("text")), 4)]
    wanted = [7, 90, 201]  # the last is the row without an id
    picked = pa.record_batch([pa.array([nodes[i] for i in wanted]), pa.array([ids[i] for i in wanted], pa.int64())], names=["node", "doc_id"])
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in ngram_join._spots(iter([picked])):
        bits[_map_place(np.asarray(batch.column("spot")))] = True
    likely = SimpleNamespace(value=np.packbits(bits, bitorder="little").tobytes())
    cut = []
    plain = ngram_join.row_shingles
    monkeypatch.setattr(ngram_join, "row_shingles", lambda data, offsets, k: cut.append(len(offsets) - 1) or plain(data, offsets, k))
    got = [x for b in ngram_join._with_node(4, likely)(iter([rows])) for x in b.to_pylist()]
    assert got == [{"node": nodes[i], "text": texts[i]} for i in wanted]
    assert sum(cut) == 4  # id 0 counts as likely along with the row without an id


def test_words_are_looked_up_once_and_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    words = token_files._Words(queries.tokenizer_path("word_bpe_49k.json"))
    model, whole, looked = [], [], []
    plain_model, plain_text, plain_find = words._model_ids, words._text_ids, words.find
    words._model_ids = lambda low: model.append(low) or plain_model(low)
    words._text_ids = lambda part: whole.append(part) or plain_text(part)
    words.find = lambda found: looked.extend(found) or plain_find(found)
    letters = "abcdefgh"
    names = ["wort" + a + b for a in letters for b in letters]  # more than are remembered at a time
    for at in range(0, len(names), 16):
        words.encode(pa.array([" ".join(names[at : at + 16] * 3), names[0].upper() + ","]))
    assert model == names and whole == [","]
    assert len(looked) == len(names) + 4  # not once for each of their three places


def test_words_in_any_text_as_the_library_gives_them():
    words = token_files._Words(queries.tokenizer_path("word_bpe_49k.json"))
    parts = [
        "The", "the,", "THE***", "caf\u00e9$$$", "\u00c0\u00c9\u00de)", "stra\u00dfe\"", "don't", "cats'.", "x-.", "x-", "4.0.", "5%", "...", "|", "a#b#",
        "a<|endoftext|>", "<|endoftext|>", "a|>", "<|", "\u212a", "\u212b.", "k", "\u0130x", "\u017f", "e\u0301", "\u00b5m", "a\u00a0b", "a\x1cb", "\u4e2d\u6587.", "[x](y)",
    ]
    texts = [None, "", " ", "\t" + "\n".join(parts) + " ", *parts, *(p + "{}" for p in parts), "a\x0bb\x0cc\rd"]
    plain = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for rows in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["cut off", *texts])[1:]):
        assert [x.tolist() for x in words.encode(rows)] == plain
    assert words.encode(pa.array([], pa.string())) == []


def plain_distance(a, b):
    above = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
        above = row
    return above[-1]


def test_edit_distances_of_many_pairs_agree_with_the_plain_table():
    draw = random.Random(5)
    seen = set()
    for letters in ("ab", "abcdefgh \x00\x01\x02", "abé日\U0001d11e"):
        for similarity in (0.8, 0.5, 0.95):
            pairs = []
            for _ in range(250):
                x = [draw.choice(letters) for _ in range(draw.choice((0, 1, 2, 5, 11, 30, 64, 65)))]
                y = list(x)
                for _ in range(draw.randrange(len(x) // 2 + 2)):
                    at = draw.randrange(len(y) + 1)
                    y[at : at + draw.randrange(2)] = draw.choice(["", draw.choice(letters)])
                pairs.append(draw.sample(["".join(x), "".join(y)], 2))
            right = [plain_distance(x, y) <= int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in pairs]
            batches = [pa.record_batch([pa.array([i]), pa.array([-i]), pa.array([x]), pa.array([y])], names=["a", "b", "x", "y"])
                       for i, (x, y) in enumerate(pairs)]
            got = [x for b in edits.near_pairs(similarity)(iter(batches)) for x in b.to_pylist()]
            assert got == [{"a": i, "b": -i} for i, good in enumerate(right) if good]
            seen |= set(right)
    assert seen == {True, False}


def test_one_pair_of_very_long_lines():
    draw = random.Random(6)
    x = "".join(draw.choice("abcdefgh ") for _ in range(18_000))
    y = "".join(c for i, c in enumerate(x) if i % 10)
    started = time.process_time()
    assert edits.within(pa.array([x, x]), pa.array([y, x[::-1]]), 0.8).tolist() == [True, False]
    assert time.process_time() - started < 30


def test_keys_of_lines_are_made_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line number {i} of a text about {'abcdefgh'[i % 8] * 3}\nthe same end of all") for i in range(40)], "doc_id long, text string")
    calls, plain = str(tmp_path), line_dedup._similar_keys

    def counted(*settings):
        run = plain(*settings)

        def count(batches):
            def noted(batch):
                for i in batch.column("text").to_pylist():
                    tempfile.mkstemp(dir=calls)
                return batch

            return run(map(noted, batches))

        return count

    line_dedup._similar_keys = counted
    try:
        found = line_dedup.duplicate_lines(docs, min_words=1, distance=None).collect()
    finally:
        line_dedup._similar_keys = plain
    assert len(os.listdir(calls)) == 40
    assert all(1 in r["removed"] for r in found) and len(found) == 39
    work = shared_dir(spark)
    assert not [x for x in os.listdir(work) if x.startswith("line-keys") and os.path.getmtime(f"{work}/{x}") > os.path.getmtime(calls) - 1]


def test_no_rounds_where_candidates_are_no_links(spark):
    """Nodes that share a wide key but are never linked are tested once each pair, not in rounds before."""
    keyed = spark.range(60).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.struct(F.lit(1).alias("x")).alias("meta"))
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return pairs.where("a = 7 and b = 31")

    found = {r["node"]: r["component"] for r in linking.link_components(keyed, lambda x, y: F.lit(True), verify).collect()}
    assert found == {7: 7, 31: 7}
    assert tested == [59, 60 * 59 // 2 - 59]


def test_texts_of_pairs_go_in_shares_and_do_not_stay(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"a text about {'abcdefgh'[i % 8] * 9} and what {'xyz'[i % 3] * 5} it may be called here{'.' * (i % 2)}") for i in range(48)],
        "doc_id long, text string",
    )
    find = lambda: {r["doc_id"] for r in line_dedup.duplicate_lines(docs, min_words=1, distance=None).collect()}
    stored, plain = [], line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name, *more: stored.append((name, out := plain(df, name, *more))) or out)
    whole, before = find(), len(stored)
    monkeypatch.setattr(line_dedup, "SHARE", 0)
    monkeypatch.setattr(line_dedup, "SHARE_CHARS", 500)
    assert find() == whole and 0 < len(whole) < 48
    assert sum(name == "verified" for name, _ in stored[before:]) > 3
    texts = [out._work_path for name, out in stored if name == "pair-texts"]
    assert texts and not any(os.path.exists(x.removeprefix("file:")) for x in texts)
