"""Each stage of the corpus pipeline on small awkward tables, and what it must keep."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ethersense.llm import queries
from ethersense.session import work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_node", "_rows", "_removed", "_text_key", "_mix_id", "_mix_copies", "_mix_copy", "_score_toxic", "_score_junk")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark):
    """Documents with nulls, blanks, copies, toxic texts and columns of the stages' own names."""
    rng = random.Random(4)
    clean = [words(rng, rng.randrange(20, 60)) for _ in range(60)]
    toxic = [words(rng, 30) + " vileword hateterm nastything" for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean + toxic)]
    rows += [(200, clean[0], "en", "s1", None), (201, None, None, None, None), (202, "", "en", "s0", 0), (203, " \n\t", "en", "s0", 3),
             (None, words(rng, 25), "en", "s2", 9), (None, words(rng, 26), "en", "s2", 9), (None, None, None, None, None), (5, clean[5], "en", "s2", 7)]
    path = work_path(spark, "pipeline")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= 60)) for i in range(100) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def own_columns(rows):
    return all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHING)


def test_stages_one_after_the_other(spark, folder):
    docs = queries.table(spark, folder, "documents")
    before = docs.collect()
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]

    rows = cp.drop_toxic(spark, docs, folder).collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert not any(60 <= d < 100 for d in ids if d is not None)
    clean = Counter(r["doc_id"] for r in before if r["doc_id"] is None or not 60 <= r["doc_id"] < 100)
    assert ids == clean and own_columns(rows)

    calm = spark.createDataFrame(rows, docs.schema)
    rows = cp.dedup_lines(spark, calm, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == clean and own_columns(rows)
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[200] == "" and text[202] == "" and text[203] == " \n\t" and text[201] is None and text[0]
    assert {r["n_chars"] for r in rows if r["doc_id"] == 200} == {0}

    lined = spark.createDataFrame(rows, docs.schema)
    rows = cp.join_ngrams(spark, lined, folder).collect()
    assert own_columns(rows)
    full = Counter(r["text"] for r in lined.collect() if r["text"] and r["text"].strip())
    assert Counter(r["text"] for r in rows if r["text"] and r["text"].strip()) == Counter(dict.fromkeys(full, 1))

    joined = spark.createDataFrame(rows, docs.schema)
    rows = cp.mix(spark, joined, folder).collect()
    again = cp.mix(spark, joined.repartition(3), folder).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again)) and own_columns(rows)
    assert max(Counter(map(str, rows)).values()) <= 2
    assert {r["doc_id"] for r in rows} >= {201, 202, 203}  # documents without words stay

    found = cp.sample_pieces(spark, spark.createDataFrame(rows, docs.schema), folder)
    assert "ids" not in found.columns and found.where("not decoded").count() == 0
    assert found.groupBy().agg(F.max("sample")).first()[0] == 2


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_of_an_empty_table(spark, folder, name, stage):
    docs = queries.table(spark, folder, "documents").limit(0)
    out = stage(spark, docs, folder)
    assert out.count() == 0
    if name != "sentencepiece":
        assert out.columns == docs.columns
