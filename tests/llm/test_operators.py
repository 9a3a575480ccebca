"""Each operator against a brute-force version on small tables with awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethersense.llm import ann, components, line_dedup, mixing, ngram_join, repeats, sentencepieces, token_files, topk, toxicity, warc
from ethersense.llm.queries import TOXIC, categories, op4_line_dedup, tokenizer_path
from ethersense.session import work_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=1, groups=12, copies=6):
    """Groups of near copies, exact copies, nulls, blanks, short texts, a long text, null and repeated ids."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = random_text(rng, rng.randrange(30, 90)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(1000)}"
            texts.append(" ".join(own))
    texts += [None, "", "  \n\t ", "one", "One", "two words", "three word text", texts[0], texts[0].upper(), random_text(rng, 3000), "éÉ a b c d", "a b c\x1cd e f g"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[3]), (None, None), (rows[0][0], rows[0][1])]


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumn("key", F.lit("x")).withColumn("node", F.lit(1)).withColumn("n", F.lit(None).cast("int"))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 150)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {x: 100 for x in range(100, 150)} | {200: 200, 201: 200}
    assert found == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_components(rows, words, percent):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, words, percent):
    rows = corpus()
    found = ngram_join.ngram_components(frame(spark, rows), words, percent).collect()
    assert Counter(tuple(r) for r in found) == brute_components(rows, words, percent)


def test_ngram_keep_one(spark):
    rows = [r for r in corpus(2)[:-3]]
    docs = frame(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [d for d, n, c in brute_components(rows, 5, 80).elements() if n == 0 or d == c]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_ngram_keep_one_ids(spark):
    """Null and shared ids: one row of each component, whatever the ids are."""
    rng = random.Random(13)
    clean = [random_text(rng, 40, 10**6) for _ in range(9)]
    near = clean[5] + " more"
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[1].upper()), (None, clean[2]), (7, clean[3]), (7, clean[4])]
    rows += [(7, near), (3, clean[5]), (8, clean[6]), (8, clean[6]), (None, clean[6]), (9, clean[7]), (9, clean[7] + " end"), (None, ""), (None, None), (7, " ")]
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    got = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept)
    last = [x for x in got if x[1] in (clean[7], clean[7] + " end")]
    assert len(last) == 1 and got.pop(last[0]) == 1
    want = [(None, clean[0]), (None, clean[1]), (None, clean[2]), (7, clean[3]), (7, clean[4]), (3, clean[5]), (8, clean[6])]
    assert got == Counter(want + [(None, ""), (None, ""), (7, " ")])


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "together", "segment"), [(200, 256, 1 << 18), (50, 256, 1 << 18), (50, 2, 300)])
def test_repeats(spark, monkeypatch, length, together, segment):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rng = random.Random(4)
    passage = random_text(rng, 80)
    rows = corpus(3) + [(1000 + i, random_text(rng, rng.randrange(40)) + " " + passage + " " + random_text(rng, rng.randrange(40))) for i in range(12)]
    rows += [(2000, "ab" * 900), (2001, "a" * 700), (2002, "é" * 300), (2003, passage + passage)]
    found = repeats.remove_repeats(frame(spark, rows), length).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("k"), "kept_sha256"
    )
    assert Counter(tuple(r) for r in found.collect()) == brute_repeats(rows, length)


def test_repeats_segments():
    """A text cut into segments owns each of its windows once."""
    import pyarrow as pa

    text = random_text(random.Random(1), 2000)
    batch = pa.record_batch([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "text_key", "text"])
    before = repeats.SEGMENT
    try:
        repeats.SEGMENT = 1000
        parts = list(repeats._phrases(200, 64)([batch]))
    finally:
        repeats.SEGMENT = before
    covered = sorted((lo, lo + n) for p in parts for lo, n in zip(p.column("lo").to_pylist(), p.column("n").to_pylist()))
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - 199
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [random_text(rng, rng.randrange(8, 60)) for _ in range(40)]
    lines += [x.replace("w1", "w2", 1).title() for x in lines[:20]] + ["too short", "", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for i in range(60)] + [(None, lines[0]), (None, None), (3, lines[1])]
    rows = list(dict.fromkeys(rows))

    def norm(x):
        return re.sub("[0-9]", "0", " ".join(x.lower().split()))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    kinds = sorted({norm(x) for _, t in rows for x in (t or "").split("\n") if len(x.split()) >= 5})
    sims = {k: int(line_dedup._lines_of([k])[1][0]) for k in kinds}
    group = {k: k for k in kinds}
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if bin(sims[a] ^ sims[b]).count("1") <= 3 and distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9):
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    docs = frame(spark, rows)
    key = {(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    spots = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if len(x.split()) >= 5:
                spots.setdefault(group[norm(x)], []).append(((d is not None, d or 0), key[d, t], i))
    kept = {min(s) for s in spots.values()}
    want = Counter()
    for d, t in rows:
        out = [x for i, x in enumerate((t or "").split("\n")) if len(x.split()) < 5 or ((d is not None, d or 0), key[d, t], i) in kept]
        want[d, None if t is None else "\n".join(out)] += 1
    found = line_dedup.drop_duplicate_lines(docs)
    assert found.columns == [*docs.columns, "_removed"]
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == want
    assert len(set(group.values())) < len(kinds) < len(lines)
    assert line_dedup.drop_duplicate_lines(docs.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    longer = max(len(a), len(b))
    return longer - min(len(a), len(b)) <= 0.2 * longer + 1e-9 and edits(a, b) <= math.floor(0.2 * longer + 1e-9)


def changed(rng, line, share):
    """``line`` with words swapped for others until about ``share`` of its characters may differ."""
    words, left = line.split(" "), share * len(line)
    for at in rng.sample(range(len(words)), len(words)):
        left -= len(words[at])
        if left < 0:
            break
        words[at] = "".join(rng.choice("bcdfgaeiou") for _ in words[at])
    return " ".join(words)


def test_line_dedup_short_keys():
    """Up to 24 characters every pair of enough edit similarity shares a key."""
    rng = random.Random(11)
    lines = {"".join(rng.choice("abc é日") for _ in range(rng.randrange(1, 31))) for _ in range(90)}
    for x in list(lines):
        for _ in range(4):
            y = list(x)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "a", "日"])
            lines.add("".join(y) or "a")
    keys = {x: set(line_dedup._short_keys(x, 0.8)) for x in lines}
    near = [(x, y) for x in lines for y in lines if x < y and min(len(x), len(y)) <= 24 and alike(x, y)]
    assert len(near) > 200
    assert all(keys[x] & keys[y] for x, y in near)


def test_line_dedup_recall(spark):
    """Against brute force by edit similarity alone: at least 0.95 of near copies found, and nothing else."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    base = [" ".join(word() for _ in range(n)) for n in [5, 6, 8, 10, 12, 15, 20, 25, 30, 40] * 12]
    near = [changed(rng, x, 0.2) for x in base]
    want = {i + len(base) for i, (x, y) in enumerate(zip(base, near)) if alike(x, y)}
    found = line_dedup.duplicate_lines(frame(spark, list(enumerate(base + near))), distance=None)
    gone = {r["doc_id"] for r in found.collect()}
    assert len(want) > 100 and gone <= want
    assert len(gone) >= 0.95 * len(want)


def test_line_dedup_short_lines(spark):
    """The query looks at lines of few words and at scripts without spaces too."""
    long = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(1, "Les.\nAnd ornd.\n\n" + long), (2, "les.\n \n\nAnd  ornd.\nother"), (3, "Les.\n" + long[:30] + "x" + long[31:]), (4, None)]
    docs = frame(spark, rows)
    path = work_path(spark, "documents")
    docs.write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in op4_line_dedup(spark, path).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 0}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_duplicate_lines(docs, min_words=1, distance=None).collect()}
    assert kept == {1: rows[0][1], 2: " \n\nother", 3: "", 4: None}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, random_text(rng, rng.randrange(400)), rng.choice(["a"] * 8 + ["b", "c", "d", "B", None])) for i in range(400)]
    rows += [(None, "x y z", "a"), (5, None, "b"), (7, "", "e"), (8, "w " * 20000, "d"), rows[3], rows[3]]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block_words=8, shard_blocks=64)
    found = [r.asDict() for r in mix.documents.withColumn("x", F.lit(1)).collect()]
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, rest = {}, 1.5 * sum(total.values())
    open_ = set(sources)
    while True:
        even = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if even[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            open_.discard(s)
    target |= even
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, size(t)) for d, t, _ in rows)
    for s in sources:
        mine = [r for r in found if r["source_size"] == total[s] and math.isclose(r["target"], target[s], rel_tol=1e-12)]
        assert sum(r["size"] for r in mine) == total[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 8
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    again = mixing.mix_sources(docs.repartition(5), block_words=8, shard_blocks=64).documents.collect()
    assert Counter(tuple(r) for r in again) == Counter((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in found)
    plan = mix.plan.collect()
    assert len({r["slot"] for r in plan}) == len(plan)
    assert max(Counter((r["source"], r["block"]) for r in plan).values()) <= 2
    for empty in (docs.limit(0), docs.where("size(split(text, ' ')) < 2").limit(1)):
        assert all(r["taken"] <= 2 * r["size"] for r in mixing.mix_sources(empty).documents.collect())


def test_warc(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
        rows = [(i, f"http://x/{i}\r\n", f"<p>{i % 7}</p>" * (i % 40)) for i in range(120)]
        rows += [(200, None, None), (201, "u", ""), (202, "v", "before " + fake * 3 + "after"), (203, "WARC/1.1\r\n", "WARC/1.1\r\n"), (204, "é", "é\r\n\r\n" * 9)]
        rows += [(None, "n", "lone"), (None, "m", "<p>1</p>"), (300, "a", "twice"), (300, "b", "twice"), (205, "x", "before " + fake * 3 + "after")]
        pages = frame(spark, rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
        found = warc.round_trip(pages, records=50)
        payload = [(p, (h or "").encode()) for p, _, h in rows]
        want, heads = Counter(), {}
        for p, b in sorted(payload, key=lambda x: (x[0] is None, x[0] or 0)):
            digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
            first = b not in heads
            heads.setdefault(b, p)
            want[p, len(b), digest, "response" if first else "revisit", None if first else heads[b]] += 1
        got = Counter(tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert got == want
        blocks = {r["page_id"]: bytes(r["block"]) for r in found.where("record_type = 'response'").select("page_id", "block").collect()}
        assert all(blocks[p] == b for p, b in payload if p in blocks and heads[b] == p and p is not None)
        bare = warc.round_trip(pages, records=50, keep_blocks=False)
        assert bare.where("block is not null").count() == 0
        assert Counter(tuple(r) for r in bare.drop("block").collect()) == want
        assert warc.round_trip(pages.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def vectors(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[7] = x[9] = x[11] = x[20]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(1000, None), (None, rows[0][1]), (1001, [None] * dim), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (1040, [0.0] * dim), (1005, []), (1060, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("s"))


def usable(rows, zero):
    for i, x in rows:
        if i is not None and x and not any(v is None or math.isnan(v) or math.isinf(v) for v in x) and (zero or any(x)):
            yield i, x


@pytest.mark.parametrize("rows_per_block", [1024, 37])
def test_exact_top_k(spark, rows_per_block):
    rows, df = vectors(spark)
    good = [(i, [math.floor(256 * v) for v in x]) for i, x in usable(rows, True)]
    want = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x)))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    found = topk.exact_top_k(df, every=20, k=5, rows=rows_per_block, queries=7, step=4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert topk.exact_top_k(df.limit(0), every=20, k=5).count() == 0


def test_nearest(spark):
    rows, df = vectors(spark)
    good = list(usable(rows, False))
    found = {}
    for r in ann.nearest_neighbours(df, every=20, k=10, part_rows=64).collect():
        found.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for q, x in good:
        if q % 20 == 0:
            exact = {i: float((np.array(x) * np.array(y)).sum()) for i, y in good if i != q and len(y) == len(x)}
            best = sorted(exact, key=lambda i: (-exact[i], i))[:10]
            mine = sorted(found.get(q, []), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
            assert all(r["score"] == exact[r["vec_id"]] for r in mine)
            order = [(-r["score"], r["vec_id"]) for r in mine]
            assert order == sorted(order) and len(set(order)) == len(order)
            hit, total = hit + len(set(best) & {r["vec_id"] for r in mine}), total + len(best)
    assert hit >= 0.9 * total
    assert ann.nearest_neighbours(df.limit(0), every=20, k=5).count() == 0


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    found = ann.nearest_neighbours(df, every=20, k=20).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    hit = total = 0
    for r in found:
        best = sorted((-float(x[r["query_id"]] @ y), i) for i, y in x.items() if i != r["query_id"])[:20]
        hit, total = hit + len({i for _, i in best} & set(r["v"])), total + 20
    assert hit >= 0.9 * total


@pytest.mark.parametrize(("kind", "exact_rows"), [("outlier", 1024), ("outlier", 0), ("lognormal", 128), ("tiny", 0)])
def test_nearest_uneven_norms(spark, kind, exact_rows):
    """All queries get their rows and recall stays when norms differ."""
    rng = np.random.default_rng(3)
    n = 15 if kind == "tiny" else 2000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= np.exp(rng.standard_normal((n, 1)))
    else:
        x[5] *= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(df, every=20, k=20, exact_rows=exact_rows).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in range(0, n, 20):
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
        assert len(found[q]) == len(order)
        hit, total = hit + len(found[q] & set(order)), total + len(order)
    assert hit >= 0.9 * total, hit / total


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", F.lit("x").alias("p_toxic"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train_chain(docs, labels.where("doc_id % 3 <> 0"), categories())
    assert [len(e) for e in chain.earlier] == [0, 1]
    scored = toxicity.score_toxicity(docs, chain).join(labels.where("doc_id % 3 = 0"), "doc_id")
    rows = scored.select("toxic", (F.col("p_toxic") >= TOXIC).cast("int").alias("said")).groupBy("toxic", "said").count().collect()
    n = {(r["toxic"], r["said"]): r["count"] for r in rows}
    # about 300 toxic training texts; in three of four languages their words are rare
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "idiot"), (3, "a b c"), (3, "a b c")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, none, categories())
    assert all(r["p_toxic"] < 0.5 for r in toxicity.score_toxicity(docs, chain).collect())
    some = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (None, 1, 1), (2, None, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, some, categories())
    assert toxicity.score_toxicity(docs, chain).count() == 5


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = corpus(7) + [(500 + i, t) for i, t in enumerate([
        "Hello, World! it's don't WE'LL  x.y,z;; 12 a1b2", "<|endoftext|> in <|startoftext|>x", "ÉCOLE Straße İstanbul ΣΑΣ ﬁ é Ａ", "日本語 текст", "😀 ok\u0085b \x1c",
    ])]
    path = work_path(spark, "tokens")
    name = tokenizer_path("word_bpe_49k.json")
    token_files.write_token_files(frame(spark, rows), path, name)
    found = token_files.read_token_files(spark, path).collect()
    plain = Tokenizer.from_file(name)
    ids = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((d, tuple(x)) for (d, _), x in zip(rows, ids))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"]) for r in found)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1], np.uint32)
    for n in range(9):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()
    assert token_files.round_trip(frame(spark, rows).limit(0), name).count() == 0


def test_sentencepiece(spark):
    rows = corpus(8) + [(600, "a  b\n\n c\t日本 😀é "), (601, "ab"), (602, "x"), (603, " ")]
    docs = frame(spark, rows)
    name = tokenizer_path("piece_bpe_32k.model")
    found = sentencepieces.sample_segmentations(docs, name, k=3).collect()
    by_row = {}
    for r in found:
        assert r["decoded"] and 0 <= r["inclusion"] <= 1 and r["log_prob"] <= 0
        by_row.setdefault(r["doc_id"], []).append(r)
    texts = {d: t for d, t in rows}
    model = sentencepieces._load(name, 1.0).model
    for d, mine in by_row.items():
        if d is not None and len({r["sample"] for r in mine}) == len(mine):
            assert len({tuple(r["ids"]) for r in mine}) == len(mine)
            assert all(model.decode(r["ids"]) == (texts[d] or "") for r in mine)
    again = sentencepieces.sample_segmentations(docs.repartition(2), name, k=3).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))
    assert sentencepieces.sample_segmentations(docs.limit(0), name).count() == 0


def test_sentencepiece_log_inclusion(spark):
    """Inclusion scores of long texts can be told apart by their logarithm."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    words = [w for r in texts for w in (r["text"] or "").split()]
    assert len(words) > 20000
    docs = frame(spark, [(1, " ".join(words[:10000])), (2, " ".join(words[-10000:])), (3, "one two"), (4, "")])
    found = sentencepieces.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=False).collect()
    assert all(math.isfinite(r["log_inclusion"]) and r["log_inclusion"] <= 0 for r in found)
    assert all(math.isclose(math.exp(r["log_inclusion"]), r["inclusion"], rel_tol=1e-9, abs_tol=1e-300) for r in found)
    long = [r["log_inclusion"] for r in found if r["doc_id"] < 3]
    assert len(set(long)) == 4 and max(long) < -745, long
    assert all(r["inclusion"] == 0 for r in found if r["doc_id"] < 3)
    gaps = [-800.0, -40.0, -29.9, -5.0, -0.4, -0.3, 2.0, 60.0]
    logs = [sentencepieces._log_inclusion(g) for g in gaps]
    assert all(math.isclose(x, math.log(-math.expm1(-math.exp(g))), rel_tol=1e-12) for g, x in zip(gaps[1:5], logs[1:5]))
    assert logs == sorted(logs) and logs[0] == -800.0


def test_sentencepiece_distribution():
    """Over many keys the first sample follows the lattice's chances, and inclusion follows sampling in pairs."""
    name = tokenizer_path("piece_bpe_32k.model")
    model = sentencepieces._load(name, 1.0)
    lattice = sentencepieces._Lattice(model, ["▁the", "▁in"])
    ways = {}

    def walk(state, path, log_p):
        for e in range(lattice.first[state], lattice.first[state + 1]):
            to = lattice.to[e]
            if to < 0:
                ways[tuple(path + [e])] = log_p + lattice.log_p[e]
            else:
                walk(to, path + [e], log_p + lattice.log_p[e])

    walk(lattice.start[0], [], 0.0)
    assert math.isclose(sum(map(math.exp, ways.values())), 1.0, rel_tol=1e-9)
    n, k = 4000, 2
    first, weight = Counter(), Counter()
    unit = np.zeros(1, np.int64)
    for i in range(n):
        seed = int(sentencepieces.mix64(np.array([i], np.uint64))[0])
        fresh = [sentencepieces._paths(lattice, unit, sentencepieces.mix64(np.array([seed], np.uint64)), r) for r in range(k)]
        found, bar = sentencepieces._sample_row(lattice, fresh, (0, 1), seed, k)
        first[tuple(found[0][0])] += 1
        assert found[0][2] > found[1][2] > bar
        for edges, log_p, _ in found:
            weight[tuple(edges)] += 1 / -math.expm1(-math.exp(log_p - bar)) if bar > -math.inf else 1
    for way, log_p in ways.items():
        p = math.exp(log_p)
        assert abs(first[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
    # the inverse inclusion scores estimate one per way, weighted by its chance they sum to 1
    assert abs(sum(math.exp(ways[w]) * c / n for w, c in weight.items()) - 1) < 0.1
