"""Language identification, whitening and conversation repair against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ethersense.llm import conversations as cv
from ethersense.llm import ann, language, line_dedup, linking, ngram_join, sentencepieces, toxicity, whitening
from ethersense.llm.queries import op11_language, op12_whiten, op13_repair, tokenizer_path

MARK = re.compile(r"[^\x20\x09-\x0D]")


# -- language ---------------------------------------------------------------------------------------------------


def text_grams(text):
    kind = ["w" if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in text.lower()]
    words = "".join(c if k == "w" else " " for c, k in zip(text.lower(), kind)).split()
    out = Counter()
    for w in words:
        w = f" {w} "
        for n in language.ORDERS:
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if not (n > 2 and " " in g[1:-1]):
                    out[g] += 1
    # edges are shared by neighbouring words, so each bigram and longer gram still belongs to one word
    return out


def brute_languages(rows):
    counts = {}
    for lang, text in rows:
        for g, n in text_grams(text).items():
            counts.setdefault(g, Counter())[lang] += n
    totals = Counter()
    for g, by in counts.items():
        for lang, n in by.items():
            totals[lang, len(g)] += n
    contained = {}
    for g, by in counts.items():
        share = {lang: n / totals[lang, len(g)] for lang, n in by.items() if n / totals[lang, len(g)] >= language.RARE}
        for lang, p in share.items():
            if p >= language.SHARE * max(share.values()):
                contained.setdefault(lang, set()).add(g)
    return contained


ROWS = [
    ("en", "The cat and the dog. The end of that?"), ("en", "this is the one that they had, and the"), ("fr", "le chat et le chien, c'est la vie où"),
    ("fr", "les uns et les autres ÉTÉ là"), ("ta", "தமிழ் மொழி"), ("", "zzz zzq"), ("de", None), (None, "not learned at all"), ("de", "12 34 ..."),
]


def hash_of(gram):
    found, _, _ = next(language.grams([gram.strip() or "x"], (len(gram),)))
    return found


def test_language_filters(spark):
    model = language.learn_languages(spark.createDataFrame(ROWS, "lang string, text string").repartition(3))
    assert model.languages == ["", "de", "en", "fr", "ta"]
    contained = brute_languages([(a, b) for a, b in ROWS if a is not None and b is not None])
    texts = [b for _, b in ROWS if b]
    for text in texts:  # which languages contain the grams: no false negatives, hardly any false positives here
        found, whose, _ = next(language.grams([text]))
        want = text_grams(text)
        assert sum(len(f) for f in found) == sum(want.values())
        masks = np.concatenate([model.containing(h)[0] for h in found])
        for i, name in enumerate(model.languages):
            exact = sum(n for g, n in want.items() if g in contained.get(name, ()))
            assert exact <= ((masks >> i) & 1).sum() <= exact + 1
    queries = texts + [None, "", " \n", "12!", "the", "ü", "THE CAT"]
    names, score = model.decide(queries)
    for text, name, s in zip(queries, names, score.tolist()):
        g = text_grams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (name, s) == ("und", 0.0)
            continue
        share = {x: sum(n for k, n in g.items() if k in contained.get(x, ())) / sum(g.values()) for x in model.languages}
        assert abs(share[name] - max(share.values())) < 0.02 and abs(s - share[name]) < 0.02 and 0 <= s <= 1


def test_language_awkward_rows(spark):
    model = language.learn_languages(spark.createDataFrame(ROWS, "lang string, text string"))
    rows = [(1, "the cat", "x"), (1, "the cat", "x"), (None, "le chien", None), (3, None, "y"), (4, "", ""), (5, "the " * 700_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lang string").withColumn("0", F.lit(1)).withColumn("_text", F.lit(2))
    got = {(r["doc_id"], r["_lang"]): r for r in language.identify(df, model).collect()}
    assert set(got) == {(1, "en"), (None, "fr"), (3, "und"), (4, "und"), (5, "en")}
    assert all(r["0"] == 1 and r["_text"] == 2 for r in got.values())
    empty = language.learn_languages(spark.createDataFrame([], "lang string, text string"))
    assert {(r["_lang"], r["_lang_score"]) for r in language.identify(df, empty).collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), model).collect() == []
    many = spark.createDataFrame([(f"l{i:03d}", "".join(chr(0x4E00 + 40 * i + j) for j in range(30))) for i in range(130)], "lang string, text string")
    wide = language.learn_languages(many)
    assert len(wide.filters) == 3
    assert wide.decide([r["text"] for r in many.orderBy("lang").collect()])[0] == wide.languages


def test_language_long_words(spark):
    parts = list(language._parts("ab " * 400_000 + "c" * (1 << 20) + "d"))
    assert sum(len(p) for p in parts) == 1_200_000 + (1 << 20) + 1
    assert len(parts[0]) <= language.LONG and chr(parts[0][-1]) == " "


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op11_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.98


# -- whitening --------------------------------------------------------------------------------------------------


def brute_whiten(rows, k=16):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept], object)
    fit = sorted(set(map(tuple, x.tolist())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in fit], float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = []
    for (i, _), row in zip(kept, x.tolist()):
        far = [n * v - s for v, s in zip(row, sums)]
        white = np.array([f / n for f in far]) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, sum(f * f for f in far), white))
    return n, out, values[order] / np.trace(cov)


def check_whiten(got, rows):
    n, want, explained = brute_whiten(rows)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert Counter((i, d) for i, d, _ in want) == Counter({key: len(c[1]) for key, c in by.items()})
    signs = None
    for i, deviation, white in want:
        mine = np.array([by[i, deviation][c + 1][0]["whitened"] for c in range(len(white))])
        if signs is None or (signs == 0).any():
            signs = np.where(np.abs(white) > 1e-6, np.sign(mine * white), 0) if signs is None else np.where(signs == 0, np.sign(mine * white), signs)
        assert np.allclose(np.abs(mine), np.abs(white), atol=1e-9) and np.allclose(mine, signs * white, atol=1e-6)
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-4 and abs(r["explained"] / explained[r["component"] - 1] - 1) <= 1e-4


def test_whiten(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(120, 20)) * np.linspace(0.2, 3, 20))]
    rows += [(200, rows[0][1]), (3, rows[3][1]), (None, rows[5][1])]
    bad = [(300, None), (301, []), (302, [None] + rows[0][1][1:]), (303, [float("nan")] + rows[0][1][1:]), (304, [float("inf")] + rows[0][1][1:]), (305, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5).withColumn("x", F.lit(1)).withColumn("row_index", F.lit(2))
    check_whiten(whitening.whiten(df).collect(), rows)


def test_whiten_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same} == {
        (i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)}
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], schema)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert max(r["identity_error"] for r in line) < 1e-9 and {r["deviation"] for r in line} == {64 * 64 * 2}
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert len(far) == 6


def test_whiten_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whiten(op12_whiten(spark, sf).collect(), rows)


# -- conversations ----------------------------------------------------------------------------------------------

NEXT = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
INSERT = {"0": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def close(best):
    for _ in range(3):
        for state in list(best):
            cost, audit, lines = best[state]
            to = INSERT[state]
            found = (cost + 2, audit + "I", (*lines, NAME[to] + ":"))
            if to not in best or found[:2] < best[to][:2]:
                best[to] = found
    return best


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        marks = MARK.findall(text)
        faults.append("blank" if not marks else "again" if (role, text) in seen else "open" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"0": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in close(best).items():
            late, to = int(fault == "open"), INSERT[state]
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "again"):
                options.append((to, (cost + 2 + late, audit + "R", (*lines, f"{NAME[to]}:{text}"))))
                if role[:1] in NEXT[state]:
                    options.append((NEXT[state][role[:1]], (cost + late, audit + "K", (*lines, f"{role}:{text}"))))
            for s, found in options:
                if s not in new or found[:2] < new[s][:2]:
                    new[s] = found
        best = new
    cost, audit, lines = min((v for s, v in close(best).items() if s in "0a"), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("again"), faults.count("open"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def check_repair(spark, df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = {conv: brute_repair(kept) for conv, kept in damage(rows).items()}
    got = cv.repair_conversations(df).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def awkward(seed=1):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "s", "usher"]
    rows = [
        (rng.choice([c, c, c, None]) if c < 15 else c, rng.choice([t, t, t, None, rng.randrange(5), -t]), rng.choice(roles),
         rng.choice(["Hi.", "ok", "", None, "a b!", "x? ", "zz\n", "é..", " \t", f"q{t}."]))
        for c in range(150) for t in range(rng.choice([1, 2, 3, 5, 8, 20]))
    ]
    rows += [(1000, t if t % 7 else None, rng.choice(roles[:5] + ["tool"]), rng.choice(["Hi.", "ok", f"w{t}.", f"v{t}", f"r{t}!"])) for t in range(3000)]
    return rows + [(1001, 5, "user", "Same.")] * 300 + [(1002, 1, "user", "Big " * 300_000 + ".")] * 3


def test_repair(spark):
    df = spark.createDataFrame(awkward(), "conv_id long, turn long, role string, text string").repartition(5)
    check_repair(spark, df.withColumn("n", F.lit("x")).withColumn("digest", F.lit(0)).withColumn("part", F.lit(9)))
    check_repair(spark, df.limit(0))


def test_repair_table(spark):
    check_repair(spark, spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert op13_repair(spark, "/root/testdata/sf0.001").count() == 20


def least_costs(codes, ends):
    """Distances by relaxing every arc until nothing changes."""
    graph, first, _ = cv.row_lattices([codes], np.array([ends], np.int64))
    price = np.where(graph.sink, graph.price, cv.INF)
    for _ in range(len(price) + 1):
        price = np.where(graph.sink, price, np.minimum((graph.cost + price[graph.to]).min(axis=1), cv.INF))
    return price


def test_auction_prices():
    rng = random.Random(5)
    for _ in range(60):
        codes = [rng.choice([-1, -3, 0, 1, 2, 3, 1, 2, 5, 6]) for _ in range(rng.randrange(0, 30))]
        ends = [rng.choice([0, 2, 5, int(cv.INF)]) for _ in range(3)] + [0]
        graph, first, last = cv.row_lattices([codes], np.array([ends], np.int64))
        want = least_costs(codes, ends)
        origins = first + rng.randrange(4)
        graph.settle(origins, first)
        assert graph.price[origins[0]] == want[origins[0]]
        assert (graph.price <= want).all() and (graph.price[graph.exact] == want[graph.exact]).all()
        cuts = sorted(rng.randrange(len(codes) + 1) for _ in range(3))
        chain = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        costs = cv.block_costs(chain)
        joined = cv.chain_costs([costs.tolist()])[0]
        assert (joined == cv.block_costs([codes])[0]).all()
        behind = cv.chain_prices([costs.tolist()], np.array([ends], np.int64))[0]
        assert (behind == want.reshape(-1, 4)[[*cuts, len(codes)]]).all()
        prices, labels, exits = cv.block_traces(chain, behind)
        state, text = 0, ""
        for p, l, e in zip(prices, labels, exits):
            if p[0] < cv.INF or state:
                text, state = text + l[state], e[state]
        whole = cv.block_traces([codes], np.array([ends], np.int64))
        if want[0] < cv.INF:
            assert (text, state) == (whole[1][0][0], whole[2][0][0]) and whole[0][0][0] == want[0]


# -- earlier operators: extreme values and clashing names --------------------------------------------------------


def test_nearest_of_extreme_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v * s]) for i, (v, s) in enumerate(zip(rng.normal(size=(60, 4)), [1e150, 1.0, 1e-150, 1e-200] * 15))]
    rows += [(60, [1e308, 0.0, 0.0, 0.0]), (61, [5e-324, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for exact in (0, 1024):
        got = ann.nearest_neighbours(df, every=20, k=5, exact_rows=exact).collect()
        assert Counter(r["query_id"] for r in got) == {0: 5, 20: 5, 40: 5, 60: 5}


def test_nearest_recall_of_the_hashed_path(spark):
    """The table of sf0.1, with no band searched exactly."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {}
    for r in ann.nearest_neighbours(df, every=20, k=20, exact_rows=0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.argsort(-score)[:20]].tolist())
        hit, total = hit + len(best & found[int(ids[q])]), total + 20
    assert hit / total >= 0.9


def test_stages_keep_columns_of_their_own_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "mine", 7, [1], "r"), (2, text, "yours", 8, [2], "s"), (3, "\n".join([text, text]), "his", 9, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _node string, _rows int, _removed array<int>, _text_key string")
    kept = ngram_join.keep_one(df).collect()
    assert [tuple(r) for r in kept if r["doc_id"] == 1] == [rows[0]]
    lines = {r["doc_id"]: r for r in line_dedup.drop_duplicate_lines(df).collect()}
    assert lines[1]["text"] == text and lines[2]["text"] == "" and lines[3]["text"] == ""
    assert {r["_text_key"] for r in lines.values()} == {"r", "s", "t"} and {r["_node"] for r in lines.values()} == {"mine", "yours", "his"}
    assert list(lines[3]["_removed"]) == [0, 1]


def plain_logistic(x, y, penalty):
    """Newton steps on the penalised loss that ``toxicity._fit`` minimises, densely."""
    w = np.zeros(x.shape[1] + 1)
    dense = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.full(x.shape[1], penalty), 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-dense @ w))
        gradient = dense.T @ (p - y) / len(y) + keep * w
        hessian = (dense * (p * (1 - p))[:, None]).T @ dense / len(y) + np.diag(keep + 1e-12)
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_chain_against_plain_logistic_models():
    """Weights of the chain, and the out-of-fold probabilities they were fitted with, against dense Newton steps."""
    rng = np.random.default_rng(6)
    n, words, folds, penalty = 240, 12, 3, 1e-2
    x = (rng.random((n, words)) < 0.3).astype(float)
    junk = (rng.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] - 0.5)))).astype(float)
    toxic = (rng.random(n) < 1 / (1 + np.exp(-(2 * junk + 2 * x[:, 2] - 1.5)))).astype(float)
    fold = rng.integers(0, folds, n)
    table = pa.table({
        "labels": pa.array(np.stack([junk, toxic], 1).tolist()), "fold": pa.array(fold.astype(np.int32)),
        "words": pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int64())),
    })
    found = toxicity._train(2, folds, penalty)(table).to_pylist()

    def chance(w, dense):
        return 1 / (1 + np.exp(-(dense @ w[:-1] + w[-1])))

    first = plain_logistic(x, junk, penalty)
    assert np.allclose(found[0]["weights"], first[:-1], atol=5e-3) and abs(found[0]["bias"] - first[-1]) < 5e-3
    held_out = np.zeros(n)
    for f in range(folds):
        held_out[fold == f] = chance(plain_logistic(x[fold != f], junk[fold != f], penalty), x[fold == f])
    second = plain_logistic(np.hstack([x, held_out[:, None]]), toxic, penalty)
    assert np.allclose(found[1]["weights"], second[:words], atol=5e-3)
    assert abs(found[1]["earlier"][0] - second[words]) < 5e-3 and abs(found[1]["bias"] - second[-1]) < 5e-3


def test_decoding_by_table():
    model = sentencepieces._load(tokenizer_path("piece_bpe_32k.model"), 1.0)
    for text in ("Hello  world", "a\nb", "日本語 € é", "x" * 300, " lead", "tail ", "\t tab"):
        ids = np.array(model.model.encode(text))
        assert sentencepieces.decode_ids(model, ids) == model.model.decode(ids.tolist())


def test_large_loose_group_takes_few_tests(spark):
    """A key of many nodes of which every eighth pair is linked: the group grows together without testing all pairs."""
    n = 300
    linked = lambda a, b: (a * 1103515245 + b * 12345 >> 7) % 8 == 0
    keyed = spark.range(n).select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.struct(F.lit(1).alias("x")).alias("meta"))
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return pairs.where(F.expr("shiftright(a * 1103515245L + b * 12345L, 7) % 8 = 0"))

    found = {r["node"]: r["component"] for r in linking.link_components(keyed, lambda x, y: F.lit(True), verify).collect()}
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {x: root(x) for x in range(n)}
    assert {x: found.get(x, x) for x in range(n)} == want
    assert sum(tested) <= 50 * n
