"""Whitening, toxicity and collocations against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import phrases, toxicity, whitening

VECTORS = "vec_id long, embedding array<float>, x string, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", "c", "n") for i, v in rows], VECTORS).repartition(3)


def plain_whitening(rows):
    """By numpy's eigh over the distinct integer vectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = np.array([np.floor(256 * np.append(np.float32(v).astype(float), np.zeros(d - len(v)))) for _, v in good]).astype(np.int64).reshape(-1, d)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:4]
    keep = [i for i in order if e[i] > 1e-15 * e[order[0]]]
    return good, x, n, s, e[keep], q[:, keep], e.sum()


def compare(spark, rows):
    good, x, n, s, e, q, trace = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert len(got) == len(good) * len(e)
    assert (got.n == n).all() and (got.identity_error <= 1e-9).all() and set(got.component) == set(range(1, len(e) + 1))
    want = Counter((i, int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)))) for (i, _), r in zip(good, x))
    assert Counter(zip(got[got.component == 1].vec_id, got[got.component == 1].deviation)) == want
    for k in range(len(e)):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, e[k] / trace, rtol=1e-9)
        z = (x - s / n) @ q[:, k] / np.sqrt(e[k])
        mine, theirs = own.sort_values("vec_id").whitened.to_numpy(), z[np.argsort([i for i, _ in good], kind="stable")]
        assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-8), k


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    some = rng.standard_normal((300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, v) for i, v in enumerate(some)]
    odd = [(900, None), (901, [None] * 12), (902, [np.nan] * 12), (903, [np.inf] * 12), (904, []), (905, [1.0, 2.0])]
    compare(spark, rows + odd + [(i, some[7]) for i in range(400, 600)])


def test_whitening_finds_equal_deviations(spark):
    points = [[a * 3.0 * (i == j) for j in range(5)] for i in range(5) for a in (-1, 1)]
    got = whitening.whiten(vectors(spark, list(enumerate(points)))).toPandas()
    assert len(got) == 40 and np.allclose(got.explained, 0.2) and (got.identity_error < 1e-9).all()


def test_whitening_of_few_dimensions(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    got = whitening.whiten(vectors(spark, flat)).toPandas()
    assert set(got.component) == {1} and np.allclose(got.explained, 1)
    compare(spark, [(0, [1, 0]), (1, [0, 1]), (2, [3, 1]), (2, [3, 1])])
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0


def test_deviation_past_64_bits_is_null():
    x, s = np.array([[2**40, 0], [1, 1]]), np.array([3, 3])
    assert whitening.exact_squares(x, 2, s) == [None, 2]


def grams(texts, k):
    out = Counter()
    for lang, t in texts:
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return out


def plain_collocations(texts, top):
    f = {k: grams(texts, k) for k in (1, 2, 3, 4)}
    every = {key: n for k in f for key, n in f[k].items()}
    total = Counter()
    for (lang, _), n in f[1].items():
        total[lang] += n
    longest = defaultdict(int)
    for k in (3, 4):
        for (lang, p), a in f[k].items():
            w = p.split(" ")
            for m in range(2, k):
                for i in range(k - m + 1):
                    if a >= 30:
                        key = (lang, " ".join(w[i : i + m]))
                        longest[key] = max(longest[key], a)
    rows = defaultdict(list)
    for k in (2, 3, 4):
        for (lang, p), a in f[k].items():
            if a < 30 or 100 * longest[lang, p] >= 80 * a:
                continue
            w = p.split(" ")
            cuts = [(2000000 * a // (l + r), i, l, r) for i in range(1, k) for l, r in [(every[lang, " ".join(w[:i])], every[lang, " ".join(w[i:])])]]
            s, _, l, r = min(cuts)
            rows[lang].append((-s, -a, p.encode(), p, a, l, r, total[lang], s))
    return {(lang, i, *x[3:]) for lang, found in rows.items() for i, x in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("top, cells", [(3, 8), (12, 1 << 16), (2000, 64)])
def test_collocations(spark, top, cells):
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(12)]
    texts = []
    for i in range(260):
        w = [str(x) for x in rng.choice(common, 60)]
        if i % 3:
            w[10:10] = ["Alpha", "beta", "gamma", "delta", "eps"]
        if i % 4 == 0:
            w[30:30] = ["new", "\t", "york"] if i % 8 else ["new york"]
        texts.append((["en", "de", None][i % 3], " ".join(w[:40]) + ", " + "  ".join(w[40:]) + ("\n" if i % 2 else ".") + "Alpha beta"))
    texts += [("en", None), ("en", ""), (None, " \t"), ("xx", "only one"), ("en", "ü é " * 3000), *[texts[0]] * 40]
    df = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string, a int, n int").repartition(4)
    got = {tuple(r) for r in phrases.collocations(df, top, cells).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain_collocations(texts, top)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9_000_000_000_000_000_000
    got = spark.range(1).select(phrases.score(F.lit(a), F.lit(a), F.lit(a - 7)).alias("s")).first().s
    assert got == 2_000_000 * a // (a + a - 7)


def test_chunks_hold_all_texts():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, "", None, "b" * 50, "c"], "lang": ["x"] * 5})
    got = [t.to_pylist() for t, _ in phrases.chunks([b], 12)]
    assert sum(got, []) == ["a" * 10, "", None, "b" * 50, "c"] and len(got) == 3


DOCS = "doc_id long, text string, lang string, score string, predicted string, toxic string"


def test_factorization_machine_learns_pairs(spark):
    """An insult or a group alone is fine, both together are not: additive weights can't tell."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        w = [f"w{x}" for x in rng.integers(0, 30, 12)]
        kind = i % 4
        w[3:3] = [["wretch"], ["folk"], ["wretch", "folk"], []][kind]
        rows.append((i, " ".join(w), int(kind == 2)))
    docs = spark.createDataFrame([(i, t, "en", "s", "p", "t") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fitted(toxicity.training(docs, labels))
    got = toxicity.scores(docs.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out")), model).toPandas().set_index("doc_id")
    want = np.array([y for _, _, y in rows])
    held = got.held_out.loc[range(1200)].to_numpy()
    assert held.any() and ((got.predicted.loc[range(1200)] == want)[held]).mean() > 0.97


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", "p", "t"), (2, "", None, "s", "p", "t"), (3, "a word " * 200_000, "en", "s", "p", "t"), (3, "again", "en", "s", "p", "t"), (None, "x", "en", "s", "p", "t")], DOCS)
    held = docs.select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("held_out"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, prior in ((none, 0.0), (spark.createDataFrame([(2, 1), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int"), 1.0)):
        model = toxicity.fitted(toxicity.training(docs, labels))
        got = toxicity.scores(held, model).collect()
        assert len(got) == 5 and all(r.score == prior and r.predicted == int(prior) for r in got)
    assert toxicity.scores(held.limit(0), toxicity.Model(0.0, np.arange(8), np.zeros(8), np.zeros((8, 2)))).count() == 0


def test_scores_equal_the_formula():
    rng = np.random.default_rng(2)
    feature = rng.permutation(64) - 14  # 14 cells have none
    m = toxicity.Model(0.3, np.maximum(feature, -1), rng.standard_normal(50), rng.standard_normal((50, 3)))
    texts = ["one two three", "", None, "One, two! (three) twofold"]
    cell, start = toxicity.term_cells(pa.array(texts), 64)
    got = toxicity.logits(m, cell, start)
    for i, text in enumerate(texts):
        own = m.feature[cell[start[i] : start[i + 1]]]
        own = own[own >= 0]
        pairs = sum(m.factors[a] @ m.factors[b] for j, a in enumerate(own) for b in own[:j])
        assert np.isclose(got[i], 0.3 + m.weights[own].sum() + pairs)
    assert set(cell[start[0] : start[1]]) <= set(cell[start[3] : start[4]]) and got[1] == got[2] == 0.3


def test_telling_cells(spark):
    rows = [(1, [1, 2, 9])] * 5 + [(0, [2, 3, 9])] * 7 + [(1, [4, 9])] * 2
    assert toxicity.telling_cells(spark.createDataFrame(rows, "label int, cells array<long>"), 14, 7, 2, 3) == [1, 3]


@pytest.mark.parametrize("name", ["op11_whitening", "op12_toxicity"])
def test_queries_on_tables(spark, sf_dir, name):
    from tideline.llm import registry

    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    if name == "op11_whitening":
        assert len(got) == 4 * con.execute(f"SELECT count(*) FROM '{sf_dir}/embeddings.parquet'").fetchone()[0] and got.identity_error.max() <= 1e-4
        return
    toxic = dict(con.execute(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    assert len(got) == con.execute(f"SELECT count(*) FROM '{sf_dir}/documents.parquet'").fetchone()[0] and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.isin(toxic)]
    assert (held.predicted == held.doc_id.map(toxic)).mean() > 0.9
