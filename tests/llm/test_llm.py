"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import common, decontaminate, fm_index, langid, line_dedup, minhash, pieces, quality, registry, sharding, substring_dedup, suffix_array, warc
from tideline.llm.components import components, contracted
from tideline.llm.repeats import Plan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, key string, block string, h long"
LINE = "This very line is shared by many documents"
PASSAGE = " ".join(f"w{i}" for i in range(40))


def rows():
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(rng.choice([f"v{i}" for i in range(60)], n))
    texts = [None, "", " \t\n ", "one", "one two", some(30), f"{PASSAGE} {some(20)}", f"{some(15)} {PASSAGE}", f"{LINE}\n{some(10)}", f"  {LINE.upper()} \n{LINE}", f"{some(5)}\n{LINE}", PASSAGE, PASSAGE, some(4000), "é" * 70 + " ü" * 40, "é" * 70, "x" * 130, "x" * 60]
    base = some(200).split()
    for i in range(6):
        w = list(base)
        w[i * 7] = "changed"
        texts.append(" ".join(w))
    out = [(i, t, "en" if i % 2 else None, "s", 1, "clash", None, "b", 5) for i, t in enumerate(texts)]
    return [*out, out[5], out[7], (None, PASSAGE, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_line_dedup(docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t, *_ in rows():
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 3}
    got = by_id(docs.select("doc_id", "text").join(line_dedup.line_bitmaps(docs), "doc_id", "left").mapInArrow(line_dedup._cut(True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))
    for d, t, *_ in rows():
        if d is not None:
            lines = (t or "").split("\n")
            kept = [x for x in lines if lost.get(key(x), d) == d]
            assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert len(lost) >= 1
    maps = by_id(line_dedup.keep_bitmaps(docs))
    assert np.unpackbits(np.frombuffer(zlib.decompress(maps[8].keep_bitmap), np.uint8))[:2].tolist() == [0, 1]
    for d, t, *_ in rows():
        if d is not None:
            lines = (t or "").split("\n")
            gone = [i for i, x in enumerate(lines) if lost.get(key(x), d) != d]
            bitmap = maps[d].keep_bitmap
            assert maps[d].n_lines == len(lines) and (line_dedup.dropped_at(bitmap, len(lines)).tolist() if bitmap else []) == gone
    cut = line_dedup.drop_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("doc_id = 0").first().text is None
    assert line_dedup.drop_lines(empty).count() == line_dedup.keep_bitmaps(empty).count() == 0


def covered(tokens, k):
    """Per document the tokens covered by windows that start in a smaller document too."""
    first = {}
    for d, t in sorted(tokens.items()):
        for i in range(len(t) - k + 1):
            first.setdefault(tuple(t[i : i + k]), d)
    out = {}
    for d, t in tokens.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - k + 1):
            if first[tuple(t[i : i + k])] < d:
                gone[i : i + k] = True
        out[d] = gone
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, empty, hot):
    plan = Plan(k=13, m=6, by_word=True, hot=hot, block_bytes=600)
    got = by_id(substring_dedup.dedup_words(docs, plan))
    words = {d: WORD.findall(t or "") for d, t, *_ in rows() if d is not None}
    gone = covered(words, 13)
    for d, w in words.items():
        kept = " ".join(x for x, g in zip(w, gone[d]) if not g)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), gone[d].sum(), sha(kept)), d
    assert substring_dedup.dedup_words(empty, plan).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_array_dedup(docs, empty, hot):
    plan = Plan(k=50, m=20, by_word=False, hot=hot, block_bytes=600)
    got = by_id(suffix_array.dedup_bytes(docs, plan))
    data = {d: (t or "").encode() for d, t, *_ in rows() if d is not None}
    gone = covered({d: tuple(b) for d, b in data.items()}, 50)
    for d, b in data.items():
        g = gone[d]
        spans = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), g.sum(), spans, sha(kept)), d
    assert suffix_array.dedup_bytes(empty, plan).count() == 0


@pytest.mark.parametrize("k, m", [(5, 2), (13, 8), (40, 20)])
def test_substring_dedup_at_other_widths(docs, k, m):
    got = by_id(substring_dedup.dedup_words(docs, Plan(k=k, m=m, by_word=True, block_bytes=900)))
    words = {d: WORD.findall(t or "") for d, t, *_ in rows() if d is not None}
    gone = covered(words, k)
    assert {d: r.n_removed for d, r in got.items()} == {d: gone[d].sum() for d in words}


def test_large_ids_beside_a_null_id(spark):
    big = 2**53
    df = spark.createDataFrame([(None, PASSAGE), (big, PASSAGE), (big + 1, PASSAGE)], "doc_id long, text string").coalesce(1)
    got = by_id(substring_dedup.dedup_words(df))
    assert (got[big].n_removed, got[big + 1].n_removed) == (0, 40)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=20, max_size=20)), min_size=1, max_size=60), st.sampled_from([4, 8, 16]), st.sampled_from([2, 4, 32]))
def test_deep_shallow_sorts(rows_, shallow, blind):
    rows_ = sorted((g, bytes(x % 3 for x in b)) for g, b in rows_)[::-1]
    rows_.sort(key=lambda r: r[0])
    data = np.frombuffer(b"".join(b for _, b in rows_), np.uint8)
    order, head = suffix_array.deep_shallow(data, np.arange(len(rows_)) * 20, np.array([g for g, _ in rows_]), 20, shallow=shallow, blind=blind)
    assert [rows_[i // 20] for i in order] == sorted(rows_)
    assert len(head) == len(set(rows_))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=24, max_size=24), min_size=2, max_size=32))
def test_blind_tries_keep_order_and_partings(strings):
    data = np.array(strings, np.uint8)
    data[:, :8] = 7
    leaf, part = suffix_array.blind_tries(suffix_array.Characters(data.ravel()), np.arange(len(data))[None, :] * 24, 8, 24)
    got = [bytes(data[i // 24]) for i in leaf[0]]
    assert got == sorted(bytes(x) for x in data)
    for i in range(1, len(got)):
        apart = [d for d in range(24) if got[i][d] != got[i - 1][d]]
        assert part[0, i] == (apart[0] if apart else 24)


@settings(max_examples=80, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(1, 3), min_size=1, max_size=14)), min_size=1, max_size=9),
    st.lists(st.tuples(st.integers(0, 7), st.lists(st.integers(1, 5), min_size=1, max_size=16)), min_size=1, max_size=6),
    st.integers(1, 5),
)
def test_matching_statistics_find_all_earlier_stretches(texts, patterns, k):
    """Patterns with symbols and orders that the index doesn't hold, so that matches break off and step to parent intervals."""
    text = np.array([x for _, t in texts for x in [*t, 0]])
    index = fm_index.FMIndex(text, 4, np.repeat([o for o, _ in texts], [len(t) + 1 for _, t in texts]), max(len(t) for _, t in texts) + 1)
    flat, size = np.array([x for _, p in patterns for x in p]), np.array([len(p) for _, p in patterns])
    number, begin, length = fm_index.matches(index, flat, np.cumsum(size) - size, size, np.array([o for o, _ in patterns]), k)
    assert (length >= k).all()
    for i, (limit, p) in enumerate(patterns):
        held = lambda w: any(o < limit and any(t[a : a + len(w)] == w for a in range(len(t))) for o, t in texts)  # noqa: B023, E731
        want, got = np.zeros(len(p), bool), np.zeros(len(p), bool)
        for x in range(len(p) - k + 1):
            if held(p[x : x + k]):
                want[x : x + k] = True
        for x, y in zip(begin[number == i], length[number == i]):
            assert held(p[x : x + y]) and not (x > 0 and held(p[x - 1 : x + y]))
            got[x : x + y] = True
        assert (want == got).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_tree_ranks(values):
    tree = fm_index.WaveletTree(np.array(values), 10)
    for c in set(values):
        got = tree.rank(np.full(len(values) + 1, c), np.arange(len(values) + 1))
        assert got.tolist() == [values[:i].count(c) for i in range(len(values) + 1)]


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, sharding.tree(7)).collect()
    assert len(got) == len(rows())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    null = [r for r in got if r.doc_id == 0][0]
    assert (null.size, null.text_crc32, null.law) == (16, 0, "key")
    assert {r.text_crc32 for r in got if r.doc_id == 3} == {zlib.crc32(b"one")}
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("base, grown", [(40, 0), (40, 1), (40, 2), (7, 0), (1, 0)])
def test_growth_moves_rows_into_the_new_shard_only(spark, base, grown):
    t = sharding.tree(base)
    for _ in range(grown):
        t = sharding.grow(t)
    got = sharding.shard_documents(spark.range(4000).selectExpr("id AS doc_id", "'x' AS text"), t).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert moved and {r.grown_shard for r in moved} == {base + grown}
    assert {r.shard for r in got} == set(range(base + grown))


def test_slots_of_tied_rows(spark):
    d = spark.createDataFrame([(5, "a")] * 4 + [(5, "b"), (5, None), (None, "a"), (None, "a")], "doc_id long, text string")
    got = sharding.shard_documents(d).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_weight_changes_stay_in_their_subtree(spark):
    d = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    heavy = sharding.tree(40, {3: 3.0})
    a = sharding.assign(sharding.assign(d, F.col("k"), sharding.tree(40), "a"), F.col("k"), heavy, "b").where("a <> b").collect()
    assert a and all(r.b < 20 for r in a)  # towards shard 3's region, never out of it
    assert all(r.b < 5 for r in a if r.a < 20)


def test_warc(spark):
    body = "<html>" + "x" * 120 + "</html>"
    pages = spark.createDataFrame([(5, "http://a/", body, 1), (3, "http://b/ c\n", body, 1), (4, None, body, 1), (9, "u", "short", 1), (8, "v", "short", 1), (7, "n", None, 1), (6, "r", "a\r\n\r\nWARC/1.1\r\n" + "é" * 80, 1), (None, "q", body, 1)], "page_id long, url string, html string, first int")
    got = {r.page_id: r for r in warc.resolved(archive(spark, pages)).collect()}
    assert [(got[i].record_type, got[i].refers_to) for i in (3, 4, 5, None)] == [("response", None), ("revisit", 3), ("revisit", 3), ("response", None)]
    assert got[9].record_type == got[8].record_type == "response"
    for r in pages.collect():
        b = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(b), sha(b))
    assert archive(spark, pages.limit(0)).count() == 0


def archive(spark, pages):
    import uuid

    path = f"{common.shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path)


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = warc.write_arc(version, "f", [("http://a", "1.2.3.4", "20240101000000", b"head\r\n\r\nbody\n\n"), ("b", "::1", "20240101000001", b"")])
        got = list(warc.parse_arc(data))
        assert [(r.version, r.fields["URL"], r.block) for r in got] == [(version, "http://a", b"head\r\n\r\nbody\n\n"), (version, "b", b"")]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-20]))
    record = warc.to_warc(got[0], None) + warc.END
    f, block = next(warc.parse_warc(gzip.decompress(gzip.compress(record))))
    assert f["warc-date"] == "2024-01-01T00:00:00Z" and f["warc-payload-digest"] == "sha256:" + sha(b"body\n\n") and block == got[0].block


def grams(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_minhash(docs, empty):
    sets = {d: grams(t, 3) for d, t, *_ in rows() if d is not None}
    comp = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = by_id(minhash.near_duplicates(docs))
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}
    assert any(comp[d] != d for d in range(18, 24))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_prefix_pairs_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        at = rng.choice(60, rng.integers(0, 9), replace=False)
        s[at] = rng.integers(0, 2**63, len(at), dtype=np.int64)
        sets.append(np.unique(s))
    df = spark.createDataFrame([(i, i % 5, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, comp long, sh binary")
    pairs = minhash.prefix_pairs(df, 85)
    assert set(minhash.prefix_pairs(df.union(df).union(df), 85).collect()) == set(pairs.collect())  # rows that repeat
    got = {(r.a, r.b) for r in minhash.confirm(pairs, df.select("id", "sh"), 85).collect()}
    j = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 5 != b % 5 and j(sets[a], sets[b])}


def test_components_in_rounds_equal_those_of_one_task(spark):
    rng = np.random.default_rng(6)
    e = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)], "a long, b long")
    want = {tuple(r) for r in components(e).collect()}
    for few in (0, 60):
        assert {tuple(r) for r in contracted(e, few).collect()} == want
    ends = {r.comp for r in components(e).where("node >= 1000").collect()}
    assert ends == {1000}


def test_near_duplicates_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(24):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    once = {(r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(d).collect()}
    twice = minhash.near_duplicates(d.union(d).union(d)).collect()
    assert len(twice) == 72 and {(r.doc_id, r.component_id, r.n_shingles) for r in twice} == once


def test_lines_are_dropped_whatever_columns_are_called(spark):
    line = "a line that is long enough to count"
    names = "keep_bitmap doc2 n_lines dropped pos h key".split()
    d = spark.createDataFrame([(i, f"{line}\n{i}", *["c"] * 7) for i in range(3)], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = line_dedup.drop_lines(d).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["0", "1", f"{line}\n2"] and all(r.keep_bitmap == "c" for r in got)


def test_components_of_odd_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    e = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 3), (4, None), (9, 8)], "a long, b long")
    assert {r.node: r.comp for r in components(e).collect()} == {1: 1, 2: 1, 8: 8, 9: 8}


def test_components_of_a_hub(spark):
    e = spark.range(1, 5001).selectExpr("0L AS a", "id AS b").union(spark.range(1).selectExpr("7L AS a", "90000L AS b"))
    got = components(e)
    assert got.count() == 5002 and got.where("comp <> 0").count() == 0


def test_dealt_join_equals_a_join(spark):
    rows_ = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN id % 50 END AS k", "id AS v")
    table = spark.range(40).selectExpr("id AS k", "id * 10 AS w")
    n = rows_.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = common.dealt_join(rows_, table, ["k"], "v", n, how)
        assert sorted(got.select("k", "v", "w").collect(), key=str) == sorted(rows_.join(table, ["k"], how).select("k", "v", "w").collect(), key=str)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50, 80)] + [(7, 5), (5, 9)], "a long, b long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert {got[i] for i in range(50, 81)} == {50} and {got[i] for i in (5, 7, 9)} == {5}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, docs, empty, limit):
    items = [(1, PASSAGE), (2, "v1 v2"), (3, None), (4, " "), (5, "one two"), (6, PASSAGE.upper() + " tail"), (7, " ".join(PASSAGE.split()[:20] + ["z"] * 20)), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, *_ in rows():
        for i, x in items:
            g = grams(x, 5)
            if d is not None and g and 100 * len(g & grams(t, 5)) >= 80 * len(g):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, max_broadcast=limit).collect()}
    assert got == want and (11, 6) in want and (4, 5) in want
    assert decontaminate.leaks(empty, bench, max_broadcast=limit).count() == 0
    assert decontaminate.drop_leaked(docs, bench.limit(0)).count() == docs.count()


def test_quality(docs, empty):
    got = by_id(quality.quality_report(docs))
    for d, t, *_ in rows():
        if d is None:
            continue
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, g in enumerate(tri) if tri.count(g) > 1 for j in range(3)} if len(w) < 1000 else None
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert hit is None or r.n_repeat_words == len(hit)
        assert not (r.base_failed and r.kept)
    assert quality.quality_report(empty).count() == 0
    assert quality.keep_quality(docs).columns == docs.columns


def test_clean_prose_stays_and_menus_go(spark):
    rng = np.random.default_rng(8)
    some = lambda: " ".join(rng.choice([f"word{i}" for i in range(5000)], 9))
    prose = "\n".join(f"{some()}." for _ in range(12))
    menu = "\n".join(f"Home{i} | News{i} | About{i} | Contact{i} | Search{i} | Login{i}" for i in range(12))
    got = by_id(quality.quality_report(spark.createDataFrame([(1, prose), (2, menu), (3, prose.upper().replace(" ", "!! "))], "doc_id long, text string")))
    assert [got[i].kept for i in (1, 2, 3)] == [True, False, False]


TEXTS = ["", "plain words and more plain words", "  two  blanks \n\n and\tlines ", "▁ sign ▁▁ kept", "日本語 é ñ 🙂 \u0000 end", "x" * 3000, "these words come many times " * 100]


def test_pieces_round_trip_and_repeat(spark, empty):
    v = pieces.Vocabulary.load()
    df = spark.createDataFrame([*enumerate(TEXTS), (90, None), (None, "a b"), (1, TEXTS[1])], "doc_id long, text string")
    got = pieces.encode(df, v).collect()
    for r in got:
        if r.doc_id is not None and r.doc_id < 90:
            assert r.decoded_sha256 == sha(TEXTS[r.doc_id]) and r.n_pieces == len(r.pieces)
    assert [r.pieces for r in got if r.doc_id == 90] == [None]
    a, b = [r.pieces for r in got if r.doc_id == 1]
    assert a == b
    assert [r.text for r in pieces.decode(pieces.encode(df, v), v).orderBy("doc_id").collect()] == [r.text for r in df.orderBy("doc_id").collect()]
    other = by_id(pieces.encode(df, v, seed=99))
    assert other[6].pieces != [r.pieces for r in got if r.doc_id == 6][0]
    assert pieces.encode(empty, v).count() == 0


def test_sampling_follows_the_weights():
    byte = list(range(256))
    # pieces a, b and ab: "ab" is one piece or two
    v = pieces.Vocabulary([bytes([b]) for b in byte] + [b"a", b"b", b"ab"], byte, np.log(np.r_[np.full(256, 1e-9), 0.5, 0.4, 0.6]))
    n = 20_000
    data = np.frombuffer(b"ab" * n, np.uint8)
    starts = np.arange(n) * 2
    ids, offsets = pieces.sample(v, data, starts, starts + 2, common.mix(np.arange(n, dtype=np.uint64)), 1)
    assert abs(np.mean(np.diff(offsets) == 1) - 0.6 / (0.6 + 0.2)) < 0.02
    assert pieces.decode_ids(v, ids) == b"ab" * n


def all_paths(v, text):
    """Every segmentation of a short text into pieces, with its weight."""
    held = {}
    for i, (start, size) in enumerate(zip(v.start, v.size)):
        if size and i not in set(v.byte_ids.tolist()):
            held.setdefault(v.blob[start : start + size].tobytes(), i)
    out, todo = {}, [(0, (), 0.0)]
    while todo:
        at, path, weight = todo.pop()
        if at == len(text):
            out[path] = weight
            continue
        char = next(n for n in range(1, 5) if at + n == len(text) or (text[at + n] & 0xC0) != 0x80)
        for n in range(1, len(text) - at + 1):
            if (i := held.get(text[at : at + n])) is not None:
                todo.append((at + n, (*path, i), weight + v.weights[i]))
        if text[at : at + char] not in held:
            ids = v.byte_ids[list(text[at : at + char])].tolist()
            todo.append((at + char, (*path, *ids), weight + sum(v.weights[j] for j in ids)))
    return out


@pytest.mark.parametrize("text", ["thing", " over", "añb", "☃x"])
def test_sampling_over_all_paths_of_the_vocabulary(text):
    v = pieces.Vocabulary.load()
    data, n = text.encode(), 20_000
    want = all_paths(v, data)
    total = sum(np.exp(w) for w in want.values())
    starts = np.arange(n) * len(data)
    ids, offsets = pieces.sample(v, np.frombuffer(data * n, np.uint8), starts, starts + len(data), common.mix(np.arange(n, dtype=np.uint64)), 3)
    got = {}
    for x, y in zip(offsets[:-1], offsets[1:]):
        got[tuple(ids[x:y].tolist())] = got.get(tuple(ids[x:y].tolist()), 0) + 1
    assert set(got) <= set(want)
    for path, w in want.items():
        share = np.exp(w) / total
        assert abs(got.get(path, 0) / n - share) < 4 * np.sqrt(share * (1 - share) / n) + 1e-4


def test_samples_do_not_depend_on_batches():
    v = pieces.Vocabulary.load()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["reading", "Überlauf", "日本語", "x1y2", "antionhare"], 9)).encode() for _ in range(60)] + [b"q7" * 900]
    keys = common.mix(np.arange(len(texts), dtype=np.uint64))

    def run(at):
        size = np.array([len(texts[i]) for i in at])
        starts = np.cumsum(size) - size
        ids, offsets = pieces.sample(v, np.frombuffer(b"".join(texts[i] for i in at), np.uint8), starts, starts + size, keys[at], 5)
        return [ids[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:])]

    whole = run(list(range(len(texts))))
    assert [x for i in range(0, len(texts), 3) for x in run(list(range(i, min(i + 3, len(texts)))))] == whole


def test_long_parts_follow_the_weights_too(monkeypatch):
    v = pieces.Vocabulary.load()
    n = 3000
    data, starts = np.frombuffer(b"things" * n, np.uint8), np.arange(n) * 6
    keys = common.mix(np.arange(n, dtype=np.uint64))
    short = pieces.sample(v, data, starts, starts + 6, keys, 1)
    monkeypatch.setattr(pieces, "LONG_PART", 2)
    long_ = pieces.sample(v, data, starts, starts + 6, keys, 1)
    assert (short[0] == long_[0]).mean() > 0.999 and (short[1] == long_[1]).mean() > 0.999


def test_langid_equals_brute_force(spark):
    train = [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("le chat", "fr"), ("zzz", None), (None, "en")]
    langs, ranks = langid.profiles(spark.createDataFrame(train, "text string, lang string"), 20)
    assert langs == ["de", "en", "fr"]

    def ranked(texts):
        count = {}
        for t in texts:
            for cell in langid.gram_cells(t).tolist():
                count[cell] = count.get(cell, 0) + 1
        return sorted(count, key=lambda x: (-count[x], x))[:20]

    tables = {x: ranked([t for t, lang in train if lang == x and t]) for x in langs}
    asked = ["the hat", "die maus", "le chien et le chat", "the hat", "", None, "12 !", "𰀁", "q" * 5000, "le die the"]
    df = spark.createDataFrame([(i, t, False, "x") for i, t in enumerate(asked)], "doc_id long, text string, held_out boolean, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df, langs, ranks, 20).collect()}
    for i, t in enumerate(asked):
        own = ranked([t]) if t else []
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        apart = {x: sum(abs(k - tables[x].index(c)) if c in tables[x] else 20 for k, c in enumerate(own)) for x in langs}
        best = min(langs, key=lambda x: (apart[x], x))
        assert got[i].lang_pred == best and abs(got[i].score - (1 - apart[best] / (20 * len(own)))) < 1e-9
    assert got[7].lang_pred != "und"


def test_langid_query_over_an_empty_table(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["op10_langid"](spark, str(tmp_path)).count() == 0


def test_langid_on_held_out_documents(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.QUERIES["op10_langid"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    langs, ranks = langid.profiles(d)
    odd = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, "")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, langs, ranks).collect()} == {("und", 0.0)}
    assert langid.profiles(empty)[0] == []


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, seen, sf))
        assert after.columns == docs.columns and 0 < after.count() <= seen.count(), name
        seen = after
    sets = {r.doc_id: grams(r.text, 5) for r in seen.collect()}
    ids = sorted(sets)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    out = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert all(r.decoded_sha256 == sha(texts[r.doc_id]) for r in out.collect())
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = common.stored(stage(spark, none, sf))
    assert none.count() == 0


def test_quality_removes_failing_lines(spark):
    prose = [" ".join(f"word{9 * i + j}" for j in range(9)) + "." for i in range(12)]
    text = "\n".join([*prose[:5], "", "Home | News | About | Contact | Search", "Read more about all of these things right here.", *prose[5:], "  "])
    want = "\n".join([*prose[:5], "", *prose[5:], "  "])
    df = spark.createDataFrame([(1, text, len(text), "x"), (2, "\n".join(prose), 7, "y"), (3, "a b", 3, "z"), (4, None, None, "z")], "doc_id long, text string, n_chars int, tag string")
    got = {r.doc_id: (r.text, r.n_chars, r.tag) for r in quality.keep_quality(df).collect()}
    assert got == {1: (want, len(want), "x"), 2: ("\n".join(prose), len("\n".join(prose)), "y")}
    assert quality.keep_quality(df).dtypes == df.dtypes


def test_final_mark_before_many_blanks(spark):
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    df = spark.createDataFrame([(1, f"{prose}\nIt ends here.{' ' * 60}\nNo end{chr(9) * 60}")], "doc_id long, text string")
    assert quality.keep_quality(df).first().text == f"{prose}\nIt ends here.{' ' * 60}"
