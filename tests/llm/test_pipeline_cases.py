"""The pipeline's stages with nulls, repeated rows, long texts and clashing column names."""

import numpy as np

import corpus_pipeline
from tideline.llm import common

CLASHES = "keep_bitmap key block id token comp n p band shard item_id keep kept pos dropped node sh".split()


def test_stages_keep_odd_rows_whole(spark):
    rng = np.random.default_rng(12)
    syllables = ["ka", "lo", "mi", "ren", "tos", "ul", "ver", "zan"]

    def prose(n):
        lines = []
        for _ in range(n // 12):
            words = ["".join(rng.choice(syllables, 3)) for _ in range(12)]
            lines.append(" ".join(words).capitalize() + ".")
        return "\n".join(lines)

    copied, long = prose(240), prose(150_000)
    assert len(long) > 1_000_000
    texts = [(1, copied), (2, copied), (4, prose(240)), (4, None), (5, None), (6, ""), (7, long), (None, prose(120))]
    rows = [(i, t, "en", "s", len(t or ""), *["c"] * len(CLASHES)) for i, t in [*texts, texts[2], texts[6]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, seen, "/root/testdata/sf0.001"))
        assert after.columns == docs.columns, name
        assert after.where(" OR ".join(f"`{c}` <> 'c'" for c in CLASHES)).count() == 0, name
        seen = after
    left = [(r.doc_id, r.text) for r in seen.collect()]
    by = {i: t for i, t in left}
    assert sorted(i for i, _ in left if i is not None) == [1, 4, 4, 7, 7]  # nulls, empty texts and copies are gone, repeated rows are not
    assert by[7] == long and sum(i is None for i, _ in left) == 1
    out = corpus_pipeline.STAGES[-1][1](spark, seen, "/root/testdata/sf0.001").collect()
    assert len(out) == len(left)
