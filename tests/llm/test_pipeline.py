import numpy as np
from test_packing import check_cover, whole_ids
from test_suffix import brute

import corpus_pipeline
from palimpsa.llm.queries import op3_quality, op6_toxicity

PATH = "/root/testdata/sf0.01"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_brute_force(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{PATH}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, PATH).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r.doc_id: r for r in docs.collect()} if i < 4 else docs.collect())
        assert i == 4 or docs.columns == columns, name
    clean = {r.doc_id for r in op6_toxicity(spark, PATH).collect() if not r.predicted}
    assert set(kept[0]) == clean
    assert set(kept[1]) == {r.doc_id for r in op3_quality(spark, PATH).collect() if r.kept} & clean
    # Every document that went has a close relative of a smaller id; no two that stayed are alike.
    sets = {d: shingles(r.text) for d, r in kept[1].items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for d in set(kept[1]) - set(kept[2]):
        assert max(alike(d, x) for x in kept[1] if x != d) > 0.7
    stay = sorted(kept[2])
    assert not [(a, b) for i, a in enumerate(stay) for b in stay[:i] if alike(a, b) >= 0.85]
    texts = [(d, kept[2][d].text.encode()) for d in stay]
    for d, n, removed, *_ in brute(texts):
        text = kept[3][d].text
        if not removed:
            assert text == kept[2][d].text
        else:
            assert n - removed - 12 <= len(text.encode()) <= n - removed
        assert kept[3][d].n_chars == len(text)
    check_cover(kept[4], 2048)
    assert sum(r.length for r in kept[4]) == sum(len(whole_ids(r.text)) for r in kept[3].values())


def test_run_gives_the_stages_result(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_cover(rows, 2048)
    assert len({r.doc_id for r in rows}) > 100 and np.all([r.length > 0 for r in rows])


def test_odd_tables(spark):
    rows = [(None, None, "en", None, 0), (1, None, None, "s", 0), (2, "", "en", "s", 0)]
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows += [(3, good, "en", "s", 9), (3, good, "en", "s", 9), (4, good, "en", "t", 9), (None, good + " more", "en", "t", 9)]
    other = " ".join(f"thing{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows += [(3, other, "en", "s", 9), (None, other[::-1], "en", "s", 9), (None, other[::-1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, ids in ((docs, [3, 3, None]), (docs.limit(0), [])):
        path = "/root/testdata/sf0.001"
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame.cache(), path)
        assert sorted([r.doc_id for r in frame.collect()], key=str) == ids
        assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, frame, path).collect()} == set(ids)


def test_clashing_columns_pass_through(spark):
    extra = ["text_hash", "first_id", "near_copy_text_hash", "text_mark", "first_hash", "Kept", "score", "predicted", "fp", "component_id", "quality_words", "block", "n", "node", "part"]
    words = lambda stem: " ".join(f"{stem}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, words("one"), "en", "s", 9), (2, words("one"), "en", "s", 9), (3, words("two"), "en", "t", 9), (4, words("three") + " " + words("four"), "en", "t", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)
    docs = spark.createDataFrame([(*r, *(100 * r[0] + k for k in range(len(extra)))) for r in rows], schema)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame.cache(), "/root/testdata/sf0.001")
        assert frame.columns == docs.columns
        got = {r.doc_id: [r[c] for c in extra] for r in frame.collect()}
        assert all(v == [100 * i + k for k in range(len(extra))] for i, v in got.items())
    assert set(got) == {1, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, frame, "").collect()} == {1, 3, 4}
