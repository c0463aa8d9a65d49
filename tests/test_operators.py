from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palimpsa.functions import applicability, temporal, text
from palimpsa.operators import dates, documents, graph, identity, ranking, versions
from palimpsa.operators.components import connected_components
from palimpsa.streaming import outbox


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc)


def test_bitemporal_correction(spark):
    rows = [("p", "2024-01-01", "2020-01-01", "2030-01-01"), ("p", "2024-02-01", "2025-01-01", "2028-01-01")]
    log = spark.createDataFrame(rows, "id string, r string, f string, u string").select(
        "id", F.to_timestamp("r").alias("r"), F.to_timestamp("f").alias("valid_from"), F.to_timestamp("u").alias("valid_until")
    )
    records = versions.append_versions(log, ["id"], ["r"], "r")
    at = lambda d: F.lit(d).cast("timestamp")
    read = lambda known: [r.version for r in versions.as_of(records, at(known), at("2022-01-01")).collect()]
    assert read("2024-02-01") == [] and read("2024-01-15") == [1] and read("2023-01-01") == []
    history = records.orderBy("version").collect()
    assert [r.version for r in history] == [1, 2] and history[-1].superseded_at is None


def test_unknown_starts_and_half_open_ends(spark):
    rows = [("all", "2025-01-01", "2025-02-01"), ("unknown", None, "2025-02-01")]
    frame = spark.createDataFrame(rows, "id string, f string, u string").select("id", F.to_timestamp("f").alias("f"), F.to_timestamp("u").alias("u"))
    at = lambda d, unknown=True: {r.id for r in frame.filter(temporal.valid_at(F.col("f"), F.col("u"), F.lit(d).cast("timestamp"), unknown)).collect()}
    assert at("2025-01-01") == {"all", "unknown"} and at("2025-01-01", False) == {"all"} and at("2025-02-01") == set()


def test_applicability(spark):
    rows = [("京东", "直播"), ("all", "直播"), ("美团", "all"), ("淘宝", "直播"), ("美团", "外卖"), ("unknown", "直播")]
    frame = spark.createDataFrame(rows, "p string, b string")
    mode = lambda c: F.when(F.col(c).isin("all", "unknown"), F.col(c)).otherwise("specific")
    asked = {"platforms": {"mode": "specific", "values": ["美团", "京东"]}, "businesses": {"mode": "specific", "values": ["直播"]}}
    met = applicability.scope_matches({"platforms": (mode("p"), F.array("p")), "businesses": (mode("b"), F.array("b"))}, asked)
    assert [tuple(r) for r in frame.filter(met).collect()] == rows[:3]
    assert applicability.scope_identity({"platforms": "unknown"}) == ""
    same = applicability.scope_identity({"platforms": {"mode": "specific", "values": [" Ａ", "b", "b"]}})
    assert same == applicability.scope_identity({"platforms": {"mode": "specific", "values": ["b", "A"]}})
    with pytest.raises(ValueError):
        applicability.normalise({"platforms": {"mode": "specific", "values": []}})


def test_rank_fusion_order(spark):
    make = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    both = [("keyword", make(["exact", "semantic"])), ("semantic", make(["semantic", "exact"]))]
    assert [r.id for r in ranking.rrf(both, "id", 2).collect()] == ["exact", "semantic"]
    assert [r.id for r in ranking.rrf(both[::-1], "id", 2).collect()] == ["exact", "semantic"]


def test_cosine(spark):
    vectors = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "id string, v array<double>")
    assert ranking.top(ranking.cosine_rank(vectors, "v", [0.9, 0.1]), "score", "id", 1).first().id == "a"
    with pytest.raises(ValueError):
        ranking.cosine_rank(vectors, "v", [0.0, 0.0])


def chain(spark):
    edges = spark.createDataFrame([(f"r{i:02d}", f"n{i - 1}", f"n{i}") for i in range(1, 13)], "edge string, src string, dst string")
    return edges, spark.createDataFrame([("n0",)], "node string")


def test_bounded_search(spark):
    edges, seeds = chain(spark)
    nodes = lambda *a, **k: (lambda x: ({r.node for r in x[0].collect()}, x[1]))(graph.bounded_search(edges, seeds, *a, **k))
    assert nodes(4) == ({"n0", "n1", "n2", "n3", "n4"}, False)
    assert nodes(0) == ({"n0"}, False)
    assert len(nodes(10)[0]) == 11
    assert nodes(10, max_nodes=4) == ({"n0", "n1", "n2", "n3"}, True)
    assert nodes(10, max_edges=2) == ({"n0", "n1", "n2"}, True)
    back = spark.createDataFrame([("n2",)], "node string")
    assert {r.node for r in graph.bounded_search(edges, back, 1, direction="backward")[0].collect()} == {"n1", "n2"}


def test_closure_cycles_and_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("m", "n"), ("m", "o"), ("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("l", "m")] + [(f"k{i}", f"k{(i + 1) % 5}") for i in range(5)], "src string, dst string")
    closed = graph.closure(edges, "src", "dst")
    assert {(r.child, r.parent): r.depth for r in closed.collect()}[("a", "d")] == 3
    assert {r.node for r in graph.on_cycles(closed).collect()} == {"x", "y", "p", "q", "r", "k0", "k1", "k2", "k3", "k4"}
    ends = {r.node: (r.target, r.steps, r.issue) for r in graph.chain_ends(edges).collect()}
    assert ends["a"] == ("d", 3, None) and ends["c"] == ("d", 1, None)
    assert {n for n, e in ends.items() if e == (None, None, "cycle")} == {"x", "y", "p", "q", "r", "s", "k0", "k1", "k2", "k3", "k4"}
    assert ends["m"] == ends["l"] == (None, None, "ambiguous")


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (5, 100), (7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: i - i % 10 for i in range(40)} | {100: 0}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_value_conflicts(spark):
    rows = [(1, "x", 0, 5), (1, "y", 5, 9), (2, "x", 0, 5), (2, "y", 4, None), (3, "x", 0, 9), (3, "x", 1, 2)]
    frame = spark.createDataFrame(rows, "o int, v string, s int, t int")
    assert [(r.o, r.at) for r in identity.value_conflicts(frame, ["o"], "v", "s", "t").collect()] == [(2, 4)]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("发布日期：2026-09-25\n生效时间：2026-10-29", {"published_at": utc(2026, 9, 24, 16), "valid_from": utc(2026, 10, 28, 16)}),
        ("本表于2023年3月12日00：00：00首次生效，于2026年9月23日00：00：00最新修订生效。", {"valid_from": utc(2026, 9, 22, 16)}),
        ("本规则自2025年10月1日起失效。", {"valid_until": utc(2025, 9, 30, 16)}),
        ("本规范有效至2025年10月1日。", {"valid_until": utc(2025, 10, 1, 16)}),
        ("本规则有效期为2025年1月1日至2025年12月31日。", {"valid_from": utc(2024, 12, 31, 16), "valid_until": utc(2025, 12, 31, 16)}),
        ("失效日期：2026/1/2 08:30\n**发布时间**：2026-01-02T00:00:00Z", {"valid_until": utc(2026, 1, 2, 0, 30), "published_at": utc(2026, 1, 2)}),
        ("修订时间: 2026-02-30", {"revised_at": None}),
        ("本细则自2025年1月1日起施行，于2025年6月1日修订。", {"valid_from": utc(2024, 12, 31, 16), "revised_at": utc(2025, 5, 31, 16)}),
        ("生效日期：2026-01-02\n生效时间：2026-01-03", {"valid_from": None}),
        ("生效日期：2026-01-02\n失效日期：2026-01-01", {"valid_from": None, "valid_until": None}),
        ("# 关于《旧规则》的通知\n本规则自2025年10月1日起失效。本通知自2025年2月1日起执行", {"valid_from": utc(2025, 1, 31, 16)}),
        ("# 旧规则【2024年1月1日已失效】\n正文", {"valid_until": utc(2023, 12, 31, 16)}),
        ("本办法与《他办法》自2025年10月1日起失效。\n## 一\n发布日期：2026-01-01", {}),
        ("> 本规则自2025年10月1日起失效。\n“本规范有效至2025年10月1日”", {}),
        ("`abcdef` 本规则自2024年1月1日起施行。", {"valid_from": utc(2023, 12, 31, 16)}),
        ("“试行稿”本规则自2024年1月1日起施行。", {"valid_from": utc(2023, 12, 31, 16)}),
        ("    本规则自2024年1月1日起施行。\n\t本规则有效至2024年1月1日。", {}),
        ("例如本规则自2024年1月1日起施行。\n```\n本规则有效至2024年1月1日。\n```本规则有效至2025年1月1日。", {"valid_until": utc(2025, 1, 1, 16)}),
        ("“引\n本规则自2024年1月1日起施行。", {"valid_from": utc(2023, 12, 31, 16)}),
        ("“外“内”本规则自2024年1月1日起施行。", {"valid_from": utc(2023, 12, 31, 16)}),
    ],
)
def test_document_dates(body, expected):
    assert {k: v[0] for k, v in dates.document_dates(body).items()} == expected


def test_date_status_and_given_values(spark):
    found = dates.resolve("是否生效：已废止\n发布日期：2026-01-01")
    assert (found.in_force, found.warnings) == ("已废止", ["expired_status_without_date"])
    found = dates.resolve("# 旧【2024年1月1日已失效】\n**是否生效**：生效中**")
    assert found.warnings == ["title_status_conflict"]
    many = "\n".join(f"发布日期：2026-01-{d:02d}、2026-02-{d:02d}、2026-03-{d:02d}" for d in range(1, 20))
    assert dates.resolve(many).warnings == ["published_at_candidate_limit"]
    hand = utc(2030, 1, 1)
    found = dates.resolve("生效日期：2026-01-02\n失效日期：2026-03-01", given={"valid_from": hand})
    assert found.fields["valid_from"] == (hand, 5, "manual") and found.fields["valid_until"][2] == "review"
    assert dates.own_words("甲“乙\n丙”丁", [(0, 1)]) == "   \n  丁"
    rows = spark.createDataFrame([(1, "发布日期：2026-01-01", None), (2, None, hand), (3, "", None)], "id int, body string, at timestamp")
    got = {r.id: r for r in dates.resolved(rows, "id", "body", given={"valid_from": "at"}).collect()}
    assert [f.field for f in got[1].fields] == ["published_at"] and got[3].fields == []
    assert [(f.field, f.status, f.place) for f in got[2].fields] == [("valid_from", "manual", None)]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 5), (2, ""), (3, "short")], "id int, t string")
    rows = sorted((r.id, r.ordinal, r.start, r.stop) for r in documents.fixed_chunks(docs, "id", "t", 20, 5).collect())
    assert rows == [(1, 0, 0, 20), (1, 1, 15, 35), (1, 2, 30, 50), (3, 0, 0, 5)]
    assert documents.cut_points("一二三。四五六。七八", 6, 1, "paragraph") == [(0, 4), (3, 8), (7, 10)]
    assert documents.cut_points("一句话。   xxxxxxxxxx", 10, 2, "paragraph")[0] == (0, 7)
    assert documents.cut_points("# A\nx\n# B\ny", 100, 0, "structural") == [(0, 6), (6, 11)]
    assert documents.cut_points("序\n一、甲\n（一）乙\n第二条 丙", 100, 0, "structural") == [(0, 2), (2, 11), (11, 16)]
    assert documents.cut_points("序\n（一）乙\n2. 丙丁戊", 5, 1, "structural") == [(0, 2), (2, 7), (7, 12), (11, 13)]
    blocks = documents.markdown_blocks("# T\n\npara\n\n|a|b|\n|-|-|\n\n```\ncode\n```\n## U\nend")
    assert [(b[0], b[3]) for b in blocks] == [("heading", "T"), ("paragraph", "T"), ("table", "T"), ("code", "T"), ("heading", "T / U"), ("paragraph", "T / U")]
    assert documents.located("a b  c", "b c") == (2, 6, "whitespace")


def test_block_chunks(spark):
    table = "|a|b|\n|:-|-|\n|1|x\\|y|\n|2|zz|\n|3|z|"
    text = f"# T\n\none\n\n## U\n\n{table}\n\nend"
    assert documents.table_parts(table.split("\n"), 100) == ("a | b\n1 | x\\|y\n2 | zz\n3 | z", [(0, 27, 0, 3, "a | b\n1 | x\\|y\n2 | zz\n3 | z")])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "|h|\n|-|"), (5, "x" * 45)], "doc int, body string")
    got = [tuple(r) for r in documents.block_chunks(docs, "doc", "body", 22, 2).orderBy("id", "ordinal").collect()]
    assert got[:4] == [
        (1, 0, "prose", 0, 14, None, None, "T", "# T\n\none\n\n## U"),
        (1, 1, "table", 22, 37, 0, 2, "T / U", "a | b\n1 | x\\|y\n2 | zz"),
        (1, 2, "table", 38, 43, 2, 3, "T / U", "a | b\n3 | z"),
        (1, 3, "prose", 45, 48, None, None, "T / U", "end"),
    ]
    assert [r[:5] for r in got[4:]] == [(4, 0, "table", 0, 1), (5, 0, "prose", 0, 22), (5, 1, "prose", 20, 42), (5, 2, "prose", 40, 45)]


def test_text_functions(spark):
    row = spark.createDataFrame([("Ａb  C", "hello hello")], "n string, t string").select(
        text.canonical_name(F.col("n")).alias("n"),
        text.occurrences(F.col("t"), F.lit("hello")).alias("o"),
        text.bigrams(F.col("t")).alias("b"),
        text.snippet(F.col("t"), F.lit("LO h"), 4, 1).alias("s"),
    ).first()
    assert (row.n, row.o, row.s) == ("ab c", 2, "llo ") and "he" in row.b


def test_stream_folds_to_the_batch_state(spark, tmp_path):
    rows = [(i, i % 7, float(i)) for i in range(100)]
    frame = spark.createDataFrame(rows, "seq long, key int, value double")
    for part in range(2):
        frame.filter(F.col("seq") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    outbox.materialise(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["key"], "seq").awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out").withColumn("gone", F.lit(False))
    got = {r.key: r.value for r in outbox.fold(written, ["key"], "seq", ["value"], "gone").collect()}
    assert got == {k: float(max(i for i in range(100) if i % 7 == k)) for k in range(7)}
