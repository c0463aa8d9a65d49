import duckdb

from palimpsa.llm import chat


def test_snapshots_collapse(spark):
    rows = []
    log = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "<|im_end|> done")]
    for conv, n in ((1, 2), (2, 4), (3, 3), (4, 4)):
        rows += [(conv, t, r, x) for t, (r, x) in enumerate(log[:n])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 10, "user", "hi")]
    rows += [(7, 0, "user", None), (7, 0, "user", None), (7, None, None, "first"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody"), (None, 4, "user", "nobody"), (None, 1, "user", "somebody")]
    rows += [(8, 0, "user", "long " * 50_000)]
    talks = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, h1 string")
    rows = chat.render(talks).collect()
    nameless = sorted((r.n_turns, r.n_copies, r.rendered) for r in rows if r.conv_id is None)
    assert nameless == [(1, n, f"<|im_start|>user\n{x}<|im_end|>") for n, x in ((1, "somebody"), (2, "nobody"))]
    found = {r.conv_id: r for r in rows}
    assert set(found) == {2, 5, 7, 8, None}
    assert (found[2].n_turns, found[2].n_copies) == (4, 2)
    assert found[2].rendered.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello")
    assert found[2].rendered.endswith("< |im_end|> done<|im_end|>")
    assert found[7].rendered == "<|im_start|>\nfirst<|im_end|>\n<|im_start|>user\n<|im_end|>"
    con = duckdb.connect()
    conversations = talks.toPandas()  # noqa: F841
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    conversations["turn"] = conversations["turn"].astype("Int64")
    assert set(con.execute(chat.SQL).fetchall()) == {tuple(r) for r in rows}
    assert chat.render(talks.limit(0)).count() == 0
