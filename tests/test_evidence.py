import random
from datetime import datetime

from pyspark.sql import functions as F

from palimpsa.operators import evidence


def day(n):
    return datetime(2024, 1, n)


def frames(spark):
    events = spark.createDataFrame(
        [("e1", 1, 1, day(2), "accepted", "r"), ("e2", 1, 2, day(10), "rejected", "r"), ("e3", 2, 1, day(2), "accepted", "r"), ("e4", 2, 2, day(12), "accepted", "moved"),
         ("e5", 3, 2, day(3), "accepted", None), ("e6", 3, 1, day(8), "rejected", None), ("e7", 4, 1, day(2), "accepted", "r")],
        "event string, assertion int, decision_version int, created_at timestamp_ntz, to_status string, record string",
    )
    mappings = spark.createDataFrame([("r", 1, "e1", day(2)), ("r", 2, "e3", day(2)), ("r", 3, "e5", day(3)), ("r", 4, "e7", day(2)), ("none", 4, "e7", day(2))], "record string, assertion int, event string, created_at timestamp_ntz")
    assertions = spark.createDataFrame([(a, f"c{a}", "d" if a < 4 else "gone", day(1)) for a in (1, 2, 3, 4)], "assertion int, chunk string, document string, created_at timestamp_ntz")
    chunks = spark.createDataFrame([(f"c{a}", "d" if a < 4 else "gone", day(1), day(1), None) for a in (1, 2, 3, 4)], "chunk string, document string, recorded_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz")
    documents = spark.createDataFrame(
        [("d", 1, day(1), day(15), False, day(1), None), ("d", 2, day(15), None, False, day(1), day(17)), ("gone", 1, day(1), day(5), False, day(1), None), ("gone", 2, day(5), None, True, None, None)],
        "document string, version int, recorded_at timestamp_ntz, superseded_at timestamp_ntz, deleted boolean, valid_from timestamp_ntz, valid_until timestamp_ntz",
    )
    return mappings, events, assertions, chunks, documents


def test_context_follows_decisions_and_authority(spark):
    rest = frames(spark)
    reads = spark.createDataFrame([(n, "r", day(n), day(n + 3)) for n in (1, 2, 4, 9, 11, 13, 16)] + [(99, "r", None, None)], "read int, record string, known_at timestamp_ntz, valid_at timestamp_ntz")
    found = evidence.occurrences(reads, *rest)
    got = {}
    for r in found.collect():
        got.setdefault(r.read, set()).add((r.chunk, r.status))
    assert got == {
        2: {("c1", "effective"), ("c2", "effective"), ("c4", "effective")},
        4: {("c1", "effective"), ("c2", "effective"), ("c3", "effective"), ("c4", "effective")},
        9: {("c1", "effective"), ("c2", "effective"), ("c3", "effective")},  # the lower version that comes later decides nothing; the deleted document authorises nothing
        11: {("c2", "effective"), ("c3", "effective")},  # rejected
        13: {("c3", "effective")},  # moved to another record
        16: {("c3", "expired")},  # by the document's version of that day
    }
    records = spark.createDataFrame([("r", day(1), None)], "record string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    judged = {r.read: (r.status, r.usage, r.n_allowed) for r in evidence.answer_validity(reads.filter("read < 99"), records, found).collect()}
    assert judged[4] == ("effective", "effective_basis", 4) and judged[16] == ("expired", "reference", 1) and judged[1] == ("unknown", "reference", 0)


def test_as_of_join_with_and_without_slices(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None, datetime(2024, 1 + i % 12, 1 + i % 28) if i % 11 else None) for i in range(300)], "i int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(i, i % 4, datetime(2024, 1 + i * 5 % 12, 1 + i * 3 % 28)) for i in range(200)] + [(900, None, day(1)), (901, 1, None)], "n int, k int, at timestamp_ntz")
    given = [(r.n, r.k, r.at) for r in right.collect()]
    for slices in ("month", "day", None):
        rows = evidence.as_of_join(left, right, ["k"], "t", "at", ["n"], slices).collect()
        assert len(rows) == 300
        for r in rows:
            want = max((n for n, k, at in given if k is not None and k == r.k and at is not None and r.t is not None and at <= r.t), default=None)
            assert (r.found.n if r.found else None) == want


def test_visible(spark):
    rows = spark.createDataFrame([(1, day(1), None, False), (2, day(1), day(3), False), (3, day(9), None, False), (4, day(1), None, True), (5, None, None, None)], "i int, recorded_at timestamp_ntz, superseded_at timestamp_ntz, deleted boolean")
    at = F.lit(day(5)).cast("timestamp_ntz")
    assert {r.i for r in rows.filter(evidence.visible(at)).collect()} == {1, 5}
    assert {r.i for r in rows.filter(evidence.visible(at, source_artifact=True)).collect()} == {1, 2, 5}


def test_conflicts_as_of(spark):
    _, _, _, _, documents = frames(spark)
    sets = spark.createDataFrame([("s", "e", day(3), day(20)), ("old", "e", day(1), day(2))], "set string, entity string, created_at timestamp_ntz, resolved_at timestamp_ntz")
    members = spark.createDataFrame([("s", "r1", 1), ("s", "r1", 2), ("s", "r2", 3), ("s", "r2", 3)], "set string, record string, assertion int")
    events = spark.createDataFrame([(1, 1, day(1), "contradicting"), (1, 2, day(9), "rejected"), (2, 1, day(1), "contradicting"), (3, 1, day(6), "contradicting")], "assertion int, decision_version int, created_at timestamp_ntz, to_status string")
    assertions = spark.createDataFrame([(1, "d"), (2, None), (3, "gone")], "assertion int, document string")
    reads = spark.createDataFrame([(n, "e", day(n)) for n in (1, 4, 7, 12, 25)], "read int, entity string, known_at timestamp_ntz")
    got = {r.read: (r.set, r.members, r.supports, r.active_supports) for r in evidence.conflict_reads(reads, sets, members, events, assertions, documents).collect()}
    # Conflicts without members are not listed; the deleted document makes its support inactive.
    assert got == {4: ("s", 2, 3, 2), 7: ("s", 2, 3, 2), 12: ("s", 2, 3, 1)}


def test_standing_mappings_against_every_decision(spark):
    """Equal instants and versions, events that occur twice, late lower versions, other records, nothing said."""
    dice = random.Random(7)
    at = lambda: day(dice.randint(1, 9)) if dice.random() > 0.05 else None
    given = [(f"e{dice.randint(1, 3)}", dice.choice([1, 2, 3, None]), dice.choice([1, 2, 3, None]), at(), dice.choice(["accepted", "accepted", "rejected"]), dice.choice(["r", "s", None, None])) for _ in range(40)]
    given += given[:9]
    made = [(dice.choice("rs"), a, f"e{e}", at()) for a in (1, 2, 3, None) for e in (1, 2, 3) for _ in range(6)]
    read = [(n, r, day(n)) for n in range(1, 10) for r in "rst"] + [(99, "r", None)]
    events = spark.createDataFrame(given, "event string, assertion int, decision_version int, created_at timestamp_ntz, to_status string, record string")
    mappings = spark.createDataFrame(made, "record string, assertion int, event string, created_at timestamp_ntz")
    reads = spark.createDataFrame([(*r, r[2]) for r in read], "read int, record string, known_at timestamp_ntz, valid_at timestamp_ntz")
    low = lambda v: (v is not None, v) if v is not None else (False,)
    want = []
    for n, record, known in read:
        for own, assertion, event, mapped in made:
            if own != record or None in (known, mapped, assertion) or mapped > known:
                continue
            past = [e for e in given if e[1] == assertion and e[3] is not None and e[3] <= known]
            last = max(past, key=lambda e: [low(v) for v in (e[2], e[0], e[4], e[5], e[3])], default=None)
            if last and last[0] == event and last[4] == "accepted" and last[5] in (None, record):
                want.append((n, record, assertion, event))
    got = [(r.read, r.record, r.assertion, r.event) for r in evidence.standing_mappings(reads, mappings, events).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_one_row_of_a_key_reigns_at_most(spark):
    rows = spark.createDataFrame([("a", 1, day(2)), ("a", 2, day(5)), ("a", 3, day(4)), ("a", 3, day(4)), ("a", 0, day(9)), ("a", 9, None), ("b", 1, day(1))], "k string, n int, at timestamp_ntz")
    got = sorted((r.k, r.n, r.since.day, r.until and r.until.day) for r in evidence.reigns(rows, ["k"], "at", ["n"]).collect())
    assert got == [("a", 1, 2, 4), ("a", 3, 4, None), ("b", 1, 1, None)]


def test_only_contradicting_decisions_meet_the_questions(spark, monkeypatch):
    """A contradiction that ends, one that comes late with a lower version, two at one instant, one said again."""
    log = [(1, 1, 2, True), (1, 2, 5, False), (1, 3, 8, True), (2, 5, 2, False), (2, 4, 6, True), (3, 1, 3, True), (3, 2, 3, False), (4, 1, 2, True), (4, 2, 6, True), (5, 1, 4, False)]
    events = spark.createDataFrame([(a, v, day(t), "contradicting" if c else "rejected") for a, v, t, c in log], "assertion int, decision_version int, created_at timestamp_ntz, to_status string")
    reads = spark.createDataFrame([(n, "e", day(n)) for n in range(1, 11)], "read int, entity string, known_at timestamp_ntz")
    sets = spark.createDataFrame([(f"s{a}", "e", day(1), None) for a in range(1, 6)], "set string, entity string, created_at timestamp_ntz, resolved_at timestamp_ntz")
    members = spark.createDataFrame([(f"s{a}", "r", a) for a in range(1, 6)], "set string, record string, assertion int")
    assertions = spark.createDataFrame([(a, None) for a in range(1, 6)], "assertion int, document string")
    met, join = [], evidence.as_of_join
    monkeypatch.setattr(evidence, "as_of_join", lambda left, right, *a, **k: met.append(right) or join(left, right, *a, **k))
    rows = evidence.conflict_reads(reads, sets, members, events, assertions, frames(spark)[-1]).collect()
    got = {a: [r.read for r in sorted(rows) if r.set == f"s{a}" and r.active_supports] for a in range(1, 6)}
    assert len(rows) == 50 and got == {1: [2, 3, 4, 8, 9, 10], 2: [], 3: [], 4: list(range(2, 11)), 5: []}
    assert sorted((r.assertion, r.decision_version) for r in met[0].collect()) == [(1, 1), (1, 3), (4, 1), (4, 2)]
