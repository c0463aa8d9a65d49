import random
from datetime import datetime, timedelta

from palimpsa.operators import shapes, term_operations
from palimpsa.operators.shapes import Shape

DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def snapshot(facts, types, shape, subject, t):
    """Rules of a shape that a subject breaks at an instant."""
    holds = lambda a, b: (a is None or a <= t) and (b is None or t < b)
    classes = {(s, c) for s, c, a, b in types if holds(a, b) and (a is None or b is None or a < b)}
    if (subject, shape.target) not in classes:
        return set()
    values = {v for s, p, v, a, b in facts if s == subject and p == shape.predicate and holds(a, b)}
    broken = set()
    if shape.least is not None and len(values) < shape.least:
        broken.add("least")
    if shape.most is not None and len(values) > shape.most:
        broken.add("most")
    if shape.one_of is not None and values - set(shape.one_of):
        broken.add("value")
    if shape.node_class is not None and any((v, shape.node_class) not in classes for v in values):
        broken.add("class")
    return broken


def test_equals_validation_of_each_snapshot(spark):
    r = random.Random(2)
    span = lambda: tuple(at(x) for x in sorted(r.sample(range(40), 2))) if r.random() < 0.8 else (at(r.randrange(20)) if r.random() < 0.5 else None, None)
    facts = [(r.choice("abc"), r.choice(["p", "q"]), r.choice("xyzw"), *span()) for _ in range(60)]
    types = [(r.choice("abc"), r.choice(["C", "D"]), *span()) for _ in range(8)] + [(r.choice("xyz"), "V", *span()) for _ in range(5)] + [("a", "C", at(9), at(9))]
    rules = [Shape("s1", "C", "p", least=1, most=2), Shape("s2", "D", "q", one_of=("x", "y")), Shape("s3", "C", "q", node_class="V"), Shape("s4", "C", "none", least=1)]
    found = shapes.violations(
        spark.createDataFrame(facts, "subject string, predicate string, value string, start timestamp_ntz, stop timestamp_ntz"),
        spark.createDataFrame(types, "subject string, class string, start timestamp_ntz, stop timestamp_ntz"), rules,
    ).collect()
    assert {x.rule for x in found} == {"least", "most", "value", "class"}
    marks = sorted({t for row in [*facts, *types] for t in row[-2:] if t is not None})
    instants = [t + d for t in marks for d in (timedelta(0), timedelta(microseconds=-1))] + [marks[-1] + timedelta(days=9)]
    for t in instants:
        for subject in "abc":
            for shape in rules:
                got = {x.rule for x in found if x.subject == subject and x.shape == shape.name and (x.start is None or x.start <= t) and (x.stop is None or t < x.stop)}
                assert got == snapshot(facts, types, shape, subject, t), (t, subject, shape)


def test_datatypes(spark):
    values = {"integer": (["1", "-07"], ["1.0", "", "x1"]), "boolean": (["true", "0"], ["yes"]), "date": (["2024-02-01"], ["2024-2-1"]), "dateTime": (["2024-02-01T00:00:00Z"], ["2024-02-01"])}
    for kind, (good, bad) in values.items():
        facts = [(v, "p", v, None, None) for v in good + bad]
        types = [(v, "C", None, None) for v in good + bad]
        found = shapes.violations(
            spark.createDataFrame(facts, "subject string, predicate string, value string, start timestamp_ntz, stop timestamp_ntz"),
            spark.createDataFrame(types, "subject string, class string, start timestamp_ntz, stop timestamp_ntz"), [Shape("s", "C", "p", datatype=kind)],
        )
        assert {r.subject for r in found.collect()} == set(bad)


def test_apply_then_invert_gives_the_start(spark):
    base = spark.createDataFrame([("A", "rdf:type", "owl:Class"), ("B", "rdf:type", "owl:Class"), ("A", "rdfs:subClassOf", "B")], "s string, p string, o string")
    log = [
        (1, "create_term", "C", None, "owl:Class", None), (2, "add_parent", "C", None, "A", None), (3, "remove_parent", "A", None, "B", None), (4, "add_annotation", "C", "label", "see", None),
        (5, "add_annotation", "C", "label", "see", None), (6, "remove_annotation", "C", "label", "see", None), (7, "create_term", "A", None, "owl:Class", None), (8, "remove_parent", "A", None, "B", None),
        (9, "retire_term", "B", None, None, None), (10, "set_datatype", "C", None, "xsd:int", None), (11, "set_datatype", "C", None, "xsd:date", "xsd:int"), (12, "set_datatype", "C", None, None, "xsd:gone"),
    ]
    operations = spark.createDataFrame(log, "seq long, action string, target string, predicate string, value string, before string")
    edits = term_operations.compiled(operations)
    rows = lambda d: {(r.s, r.p, r.o) for r in d.collect()}
    assert {(r.seq, r.problem) for r in term_operations.conflicts(base, edits).collect()} == {(7, "already there"), (8, "not there"), (12, "not there")}
    after = term_operations.applied(base, edits)
    assert rows(after) == {("A", "rdf:type", "owl:Class"), ("B", "rdf:type", "owl:Class"), ("C", "rdf:type", "owl:Class"), ("C", "rdfs:subClassOf", "A"), ("B", "owl:deprecated", "true"), ("C", "rdfs:range", "xsd:date")}
    back = term_operations.inverse(base, edits)
    assert term_operations.conflicts(after, back).count() == 0 and rows(term_operations.applied(after, back)) == rows(base)
    changed = term_operations.difference(base, after).selectExpr("1 as seq", "s", "p", "o", "adds", "cast(null as string) as needs")
    assert rows(term_operations.applied(base, changed)) == rows(after)


def test_merge_and_invariants(spark):
    t = "rdf:type"
    triples = spark.createDataFrame(
        [(x, t, "owl:Class") for x in "ABCDE"] + [("A", "rdfs:subClassOf", "B"), ("B", "rdfs:subClassOf", "A"), ("C", "rdfs:subClassOf", "Gone"), ("D", "rdfs:subClassOf", "E"), ("E", "owl:deprecated", "true"), ("P", "rdfs:domain", "Gone"), ("D", t, "owl:Thing")],
        "s string, p string, o string",
    )
    assert {(r.problem, r.term, r.other) for r in term_operations.invariants(triples).collect()} == {
        ("cycle", "A", None), ("cycle", "B", None), ("unknown parent", "C", "Gone"), ("retired parent", "D", "E"), ("unknown domain", "P", "Gone"), ("several kinds", "D", "owl:Class"),
    }
    merged = term_operations.merged_terms(triples, spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E"), ("D", "C")], "old string, new string"))
    rows = {(r.s, r.p, r.o) for r in merged.collect()}
    assert ("A", "dcterms:isReplacedBy", "C") in rows and ("B", "owl:deprecated", "true") in rows and ("A", t, "owl:Class") in rows
    assert {r for r in rows if r[1] == "rdfs:subClassOf"} == {("C", "rdfs:subClassOf", "Gone"), ("D", "rdfs:subClassOf", "E")}  # a fork is not followed
