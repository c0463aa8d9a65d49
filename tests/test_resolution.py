import pytest

from palimpsa.operators import algebra, entity_resolution, slices

M = "mention string, type string, scope string, source string, name string, keys map<string,string>, vector array<double>, mode string"
E = "id string, type string, scope string, source string, name string, aliases array<string>, keys map<string,string>, vector array<double>"


def resolved(spark, mentions, entities, **bands):
    out = entity_resolution.resolve(spark.createDataFrame(mentions, M), spark.createDataFrame(entities, E), **bands)
    return {r.mention: (r.outcome, r.entity, r.reason) for r in out.collect()}


def test_order_and_gates(spark):
    entities = [
        ("keyed", "Org", "", "s1", "Other", None, {"tax": "1"}, [0.0, 1.0]),
        ("named", "Org", "", "s2", "Acme", ["ACME Inc"], None, [1.0, 0.0]),
        ("clash", "Org", "", "s2", "Globex", None, {"tax": "7"}, [1.0, 0.0]),
        ("twin1", "Org", "", "s3", "Twin", None, None, None),
        ("twin2", "Org", "", "s3", "Twin", None, None, None),
        ("far", "Org", "", "s9", "Unique", None, None, [1.0, 0.0]),
        ("near", "Org", "", "s4", "Near", None, None, [1.0, 0.05]),
        ("ref", "Ref", "", "s1", "Referred", None, None, [1.0, 0.0]),
        ("scoped", "Org", "x", "s2", "Scoped", None, None, None),
    ]
    def m(name, id, type="Org", scope="", source="s2", keys=None, vector=None, mode="default"):
        return id, type, scope, source, name, keys, vector, mode

    mentions = [
        m("Acme", id="key before name", keys={"tax": "1"}),
        m(" acme INC ", id="alias"),
        m("Globex", id="name with another key", keys={"tax": "8"}),
        m("Twin", id="ambiguous", source="s3"),
        m("Unique", id="name across sources"),
        m("Nothing", id="likeness across sources", source="s0", vector=[1.0, 0.0]),
        m("Nothing", id="high", source="s4", vector=[1.0, 0.0]),
        m("Nothing", id="gray", source="s4", vector=[1.0, 0.8]),
        m("Nothing", id="low", source="s4", vector=[0.0, 1.0]),
        m("Nothing", id="reference likeness", type="Ref", source="s1", vector=[1.0, 0.0], mode="reference"),
        m("Referred", id="reference name across sources", type="Ref", source="s7", mode="reference"),
        m("Scoped", id="another scope"),
        m("Acme", id="another type", type="Person"),
        m("Nothing", id="no vector", source="s4"),
        m(None, id="no name", source="s0"),
    ]
    assert resolved(spark, mentions, entities) == {
        "key before name": ("aligned", "keyed", "strong_identity_key"),
        "alias": ("aligned", "named", "exact_name_or_alias"),
        "name with another key": ("review", None, "conflicting_identity_key"),
        "ambiguous": ("review", None, "ambiguous_exact_identity"),
        "name across sources": ("separate", None, "no_semantic_candidate"),
        "likeness across sources": ("separate", None, "no_compatible_candidate"),
        "high": ("aligned", "near", "semantic_high_band"),
        "gray": ("review", "near", "semantic_gray_band"),
        "low": ("separate", "near", "semantic_low_band"),
        "reference likeness": ("review", "ref", "reference_similarity_requires_review"),
        "reference name across sources": ("aligned", "ref", "exact_name_or_alias"),
        "another scope": ("separate", None, "no_semantic_candidate"),
        "another type": ("separate", None, "no_compatible_candidate"),
        "no vector": ("separate", None, "no_semantic_candidate"),
        "no name": ("separate", None, "no_compatible_candidate"),
    }
    with pytest.raises(ValueError):
        resolved(spark, mentions, entities, review=0.9, merge=0.8)


def test_conflicts_between_two_holders(spark):
    rows = [("1", {"tax": "a"}), ("2", {"tax": "a", "reg": "x"}), ("3", {"tax": "a", "reg": "y"}), ("4", {"tax": "b"}), ("5", {"tax": "b"}), ("6", None)]
    got = entity_resolution.key_conflicts(spark.createDataFrame(rows, "id string, keys map<string,string>")).collect()
    assert [(r.component, r.scheme, r.n_values) for r in got] in ([("1", "reg", 2)], [(1, "reg", 2)])


def test_paths_and_order(spark):
    triples = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "q", "a"), ("x", "p", "x")], "s string, p string, o string")
    found = lambda *a, **k: {(r.s, r.o) for r in algebra.path(triples, *a, **k).collect()}
    cycle = {(s, o) for s in "abc" for o in "abc"}
    assert found(["p"]) == cycle | {("x", "x")}
    assert found(["p"], least=2, most=2) == {("a", "c"), ("b", "a"), ("c", "b"), ("x", "x")}
    assert found(["^q"], least=0) == {(s, s) for s in "ax"} | {("a", "x")}
    start = spark.createDataFrame([("x",)], "s string")
    assert found(["p", "q"], start=start) == {("x", o) for o in "xabc"}
    patterns = [("?a", "p", "?b"), ("?c", "q", "?a"), ("?b", "p", "?d")]
    sizes = algebra.measured(triples, patterns)
    assert [sizes[p] for p in patterns] == [4, 1, 4] and algebra.join_order(patterns, sizes)[0] == patterns[1]
    assert [r.d for r in algebra.select(algebra.conjunction(triples, patterns), ["d"]).collect()] == ["c"]
    with pytest.raises(ValueError):
        algebra.conjunction(triples, [("?a", "p", "?b"), ("?c", "q", "?d")])
    assert algebra.conjunction(triples, [("?a", "q", "?b"), ("a", "p", "b")]).count() == 1
    assert algebra.conjunction(triples, [("?a", "q", "?b"), ("a", "p", "z")]).count() == 0


def test_slices(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    terms = frame([("Dog", True), ("Pet", True), ("Puppy", True), ("Owner", True), ("owns", False), ("Lone", False)], "term string, is_class boolean")
    labels = frame([("Dog", "dog"), ("Dog", "hound dog"), ("owns", "owns"), ("Gone", "dog")], "term string, label string")
    subs = frame([("Dog", "Pet"), ("Puppy", "Dog"), ("Dog", "Unlisted"), ("Unlisted", "Owner")], "child string, parent string")
    contracts = frame([("owns", "domain", "Owner"), ("owns", "range", "Pet"), ("Lone", "domain", "Thing")], "property string, end string, class string")
    questions = frame([(1, "A HOUND DOG"), (2, "who owns"), (3, "none"), (4, None)], "q int, t string")
    roots = frame([("Pet",), ("Unlisted",)], "term string")
    got = {}
    for r in slices.ontology_slices(questions, "q", "t", terms, labels, subs, contracts, roots).collect():
        got.setdefault(r.question, {})[r.term] = (r.surface, r.reasons)
    contract = {"owns": (None, ["property_contract"]), "Owner": (None, ["property_domain"])}
    assert got[1] == {"Dog": ("hound dog", ["lexical"]), "Pet": (None, ["ancestor", "property_range"]), "Puppy": (None, ["child"]), **contract}
    assert got[2] == {"owns": ("owns", ["lexical", "property_contract"]), "Owner": (None, ["property_domain"]), "Pet": (None, ["property_range"])}
    assert got[3] == got[4] == {"Pet": (None, ["configured_root"])}
