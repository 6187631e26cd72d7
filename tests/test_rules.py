"""Datalog, triples and what follows from them."""

from __future__ import annotations

import pytest

from tests.conftest import rows_of
from weft.plans import datalog as D
from weft.plans import triples as Q
from weft.sources import formats


def test_rules_with_comparisons_and_blanks(spark):
    p = D.Program(spark).add("""
        person("Ann"). person("Bob"). person("Cid").
        works_at("Ann", "X"). works_at("Bob", "X"). works_at("Cid", "Y"). expertise("Ann", "db"). age("Ann", 9). age("Bob", 10).
        employee(X) :- works_at(X, _).
        colleague(X, Y) :- works_at(X, C), works_at(Y, C), X != Y.
        expert_employee(X) :- employee(X), expertise(X, _).
        older(X) :- age(X, N), N > 9.
        idle(X) :- person(X), not expertise(X, _).
    """)
    assert rows_of(p.query("colleague(X, Y)")) == [("Ann", "Bob"), ("Bob", "Ann")]
    assert rows_of(p.query("expert_employee(X)")) == [("Ann",)]
    assert rows_of(p.query("older(X)")) == [("Bob",)]
    assert rows_of(p.query("idle(X)")) == [("Bob",), ("Cid",)]
    assert rows_of(p.query('works_at(X, "Y")')) == [("Cid",)]
    assert p.holds('colleague("Ann", "Bob")') and not p.holds('colleague("Ann", "Ann")')
    assert rows_of(p.aggregate("works_at", [1], count=None, set=0), "_1", "count", "set") == [("X", 2, ("Ann", "Bob")), ("Y", 1, ("Cid",))]


def test_closure_of_a_cycle_and_strata(spark):
    p = D.Program(spark).add("e(a, b). e(b, c). e(c, a). e(c, d). t(X, Y) :- e(X, Y). t(X, Z) :- t(X, Y), t(Y, Z). end(X) :- e(_, X), not e(X, _). loop(X) :- t(X, X).")
    assert rows_of(p.query("end(X)")) == [("d",)]
    assert rows_of(p.query("loop(X)")) == [("a",), ("b",), ("c",)]
    assert p.query("t(X, Y)").count() == 12
    q = D.Program(spark).add("e(a, b). e(b, c). e(x, y). r(X, Y) :- e(X, Y). r(X, Z) :- e(X, Y), r(Y, Z).")
    assert rows_of(q.magic("r(a, Z)")) == [("b",), ("c",)] == rows_of(q.query("r(a, Z)"))


def test_bad_rules(spark):
    with pytest.raises(ValueError, match="unsafe"):
        D.Program(spark).add("p(X, Y) :- q(X).")
    with pytest.raises(ValueError, match="negation"):
        D.Program(spark, {"q": spark.createDataFrame([("a",)], "x string")}).add("p(X) :- q(X), not r(X). r(X) :- q(X), not p(X).").run()
    with pytest.raises(ValueError):
        D.parse("p(X :- q(X).")


def foaf(spark):
    rows = [("ann", "type", "Person"), ("bob", "type", "Person"), ("ann", "name", "Ann"), ("bob", "name", "Bob"), ("ann", "age", "31"), ("bob", "age", "9"), ("ann", "knows", "bob"), ("acme", "type", "Company")]
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_sparql(spark):
    t = foaf(spark)
    assert rows_of(Q.sparql(t, "SELECT ?n WHERE { ?x a Person ; name ?n ; age ?a . FILTER(?a > 30) }")) == [("Ann",)]
    assert rows_of(Q.sparql(t, "SELECT ?x ?y WHERE { ?x a Person OPTIONAL { ?x knows ?y } }")) == [("ann", "bob"), ("bob", None)]
    assert rows_of(Q.sparql(t, "SELECT ?x WHERE { ?x a Person OPTIONAL { ?x knows ?y } FILTER(!bound(?y)) }")) == [("bob",)]
    assert rows_of(Q.sparql(t, "SELECT ?k (COUNT(?x) AS ?n) WHERE { ?x a ?k } GROUP BY ?k ORDER BY DESC(?n) LIMIT 1")) == [("Person", 2)]
    assert rows_of(Q.sparql(t, 'ASK { ?x name "Ann" }')) == [(True,)] and rows_of(Q.sparql(t, 'ASK { ?x name "Zoe" }')) == [(False,)]
    assert rows_of(Q.sparql(t, "CONSTRUCT { ?y known_by ?x } WHERE { ?x knows ?y }")) == [("bob", "known_by", "ann")]
    more = Q.sparql(t, 'INSERT DATA { zoe name "Zoe" . ann name "Ann" }')
    assert more.count() == t.count() + 1
    assert Q.sparql(more, 'DELETE DATA { zoe name "Zoe" }').count() == t.count()
    plan = Q.explain("SELECT ?x WHERE { ?x a Person . ?y name ?z . ?x knows ?y }")
    assert [s["how"] for s in plan["steps"]] == ["scan", "hash_join", "hash_join"]
    with pytest.raises(ValueError):
        Q.parse("DROP everything")


def test_sparql_terms_and_optional_parts(spark):
    t = foaf(spark).unionByName(spark.createDataFrame([("q", "name", "?x"), ("http://x/n", "p", "v"), ("bob", "p", "2"), ("bob", "q", "1")], "s string, p string, o string"))
    assert rows_of(Q.sparql(t, 'SELECT ?s WHERE { ?s name "?x" }')) == [("q",)]
    assert rows_of(Q.sparql(t, "PREFIX x: <http://x/> SELECT ?o WHERE { x:n p ?o }")) == [("v",)]
    assert rows_of(Q.sparql(t, "SELECT ?o ?z WHERE { ?s p ?o OPTIONAL { ?s q ?z FILTER(?z != ?o) } }")) == [("2", "1"), ("v", None)]
    assert rows_of(Q.sparql(t, 'SELECT ?s ?z WHERE { ?s a Company OPTIONAL { ?z name "nobody" } }')) == [("acme", None)]
    assert [r["p"] for r in Q.sparql(t, "SELECT DISTINCT ?p WHERE { ?s ?p ?o } ORDER BY DESC(?p) LIMIT 2").collect()] == ["type", "q"]
    assert rows_of(Q.sparql(t, "DESCRIBE <bob>")) == rows_of(t.filter("s = 'bob' or o = 'bob'"))
    assert [len(x.collect()) for x in Q.batch(t, ['INSERT DATA { new name "n" }', 'SELECT ?s WHERE { ?s name "n" }'])] == [t.count() + 1, 1]
    assert [s["part"] for s in Q.explain("SELECT ?x WHERE { { ?x a A } UNION { ?x a B } OPTIONAL { ?x p ?y } }")["steps"]] == ["union", "union", "optional"]


def test_rules_that_count_and_compute(spark):
    p = D.Program(spark).add("""
        edge(a, b). edge(b, c). edge(c, d). edge(a, d). node(X) :- edge(X, _). node(X) :- edge(_, X).
        path(X, Y, 1) :- edge(X, Y).
        path(X, Z, N) :- edge(X, Y), path(Y, Z, M), N = M + 1, N <= 10.
        degree(X, N) :- node(X), N = count(Y : edge(X, Y)).
        ends(X, T) :- node(X), T = {Y : edge(X, Y)}.
        far(X, T) :- node(X), T = top(2, Y, N : path(X, Y, N)).
        nearest(X, N) :- node(X), N = min(M : path(X, _, M)).
    """)
    assert rows_of(p.query('path("a", "d", N)')) == [("1",), ("3",)]
    assert rows_of(p.query("degree(X, N)")) == [("a", "2"), ("b", "1"), ("c", "1"), ("d", "0")]
    assert rows_of(p.query("ends(X, T)")) == [("a", "b,d"), ("b", "c"), ("c", "d"), ("d", "")]
    assert rows_of(p.query('far("a", T)')) == [("d,c",)] and rows_of(p.query("nearest(X, N)")) == [("a", "1"), ("b", "1"), ("c", "1")]
    with pytest.raises(ValueError, match="unsafe"):
        D.Program(spark).add("p(X, N) :- q(X), N = M + 1.")


def test_magic_extension_and_proof(spark):
    text = "par(a, b). par(b, c). par(c, d). par(x, y). par(z, y). anc(X, Y) :- par(X, Y). anc(X, Z) :- par(X, Y), anc(Y, Z). sg(X, X) :- par(_, X). sg(X, Y) :- par(A, X), sg(A, B), par(B, Y)."
    p = D.Program(spark).add(text)
    for goal in ("anc(b, Z)", "anc(X, d)", "anc(X, Y)", "sg(b, Y)", "anc(a, d)"):
        assert rows_of(p.magic(goal)) == rows_of(D.Program(spark).add(text).query(goal))
    p.run()
    p.extend("par", spark.createDataFrame([("d", "e"), ("a", "b")], "x string, y string"))
    whole = D.Program(spark).add(text + " par(d, e).")
    assert rows_of(p.query("anc(X, Y)")) == rows_of(whole.query("anc(X, Y)")) and rows_of(p.query("sg(X, Y)")) == rows_of(whole.query("sg(X, Y)"))
    proof = p.prove("anc(a, c)")
    assert proof[0] == (0, "anc(a, c)", "anc/2") and (1, "par(a, b)", "given") in proof and p.prove("anc(c, a)") is None


def test_transactions_and_kept_results(spark):
    from weft.plans.store import Store
    from weft.sources.tables import Graph

    s = Store(Graph(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "src string, dst string")))
    t = s.begin().insert(edges=spark.createDataFrame([("a", "q")], "src string, dst string"))
    with pytest.raises(ValueError, match="no node"):
        t.commit()
    assert s.version == 0 and s.begin().insert(nodes=spark.createDataFrame([("b",)], "id string")).commit() == 1
    with pytest.raises(ValueError, match="ended"):
        t.insert()


def test_language(spark):
    from weft.plans.language import Knowledge
    from weft.sources.tables import Graph

    nodes = spark.createDataFrame([], "id string, type string, properties map<string,string>")
    k = Knowledge(Graph(nodes, spark.createDataFrame([], "src string, dst string, type string")))
    got = k.run("""
        DEFINE entity Person WITH PROPERTIES name AS string, age AS int END
        DEFINE relationship KNOWS CONNECTING Person TO Person END
        DECLARE knowledge_graph people AS ENTITIES Person RELATIONSHIPS KNOWS END
        ASSERT Person ann WITH name "Ann A", age 31 ASSERT Person bob WITH age 9 ASSERT Person cid WITH age 40
        ESTABLISH KNOWS BETWEEN ann AND bob ESTABLISH KNOWS BETWEEN bob AND cid
        WHEN x KNOWS y AND y KNOWS z THEN x MAY_KNOW z
        FIND ALL Person p WHERE p.age > 20 ORDERED BY p.age DESC
        FIND SOME Person p WHERE p MAY_KNOW cid""")
    assert [r["id"] for r in got[0].collect()] == ["cid", "ann"] and [r["id"] for r in got[1].collect()] == ["ann"]
    assert k.graphs == {"people": ["Person", "KNOWS"]}
    with pytest.raises(ValueError, match="has no"):
        k.run("ASSERT Person dan WITH height 3")
    with pytest.raises(ValueError, match="connects"):
        k.run("ESTABLISH KNOWS BETWEEN ann AND nobody")


def test_terms_and_inference(spark):
    t = foaf(spark)
    assert rows_of(Q.distinct_terms(t, "p", s="bob")) == [("age",), ("name",), ("type",)]
    rules = [("Person", "subClassOf", "Agent"), ("knows", "domain", "Person"), ("knows", "inverseOf", "known_by"), ("in", "type", "TransitiveProperty"), ("a", "in", "b"), ("b", "in", "c"), ("c", "in", "d")]
    r = Q.rdfs(t.unionByName(spark.createDataFrame(rules, t.schema)))
    assert r.filter("s = 'ann' and p = 'type'").count() == 2 and r.filter("p = 'known_by'").count() == 1
    assert rows_of(r.filter("p = 'in'"), "s", "o") == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    assert Q.closure(e).count() == 9


def test_formats(spark, tmp_path):
    t = spark.createDataFrame([("C1", "says", 'a "quoted" \\ line\nnext'), ("C1", "near", "N2")], "s string, p string, o string")
    formats.write(t, str(tmp_path / "rdf"), "rdf")
    assert rows_of(formats.load(spark, str(tmp_path / "rdf"), "rdf"), "s", "p", "o") == rows_of(t)
    for kind in ("parquet", "json", "csv", "orc"):
        formats.write(t.filter("p = 'near'"), str(tmp_path / kind), kind)
        assert rows_of(formats.load(spark, str(tmp_path / kind), kind, "s string, p string, o string")) == [("C1", "near", "N2")]
    e = spark.createDataFrame([("a&b", "c", "T", 2.0)], "src string, dst string, type string, weight double")
    assert formats.graphml_lines(e).first()["line"] == '<edge source="a&amp;b" target="c"><data key="type">T</data></edge>'
    assert formats.gexf_lines(e).first()["line"].endswith('weight="2.0"/>')
    import xml.dom.minidom

    nodes = spark.createDataFrame([("a&b", "T", {"k": "<v>"}), ("c", "T", {})], "id string, type string, properties map<string,string>")
    for kind in ("graphml", "gexf"):
        formats.write(e, str(tmp_path / kind), kind, nodes=nodes)
        text = "".join(r["value"] for r in spark.read.option("wholetext", True).text(str(tmp_path / kind)).collect())
        doc = xml.dom.minidom.parseString(text)
        assert len(doc.getElementsByTagName("node")) == 2 and len(doc.getElementsByTagName("edge")) == 1
    formats.write(e, str(tmp_path / "jsonl"), "jsonl", nodes=nodes)
    back = formats.load_graph(spark, str(tmp_path / "jsonl"))
    assert rows_of(back[0], "id", "type") == [("a&b", "T"), ("c", "T")] and rows_of(back[1]) == [("a&b", "c", "T", 2.0)]
    formats.write(t, str(tmp_path / "turtle"), "turtle")
    assert rows_of(formats.load(spark, str(tmp_path / "turtle"), "turtle")) == rows_of(t)
    long = """@prefix f: <http://x/> .
f:a a f:P ; f:n "A \\"q\\"", "b"@en, "1"^^f:int ; f:k <urn:weft:C1> . # said
"""
    assert formats.parse_turtle(long) == [("http://x/a", "type", "http://x/P"), ("http://x/a", "http://x/n", 'A "q"'), ("http://x/a", "http://x/n", "b"), ("http://x/a", "http://x/n", "1"), ("http://x/a", "http://x/k", "C1")]
    formats.compact(spark, str(tmp_path / "parquet"), str(tmp_path / "compact"), 1)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 1
