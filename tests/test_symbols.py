"""Names of types by scope: two classes of one simple name, every kind of import, nested types, supertypes, transfer objects."""

import random
import time

import pytest

from graphlens.operators import audit
from graphlens.plans import analysis
from graphlens.resolvers import symbols
from graphlens.sources import java

SHOP = {
    "old/Order.java": "package old; @Entity public class Order { @Id Long id; }",
    "now/Order.java": "package now; import old.Order; @Entity public class Orders { @Id Long id; @OneToMany List<Line> lines; @ManyToOne Order before; static class Line { Order own; } }",
    "now/Line.java": "package now; @Entity class Line { @Id int id; }",
    "now/Store.java": "package now; public interface Store extends Base {}",
    "now/Base.java": "package now; public interface Base {}",
    "now/SqlStore.java": "package now; @Repository public class SqlStore implements Store {}",
    "old/SqlStore.java": "package old; @Repository public class SqlStore {}",
    "web/Api.java": """package web;
import now.*; import old.SqlStore; import java.util.List; import static web.Tools.help;
@RestController class Api {
  private final Base base; private final SqlStore sql;
  Api(Base base, SqlStore sql) {}
  @GetMapping("/all") List<OrderView> all(@RequestParam Filter f) { Base x = null; x.run(); sql.load(); this.base.more(); return Tools.help(1); }
  @PostMapping("/one") ResponseEntity<OrderView> one(@RequestBody Command c) { c.check(); other.go(); return null; }
  record Command(int n) {} static class Filter {}
}""",
    "web/OrderView.java": "package web; class OrderView { OrderView(old.Order from, now.Orders all) {} }",
    "web/Tools.java": "package web; class Tools {}",
    "src/ApiTest.java": "package other; import web.Api; import old.SqlStore; @SpringBootTest(classes = {Api.class}) class ApiTest { @InjectMocks Api api; @Mock SqlStore store; }",
    "data/Repo.java": "package data; import old.Order; interface Repo extends JpaRepository<Order, Long> {}",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(SHOP.items()), "file string, text string")


@pytest.fixture(scope="module")
def shop(files):
    graph = analysis.graph_of(analysis.facts_of(files, by_import=True))
    return graph, {r.id: r for r in graph.nodes.collect()}, {tuple(r) for r in graph.edges.collect()}


def read(name, own, package, imports, declared):
    """The scopes of one name, one after another."""
    inside, head, rest = own[len(package) + 1 :].split(".") if package else own.split("."), name.split(".")[0], name[len(name.split(".")[0]) :]
    dot = package + "." if package else ""
    order = []
    for n in range(len(inside), 0, -1):
        here = dot + ".".join(inside[:n])
        order.append([f"{here}.{name}", *([here + rest] if inside[n - 1] == head else [])])
    plain = [i.removeprefix("static ") for i in imports]
    order += [[i + rest for i in plain if i.split(".")[-1] == head], [dot + name], [i[:-1] + name for i in plain if i.endswith(".*")], [name]]
    return next((min(f for f in fulls if f in declared) for fulls in order if any(f in declared for f in fulls)), None)


def test_names_equal_a_plain_reading(spark):
    rnd, texts = random.Random(6), []
    packages, simple = ["a", "a.b", "c", ""], ["X", "Y", "Z", "A", "B"]
    for n in range(40):
        package = rnd.choice(packages)
        lines = [f"package {package};"] if package else []
        for _ in range(rnd.randrange(4)):
            lines.append(f"import {rnd.choice(['', 'static '])}{rnd.choice(['a', 'a.b', 'c', 'a.A', 'q'])}.{rnd.choice([*simple, '*'])};")
        inner = " ".join(f"{rnd.choice([*simple, 'a.b.X', 'A.B', 'X.Y', 'q.Q'])} f{k};" for k in range(3))
        lines.append(f"class {rnd.choice(simple)} {{ {inner} class {rnd.choice(simple)} {{ {rnd.choice(simple)} g; }} }}")
        texts.append((f"{n}.java", "\n".join(lines)))
    types = java.types(spark.createDataFrame(texts, "file string, text string"))
    rows = types.collect()
    declared = {r.fqn for r in rows}
    want = {(r.file, r.at, f.type): read(f.type, r.fqn, r.package, r.imports, declared) for r in rows for f in r.fields}
    got = {(r.file, r.at, r.name): r.full for r in symbols.resolved_names(types).where("declared").collect()}
    assert {k: v for k, v in want.items() if v} == {k: got[k] for k in want if k in got}


def test_outside_types_are_what_imports_say(spark):
    types = java.types(spark.createDataFrame([("a.java", "package a; import x.y.Out; class A { Out o; Map<Out, Nope> m; }")], "file string, text string"))
    assert {(r.name, r.full, r.declared) for r in symbols.resolved_names(types).collect()} == {("Out", "x.y.Out", False)}


def test_injections_by_scope_and_supertype(shop):
    _, nodes, edges = shop
    # Base is offered by SqlStore of now through Store; the imported SqlStore is the old one
    assert {t for s, t, k in edges if s == "class:web.Api" and k == "INJECTS"} == {"class:now.SqlStore", "class:old.SqlStore"}
    assert nodes["class:now.SqlStore"].type == nodes["class:old.SqlStore"].type == "REPOSITORY"


def test_calls_lead_to_receivers(shop):
    _, _, edges = shop
    assert {t for s, t, k in edges if s == "class:web.Api" and k == "CALLS"} == {"class:now.SqlStore", "class:old.SqlStore", "class:web.Tools", "class:web.Api.Command", "class:other"}


def test_tests_and_mocks_by_full_name(shop):
    _, _, edges = shop
    test = "test:other.ApiTest"
    assert {(t, k) for s, t, k in edges if s == test} == {("class:web.Api", "TESTS"), ("class:old.SqlStore", "MOCKS")}


def test_entities_by_full_name(shop):
    _, nodes, edges = shop
    # the nested Line hides the package's
    assert ("persistence_entity:now.Orders", "persistence_entity:now.Orders.Line", "HAS_MANY") in edges
    assert ("persistence_entity:now.Orders", "persistence_entity:old.Order", "BELONGS_TO") in edges
    assert ("data_repo:data.Repo", "persistence_entity:old.Order", "MAPS_TO") in edges and "persistence_entity:Order" not in nodes


def test_transfer_objects_of_signatures(shop):
    graph, nodes, edges = shop
    all_, one = "endpoint:GET:/all:all", "endpoint:POST:/one:one"
    assert {(s, t, k) for s, t, k in edges if k in ("ACCEPTS", "RETURNS")} == {
        (all_, "dto:web.OrderView", "RETURNS"), (one, "dto:web.OrderView", "RETURNS"), (one, "dto:web.Api.Command", "ACCEPTS"),
    }
    assert {t for s, t, k in edges if s == "dto:web.OrderView" and k == "MAPS_TO"} == {"persistence_entity:old.Order", "persistence_entity:now.Orders"}
    assert nodes["dto:web.OrderView"].type == "DATA_TRANSFER_OBJECT" and audit.dto_lineage(graph, "OrderView").count() > 0


def test_reader_ends_on_any_text_and_in_linear_time():
    words = "class interface enum record @ @interface { } ( ) [ ] < > ; , . = new for while do if a B c.d \"s\" 'x' -> :: import package static public throws".split()
    rnd = random.Random(2)
    began = time.time()
    for _ in range(4000):
        java.declarations(" ".join(rnd.choice(words) for _ in range(rnd.randrange(80))))
    assert java.declarations("class A { @interface { } }") is not None
    chain = java.declarations("class A { void f() { x" + ".b(1)" * 4000 + "; } }")
    assert len(chain[0]["calls"]) == 4000 and chain[0]["calls"][1]["scope"] == "x.b(1)"
    assert time.time() - began < 30


def test_locals_and_calls():
    (a,) = java.declarations("class A { void f(P p) { List<Order> os = all(); var z = new q.Foo(1); for (Line l : os) l.run(); int[] n = null; a.B c; x = 3; return y; } }")
    assert [(v["name"], v["type"]) for v in a["methods"][0]["locals"]] == [("os", "List<Order>"), ("z", "q.Foo"), ("l", "Line"), ("n", "int[]"), ("c", "a.B")]
    assert [c["text"] for c in a["calls"]] == ["all()", "l.run()"]
