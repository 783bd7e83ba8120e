import pytest

from graphlens import model
from graphlens.operators import audit, diff, health, search, traversal
from graphlens.plans import analysis
from graphlens.sources import files, graph_files
from graphlens.streaming import refresh

CONTROLLER = """package shop;
/* class Fake */
@RestController
public class OrderController {
    private int count;
    private final Map<String, Long> fixed = null;
    private HashMap<String, Long> cache;
    private volatile Random dice;
    public OrderController(OrderService orders) {}
    @GetMapping("/api/orders") public String all() { return ""; }
    @PostMapping("/api/orders") public void add() {}
}
"""
SERVICE = "package shop;\n@Service @Transactional\npublic class OrderService {\n  @Autowired private OrderRepository repo;\n}\n"
REPO = "package shop;\n@Repository\npublic class OrderRepository {}\n"


def graph(spark, nodes, edges):
    rows = [(i, i, t, m) for i, t, m in nodes]
    return model.Graph(spark.createDataFrame(rows, model.NODE), spark.createDataFrame(edges, model.EDGE))


def test_fold_keeps_first_head_and_last_values(spark):
    facts = spark.createDataFrame(
        [("a", "A", "CLASS", {"k": "1", "x": "y"}, None, 1), ("a", "B", "SERVICE", {"k": "2"}, None, 2), ("b", None, "TEST", {}, "f", 3)],
        model.FACT,
    )
    out = {r.id: r for r in model.fold_nodes(facts).collect()}
    assert (out["a"].name, out["a"].type, out["a"].metadata) == ("A", "CLASS", {"k": "2", "x": "y"})
    assert out["b"].metadata == {} and model.node_labels(facts).count() == 3


def test_cycles_bfs_and_dangling(spark):
    g = graph(
        spark,
        [(x, "SERVICE", {}) for x in "abcd"],
        [("a", "b", "INJECTS"), ("b", "a", "INJECTS"), ("c", "c", "INJECTS"), ("b", "c", "INJECTS"), ("c", "a", "INJECTS"), ("d", "gone", "CALLS"), ("gone", "a", "CALLS")],
    )
    assert {r.path for r in traversal.cycles(g).collect()} == {"a -> b -> a", "c -> c", "a -> b -> c -> a"}
    far = traversal.reach(g.edges, spark.createDataFrame([("d",)], "id string"), 2, both_ways=True)
    assert {(r.id, r.depth) for r in far.collect()} == {("d", 0), ("gone", 1), ("a", 2)}
    assert {r.id for r in traversal.blast_radius(g, "d", 1).collect()} >= {"a", "b", "c"}


def test_health_of_an_empty_and_a_clean_graph(spark):
    g = graph(spark, [("x", "COMPONENT", {}), ("t", "TEST", {})], [("t", "x", "TESTS")])
    scores = {r.dimension: (r.score, r.note) for r in health.health(g).collect()}
    assert scores["OVERALL"] == (100, "A") and len(scores) == 8
    with pytest.raises(ValueError, match="unknown type"):
        health.add_rule(health.standard_rules(spark), "X", "ERROR", "NOPE", "SERVICE", "SERVICE")


def test_diff_is_the_inverse_backwards(spark):
    a = graph(spark, [("x", "CLASS", {"k": "1"}), ("y", "CLASS", {})], [("x", "y", "CALLS")])
    b = graph(spark, [("x", "CLASS", {"k": "2"}), ("y", "CLASS", {}), ("z", "CLASS", {})], [("y", "z", "CALLS"), ("x", "y", "CALLS")])
    there = {(r.change, r.id) for r in diff.diff(a, b).collect()}
    assert there == {("node_changed", "x"), ("node_added", "z"), ("edge_added", "y|CALLS|z"), ("impacted", "y")}
    back = {(r.change, r.id) for r in diff.diff(b, a).collect()}
    assert ("node_removed", "z") in back and ("edge_removed", "y|CALLS|z") in back


def test_java_sources_to_graph_and_audits(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in (("OrderController", CONTROLLER), ("OrderService", SERVICE), ("OrderRepository", REPO)):
        (tmp_path / "src" / f"{name}.java").write_text(text)
    found = files.text_files(spark, str(tmp_path / "src"), "*.java")
    g = analysis.analyze(spark, str(tmp_path / "src"), by_simple_name=True)
    assert {(r.id, r.type) for r in g.nodes.where("type <> 'TEST'").collect()} == {
        ("class:shop.OrderController", "CONTROLLER"), ("class:shop.OrderService", "SERVICE"), ("class:shop.OrderRepository", "REPOSITORY"),
        ("endpoint:GET:/api/orders:all", "CONTROLLER_ENDPOINT"), ("endpoint:POST:/api/orders:add", "CONTROLLER_ENDPOINT"),
    }
    assert {(r.source_id, r.target_id) for r in g.links("INJECTS").collect()} == {
        ("class:shop.OrderController", "class:shop.OrderService"), ("class:shop.OrderService", "class:shop.OrderRepository")}
    assert audit.by_annotation(g, "@Transactional").count() == 1 and audit.unsecured_endpoints(g).count() == 2
    risky = audit.thread_safety(found, audit.singletons(g)).collect()
    assert {(r.field_type, r.severity) for r in risky} == {("int", "LOW"), ("HashMap", "HIGH"), ("Random", "MEDIUM")}
    assert files.fingerprints(spark, str(tmp_path / "src")).count() == 3


def test_properties_exports_snapshots(spark, tmp_path):
    props = files.properties(spark.createDataFrame([("a", "# c\nx = 1\ny: 2\nx=3")], "file string, text string"))
    assert {(r.key, r.value) for r in props.collect()} == {("x", "3"), ("y", "2")}
    odd = graph(spark, [("a'\"<&", "CLASS", {"k": "v"}), ("b", "TEST", {})], [("a'\"<&", "b", "CALLS")])
    lines = {f: graph_files.export(odd, f).orderBy("part", "value").collect()[1].value for f in ("json", "cypher", "graphml", "dot")}
    assert "\\'" in lines["cypher"] and "&lt;&amp;" in lines["graphml"] and '\\"' in lines["dot"]
    with pytest.raises(ValueError, match="unknown format"):
        graph_files.export(odd, "mermaid")
    graph_files.write_json(odd, str(tmp_path / "graph"))
    back = graph_files.read_json(spark, str(tmp_path / "graph"))
    assert diff.diff(odd, back).count() == 0 and back.edges.count() == 1
    assert graph_files.read_json(spark, str(tmp_path / "none")).nodes.count() == 0
    diff.take_snapshot(odd, str(tmp_path / "snaps"), "one")
    assert diff.diff(odd, diff.read_snapshot(spark, str(tmp_path / "snaps"), "one")).count() == 0
    assert [r.label for r in diff.list_snapshots(spark, str(tmp_path / "snaps")).collect()] == ["one"]


def test_search_boosts_fuzzy_rules_and_removal(spark):
    g = graph(spark, [("orders", "SERVICE", {"sourceFile": "a"}), ("x", "ORDERS", {}), ("y", "TEST", {"k": "orders orders"})], [("orders", "x", "CALLS"), ("x", "y", "CALLS")])
    assert [r.id for r in search.search(g, "orders", weights=search.BOOSTED).collect()][0] == "x"
    assert search.search(g, "ordrs").count() == 0 and search.search(g, "ordrs", fuzzy=1).count() == 3
    assert [r.id for r in search.nodes_of_type(g, "TEST", 5).collect()] == ["y"] and search.edges_of_type(g, "CALLS", 1).count() == 1
    rules = health.remove_rule(health.add_rule(health.standard_rules(spark), "OWN", "WARNING", "CALLS", "SERVICE", "TEST"), "ARCH-001")
    assert [r.rule_id for r in health.list_rules(rules).collect()] == ["ARCH-002", "ARCH-003", "ARCH-004", "ARCH-005", "OWN"]
    left = model.remove_file(g, spark.createDataFrame([("a",)], "source_file string"))
    assert {r.id for r in left.nodes.collect()} == {"x", "y"} and left.edges.count() == 1
    assert audit.lookup(g, "x").count() == 1 and audit.websocket()["protocol"] == "STOMP"


def test_walks_have_no_longest_length(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}", "CALLS") for i in range(40)]
    g = graph(spark, [(f"n{i:03}", "SERVICE", {}) for i in range(41)], chain)
    start = spark.createDataFrame([("n000",)], "id string")
    assert traversal.reach(g.edges, start, None).agg({"depth": "max"}).first()[0] == 40


def test_streaming_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id":"a","name":"A","type":"CLASS","metadata":{"k":"1"},"seq":1}\n{"id":"a","name":"B","type":"TEST","metadata":{"k":"2"},"seq":2}')
    query = refresh.append_facts(refresh.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "cp"))
    query.awaitTermination()
    row = refresh.current_nodes(spark, str(tmp_path / "facts")).first()
    assert (row.name, row.type, row.metadata) == ("A", "CLASS", {"k": "2"})
    refresh.topics(refresh.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "topics"), str(tmp_path / "cp2")).awaitTermination()
    sent = spark.read.text(str(tmp_path / "topics"))
    assert {(r.topic, r.n) for r in sent.groupBy("topic").agg({"*": "count"}).toDF("topic", "n").collect()} == {("graph-updates", 2), ("analysis-progress", 2)}


def test_backlog_and_request_flow_are_whole(spark):
    chain = [f"n{i}" for i in range(25)]
    start = ("e", "CONTROLLER_ENDPOINT", {"httpVerb": "GET", "path": "/x"})
    edges = [("e", "n0", "ROUTES_TO"), *((a, b, "CALLS") for a, b in zip(chain, chain[1:], strict=False))]
    g = graph(spark, [start, *((x, "SERVICE", {}) for x in chain)], edges)
    assert {r.id for r in traversal.request_flow(g, "get", "/x").collect()} == {"e", *chain}
    small = graph(spark, [("x", "SERVICE", {}), ("y", "SERVICE", {})], [("x", "y", "INJECTS"), ("y", "x", "INJECTS")])
    assert {"dependency cycle", "untested", "not instrumented"} <= {r.reason for r in health.backlog(small).collect()}


def test_documents_can_be_loaded(spark, tmp_path):
    import glob
    import xml.etree.ElementTree as ET

    g = graph(spark, [(f'n{i}"<&', "SERVICE", {}) for i in range(40)], [('n1"<&', 'n2"<&', "CALLS"), ('n2"<&', "gone", "CALLS")])

    def whole(form):
        graph_files.write_document(g, form, str(tmp_path / form))
        return "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/{form}/part-*.txt")))

    space = "{http://graphml.graphdrawing.org/xmlns}"
    (found,) = ET.fromstring(whole("graphml")).findall(f"{space}graph")
    assert sorted(n.get("id") for n in found.findall(f"{space}node")) == sorted(f'n{i}"<&' for i in range(40))
    assert [(e.get("source"), e.get("target")) for e in found.findall(f"{space}edge")] == [('n1"<&', 'n2"<&'), ('n2"<&', "gone")]
    lines = whole("dot").splitlines()
    assert lines[0] == "digraph architecture {" and lines[-1] == "}" and len(lines) == 45 and all(x.endswith(";") for x in lines[1:-1])
    assert whole("cypher").count("CREATE (:SERVICE") == 40


def test_a_hop_shuffles_its_front_only(spark, monkeypatch):
    g = graph(spark, [], [(f"n{i}", f"n{i + 1}", "CALLS") for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    settle = traversal.settle
    monkeypatch.setattr(traversal, "settle", lambda df, name, by=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, name, by))
    try:
        found = traversal.reach(g.edges, spark.createDataFrame([("n0",)], "id string"), 3)
        assert {(r.id, r.depth) for r in found.collect()} == {("n0", 0), ("n1", 1), ("n2", 2), ("n3", 3)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hop = plans[1]
    # the table of steps is scanned by buckets, with no exchange between scan and join
    at = next(n for n, line in enumerate(hop.splitlines()) if "steps_" in line or "from_id" in line and "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = hop.splitlines()
    above, now = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < now:
            above.append(line)
            now = depth(line)
    assert "Bucketed: true" in lines[at]
    join = next(n for n, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:join])
