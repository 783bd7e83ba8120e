"""From sources to the graph: declarations, beans and every resolver on small trees."""

import json
import struct

import pytest

from graphlens.operators import audit, health, traversal
from graphlens.plans import analysis
from graphlens.resolvers import beans, builds
from graphlens.sources import files, java

SHOP = {
    "src/web/OrderController.java": """package shop.web;
@RestController @RequestMapping("/api")
public class OrderController {
  private final OrderService orderService;
  @Value("${page.size:20}") private int size;
  @Value("${page.color}") private String color;
  public OrderController(OrderService orderService) { this.orderService = orderService; }
  @GetMapping("orders") @Operation(summary = "All orders", operationId = "all") public List<Order> all() { return orderService.findAll(); }
  @PostMapping(value = "/orders", produces = "application/json") @PreAuthorize("hasRole('ADMIN')") public void add() { orderService.save(null); }
}
""",
    "src/service/OrderService.java": """package shop.service;
/* a comment with class Fake { */
@Service @Slf4j
public class OrderService {
  @Autowired @Qualifier("main") private OrderRepository orderRepository;
  private final KafkaTemplate<String, Order> kafkaTemplate = null;
  private MeterRegistry registry;
  @Transactional public List<Order> findAll() { for (Order o : x) { orderRepository.findById(o.id); } return null; }
  public void save(Order o) { orderRepository.save(o); orderRepository.deleteAll(); kafkaTemplate.send("orders", o); Class.forName("x"); }
  @KafkaListener(topics = {"payments"}) public void on(String m) { Counter.builder("seen").register(registry); }
  @Timed("slow") public int slow() { return 1; }
}
""",
    "src/data/OrderRepository.java": 'package shop.data; @Repository("main") class OrderRepository implements Store { @NewSpan void save(Order o) {} }',
    "src/data/Orders.java": "package shop.data; public interface Orders extends JpaRepository<Order, Long> {}",
    "src/data/Order.java": """package shop.data;
@Entity @Table(name = "ORDERS") class Order { @Id Long id; @OneToMany private List<Line> lines; @Column(name = "gone") String gone; @Column(name = "id") Long same; }
""",
    "src/conf/Security.java": """package shop;
@Configuration class Security {
  @Bean SecurityFilterChain chain(HttpSecurity http) { http.csrf().disable(); http.authorizeHttpRequests(a -> a.requestMatchers("/x").hasRole("X")); return http.build(); }
  @Bean("sink") Consumer<String> sink() { return null; }
}
""",
    "src/remote/Bank.java": 'package shop; @FeignClient(name = "bank") interface Bank { }',
    "src/test/OrderServiceTest.java": "package shop.service; class OrderServiceTest { @InjectMocks OrderService s; @Mock OrderRepository r; }",
    "src/props/Page.java": 'package shop; @Component @ConfigurationProperties(prefix = "page") class Page implements HealthIndicator { int size; @Lazy Object o; }',
    "src/main/resources/application.properties": "page.size=50\n# x\nfeature=on\n",
    "src/main/resources/db/migration/V2__b.sql": 'alter table ORDERS add column note varchar(9);',
    "src/main/resources/db/migration/V1__a.sql": "CREATE TABLE orders (id INT PRIMARY KEY, total NUMERIC(9, 2));\ncreate table lines (id int, primary key (id));",
    "src/main/resources/db/changelog/c.xml": '<databaseChangeLog><createTable tableName="Audit"><column name="who" type="text"/></createTable></databaseChangeLog>',
    "openapi.yaml": "openapi: 3.0.0\npaths:\n  /api/orders:\n    post:\n      responses: {}\n",
    "pom.xml": "<project><groupId>g</groupId><artifactId>top</artifactId><modules><module>a</module><module>b</module></modules></project>",
    "a/pom.xml": "<project><artifactId>a</artifactId><dependencies><dependency><artifactId>b</artifactId></dependency></dependencies></project>",
    "b/pom.xml": "<project><parent><artifactId>top</artifactId><groupId>g</groupId></parent><artifactId>b</artifactId><version>2</version></project>",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, text in SHOP.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    graph = analysis.analyze(spark, str(root), by_simple_name=True, by_field_type=True)
    return graph, {r.id: r for r in graph.nodes.collect()}, {tuple(r) for r in graph.edges.collect()}


def test_reader_knows_nested_types_generics_and_loops():
    text = """package a.b; @Ann(x = {1, 2}, y = "q") public abstract class Foo<T extends Bar<T>> extends Base<T> implements I1, p.I2<String> {
      private final Map<String, List<Order>> m = new HashMap<>(), n[] = null; static { init(); }
      enum E { A(1) { void q() {} }, B; } record R(int a) { void z() { foo(); } }
      interface In { int two(int... xs); }
      <R> List<R> all(@P("id") final Long id) throws X { do { repo.find(id); } while (x < y); while (ok()) repo.save(a, b(1)); return list.stream().map(v -> v.get()).collect(to()); }
    } @interface Note { String value() default "x"; }"""
    found = {c["fqn"]: c for c in java.declarations(text)}
    assert set(found) == {"a.b.Foo", "a.b.Foo.E", "a.b.Foo.R", "a.b.Foo.In", "a.b.Note"} and found["a.b.Note"]["kind"] == "annotation"
    foo = found["a.b.Foo"]
    assert foo["extends"] == ["Base<T>"] and foo["implements"] == ["I1", "p.I2<String>"]
    assert [(f["name"], f["type"]) for f in foo["fields"]] == [("m", "Map<String, List<Order>>"), ("n", "Map<String, List<Order>>[]")]
    (method,) = foo["methods"]
    assert (method["type"], method["params"][0]["type"]) == ("List<R>", "Long")
    calls = {c["text"]: c for c in method["calls"]}
    assert calls["repo.find(id)"]["loops"][0]["type"] == "do-while" and calls["repo.save(a, b(1))"]["loops"][0]["type"] == "while"
    assert calls["repo.save(a, b(1))"]["args"] == ["a", "b(1)"]
    assert any(c["name"] == "collect" and c["scope"] == "list.stream().map(v->v.get())" for c in method["calls"])
    assert java.declarations(None) == [] and java.declarations("class {{{ ((") is not None


def test_beans_wiring_and_proxies(shop):
    _, nodes, edges = shop
    assert nodes["class:shop.service.OrderService"].type == "SERVICE" and nodes["class:shop.data.OrderRepository"].type == "REPOSITORY"
    assert nodes["class:shop.data.OrderRepository"].metadata["beanName"] == "main"
    assert ("class:shop.web.OrderController", "class:shop.service.OrderService", "INJECTS") in edges
    assert ("class:shop.service.OrderService", "class:shop.data.OrderRepository", "INJECTS") in edges
    assert ("class:shop.web.OrderController", "class:shop.service.OrderService", "CALLS") in edges
    proxy = nodes["proxy:shop.service.OrderService"]
    assert proxy.type == "PROXY" and proxy.metadata["PROXY_STEREOTYPE"] == "TRANSACTION_INTERCEPTOR"
    assert ("class:shop.web.OrderController", proxy.id, "CALLS") in edges and (proxy.id, "class:shop.service.OrderService", "CALLS") in edges


def test_web_security_and_contracts(shop):
    graph, nodes, edges = shop
    get, post = nodes["endpoint:GET:/api/orders:all"], nodes["endpoint:POST:/api/orders:add"]
    assert post.metadata["produces"] == "application/json" and post.metadata["hasOpenApiSpec"] == "true"
    assert get.metadata["operationSummary"] == "All orders" and get.metadata["hasOpenApiAnnotation"] == "true"
    rule = nodes["auth_rule:shop.web.OrderController.PreAuthorize"]
    assert rule.metadata["expression"] == "hasRole('ADMIN')" and (post.id, rule.id, "SECURED_BY") in edges
    chain = "security_filter_chain:shop.Security.chain"
    assert {t for s, t, k in edges if s == chain and k == "CONFIGURED_BY"} == {"security_flag:shop.Security.CSRF_DISABLED", "security_flag:shop.Security.AUTH_MATCHER_chain_0"}
    assert audit.auth_rules(graph).count() == 1 and audit.unsecured_endpoints(graph).count() == 0


def test_data_schema_messages_and_configuration(shop):
    graph, nodes, edges = shop
    assert nodes["data_repo:shop.data.Orders"].metadata["technology"] == "jpa" and ("data_repo:shop.data.Orders", "persistence_entity:Order", "MAPS_TO") in edges
    assert ("persistence_entity:shop.data.Order", "persistence_entity:Line", "HAS_MANY") in edges
    assert {n for n in nodes if n.startswith("schema_")} == {
        "schema_migration:1", "schema_migration:2", "schema_migration:c", "schema_table:orders", "schema_table:lines", "schema_table:audit",
        "schema_column:orders.id", "schema_column:orders.total", "schema_column:orders.note", "schema_column:lines.id", "schema_column:audit.who",
    }
    assert ("persistence_entity:shop.data.Order", "schema_table:orders", "SCHEMA_MAPS_TO") in edges
    assert ("class:shop.service.OrderService", "message_topic:orders", "PUBLISHES_TO") in edges
    assert ("message_topic:payments", "class:shop.service.OrderService", "SUBSCRIBES_FROM") in edges
    assert nodes["config_key:page.size"].metadata["hasDefault"] == "true" and nodes["config_key:page.color"].metadata["hasDefault"] == "false"
    assert ("config_key:page.size", "config_value:page.size", "RESOLVES_TO") in edges
    assert [r.name for r in audit.undefined_properties(graph).orderBy("name").collect()] == ["page.color", "page.o"]
    assert nodes["config_properties:shop.Page"].type == "CONFIG_PROPERTIES"


def test_remote_tests_observability_performance_native_modules(shop):
    _, nodes, edges = shop
    assert ("feign_client:shop.Bank", "external_service:bank", "CALLS_REMOTE") in edges
    test = "test:shop.service.OrderServiceTest"
    assert (test, "class:shop.data.OrderRepository", "MOCKS") in edges
    service = nodes["class:shop.service.OrderService"].metadata
    assert service["hasStructuredLogging"] == "true" and service["instrumented"] == "true" and service["usesReflection"] == "true"
    assert {t for s, t, k in edges if k == "MEASURES"} == {"metric:seen", "metric:slow"}
    assert ("class:shop.data.OrderRepository", "trace_span:shop.data.OrderRepository.save", "TRACES") in edges
    assert ("class:shop.Page", "health_indicator:shop.Page", "IMPLEMENTS") in edges
    issues = {n for n in nodes if n.startswith("perf:")}
    assert {"perf:n_plus_one:shop.service.OrderService.findAll", "perf:missing_transaction:shop.service.OrderService.save", "perf:fetch_strategy:shop.data.Order.lines"} <= issues
    assert {n for n in nodes if n.startswith("compat_issue:")} == {"compat_issue:reflection:shop.service.OrderService", "compat_issue:lazy:shop.Page"}
    assert ("module:a", "module:b", "DEPENDS_ON") in edges and nodes["module:b"].metadata["version"] == "2" and "module:top" not in nodes


def test_plain_reading_of_a_small_application(spark, tmp_path):
    """Literal mode: calls lead to what they are made on, and simple type names resolve to nothing."""
    texts = {
        "AController": 'package t; @RestController class AController { AController(AService s) {} @GetMapping("/a") int a() { return aService.all(); } }',
        "AService": "package t; @Service class AService { @Transactional int all() { return aRepository.all(); } }",
        "ARepository": "package t; @Repository class ARepository { int all() { return store.size(); } }",
        "A": "package t; class A { long id; }",
    }
    (tmp_path / "main").mkdir()
    for name, text in texts.items():
        (tmp_path / "main" / f"{name}.java").write_text(text)
    files_ = files.text_files(spark, str(tmp_path / "main"), "*.java")
    # the path of a temporary folder holds `test`, so every class would be a test
    rows = [(f"/main/{r.file.rsplit('/', 1)[1]}", r.text) for r in files_.collect()]
    graph = analysis.graph_of(analysis.facts_of(spark.createDataFrame(rows, "file string, text string")))
    assert {r.id for r in graph.nodes.collect()} == {"class:t.AController", "class:t.AService", "class:t.ARepository", "proxy:aService", "endpoint:GET:/a:a"}
    assert {tuple(r) for r in graph.edges.collect()} == {
        ("class:t.AController", "class:aService", "CALLS"), ("class:t.AService", "class:aRepository", "CALLS"), ("class:t.ARepository", "class:store", "CALLS"),
        ("class:t.AController", "proxy:aService", "CALLS"), ("proxy:aService", "class:aService", "CALLS"), ("endpoint:GET:/a:a", "class:t.AController", "ROUTES_TO"),
    }
    scores = {r.dimension: r.score for r in health.health(graph).collect()}
    assert scores == {
        "DEPENDENCY_HEALTH": 100, "SECURITY_HEALTH": 85, "RESILIENCE_HEALTH": 100, "TEST_HEALTH": 90, "OBSERVABILITY_HEALTH": 74, "CONTRACT_HEALTH": 90,
        "ARCHITECTURE_RULES_HEALTH": 100, "OVERALL": 91,
    }
    report = json.loads(health.gate(graph).first().report)
    assert report["overallScore"] == 91 and report["nodeCount"] == 5 and report["recommendations"] == ["IMPROVE: OBSERVABILITY_HEALTH score is 74 — address 4 issues"]
    assert {r.level for r in health.issues(graph).where("reason = 'unsecured endpoint'").collect()} == {"HIGH"}


def test_scan_profiles_and_conditions(spark):
    text = """package app; @SpringBootApplication @ComponentScan(basePackages = {"lib.core"}, excludeFilters = @Filter(classes = {lib.core.Bad.class})) class App {}
    @Service @Profile("prod") class Paid {} @Service @ConditionalOnProperty(name = "on", havingValue = "yes") class Yes {}
    @Service @ConditionalOnProperty(name = "off") class Off {} @Primary @Component class Main implements Port {} @Component class Side implements Port {}"""
    rows = [("a.java", text), ("b.java", "package lib.core.x; @Service class In {}"), ("c.java", "package lib.corex; @Service class Out {}"), ("d.java", "package lib.core; @Service class Bad {}")]
    classes = java.classes(spark.createDataFrame(rows, "file string, text string"))
    props = spark.createDataFrame([("on", "YES"), ("off", "false")], "key string, value string")
    found = beans.beans(classes, props, profiles=("dev",))
    assert {r.qualified_name for r in found.collect()} == {"app.App", "app.Yes", "app.Main", "app.Side", "lib.core.x.In"}
    assert "app.Paid" in {r.qualified_name for r in beans.beans(classes, props, profiles=("prod",)).collect()}
    wanted = spark.createDataFrame([("x", "Port", None), ("x", "Port", "side"), ("x", "None", None)], "source_id string, wanted string, qualifier string")
    assert {r.target for r in beans.resolved(wanted, found).collect()} == {"app.Main", "app.Side"}


def test_class_files_commits_and_fingerprints(spark, tmp_path):
    def utf(x):
        return b"\x01" + struct.pack(">H", len(x)) + x.encode()

    pool = utf("app/Svc$$SpringCGLIB$$0") + b"\x07\x00\x01" + utf("app/Svc") + b"\x07\x00\x03" + utf("app/Face") + b"\x07\x00\x05"
    head = b"\xca\xfe\xba\xbe\x00\x00\x00\x3d" + struct.pack(">H", 7) + pool + struct.pack(">HHHH", 0x21, 2, 4, 1) + struct.pack(">H", 6)
    (tmp_path / "c").mkdir()
    (tmp_path / "c/A.class").write_bytes(head)
    (tmp_path / "c/B.class").write_bytes(b"not a class")
    found = builds.generated_proxies(builds.class_files(spark, str(tmp_path / "c")))
    assert {tuple(r) for r in found.edges.collect()} == {("proxy:app.Svc$$SpringCGLIB$$0", "class:app.Svc", "CALLS")}
    log = f"commit {'a' * 40}\ntree x\nauthor Al <al@x> 1700000000 +0000\ngpgsig -----BEGIN SSH SIGNATURE-----\n KEY1\n -----END SSH SIGNATURE-----\n\n    first line\n    more\n\ncommit {'b' * 40}\nauthor Bo <bo@x> 1700000001 +0000\n\n    second\n"
    commits = builds.commits(builds.commit_log(spark.createDataFrame([(log,)], "text string")))
    rows = {r.hash[0]: r for r in commits.collect()}
    assert (rows["a"].signature, rows["a"].key, rows["a"].message, rows["b"].signature) == ("SSH", "KEY1", "first line", None)
    assert [r.violation for r in audit.provenance(commits).collect()] == ["MISSING_SIGNATURE"]
    assert {r.violation for r in audit.provenance(commits, ("KEY2",)).collect()} == {"MISSING_SIGNATURE", "UNAUTHORIZED_KEY"}
    assert audit.provenance_summary(audit.provenance(commits.where("signature = 'SSH'"))).first().compliant
    first = files.fingerprints(spark, str(tmp_path / "c"))
    files.persist_fingerprints(first, str(tmp_path / "prints"))
    (tmp_path / "c/C.txt").write_text("new")
    again = files.fingerprints(spark, str(tmp_path / "c"), before=spark.read.parquet(str(tmp_path / "prints")))
    assert {r.path.rsplit("/", 1)[1]: len(r.sha256) for r in again.collect()} == {"A.class": 64, "B.class": 64, "C.txt": 64}


def test_cycles_of_any_length(spark):
    from graphlens import model

    ring = [(f"n{i}", f"n{(i + 1) % 7}", "INJECTS") for i in range(7)]
    edges = [*ring, ("n3", "out", "INJECTS"), ("in", "n0", "INJECTS"), ("a", "b", "INJECTS"), ("b", "a", "INJECTS"), ("b", "n1", "INJECTS"), ("z", "z", "INJECTS")]
    graph = model.Graph(spark.createDataFrame([(f"n{i}", f"n{i}", "SERVICE", {}) for i in range(7)], model.NODE), spark.createDataFrame(edges, model.EDGE))
    found = {(r.id, r.component) for r in traversal.on_cycles(graph).collect()}
    assert found == {*((f"n{i}", "n0") for i in range(7)), ("a", "a"), ("b", "a"), ("z", "z")}
    reasons = [r.reason for r in health.issues(graph).where("dimension = 'DEPENDENCY_HEALTH'").collect()]
    assert sorted(reasons) == ["dependency cycle", "dependency cycle", "long dependency cycle"]
    assert traversal.on_cycles(graph, "CALLS").count() == 0
