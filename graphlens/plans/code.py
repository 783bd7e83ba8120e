"""Source files written from the relational tables, and the graph that the resolvers make of them.

Suppliers become services with repositories, entities, controllers, tests and migrations; nations become
packages, modules, clients and property classes; regions become interfaces and security configurations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.model import Graph
from graphlens.plans import analysis
from graphlens.resolvers.base import unite
from graphlens.storage import settle

#: Files of a supplier {s} of a nation {n} in a region {r}: path and text. {primary} is the mark of each third one.
SUPPLIER = {
    "/src/main/n{n}/S{s}.java": """package n{n};
import r{r}.Port;
@Service @Slf4j {primary}
public class S{s} implements Port {
  @Autowired private S{s}Repo itemRepo;
  private KafkaTemplate<String, String> kafka;
  @Value("${app.n{n}}") private String key;
  @Transactional public void run() { for (int i = 0; i < 9; i++) { itemRepo.findOne(i); } }
  @KafkaListener(topics = "in{n}") public void on(String m) { Class.forName(m); kafka.send("out{n}", m); }
  @Timed("metric{s}") @NewSpan("span{s}") public void timed() {}
}
""",
    "/src/main/n{n}/S{s}Repo.java": "package n{n};\n@Repository public class S{s}Repo {}\ninterface D{s} extends JpaRepository<E{s}, Long> {}\n",
    "/src/main/n{n}/E{s}.java": 'package n{n};\n@Entity @Table(name = "t{s}") public class E{s} {\n  @Id Long id;\n  @ManyToOne E{s} up;\n  @OneToMany List<E{s}> many;\n}\n',
    "/src/main/web/C{s}.java": """package web;
import n{n}.*;
@RestController @RequestMapping("/s{s}")
class C{s} {
  private final S{s} svc;
  C{s}(S{s} svc) {}
  @GetMapping("/get") @Operation(summary = "get {s}") E{s} get{s}() { return svc.load(); }
  @PostMapping("/put") @PreAuthorize("hasRole('A')") void put{s}(E{s} body) { svc.save(body); }
}
""",
    "/src/test/n{n}/S{s}Test.java": "package n{n};\nclass S{s}Test { @InjectMocks S{s} tested; @Mock S{s}Repo mocked; }\n",
    "/src/main/resources/db/migration/V{s}__x.sql": "create table t{s} (id int, c{s} int);\n",
}
NATION = {
    "/src/main/conf/F{n}.java": 'package conf;\n@Component @FeignClient(name = "x{n}") interface F{n} {}\n',
    "/src/main/conf/P{n}.java": 'package conf;\n@ConfigurationProperties(prefix = "pre{n}") class P{n} { int size; }\n',
    "/src/main/conf/N{n}.java": "package conf;\nimport r{r}.Port;\n@Component class N{n} { N{n}(Port port) {} }\n",
    "/m{n}/pom.xml": "<project><groupId>g</groupId><artifactId>m{n}</artifactId><dependencies><dependency><artifactId>m{r}</artifactId></dependency></dependencies></project>\n",
}
REGION = {
    "/src/main/r{r}/Port.java": "package r{r};\npublic interface Port {}\n",
    "/src/main/conf/Sec{r}.java": "package conf;\nclass Sec{r} { SecurityFilterChain chain(HttpSecurity http) { http.csrf().disable(); return http.build(); } }\n",
}


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def _files(rows: DataFrame, templates: dict[str, str], **values: Column) -> DataFrame:
    each = F.array(*(F.struct(_filled(p, **values).alias("file"), _filled(t, **values).alias("text")) for p, t in templates.items()))
    return rows.select(F.inline(each))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of all suppliers, nations and regions."""
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    s, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("n_regionkey")
    rows = supplier.join(nation, F.col("s_nationkey") == n)
    lines = F.when(n % 3 != 0, F.format_string("app.n%s=v%s", n.cast("string"), n.cast("string")))
    # one row: a line for each nation
    values = nation.agg(F.array_join(F.array_sort(F.collect_list(lines)), "\n").alias("text"))
    modules = nation.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("<module>m%s</module>", n.cast("string")))), "").alias("m"))
    top = F.concat(F.lit("<project><groupId>g</groupId><artifactId>top</artifactId><modules>"), "m", F.lit("</modules></project>"))
    return unite(
        _files(rows, SUPPLIER, s=s, n=n, r=r, primary=F.when(s % 3 == 0, "@Primary").otherwise("")),
        _files(nation, NATION, n=n, r=r),
        _files(region, REGION, r=F.col("r_regionkey")),
        values.select(F.lit("/src/main/resources/application.properties").alias("file"), "text"),
        modules.select(F.lit("/pom.xml").alias("file"), top.alias("text")),
    )


@lru_cache(maxsize=8)
def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of these files, by imports, in the shared folder: once a session and folder."""
    return analysis.graph_of(analysis.facts_of(settle(files(spark, sf_dir), "code"), by_import=True))


#: What each resolver gives: types of nodes and of edges, and a prefix of the nodes' or sources' ids where others give such, too.
PARTS = {
    "code_beans": (("SERVICE", "REPOSITORY", "CONTROLLER", "COMPONENT", "INTERFACE", "CLASS"), (), "class:"),
    "code_injections": ((), ("INJECTS",), "class:"),
    "code_calls": (("PROXY",), ("CALLS",), ""),
    "code_endpoints": (("CONTROLLER_ENDPOINT",), ("ROUTES_TO",), "endpoint:"),
    "code_security": (("AUTH_RULE", "SECURITY_FILTER_CHAIN", "SECURITY_FLAG"), ("SECURED_BY", "CONFIGURED_BY"), ""),
    "code_persistence": (("DATA_REPOSITORY", "PERSISTENCE_ENTITY"), ("HAS_MANY", "BELONGS_TO"), ""),
    "code_messaging": (("MESSAGE_TOPIC", "MESSAGE_PRODUCER", "MESSAGE_CONSUMER"), ("PUBLISHES_TO", "SUBSCRIBES_FROM"), ""),
    "code_configuration": (("CONFIG_PROPERTIES", "CONFIG_KEY", "CONFIG_VALUE"), ("USES_CONFIG", "RESOLVES_TO"), ""),
    "code_remote_calls": (("EXTERNAL_SERVICE", "FEIGN_CLIENT"), ("CALLS_REMOTE",), ""),
    "code_tests": (("TEST",), ("TESTS", "MOCKS"), ""),
    "code_observability": (("METRIC", "TRACE_SPAN"), ("MEASURES", "TRACES"), ""),
    "code_performance": (("PERFORMANCE_ISSUE", "PERFORMANCE_HINT"), ("PERFORMANCE_RISK",), ""),
    "code_schema": (("SCHEMA_MIGRATION", "SCHEMA_TABLE", "SCHEMA_COLUMN"), ("SCHEMA_MAPS_TO",), ""),
    "code_contains": ((), ("CONTAINS",), ""),
    "code_native": (("COMPATIBILITY_ISSUE",), ("COMPATIBILITY_RISK",), ""),
    "code_transfers": (("DATA_TRANSFER_OBJECT",), ("ACCEPTS", "RETURNS", "MAPS_TO"), ""),
    "code_modules": (("MODULE",), ("DEPENDS_ON",), ""),
}


def part(found: Graph, node_types: tuple[str, ...], edge_types: tuple[str, ...], prefix: str) -> DataFrame:
    """(part, a, b, type): nodes by id and name, edges by their ends."""
    nodes = found.of(*node_types).where(F.col("id").startswith(prefix)).select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), "type")
    edges = found.links(*edge_types).where(F.col("source_id").startswith(prefix)) if edge_types else found.edges.where("false")
    return nodes.unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "type"))


def notes(found: Graph) -> DataFrame:
    """(id, key, value): what resolvers note on services and endpoints beside their own nodes."""
    keys = ("beanName", "PRIMARY", "hasStructuredLogging", "instrumented", "usesReflection", "operationSummary", "hasOpenApiAnnotation", "PROXY_STEREOTYPE")
    rows = found.nodes.select("id", F.explode("metadata").alias("key", "value"))
    return rows.where(F.col("key").isin(*keys))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, sf_dir), one for each resolver."""
    out = {k: (lambda spark, sf_dir, p=p: part(graph(spark, sf_dir), *p)) for k, p in PARTS.items()}
    return out | {"code_notes": lambda spark, sf_dir: notes(graph(spark, sf_dir))}


