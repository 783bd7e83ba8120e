"""A refreshed project equals a new one, and only changed files are parsed."""

from graphlens.functions import meta
from graphlens.plans import incremental
from graphlens.sources import java

FILES = {
    "a/Port.java": "package a; public interface Port {}",
    "a/Main.java": "package a; @Service class Main implements Port { @Transactional void go() { other.run(); } }",
    "b/Web.java": 'package b; import a.Port; @RestController class Web { Web(Port p) {} Port p; @GetMapping("/x") String x() { return p.go(); } }',
    "b/Old.java": "package b; @Component class Old { @Autowired Gone gone; }",
    "src/main/resources/application.properties": "page.size=3\n",
    "b/Cfg.java": 'package b; @Component class Cfg { @Value("${page.size}") int n; @Value("${page.other}") int m; }',
    "db/V1__a.sql": "create table orders (id int);",
}
#: One file added, so that an injection moves, one changed, two deleted, of which one holds all of its types, and new properties.
STEP = {
    "a/Side.java": "package a; @Primary @Service class Side implements Port { void go() {} }",
    "b/Web.java": 'package b; import a.*; @RestController class Web { Web(Port p) {} Port p; @PostMapping("/y") @PreAuthorize("x") String y() { return p.go(); } }',
    "a/Main.java": None, "db/V1__a.sql": None,
    "src/main/resources/application.properties": "page.size=3\npage.other=4\n",
    "b/Gone.java": "package b; @Service class Gone {}",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, text string")


def content(graph):
    nodes = {(r.id, r.name, r.type, r.m) for r in graph.nodes.select("id", "name", "type", meta.canonical().alias("m")).collect()}
    return nodes, {tuple(r) for r in graph.edges.select("source_id", "target_id", "type").collect()}


def test_refreshed_equals_new(spark, monkeypatch):
    parsed = []
    types = java.types
    monkeypatch.setattr(java, "types", lambda files: parsed.extend(r.file for r in files.select("file").collect()) or types(files))
    project = incremental.open_project(frame(spark, FILES), by_import=True)
    assert sorted(parsed) == sorted(FILES)
    parsed.clear()
    same, changes = incremental.refresh(project, frame(spark, FILES))
    assert same is project and changes.count() == 0 and not parsed
    files = {k: v for k, v in (FILES | STEP).items() if v is not None}
    after, changes = incremental.refresh(project, frame(spark, files))
    assert sorted(parsed) == sorted(k for k, v in STEP.items() if v is not None)
    assert {r.file for r in changes.where("change <> 'dependent'").collect()} == set(STEP)
    assert len(after.nodes.layers) == len(after.edges.layers) == 2
    new = incremental.open_project(frame(spark, files), by_import=True)
    assert content(after.graph) == content(new.graph) != content(project.graph)
    edges = content(after.graph)[1]
    assert ("class:b.Web", "class:a.Side", "INJECTS") in edges and ("config_key:page.other", "config_value:page.other", "RESOLVES_TO") in edges


def test_dependent_files_are_those_whose_names_lead_to_changed_ones(spark):
    types = java.types(frame(spark, FILES))
    assert {tuple(r) for r in incremental.uses(types).collect()} == {("a/Main.java", "a/Port.java"), ("b/Web.java", "a/Port.java")}


def test_layers(spark, monkeypatch):
    rows = lambda **kinds: spark.createDataFrame([(i, k) for k, ids in kinds.items() for i in ids], "id string, type string")
    table = lambda x: {tuple(r) for r in x.table().collect()}
    first = incremental._written(incremental.Layers(), rows(A="ab", B="c"), None, "t")
    second = incremental._written(first, rows(A="xy"), ["A", "B"], "t")
    assert table(first) == {("a", "A"), ("b", "A"), ("c", "B")} and table(second) == {("x", "A"), ("y", "A")} and len(second.layers) == 2
    third = incremental._written(second, rows(C="z", A="xy"), ["C"], "t")
    assert table(third) == {("x", "A"), ("y", "A"), ("z", "C")}
    assert incremental._written(third, rows(), [], "t") is third
    monkeypatch.setattr(incremental, "LAYERS", 3)
    merged = incremental._written(third, rows(C="z"), ["A"], "t")
    assert len(merged.layers) == 1 and table(merged) == {("z", "C")}
