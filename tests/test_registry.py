"""Resolvers that a user registers: a table function file by file, and a DataFrame function."""

import pytest
from pyspark.sql import functions as F

from graphlens.plans import analysis
from graphlens.resolvers import registry
from graphlens.resolvers.base import Facts, class_id, edges, nodes
from graphlens.sources import java

FILES = [
    ("a.java", "package a; @Audited class A { void f() {} void g() {} } class B {}"),
    ("b.java", "package b; @Audited @Service class C {}"),
]


@pytest.fixture
def audited():
    from graphlens.resolvers.registry import FileResolver, edge, node

    class Audited(FileResolver):
        def resolve(self, file, types):
            for t in types:
                if any(a["name"] == "Audited" for a in t["annotations"]):
                    yield node(file, f"audit:{t['fqn']}", t["fqn"], "COMPONENT", methods=str(len(t["methods"])), of=str(len(types)))
                    yield edge(file, f"class:{t['fqn']}", f"audit:{t['fqn']}", "ANNOTATED_WITH")

    registry.register("audited", Audited)
    yield Audited
    registry.unregister("audited")
    registry.unregister("packages")


def test_a_table_function_sees_each_file(spark, audited):
    types = java.types(spark.createDataFrame(FILES, "file string, text string").repartition(2))
    (found,) = registry.resolved(types, types)
    rows = {r.id: (r.name, r.type, r.metadata, r.source_file) for r in found.nodes.collect()}
    assert rows == {
        "audit:a.A": ("a.A", "COMPONENT", {"methods": "2", "of": "2"}, "a.java"),
        "audit:b.C": ("b.C", "COMPONENT", {"methods": "0", "of": "1"}, "b.java"),
    }
    assert {tuple(r) for r in found.edges.collect()} == {("class:a.A", "audit:a.A", "ANNOTATED_WITH"), ("class:b.C", "audit:b.C", "ANNOTATED_WITH")}
    # by its name in SQL, too
    types.createOrReplaceTempView("declared")
    assert spark.sql("SELECT * FROM audited(TABLE(declared))").where("part = 'node'").count() == 2


def test_added_resolvers_add_to_an_analysis(spark, audited):
    def packages(types, texts):
        rows = types.select("file", "fqn", "package")
        return Facts(
            nodes(rows, F.concat(F.lit("package:"), "package"), F.col("package"), "MODULE", 9), edges(rows, F.concat(F.lit("package:"), "package"), class_id(), "CONTAINS")
        )

    registry.register("packages", packages)
    assert registry.names() == ["audited", "packages"]
    graph = analysis.graph_of(analysis.facts_of(spark.createDataFrame(FILES, "file string, text string")))
    assert {"audit:a.A", "audit:b.C", "package:a", "package:b"} <= {r.id for r in graph.nodes.collect()}
    found = {tuple(r) for r in graph.edges.collect()}
    assert ("class:b.C", "audit:b.C", "ANNOTATED_WITH") in found and ("package:a", "class:a.B", "CONTAINS") in found
