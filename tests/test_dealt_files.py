"""Reading declarations is spread over tasks."""

import pytest

from graphlens.plans import analysis
from graphlens.sources import java


def test_declarations_are_read_by_as_many_tasks_as_a_shuffle_has(spark, monkeypatch):
    seen = []

    def types(files):
        seen.append(files.rdd.glom().map(len).collect())
        raise StopIteration

    monkeypatch.setattr(java, "types", types)
    files = spark.createDataFrame([(f"/S{n}.java", f"class S{n} {{}}") for n in range(200)], "file string, text string").coalesce(1)
    with pytest.raises(StopIteration):
        analysis.facts_of(files)
    assert len(seen[0]) == 8 and sum(seen[0]) == 200 and min(seen[0]) > 0


def test_declarations_are_read_once(spark):
    files = spark.createDataFrame([("/S.java", "class S {}")], "file string, text string").repartition(3, "file")
    rows = java.types(files)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("_declared(") == 1
    assert [r.name for r in rows.collect()] == ["S"]
