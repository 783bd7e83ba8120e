"""Graph files: JSON in and out, Cypher, GraphML and DOT out, one text line per node or edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.model import EDGE, NODE, Graph


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph file of {nodes: [...], edges: [...]}; an empty graph where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    schema = f"nodes array<struct<{_fields(NODE)}>>, edges array<struct<sourceId:string,targetId:string,type:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    nodes = whole.select(F.inline("nodes"))
    edges = whole.select(F.inline("edges")).toDF(*(c.split()[0] for c in EDGE.split(", ")))
    return Graph(nodes, edges)


def _fields(ddl: str) -> str:
    return ",".join(":".join(x.split(" ", 1)) for x in ddl.split(", "))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _quoted(c: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(mark), F.lit("\\" + mark)), F.lit(mark))


def export(graph: Graph, form: str) -> DataFrame:
    """(part, value): lines of a format: json, cypher, graphml or dot. Unknown ones are an error."""
    n, e = graph.nodes, graph.edges
    name = F.coalesce("name", F.lit(""))
    if form.lower() == "json":
        a = F.to_json(F.struct("id", "name", "type", "metadata"))
        b = F.to_json(F.struct(F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"), "type"))
    elif form.lower() == "cypher":
        q = lambda c: _quoted(c, "'")
        a = F.concat(F.lit("CREATE (:"), "type", F.lit(" {id: "), q(F.col("id")), F.lit(", name: "), q(name), F.lit("});"))
        b = F.concat(F.lit("MATCH (a {id: "), q(F.col("source_id")), F.lit("}), (b {id: "), q(F.col("target_id")), F.lit("}) CREATE (a)-[:"), "type", F.lit("]->(b);"))
    elif form.lower() == "graphml":
        a = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(name), F.lit('</data><data key="type">'), "type", F.lit("</data></node>"))
        b = F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"><data key="type">'), "type", F.lit("</data></edge>"))
    elif form.lower() == "dot":
        q = lambda c: _quoted(c, '"')
        a = F.concat(q(F.col("id")), F.lit(" [label="), q(name), F.lit("];"))
        b = F.concat(q(F.col("source_id")), F.lit(" -> "), q(F.col("target_id")), F.lit(" [label="), q(F.col("type")), F.lit("];"))
    else:
        raise ValueError(f"unknown format {form}")
    return n.select(F.lit("node").alias("part"), a.alias("value")).unionByName(e.select(F.lit("edge").alias("part"), b.alias("value")))


def write_export(graph: Graph, form: str, path: str) -> None:
    """Writes the lines of a format as text files, nodes before edges in their folders."""
    export(graph, form).write.partitionBy("part").text(path)


#: What stands before and after the lines of a format.
FRAMES = {
    "graphml": (
        '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="name" for="node" attr.name="name" attr.type="string"/>\n'
        '<key id="type" for="all" attr.name="type" attr.type="string"/>\n<graph id="architecture" edgedefault="directed">',
        "</graph>\n</graphml>",
    ),
    "dot": ("digraph architecture {\n  rankdir=LR;", "}"),
}


def write_document(graph: Graph, form: str, path: str) -> None:
    """Writes a document of a format: text files that, one after another by name, are the document.

    The rows are dealt to files by their place (head, nodes, edges, foot), so no task holds them all.
    """
    head, foot = FRAMES.get(form.lower(), (None, None))
    lines = export(graph, form).select(F.when(F.col("part") == "node", 1).otherwise(2).alias("n"), "value")
    if head:
        lines = lines.unionByName(graph.nodes.sparkSession.createDataFrame([(0, head), (3, foot)], "n int, value string"))
    files = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(files, "n", "value").sortWithinPartitions("n", "value").select("value").write.text(path)


def write_json(graph: Graph, path: str) -> None:
    """One JSON document that read_json() reads: for graphs that one task can write, others are tables.

    The parts are texts in the order head, nodes, foot of the nodes, edges, foot; ids order the rows.
    """
    lines = export(graph, "json").select(F.when(F.col("part") == "node", 1).otherwise(3).alias("n"), "value")
    spark = graph.nodes.sparkSession
    frame = spark.createDataFrame([(0, '{"nodes":['), (2, '],"edges":['), (4, "]}")], "n int, value string")
    ordered = lines.unionByName(frame).repartitionByRange(1, "n", "value").sortWithinPartitions("n", "value")
    again = F.lag("n").over(Window.partitionBy(F.spark_partition_id()).orderBy("n", "value"))
    ordered.select(F.concat(F.when((F.col("n") % 2 == 1) & (again == F.col("n")), ",").otherwise(""), "value").alias("value")).write.text(path)
