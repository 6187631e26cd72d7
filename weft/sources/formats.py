"""Graphs in files and as text: N-Triples, Turtle, JSON, CSV, Parquet, DOT, GraphML, GEXF, Cypher statements, and the load
formats of other databases. A whole graph is written with its nodes, properties and frames, each file a document of its own.

Text formats are built a line a row, so writing is as parallel as the rows are, and read with Spark's own readers.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*$'


def quoted(text: Column) -> Column:
    """A JSON, DOT or Cypher string: in double quotes, with what needs it escaped."""
    out = F.regexp_replace(text, r'([\\"])', r"\\$1")
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(out, "\n", r"\\n"), "\r", r"\\r"), F.lit('"'))


def xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ntriples_lines(triples: DataFrame, base: str = "urn:weft:") -> DataFrame:
    """(line) of (s, p, o); objects that hold no id become literals."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.replace(F.col(c), F.lit(" "), F.lit("%20")), F.lit(">"))
    is_id = F.col("o").rlike("^[A-Z][0-9]+$")
    return triples.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(is_id, iri("o")).otherwise(quoted(F.col("o"))), F.lit(".")).alias("line"))


def parse_ntriples(lines: DataFrame, base: str = "urn:weft:") -> DataFrame:
    """(s, p, o, g) of (line); comments and what is no triple are left out."""
    part = lambda k: F.regexp_extract("line", _TRIPLE, k)
    plain = lambda c: F.when(c.startswith("<"), F.replace(F.regexp_replace(c, f"^<(?:{base})?|>$", ""), F.lit("%20"), F.lit(" "))).when(c.startswith('"'), F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1), r"\\n", "\n"), r"\\(.)", "$1")).otherwise(c)
    found = lines.filter(F.col("line").rlike(_TRIPLE))
    return found.select(plain(part(1)).alias("s"), plain(part(2)).alias("p"), plain(part(3)).alias("o"), F.nullif(plain(part(4)), F.lit("")).alias("g"))


def read_ntriples(spark: SparkSession, path: str, base: str = "urn:weft:") -> DataFrame:
    return parse_ntriples(spark.read.text(path).withColumnRenamed("value", "line"), base)


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("type")), F.lit("];")).alias("line"))


def cypher_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("MATCH (a {id: "), quoted(F.col("src")), F.lit("}), (b {id: "), quoted(F.col("dst")), F.lit("}) CREATE (a)-[:"), F.col("type"), F.lit(" {weight: "), F.col("weight").cast("string"), F.lit("}]->(b);")).alias("line"))


def graphml_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('"><data key="type">'), xml(F.col("type")), F.lit("</data></edge>")).alias("line"))


def gexf_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('<edge source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))


def _pairs(make) -> Column:
    """The properties map as an array of texts, in order of the names; empty without properties."""
    entries = F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))))
    return F.transform(entries, lambda e: make(e["key"], F.coalesce(e["value"], F.lit(""))))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    data = F.array_join(_pairs(lambda k, v: F.concat(F.lit('<data key="'), xml(k), F.lit('">'), xml(v), F.lit("</data>"))), "")
    return nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('"><data key="type">'), xml(F.col("type")), F.lit("</data>"), data, F.lit("</node>")).alias("line"))


def gexf_nodes(nodes: DataFrame) -> DataFrame:
    data = F.array_join(_pairs(lambda k, v: F.concat(F.lit('<attvalue for="'), xml(k), F.lit('" value="'), xml(v), F.lit('"/>'))), "")
    return nodes.select(F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('" label="'), xml(F.col("type")), F.lit('"><attvalues>'), data, F.lit("</attvalues></node>")).alias("line"))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    data = F.array_join(_pairs(lambda k, v: F.concat(F.lit(", "), quoted(k), F.lit("="), quoted(v))), "")
    return nodes.select(F.concat(F.lit("  "), quoted(F.col("id")), F.lit(" [type="), quoted(F.col("type")), data, F.lit("];")).alias("line"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    data = F.array_join(_pairs(lambda k, v: F.concat(F.lit(", "), k, F.lit(": "), quoted(v))), "")
    return nodes.select(F.concat(F.lit("CREATE (:"), F.col("type"), F.lit(" {id: "), quoted(F.col("id")), data, F.lit("});")).alias("line"))


def json_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id", "type", "properties")).alias("line"))


def json_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", "type", "weight")).alias("line"))


def facts_json(triples: DataFrame) -> DataFrame:
    """(line): an object for each subject, its predicates with the values in order."""
    each = triples.groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("o"))
    one = each.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("facts"))
    return one.select(F.to_json(F.struct(F.col("s").alias("subject"), "facts")).alias("line"))


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def bulk_nodes(nodes: DataFrame) -> DataFrame:
    """Lines for a bulk import of property graphs: :ID, :LABEL, then properties as JSON."""
    return nodes.select(F.concat_ws(",", csv_field(F.col("id")), csv_field(F.col("type")), csv_field(F.to_json("properties"))).alias("line"))


def bulk_edges(edges: DataFrame) -> DataFrame:
    """Lines for a bulk import of property graphs: :START_ID, :END_ID, :TYPE, weight."""
    return edges.select(F.concat_ws(",", csv_field(F.col("src")), csv_field(F.col("dst")), csv_field(F.col("type")), F.col("weight").cast("string")).alias("line"))


def key_value_commands(nodes: DataFrame) -> DataFrame:
    """(line): a command for each node that sets the fields of a hash in a key-value store."""
    fields = _pairs(lambda k, v: F.concat(F.lit(" "), k, F.lit(" "), quoted(v)))
    return nodes.select(F.concat(F.lit("HSET node:"), F.col("id"), F.lit(" type "), quoted(F.col("type")), F.array_join(fields, "")).alias("line"))


def turtle_lines(triples: DataFrame, base: str = "urn:weft:") -> DataFrame:
    """(line): a statement for each subject, predicates parted by semicolons and objects by commas, in order."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.replace(c, F.lit(" "), F.lit("%20")), F.lit(">"))
    o = F.when(F.col("o").rlike("^[A-Z][0-9]+$"), iri(F.col("o"))).otherwise(quoted(F.col("o")))
    each = triples.groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_set(o)), ", ").alias("o"))
    one = each.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat(iri(F.col("p")), F.lit(" "), F.col("o")))), " ; ").alias("po"))
    return one.select(F.concat(iri(F.col("s")), F.lit(" "), F.col("po"), F.lit(" .")).alias("line"))


_TURTLE = re.compile(r'''\s+|\#[^\n]*|(@?prefix\b|@?base\b|"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|<[^>\s]*>|\^\^|@[A-Za-z-]+|[;,.\[\]()](?!\w)|[^\s;,<>"\[\]()]+?(?=\.?(?:[\s;,<>"\[\]()]|$)))''', re.IGNORECASE)


def parse_turtle(text: str, base: str = "urn:weft:") -> list[tuple[str, str, str]]:
    """Triples of a document: prefixes, base, `a`, `;`, `,`, long texts, blank names and marks of language or type, which are dropped."""
    tokens = [t for t in _TURTLE.findall(text) if t]
    prefixes, out, at, root = {}, [], 0, ""

    def term(t: str) -> str:
        if t.startswith("<"):
            return (root + t[1:-1] if "://" not in t and ":" not in t else t[1:-1]).removeprefix(base).replace("%20", " ")
        if t.startswith('"'):
            n = 3 if t.startswith('"""') else 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), t[n:-n])
        head, colon, rest = t.partition(":")
        return (prefixes[head] + rest).removeprefix(base) if colon and head in prefixes else "type" if t == "a" else t

    while at < len(tokens):
        t = tokens[at].lstrip("@").lower()
        if t == "prefix":
            prefixes[tokens[at + 1].rstrip(":")] = tokens[at + 2][1:-1]
            at += 3 + (tokens[at + 3 : at + 4] == ["."])
            continue
        if t == "base":
            root = tokens[at + 1][1:-1]
            at += 2 + (tokens[at + 2 : at + 3] == ["."])
            continue
        s, at = term(tokens[at]), at + 1
        while at < len(tokens) and tokens[at] != ".":
            p, at = term(tokens[at]), at + 1
            while True:
                o, at = term(tokens[at]), at + 1
                while at < len(tokens) and (tokens[at] == "^^" or re.fullmatch("@[A-Za-z-]+", tokens[at])):
                    at += 2 if tokens[at] == "^^" else 1
                out.append((s, p, o))
                if tokens[at : at + 1] != [","]:
                    break
                at += 1
            while tokens[at : at + 1] == [";"]:
                at += 1
        at += 1
    return out


def read_turtle(documents: DataFrame, base: str = "urn:weft:") -> DataFrame:
    """(s, p, o) of (text), a document a row: prefixes hold for a whole document."""

    def run(batches):
        for b in batches:
            rows = [x for t in b.column(0).to_pylist() for x in parse_turtle(t or "", base)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["s", "p", "o"])

    return documents.select("text").mapInArrow(run, "s string, p string, o string")


#: How each text format makes lines of edges (or triples) and of nodes, and what stands before and after them.
LINES = {
    "rdf": (ntriples_lines, None, "", ""),
    "turtle": (turtle_lines, None, "", ""),
    "dot": (dot_lines, dot_nodes, "digraph g {", "}"),
    "cypher": (cypher_lines, cypher_nodes, "", ""),
    "graphml": (graphml_lines, graphml_nodes, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="all" attr.name="type" attr.type="string"/><graph edgedefault="directed">', "</graph></graphml>"),
    "gexf": (gexf_lines, gexf_nodes, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">', "</graph></gexf>"),
    "jsonl": (json_edges, json_nodes, "", ""),
}


def document(nodes: DataFrame | None, edges: DataFrame, kind: str) -> DataFrame:
    """(line): a graph as text: in each partition, so in each file, a whole document of nodes, then edges."""
    of_edges, of_nodes, head, foot = LINES[kind]
    parts = [] if nodes is None or of_nodes is None else [of_nodes(nodes).withColumn("o", F.lit(0))]
    lines = reduce(DataFrame.unionByName, [*parts, of_edges(edges).withColumn("o", F.lit(1))])
    between = ("<nodes>", "</nodes><edges>", "</edges>") if kind == "gexf" else ("", "", "")

    def run(batches):
        line = lambda *x: pa.RecordBatch.from_arrays([pa.array([t for t in x if t], pa.string())], ["line"])
        at = -1
        for b in batches:
            for text, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                while at < o:
                    at += 1
                    yield line(*((head, between[0]) if at == 0 else (between[1],)))
                yield line(text)
        while -1 < at < 1:
            at += 1
            yield line(between[1])
        if at >= 0:
            yield line(between[2], foot)

    if not head:
        return lines.select("line")
    return lines.coalesce(1).sortWithinPartitions("o").select("line", "o").mapInArrow(run, "line string")


def write(df: DataFrame, path: str, kind: str, mode: str = "error", nodes: DataFrame | None = None) -> None:
    """Rows as Parquet, JSON, CSV or ORC; a graph's edges, with its nodes, or triples, as a document of a text format."""
    if kind in ("parquet", "json", "csv", "orc"):
        getattr(df.write.mode(mode), kind)(path)
    else:
        document(nodes, df, kind).write.mode(mode).text(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, properties) and edges (src, dst, type, weight) of what write() made as jsonl."""
    rows = spark.read.schema("kind string, id string, src string, dst string, type string, properties map<string,string>, weight double").json(path)
    return rows.filter("kind = 'node'").select("id", "type", "properties"), rows.filter("kind = 'edge'").select("src", "dst", "type", "weight")


def load(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    if kind == "rdf":
        return read_ntriples(spark, path)
    if kind == "turtle":
        return read_turtle(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "text"))
    reader = spark.read.schema(schema) if schema else spark.read
    return getattr(reader, kind)(path)


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Rewrites many small files as a few."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(to)
