"""Files, folders and projects to graphs. [S-01..S-17, T-01..T-03]"""

from __future__ import annotations

import itertools
import json
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefixes import Prefixes
from ..functions.scalars import file_hash, form_encode, percent_encode, slugify
from ..model import EDGES, NODE_TYPES, NODES, PROPERTIES, RDF_TYPE, TRIPLES, Graph
from ..operators.ingest import build_graph
from . import parsers

#: Extensions that are read, and those that a folder's import takes. [S-11, S-17]
EXTENSIONS = ("ttl", "rdf", "xml", "nt", "trig", "nq", "jsonld", "csv", "json", "ndjson")
FOLDER_EXTENSIONS = ("ttl", "rdf", "xml", "nt", "nq", "trig", "jsonld")
_COLUMNS = [c.split()[0] for c in TRIPLES.split(", ")]
#: Room for the triples of one file in seq, and rows that leave a parser at a time.
_FILE, _BLOCK = 1 << 40, 10_000


def _parse(kind: str, path: str, text: str, prefixes: Prefixes, several: bool = False) -> Iterator[tuple]:
    """Rows of TRIPLES of one file, with compacted IRIs.  Blank nodes are named by the file's path, nodes of JSON and XML by its
    name, and by its path if it is one of several, whose names may be equal.  A mistake is told and left out: in Turtle and TriG the rest of
    its statement, in N-Triples its line; of the other formats what stands before it is kept."""
    hash_, blank = file_hash(path if several else path.rsplit("/", 1)[-1]), file_hash(path)
    mistakes: list[str] = []
    if kind in ("ttl", "trig"):  # the document's own prefixes are known before its first triple
        for p, base in _declared(text):
            prefixes.add(p, base)
    short = prefixes.compact_text
    node = lambda t: f"_:{blank}:{t[1]}" if t[0] == "blank" else short(t[1])
    try:
        if kind in ("ttl", "trig"):
            got = parsers.turtle(text, mistakes=mistakes)
        elif kind == "rdf" or (kind == "xml" and parsers.is_rdf_xml(text)):
            got = parsers.rdf_xml(text)
        elif kind in ("nt", "nq"):
            got = parsers.ntriples(text)
        elif kind == "jsonld":
            got = parsers.json_ld(text)
        elif kind == "json":
            got = iter(parsers.json_tree(text, hash_)[0])
        else:
            got = parsers.xml_tree(text, hash_)
        for i, (s, p, o) in enumerate(got):
            literal = o[0] == "literal"
            yield node(s), s[0] == "blank", short(p), o[1] if literal else node(o), o[0], short(o[3]) if literal and o[3] else None, o[2] if literal else None, i
    except (ValueError, SyntaxError, RecursionError, AttributeError, KeyError) as e:
        mistakes.append(str(e))
    if mistakes:
        print(f"{path}: {len(mistakes)} mistakes, the first: {mistakes[0]}")


def _parsed(files: DataFrame, kind: str, prefixes: dict[str, str] | None, several: bool) -> DataFrame:
    """files: (path, text).  A file a task; seq is the file's number, in order of paths, and the triple's within it."""
    more = dict(prefixes or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["path"], pdf["text"]):
                rows = _parse(kind, name, text, Prefixes(more), several)
                while block := list(itertools.islice(rows, _BLOCK)):
                    out = pd.DataFrame(block, columns=_COLUMNS)
                    out["path"] = name
                    yield out

    # one row a file: their number, not their size, is in one task
    number = files.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("file"))
    found = files.mapInPandas(run, TRIPLES + ", path string").join(number, "path")
    return found.withColumn("seq", F.col("file") * _FILE + F.col("seq")).select(*_COLUMNS)


def _declared(text: str) -> Iterator[tuple[str, str]]:
    import re

    for m in re.finditer(r"(?im)^\s*@?prefix\s+([\w.\-]*):\s*<([^>]*)>", text):
        yield m[1], m[2]


def read_triples(spark: SparkSession, path: str, kind: str | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Triples of one file or of all files that a path with wildcards names.  Formats with a file as their unit are
    parsed a file a task; lines of N-Triples, N-Quads, NDJSON and CSV are split."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in EXTENSIONS:
        raise ValueError(f"unknown extension {kind}")
    if kind in ("nt", "nq"):
        return ntriples(spark, path, prefixes)
    if kind == "csv":
        return csv_triples(spark, path)
    if kind == "ndjson":
        return ndjson_triples(spark, path)
    return _parsed(_whole(spark.read, path), kind, prefixes, not path.lower().endswith(f".{kind}") or any(c in path for c in "*?[{"))


def _whole(reader, path: str) -> DataFrame:
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _unescape(c):
    """N-Triples escapes; rare ones (code points) go by Spark's own reader of JSON strings."""
    quoted = F.concat(F.lit('["'), F.regexp_replace(F.regexp_replace(c, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), r"\\'", "'"), F.lit('"]'))
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(F.get(F.from_json(quoted, "array<string>"), 0), c)).otherwise(c)


def ntriples(spark: SparkSession, path: str | list[str], prefixes: dict[str, str] | None = None, reader=None) -> DataFrame:
    """N-Triples and N-Quads line by line, by built-in functions; the graph's name is dropped. [S-03, S-05]"""
    p = Prefixes(prefixes)
    line = (reader or spark.read).text(path).select(F.trim("value").alias("l"), F.hex(F.xxhash64("_metadata.file_path")).alias("f"), F.monotonically_increasing_id().alias("seq")).where(~F.startswith("l", F.lit("#")) & (F.col("l") != ""))
    pattern = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
    cut = line.where(F.col("l").rlike(pattern)).select("f", "seq", *[F.regexp_extract("l", pattern, i).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))])
    blank = lambda c: F.concat(F.lit("_:"), F.col("f"), F.lit(":"), F.substring(c, F.lit(3), F.length(c)))
    iri = lambda c: p.compact(_unescape(F.substring(c, F.lit(2), F.length(c) - 2)))
    s, o = F.col("s"), F.col("o")
    is_lit = F.startswith(o, F.lit('"'))
    datatype = F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1)
    lang = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)
    return cut.select(
        F.when(F.startswith(s, F.lit("_:")), blank(s)).otherwise(iri(s)).alias("subj"), F.startswith(s, F.lit("_:")).alias("subj_is_blank"), p.compact(_unescape(F.col("p"))).alias("pred"),
        F.when(is_lit, _unescape(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1))).when(F.startswith(o, F.lit("_:")), blank(o)).otherwise(iri(o)).alias("obj"),
        F.when(is_lit, "literal").when(F.startswith(o, F.lit("_:")), "blank").otherwise("iri").alias("obj_kind"),
        F.when(datatype != "", p.compact(datatype)).alias("datatype"), F.when(lang != "", F.lower(lang)).alias("lang"), "seq",
    )


def numbered(df: DataFrame, order: str, count: str | None = None) -> DataFrame:
    """df with n, the running number of rows (or sum of `count`) before each, without one task for all: sums by
    partition first, then within. [W-01]"""
    parts = df.withColumn("_p", F.spark_partition_id()).withColumn("_o", F.monotonically_increasing_id())
    by = parts.groupBy("_p").agg(F.sum(count).alias("_s") if count else F.count("*").alias("_s"))
    before = by.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_b"))
    within = F.sum(count if count else F.lit(1)).over(Window.partitionBy("_p").orderBy("_o")) - (F.col(count) if count else 1)
    return parts.join(F.broadcast(before), "_p").withColumn("n", F.col("_b") + within).drop("_p", "_o", "_b")


def csv_triples(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A row is a node, a column a predicate, empty cells are nothing. [S-07]

    A line with an odd number of quotes begins a cell that goes on in the next one.  Only files of which one has such a line
    are read whole; others are split."""
    odd = spark.read.text(path).where(F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1)
    df = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, multiLine=not odd.isEmpty(), quote='"', escape='"')
    name = path.rstrip("/").rsplit("/", 1)[-1]
    rows = numbered(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]), "n")
    subj = F.concat(F.lit(f"urn:row:{file_hash(name)}:"), (F.col("n") + 1).cast("string"))
    cells = [F.struct(F.lit(RDF_TYPE).alias("pred"), F.lit(f"urn:csv:{slugify(name)}").alias("obj"), F.lit("iri").alias("obj_kind"), F.lit(0).alias("i"))]
    cells += [F.struct(F.lit(f"urn:col:{percent_encode(c)}").alias("pred"), F.col(f"c{i}").alias("obj"), F.lit("literal").alias("obj_kind"), F.lit(i + 1).alias("i")) for i, c in enumerate(df.columns)]
    out = rows.select(subj.alias("subj"), "n", F.inline(F.array(*cells))).where("obj is not null and obj <> ''")
    null = F.lit(None).cast("string")
    return out.select("subj", F.lit(False).alias("subj_is_blank"), "pred", "obj", "obj_kind", null.alias("datatype"), null.alias("lang"), (F.col("n") * (len(df.columns) + 1) + F.col("i")).alias("seq"))


def ndjson_triples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON value a line; objects are numbered over all lines. [S-09]"""
    hash_ = file_hash(path.rstrip("/").rsplit("/", 1)[-1])

    def objects(v) -> int:
        return sum(map(objects, v.values())) + 1 if isinstance(v, dict) else sum(map(objects, v)) if isinstance(v, list) else 0

    def load(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return None

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: objects(load(t)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = Prefixes().compact_text
        for pdf in batches:
            rows = []
            for text, n in zip(pdf["value"], pdf["n"]):
                for i, (s, p, o) in enumerate(parsers.json_tree(text, hash_, n)[0] if load(text) is not None else []):
                    lit = o[0] == "literal"
                    rows.append((s[1], False, short(p), o[1] if lit else short(o[1]), o[0], short(o[3]) if lit and o[3] else None, None, int(n) * 1024 + i))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("objects", count("value"))
    return numbered(lines, "n", "objects").mapInPandas(run, TRIPLES)


def load(spark: SparkSession, path: str, languages: list[str] | None = None, prefixes: dict[str, str] | None = None) -> Graph:
    """One file, or a saved project. [S-14, S-15]"""
    if path.rstrip("/").endswith(".project"):
        from .sinks import restore

        return restore(spark, path)
    return build_graph(read_triples(spark, path, prefixes=prefixes), languages)


def load_folder(spark: SparkSession, path: str, languages: list[str] | None = None) -> Graph:
    """All RDF files in a folder and those in it; CSV and JSON are left out, and files with mistakes give what could
    be read.  N-Triples and N-Quads are split by lines, other files are read whole. [S-11, U-06]"""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lower(F.substring_index("path", ".", -1)).alias("kind")).distinct().collect()
    kinds = sorted({r["kind"] for r in names} & set(FOLDER_EXTENSIONS))
    out = None
    for kind in kinds:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
        got = ntriples(spark, path, reader=reader) if kind in ("nt", "nq") else _parsed(_whole(reader, path), kind, None, True)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], TRIPLES)
    return build_graph(out, languages)


#: What is asked for from a server, by format. [S-12]
ACCEPT = {"ttl": "text/turtle", "rdf": "application/rdf+xml", "nt": "application/n-triples"}


def fetch(spark: SparkSession, url: str, kind: str, target: str) -> str:
    """Download to a path in a store that the cluster shares; load() takes it from there. [S-12]"""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": ACCEPT[kind]})) as r:  # noqa: S310
        write_file(spark, target, r.read())
    return target


def write_file(spark: SparkSession, target: str, data: bytes) -> None:
    """One file through the file system that Spark has for its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(data)
    finally:
        out.close()


def write_lines(lines: DataFrame, folder: str, kind: str) -> None:
    """Files with an extension in a new folder, one for each task that has lines: none of these reach the driver."""
    lines.write.text(folder)
    jvm, conf = lines.sparkSession.sparkContext._jvm, lines.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    for found in fs.listStatus(where):
        name = found.getPath().getName()
        if name.endswith(".txt") and not fs.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(where, f"{name[:-4]}.{kind}")):
            raise OSError(f"{found.getPath()} keeps its name")


def describe_query(iri: str, most: int = 500) -> str:
    """What a remote endpoint would be asked about one node. [S-13]"""
    return f"CONSTRUCT {{ <{iri}> ?p ?o . ?s ?q <{iri}> }} WHERE {{ {{ <{iri}> ?p ?o }} UNION {{ ?s ?q <{iri}> }} }} LIMIT {most}"


def endpoint(url: str, timeout: float = 30.0):
    """A function that posts a query to an endpoint as a form and returns the Turtle that it answers. [S-13, X-17]"""

    def ask(query: str) -> str:
        asked = urllib.request.Request(url, form_encode({"query": query}).encode(), {"Accept": ACCEPT["ttl"], "Content-Type": "application/x-www-form-urlencoded"})
        with urllib.request.urlopen(asked, timeout=timeout) as r:  # noqa: S310
            return r.read().decode()

    return ask


class DescribeAdapter:
    """Fetches a node that is only mentioned.  ask: a function from query text to Turtle, as of endpoint(). [S-13, N-15]"""

    def __init__(self, ask):
        self.ask = ask

    def load(self, spark: SparkSession, iri: str) -> Graph:
        rows = list(_parse("ttl", "remote.ttl", self.ask(describe_query(iri)), Prefixes()))
        return build_graph(spark.createDataFrame(rows, TRIPLES))


SCHEMAS = {"nodes": NODES, "types": NODE_TYPES, "properties": PROPERTIES, "edges": EDGES}
