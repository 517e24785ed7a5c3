"""JSON, NDJSON and XML documents as one struct column per record."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.functions.tokens import blank_to_null
from rowsmith.session import scratch_folder, small_batches, whole_files
from rowsmith.sources.sections import raw_blocks
from rowsmith.sources.text import decode_bytes

XML_OPTIONS = {"attributePrefix": "attr_", "valueTag": "text", "ignoreNamespace": "true"}


def json_schema(df: DataFrame, column: str) -> T.DataType:
    """The schema that all JSON documents of a column share, in one partial aggregate.

    Keys that appear in some records only are part of it; a key with conflicting types is
    a variant. Fractions are doubles, as in the documents.
    """
    parsed = F.parse_json(F.col(column))
    text = df.agg(F.schema_of_variant_agg(parsed).alias("s")).first()["s"]
    return parse_variant_schema(text)


def parse_variant_schema(text: str) -> T.DataType:
    ddl = text.replace("OBJECT<", "STRUCT<")
    return _widen(T._parse_datatype_string(ddl))


def _widen(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _widen(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_widen(kind.elementType))
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, (T.DecimalType, T.FractionalType)):
        return T.DoubleType()
    if isinstance(kind, T.NullType):
        return T.StringType()
    return kind


def parse_json_column(df: DataFrame, column: str, schema: T.DataType | None = None) -> DataFrame:
    """Replace a JSON text column by its typed value; infers the schema when not given."""
    schema = schema or json_schema(df, column)
    return df.withColumn(column, F.from_json(F.col(column), schema))


def ndjson_documents(lines: DataFrame, column: str = "line") -> DataFrame:
    """Non-blank lines; each one is a document."""
    return lines.withColumn(column, blank_to_null(F.col(column))).filter(F.col(column).isNotNull())


def root_records(document: Column, schema: T.DataType) -> tuple[Column, T.DataType]:
    """The record array of a document, and the type of one record.

    A list is its items; an object with one key unwraps to the list or value under it;
    anything else is one record.
    """
    if isinstance(schema, T.ArrayType):
        return document, schema.elementType
    if isinstance(schema, T.StructType) and len(schema.fields) == 1:
        only = schema.fields[0]
        inner = document.getField(only.name)
        if isinstance(only.dataType, T.ArrayType):
            return inner, only.dataType.elementType
        return F.when(document.isNotNull(), F.array(inner)), only.dataType
    return F.array(document), schema


def record_rows(df: DataFrame, document: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep..., record``: the records of each document."""
    records, _ = root_records(F.col(document), df.schema[document].dataType)
    # The outer form, as the inner one makes Spark parse the document again in a filter.
    listed = df.select(*keep, F.posexplode_outer(records).alias("pos_", "record"))
    return listed.filter("pos_ IS NOT NULL").drop("pos_")


def read_json(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """``file, document``: one typed document per JSON file."""
    content = spark.read.format("binaryFile").load(path)
    text = content.select(
        F.col("path").alias("file"), decode_bytes(F.col("content"), encoding).alias("document")
    )
    return parse_json_column(text, "document")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """``file, document``: one typed document per non-blank line; large files split."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("document")
    )
    return parse_json_column(ndjson_documents(lines, "document"), "document")


def read_xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Records of one element name; Spark splits nothing inside a record."""
    return spark.read.options(**XML_OPTIONS, rowTag=row_tag).xml(path)


def parse_xml_column(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return df.withColumn(column, F.from_xml(F.col(column), schema.simpleString(), XML_OPTIONS))


# Endings of English names, what stands for them in the other number, and the least length of a name
# they apply to. The first that fits is used.
TO_SINGULAR = (
    ("ies", "y", 4), ("ches", "ch", 0), ("shes", "sh", 0), ("sses", "ss", 0), ("xes", "x", 0), ("zes", "z", 0),
    ("ss", "ss", 0), ("s", "", 0),
)
TO_PLURAL = (
    ("ay", "ays", 0), ("ey", "eys", 0), ("iy", "iys", 0), ("oy", "oys", 0), ("uy", "uys", 0), ("y", "ies", 2),
    ("s", "ses", 0), ("x", "xes", 0), ("z", "zes", 0), ("ch", "ches", 0), ("sh", "shes", 0), ("", "s", 0),
)


def in_other_number(name: str, endings: tuple[tuple[str, str, int], ...]) -> str:
    for ending, other, length in endings:
        if len(name) >= length and name.lower().endswith(ending):
            return name[: len(name) - len(ending)] + other
    return name


def xml_table_name(root: str, record: str) -> str:
    """The root's name where it is the plural of the record's, else the record's plural."""
    one, other = (in_other_number(n.lower(), TO_SINGULAR) for n in (root, record))
    return root if one == other else in_other_number(record, TO_PLURAL)


def xml_records(root: str, value: Column, schema: T.DataType) -> tuple[str, Column, T.DataType]:
    """Table name, record array and record type below a parsed XML root.

    A root whose only child repeats is that list; any other root is one record.
    """
    if isinstance(schema, T.StructType) and len(schema.fields) == 1:
        only = schema.fields[0]
        if isinstance(only.dataType, T.ArrayType):
            name = xml_table_name(root, only.name)
            return name, value.getField(only.name), only.dataType.elementType
    return root, F.array(value), schema


# --- structure of XML files -------------------------------------------------------------

PATHS = "file string, path array<string>, attribute boolean, place int, repeats int, has_text boolean, error string"
_PATHS = pa.schema([
    ("file", pa.string()), ("path", pa.list_(pa.string())), ("attribute", pa.bool_()), ("place", pa.int32()),
    ("repeats", pa.int32()), ("has_text", pa.bool_()), ("error", pa.string()),
])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


class _PathTree:
    """Every path of a document: place of its first element, most repeats in one parent, whether one has text.

    A target of the XML parser, which is fed piece by piece; only the different paths and the open elements are held.
    """

    def __init__(self) -> None:
        self.tree: dict[tuple[tuple[str, ...], bool], list] = {}
        self.counts: list[dict[str, int]] = [{}]
        self.way: list[tuple[str, ...]] = [()]

    def _note(self, path: tuple[str, ...], attribute: bool = False) -> list:
        return self.tree.setdefault((path, attribute), [len(self.tree), 1, False])

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        name = _local(tag)
        count = self.counts[-1][name] = self.counts[-1].get(name, 0) + 1
        path = (*self.way[-1], name)
        seen = self._note(path)
        seen[1] = max(seen[1], count)
        for attribute in attributes:
            self._note((*path, _local(attribute)), True)
        self.way.append(path)
        self.counts.append({})

    def end(self, tag: str) -> None:
        self.way.pop()
        self.counts.pop()

    def data(self, text: str) -> None:
        if text.strip() and len(self.way) > 1:
            self.tree[(self.way[-1], False)][2] = True

    def close(self) -> dict[tuple[tuple[str, ...], bool], list]:
        return self.tree


def _path_rows(file: str, parser: ElementTree.XMLParser | None, error: str | None) -> pa.RecordBatch:
    try:
        tree = parser.close() if error is None else {}
    except ElementTree.ParseError as late:
        tree, error = {}, str(late)
    rows = [
        {"file": file, "path": path, "attribute": attribute, "place": place, "repeats": repeats, "has_text": has_text}
        for (path, attribute), (place, repeats, has_text) in tree.items()
    ]
    return pa.RecordBatch.from_pylist(rows if error is None else [{"file": file, "path": [], "error": error}], _PATHS)


#: Bytes that go to the parser at once.
FEED = 1 << 16


def _path_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files, in order, as path trees."""
    file, parser, error = None, None, None
    for batch in batches:
        held: list[bytes] = []
        size = 0

        def feed() -> None:
            nonlocal error, size
            if held and error is None:
                try:
                    parser.feed(b"".join(held))
                except ElementTree.ParseError as found:
                    error = str(found)
            held.clear()
            size = 0

        for this, line in zip(batch.column("file").to_pylist(), batch.column("line"), strict=True):
            if this != file:
                feed()
                if file is not None:
                    yield _path_rows(file, parser, error)
                file, parser, error = this, ElementTree.XMLParser(target=_PathTree()), None
            else:
                held.append(b"\n")
            held.append(line.as_py())
            size += len(held[-1]) + 1
            if size >= FEED:
                feed()
        feed()
    if file is not None:
        yield _path_rows(file, parser, error)


def xml_paths(spark: SparkSession, path: str) -> DataFrame:
    """The path tree of each XML file, one row per different path; a file that is not XML has its error.

    A file is read line by line in one task, which holds neither the file nor its elements. Spark's readers pass over empty files.
    """
    files = spark.read.format("binaryFile").load(path).select("length")
    folder = scratch_folder(spark, "paths")
    lines = small_batches(raw_blocks(whole_files(spark, files), path, named=True))
    lines.mapInArrow(_path_trees, PATHS).write.parquet(folder)
    return spark.read.schema(PATHS).parquet(folder)


@dataclass
class _Element:
    """An element name below its parent, over all files."""

    repeats: bool = False
    has_text: bool = False
    attributes: tuple[str, ...] = ()
    children: dict[str, _Element] | None = None

    def kind(self) -> T.DataType:
        fields = [T.StructField(f"attr_{name}", T.StringType()) for name in self.attributes]
        inner = (self.children or {}).items()
        if not fields and not inner:
            return T.StringType()
        if self.has_text:
            fields.append(T.StructField("text", T.StringType()))
        fields += [T.StructField(name, T.ArrayType(e.kind()) if e.repeats else e.kind()) for name, e in inner]
        return T.StructType(fields)


def _merged(rows: list) -> dict[str, _Element]:
    """Path trees as elements by root name; parents come before their children."""
    top = _Element(children={})
    for row in sorted(rows, key=lambda r: (len(r["path"]), r["place"], r["path"])):
        at = top
        for name in row["path"][:-1]:
            at = at.children[name]
        name = row["path"][-1]
        if row["attribute"]:
            at.attributes = (*at.attributes, name)
        else:
            at.children = at.children or {}
            at.children[name] = _Element(row["repeats"] > 1, row["has_text"])
    return top.children


@dataclass(frozen=True)
class XmlTables:
    """``file, record`` of each table, and what was left out."""

    tables: dict[str, DataFrame]
    warnings: tuple[str, ...]


def read_xml(spark: SparkSession, path: str) -> XmlTables:
    """Records of XML files, whose row element and schema follow from the files.

    Path trees are merged over all files of a root; only different paths come to the driver. A root whose only content is
    one repeated element is the list of those, under the plural of their name; any other root is one record. Records
    are read by their element name, so Spark splits large files. All values are text; nothing is typed here.
    """
    found = xml_paths(spark, path)
    trees = found.filter("error IS NULL").groupBy("path", "attribute").agg(
        F.min("place").alias("place"), F.max("repeats").alias("repeats"), F.bool_or("has_text").alias("has_text")
    )
    roots = _merged(trees.collect())
    broken = found.filter("error IS NOT NULL").count()
    tables: dict[str, DataFrame] = {}
    for root, element in roots.items():
        children = element.children or {}
        only = next(iter(children), None) if len(children) == 1 and not element.attributes and not element.has_text else None
        name, tag, record = root, root, element
        if only and children[only].repeats:
            name, tag, record = xml_table_name(root, only), only, children[only]
        rows = _xml_records(spark, path, tag, record.kind())
        if len(roots) > 1:
            own = found.filter(F.size("path") == 1).filter(F.col("path")[0] == root).select("file")
            rows = rows.join(own, "file", "left_semi")
        if name in tables:
            name = f"{name}_{root}"
        tables[name] = rows
    return XmlTables(tables, (f"{broken} file(s) are not well-formed XML and were left out",) if broken else ())


def _xml_records(spark: SparkSession, path: str, tag: str, kind: T.DataType) -> DataFrame:
    scalar = not isinstance(kind, T.StructType)
    schema = T.StructType([T.StructField("text", T.StringType())]) if scalar else kind
    rows = spark.read.options(**XML_OPTIONS, rowTag=tag, mode="PERMISSIVE").schema(schema).xml(path)
    record = F.col("text") if scalar else F.struct(*[F.col(f"`{f.name}`") for f in schema])
    return rows.select(F.col("_metadata.file_path").alias("file"), record.alias("record"))
