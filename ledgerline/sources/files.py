"""Readers and writers: delimited text of unknown dialect, tolerant scans, exports and keyed writes."""

from __future__ import annotations

import csv
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", "\t", ";", "|")
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "text", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "xml": "xml", "avro": "avro"}


#: Parts of a media type that name a format, in order.
MEDIA_TYPES = {"tab-separated": "csv", "csv": "csv", "ndjson": "json", "jsonl": "json", "json": "json", "parquet": "parquet", "orc": "orc", "xml": "xml", "avro": "avro"}


def detect_format(path: str, media_type: str | None = None) -> str:
    """By the extension of a path or URL (without its query), under an optional compression suffix, else by the media type; unknown ones are text."""
    name = re.sub(r"\.(gz|bz2|zst|snappy)$", "", re.sub(r"[?#].*$", "", path.lower()).rstrip("/"))
    step = name.rpartition("/")[2]
    known = FORMATS.get(step.rpartition(".")[2]) if "." in step else None
    return known or next((f for part, f in MEDIA_TYPES.items() if part in (media_type or "").lower()), "text")


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that gives most lines one common width of two or more; ties by width, then order."""

    def score(d: str) -> tuple[int, int]:
        widths = [len(row) for row in csv.reader(lines, delimiter=d) if row]
        common = max(set(widths), key=widths.count, default=0)
        return (widths.count(common) * 10 + common if common > 1 else 0, common)

    return max(DELIMITERS, key=score)


def looks_like_header(rows: list[list[str]]) -> bool:
    """First cells are words, distinct and not empty, and some column is numeric below a cell that is not."""
    if not rows:
        return False
    first, rest = rows[0], rows[1:]
    numeric = lambda x: bool(re.fullmatch(r"\s*[-+]?[\d.,]+\s*%?", x))
    if len(set(first)) < len(first) or any(not x.strip() or numeric(x) for x in first):
        return False
    return not rest or any(all(numeric(r[i]) for r in rest if i < len(r)) for i in range(len(first))) or all(len(x) < 40 for x in first)


def read_delimited(spark: SparkSession, path: str, sample: int = 20, multiline: bool = True) -> DataFrame:
    """A quoted, delimited file: dialect and header by its first lines, the rest by Spark's reader.

    multiline: cells may hold line breaks, for which a file must be read by one task; without it files are split.
    Cells are strings, trimmed; a missing header gives col_1, col_2, ...; rows without any value are dropped.
    """
    lines = [r.value for r in spark.read.text(path).limit(sample).collect()]
    delimiter = sniff_delimiter(lines[:10])
    rows = [r for r in csv.reader(lines, delimiter=delimiter) if any(x.strip() for x in r)]
    header = looks_like_header(rows)
    names = [x.strip().lstrip("﻿") for x in rows[0]] if header else [f"col_{i + 1}" for i in range(max(map(len, rows), default=1))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    table = spark.read.csv(path, schema=schema, sep=delimiter, header=header, multiLine=multiline, quote='"', escape='"', enforceSchema=True)
    trimmed = table.select(*(F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names))
    return trimmed.dropna("all")


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with the schema's columns, null where a column is missing; empty where there is no such path.

    Anything else that keeps the table from being read is an error.
    """
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    have = {c.lower() for c in table.columns}
    return table.select(*((F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def export_csv(rows: DataFrame, path: str, delimiter: str = ",", crlf: bool = True) -> None:
    """Part files with a header; quotes only where needed."""
    rows.write.mode("overwrite").csv(path, header=True, sep=delimiter, escape='"', lineSep="\r\n" if crlf else "\n")


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def export_json_array(rows: DataFrame, path: str) -> None:
    """Text files, each of which is one JSON array with a row a line; nulls are written, and rows stream through a partition."""

    def lines(batches):
        import pyarrow as pa

        before = None
        for batch in batches:
            out = []
            for row in batch.column(0).to_pylist():
                if before is not None:
                    out.append(before + ",")
                before = ("[" if not out and before is None else "") + row
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([before + "]" if before is not None else "[]"], pa.string())], ["value"])

    as_json = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    as_json.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Whether two aliased sides agree in all keys; nulls agree with each other."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys))


def one_row_per_key(rows: DataFrame, keys: list[str], how: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """What writing the rows one after the other, in ascending order, would leave of each key; same columns.

    order: columns, by default all that are no keys, so that the result never depends on
    how the rows are partitioned. Null keys are keys like others.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    last = F.struct(*(order or rest))
    picked = {
        "take": lambda c: F.max_by(F.struct(c), last)[c],
        "keep_null": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), last)),
        "greatest": F.max,
    }
    return rows.groupBy(*keys).agg(*(picked[(how or {}).get(c, "take")](c).alias(c) for c in rest)).select(*rows.columns)


def merged(old: DataFrame, new: DataFrame, keys: list[str], how: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """old with new written over it by key: new rows are inserted; columns of known ones follow `how`.

    take (default): the new value; keep_null: the old one where the new is null; greatest: the larger.
    Several new rows of a key are first made one (one_row_per_key), and null keys meet null keys,
    so writing the same rows again changes nothing.
    """
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_o"), F.lit(True).alias("_old")).alias("o")
    n = one_row_per_key(new.select(*old.columns), keys, how, order).select(*keys, F.struct(*rest).alias("_n"), F.lit(True).alias("_new")).alias("n")
    joined = o.join(n, same_keys("o", "n", keys), "full")

    def column(c: str) -> Column:
        o, n = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        rule = (how or {}).get(c, "take")
        changed = {"take": n, "keep_null": F.coalesce(n, o), "greatest": F.greatest(n, o)}[rule]
        return F.when(F.col("_new").isNull(), o).otherwise(changed).alias(c)

    return joined.select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), *(column(c) for c in rest)).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old and the new rows whose keys it lacks: of each such key the first row by order (by default, all other columns)."""
    rest = [c for c in old.columns if c not in keys]
    first = new.select(*old.columns)
    first = first.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_n")).select(*keys, "_n.*") if rest else first.distinct()
    return old.unionByName(first.alias("n").join(old.select(*keys).alias("o"), same_keys("n", "o", keys), "left_anti").select(*old.columns))


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(self.path))


class TableFolder(Folder):
    """A Parquet table that is replaced as a whole: at every moment its old or its new rows are whole on disk.

    The new rows are written beside it; then the old folder is set aside, the new one takes its
    place, and the old one goes. A crash between the moves leaves no table but one set aside,
    which `recover` puts back. Moves of a folder are atomic on HDFS and local disks; on an object store
    they are not, and a table format should be used there.
    """

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not move {source} to {target}")

    def recover(self) -> None:
        """Puts back the newest table that was set aside, if there is none in place."""
        aside = self._fs.globStatus(self._path(f"{self.path}.aside-*")) or []
        if aside and not self.exists():
            self.move(max(aside, key=lambda f: f.getModificationTime()).getPath().toString(), self.path)

    def replace(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        beside, aside = f"{self.path}.new-{name}", f"{self.path}.aside-{name}"
        rows.write.parquet(beside)
        if self.exists():
            self.move(self.path, aside)
        self.move(beside, self.path)
        self._fs.delete(self._path(aside), True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], how: dict[str, str] | None = None, order: list[str] | None = None, create: bool = True) -> None:
    """merged() into the Parquet table at path. Without create, a missing table is an error; one that a crash set aside is put back."""
    folder = TableFolder(spark, path)
    folder.recover()
    if not create and not folder.exists():
        raise FileNotFoundError(path)
    folder.replace(merged(scan_or_empty(spark, path, new.schema), new, keys, how, order))


#: Beginning of the name of a table's layout column, which ends in how many parts there are.
PART_OF = "part_of_"


def upsert_parts(spark: SparkSession, path: str, new: DataFrame, keys: list[str], how: dict[str, str] | None = None, order: list[str] | None = None, parts: int = 64) -> None:
    """merged() into the table at path, reading and rewriting only the parts that new rows fall into.

    The table is laid out by a hash of the keys in so many parts when it is made; later calls keep its number. The parts of a batch are replaced
    together when its job commits, so a job that fails changes nothing, and writing a batch again gives the same rows.
    """
    folder = Folder(spark, path)
    old = spark.read.parquet(path) if folder.exists() else None
    column = next((c for c in old.columns if c.startswith(PART_OF)), None) if old is not None else f"{PART_OF}{parts}"
    if column is None:
        raise ValueError(f"{path} is not laid out in parts")
    part = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(int(column.removeprefix(PART_OF)))).cast("int")
    placed = new.withColumn(column, part)
    if old is not None:
        touched = [r[0] for r in placed.select(column).distinct().collect()]  # a row a part at most
        before = old.filter(F.col(column).isin(touched)).select(*new.columns)
        placed = merged(before, new, keys, how, order).withColumn(column, part)
    else:
        placed = one_row_per_key(new, keys, how, order).withColumn(column, part)
    placed.repartition(F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def rebuild_table(spark: SparkSession, path: str, derived: DataFrame, scope: list[str], touched: DataFrame | None = None) -> None:
    """Derived rows anew: those of the touched scopes (by default, of derived's) go, and derived's come; doing so again changes nothing.

    scope: the columns that a rebuild is by, such as an entity; touched: rows of these, also of scopes that nothing is derived from any more.
    """
    folder = TableFolder(spark, path)
    folder.recover()
    old = scan_or_empty(spark, path, derived.schema)
    gone = (derived if touched is None else derived.select(*scope).unionByName(touched.select(*scope))).select(*scope).distinct()
    kept = old.alias("o").join(gone.alias("n"), same_keys("o", "n", scope), "left_anti")
    folder.replace(kept.unionByName(derived.select(*old.columns)))


def feed_items(pages: DataFrame, xml: str) -> DataFrame:
    """The other columns of pages with title, link, guid, published and description of each item of an RSS document or entry of an Atom one."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    rows = pages.select(*(c for c in pages.columns if c != xml), F.explode(items).alias("item"))

    def inner(*tags: str) -> Column:
        """The text of the first of these elements that is there."""
        texts = (F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1) for tag in tags)
        return F.coalesce(*(F.nullif(F.trim(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")) for x in texts))

    # An Atom link is an attribute; the one to the entry itself is 'alternate', or says nothing of its kind.
    links = F.regexp_extract_all("item", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    own = F.filter(links, lambda x: x.rlike(r"(?i)\bhref\s*=") & (~x.rlike(r"(?i)\brel\s*=") | x.rlike(r"""(?i)\brel\s*=\s*["']alternate["']""")))
    href = F.nullif(F.regexp_extract(F.get(own, 0), r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("*", or_empty(inner("title")).alias("title"), or_empty(F.coalesce(inner("link"), href)).alias("link"), inner("guid", "id").alias("guid"), or_empty(inner("pubDate", "published", "updated", "dc:date")).alias("published"), inner("description", "summary", "content").alias("description")).drop("item")
