"""From directories of dictionary files to tables: discovery, entries, bodies, resources.

Files are read by Spark's binaryFile source. A dictionary's files are rows that come together in one task, which
decodes them in a stream of batches; tasks are spread by dictionary, and rows of a batch are written as they come.
Formats are told by the beginnings of files.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import group_label
from glossmill.operators.scope import ordered_as
from glossmill.shared import exists
from glossmill.sources.bgl import Bgl
from glossmill.sources.dictproto import DictServer
from glossmill.sources.dsl import Dsl
from glossmill.sources.epwing import Epwing
from glossmill.sources.mdict import MDict
from glossmill.sources.registry import Registry, base_name, stem
from glossmill.sources.stardict import StarDict

DICTIONARIES = "path string, format_name string, name string, source_lang string, target_lang string, group string, mtime long, error string"
ENTRIES = "dict_id string, entry_seq long, headword string, byte_offset long, byte_length long, entry_key string"
HOOKED = "path string, format_name string, name string, source_lang string, target_lang string, group string, priority int"
BODIES = "dict_id string, entry_seq long, headword string, raw string, markup string"
_BATCH = 4096
#: Bytes by which a format is told; a packed file's table of chunks may take up half of them.
HEAD = 1 << 17


def standard() -> Registry:
    out = Registry()
    for f in (Dsl(), StarDict(), MDict(), Bgl(), Epwing(), DictServer()):
        out.register(f)
    return out


def files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(path, modificationTime, length, content) of all files below; only columns that are used are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(directories))


def _main(registry: Registry, path: str) -> bool:
    return path.lower().endswith(tuple(registry.extensions())) and "_abrv." not in base_name(path).lower()


def _with_companions(found: DataFrame, registry: Registry, mains: DataFrame) -> DataFrame:
    """(path, format_name, mtime, file, content): each main file's own row and those of its companions, together and in
    order of path. No row holds more than one file."""
    names = {f.name: f for f in registry.formats}

    @F.pandas_udf("array<string>")
    def needed(paths: pd.Series, formats: pd.Series) -> pd.Series:
        return pd.Series([[p, *names[f].companions(p)] for p, f in zip(paths, formats, strict=True)])

    asked = mains.withColumn("file", F.explode(needed("path", "format_name")))
    both = asked.join(found.select(F.col("path").alias("file"), "content"), "file")
    return both.repartition("path").sortWithinPartitions("path", "file").select("path", "format_name", "mtime", "file", "content")


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, dict[str, bytes]]]:
    """(path, format name, time, contents by file) of each dictionary of sorted rows."""
    now, files = None, {}
    for batch in batches:
        for path, kind, mtime, file, content in zip(*(batch.column(n) for n in range(5)), strict=True):
            key = (path.as_py(), kind.as_py(), mtime.as_py())
            if now is not None and key[0] != now[0]:
                yield (*now, files)
                files = {}
            now = key
            files[file.as_py()] = content.as_py()
    if now is not None:
        yield (*now, files)


def mains(found: DataFrame, registry: Registry) -> DataFrame:
    """(path, format_name, mtime) of files that a format takes; only the first HEAD bytes of a file are looked at."""

    @F.pandas_udf("string")
    def kind(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = [registry.detect(p, bytes(c)) for p, c in zip(paths, contents, strict=True)]
        return pd.Series([f.name if f else None for f in out], dtype=object)

    ends = F.lower("path").rlike("(?:" + "|".join(x.replace(".", "[.]") for x in registry.extensions()) + ")$")
    likely = found.where(ends & ~F.lower("path").rlike(r"_abrv\.[^/]*$"))
    head = F.substring("content", 1, HEAD)
    return likely.select("path", F.unix_seconds("modificationTime").alias("mtime"), kind("path", head).alias("format_name")).where("format_name is not null")


def discover(spark: SparkSession, directories: Sequence[str], registry: Registry | None = None) -> DataFrame:
    """All dictionaries below the directories. One that can't be read has an error and no name."""
    registry = registry or standard()
    found = files(spark, directories)

    names = [c.split()[0] for c in DICTIONARIES.split(", ")]
    wanted = pa.schema([(n, pa.int64() if n == "mtime" else pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, kind, mtime, content in _dictionaries(batches):
            try:
                m = registry.get(kind).metadata(path, content)
                name = m.name or stem(base_name(path), *registry.extensions())
                row = (path, kind, name, m.source_lang, m.target_lang, m.extra.get("group"), mtime, None)
            except (ValueError, KeyError, IndexError, UnicodeError) as e:
                row = (path, kind, None, "", "", None, mtime, str(e))
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in row), strict=True)), wanted)

    known = _with_companions(found, registry, mains(found, registry)).mapInArrow(read, DICTIONARIES)
    label = group_label(F.col("source_lang"), F.col("target_lang"))
    return known.withColumn("group", F.coalesce("group", label)).withColumn("dict_id", F.md5("path"))


def _decoded(spark: SparkSession, directories: Sequence[str], registry: Registry, rows_of, schema: str, only: Sequence[str] | None = None) -> DataFrame:
    found = files(spark, directories)
    taken = mains(found, registry)
    taken = taken if only is None else taken.where(F.md5("path").isin(list(only)))
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, kind, _, content in _dictionaries(batches):
            waiting, key = [], hashlib.md5(path.encode()).hexdigest()
            for row in rows_of(registry.get(kind), path, content):
                waiting.append((key, *row))
                if len(waiting) == _BATCH:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*waiting, strict=True)), strict=True)), wanted)
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*waiting, strict=True)), strict=True)), wanted)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    wanted = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return _with_companions(found, registry, taken).mapInArrow(read, schema)


def entries(spark: SparkSession, directories: Sequence[str], registry: Registry | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """The entries of all dictionaries below, or of those with the dict_ids ``only``, numbered in the order of their files."""

    def rows(f, path, content):
        return ((n, e.headword, e.offset, e.length, e.key) for n, e in enumerate(f.entries(path, content)))

    return _decoded(spark, directories, registry or standard(), rows, ENTRIES, only)


def bodies(spark: SparkSession, directories: Sequence[str], registry: Registry | None = None) -> DataFrame:
    """The same with their bodies as text, and the markup that these are in."""

    def rows(f, path, content):
        read = f.reader(path, content)
        return ((n, e.headword, read(e), f.markup) for n, e in enumerate(f.entries(path, content)))

    return _decoded(spark, directories, registry or standard(), rows, BODIES)


def abbreviations(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(dict_id, key, seq, expansion) of the DSL side tables."""
    registry = Registry()
    registry.register(Dsl())

    def rows(f, path, content):
        return ((k, n, v) for n, (k, v) in enumerate(f.abbreviations(path, content).items()))

    return _decoded(spark, directories, registry, rows, "dict_id string, key string, seq long, expansion string")


def resources(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(dict_id, key, content): members of companion archives (NAME.files.zip) and MDict resource files."""
    registry = standard()

    for f in registry.formats:
        own = f.companions
        f.companions = lambda path, own=own: [*own(path), (path[:-3] if path.lower().endswith(".dz") else path) + ".files.zip"]

    def rows(f, path, content):
        archive = content.get((path[:-3] if path.lower().endswith(".dz") else path) + ".files.zip")
        if archive is not None:
            with zipfile.ZipFile(io.BytesIO(archive)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        if isinstance(f, MDict):
            yield from f.resources(path, content)

    return _decoded(spark, directories, registry, rows, "dict_id string, key string, content binary")


def hooked(spark: SparkSession, registry: Registry) -> DataFrame:
    """Dictionaries that formats find themselves, by the columns of HOOKED, and dict_id."""
    rows = [tuple(d[c.split()[0]] for c in HOOKED.split(", ")) for f in registry.formats for d in f.discover()]
    return spark.createDataFrame(rows, HOOKED).withColumn("dict_id", F.md5("path"))


def asked(spark: SparkSession, registry: Registry, dictionaries: DataFrame, words: Sequence[str]) -> DataFrame:
    """(dict_id, word, entry_key, body) of words in dictionaries whose formats answer themselves; others have no rows
    here, and a dictionary that fails has none. The words are an argument, so the table of them is small."""
    asking = F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(words)])).alias("word")
    names = ["dict_id", "word", "entry_key", "body"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = registry.get(r["format_name"]).query_exact(r["path"], r["word"])
                    rows += [(r["dict_id"], r["word"], key, body) for key, body in found or ()]
                except (OSError, ValueError, KeyError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], pa.string()) for n in range(4)], names)

    known = dictionaries.where(F.col("format_name").isin([f.name for f in registry.formats]))
    return known.select("dict_id", "path", "format_name", asking).mapInArrow(ask, "dict_id string, word string, entry_key string, body string")


def import_order(spark: SparkSession, names: DataFrame, candidates: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Names (name, seq) in the order of the first configuration that is there, and the counts: of names that it has
    (matched) and hasn't (unmatched), and of names in it that aren't here (unknown)."""
    path = next((p for p in candidates if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no configuration among {list(candidates)}")
    wanted = goldendict_order(spark, path)
    ordered = ordered_as(names, wanted)
    counted = ordered.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    return ordered, counted.select("matched", "unmatched", (F.lit(wanted.count()) - F.col("matched")).cast("long").alias("unknown"))


def goldendict_order(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of the dictionaryOrder part of another program's configuration, an XML file."""
    text = spark.read.text(path, wholetext=True)
    names = F.expr("xpath(value, '//dictionaryOrder/dictionary/@name')")
    return text.select(F.posexplode(names).alias("seq", "name")).select("name", "seq")
