"""Source trees as rows: ``tree, path, length, text``, with what was left out beside it.

Trees come as folders (``listing``) or as tar and zip archives (``archived``), of which many are read at once; either gives the rows that
``source_files`` takes.  Spark's readers leave out empty files and every name that starts with ``_`` or ``.``, so that a folder read lacks
``__init__.py`` and ``.github``; archives are whole, and their empty files have an empty text.  Paths are relative to the root.  A missing root is an error, as in any
Spark read; an archive that can't be opened fails its task, so that nothing is silently missing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: folders that hold no sources of the project's own
EXCLUDED = [
    "node_modules", "bower_components", "vendor", "third_party",
    ".venv", "venv", "__pycache__", ".tox", ".nox", ".eggs", "site-packages",
    "build", "dist", "out", "target", "obj",
    ".next", ".nuxt", ".svelte-kit", ".astro", ".angular",
    "coverage", ".nyc_output", ".turbo", ".cache", ".parcel-cache",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".gradle", ".idea",
]
# fixed values: suffixes of files that aren't code
NON_CODE = [
    ".md", ".markdown", ".rst", ".txt", ".adoc", ".org",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".properties",
    ".lock", ".sum", ".csv", ".tsv", ".xml", ".svg",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz",
    ".po", ".pot", ".snap", ".map",
]
MAX_BYTES = 2_000_000
SNIFFED = 8192


def relative(root: str, path: str = "path") -> Column:
    """The part of a file's address after the root, whatever the scheme in front."""
    plain = root.rstrip("/").split("://")[-1]
    return F.expr(f"substring({path}, locate('{plain.replace(chr(39), chr(92) + chr(39))}/', {path}) + {len(plain) + 1})")


def decoded(content: Column) -> Column:
    """Text by the byte order mark: UTF-16 with one, else UTF-8, whose bad bytes become replacement characters."""
    mark = F.hex(F.substring(content, 1, 3))
    wide = F.decode(content.substr(F.lit(1), F.length(content) - F.length(content) % 2), "UTF-16")
    return F.when(mark.rlike("^(FFFE|FEFF)"), wide).when(mark == "EFBBBF", F.make_valid_utf8(content.substr(F.lit(4), F.length(content)).cast("string"))).otherwise(F.make_valid_utf8(content.cast("string")))


def is_binary(content: Column) -> Column:
    """A zero byte near the start, unless a UTF-16 mark explains it."""
    return ~F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") & F.substring(content, 1, SNIFFED).cast("string").contains("\x00")


def kept(at: DataFrame, excluded: Iterable[str] = EXCLUDED) -> DataFrame:
    """Files outside the excluded and hidden folders (``.github`` stays), without hidden files at the root."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda x: x.startswith(".") & (x != ".github"))
    return at.where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))) & ~hidden & ~((F.size(folders) == 0) & F.col("path").startswith(".")))


def listing(spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED) -> DataFrame:
    """``tree, path, length, content`` of the files that Spark lists under a folder, which is the tree."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return kept(raw.select(F.lit(root).alias("tree"), relative(root).alias("path"), "length", "content"), excluded)


def archived(spark: SparkSession, path: str, excluded: Iterable[str] = EXCLUDED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``tree, path, length, content`` of the members of archives; links and folders are no members.

    The content of members over ``max_bytes`` stays unread and is null.  One archive is one task's work, so keep each to a repository.
    """
    import pyarrow as pa

    def members(name: str, data: bytes):
        import io
        import tarfile
        import zipfile

        if name.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        yield m.filename, m.file_size, z.read(m) if m.file_size <= max_bytes else None
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield m.name, m.size, t.extractfile(m).read() if m.size <= max_bytes else None

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                tree, rows, held = name.as_py(), [], 0
                for row in members(tree, data.as_py()):
                    rows.append(row)
                    held += len(row[2] or b"")
                    if held > 8 * max_bytes or len(rows) >= 10_000:
                        yield made(tree, rows)
                        rows, held = [], 0
                yield made(tree, rows)

    def made(tree, rows):
        inside = [r[0].removeprefix("./") for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([tree] * len(rows), pa.string()), pa.array(inside, pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["tree", "path", "length", "content"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{zip,tar,tgz,tar.gz,tar.bz2,tar.xz}").load(path)
    return kept(raw.select("path", "content").mapInArrow(run, "tree string, path string, length long, content binary"), excluded)


def source_files(at: DataFrame, max_bytes: int = MAX_BYTES, only_code: bool = False) -> DataFrame:
    """``tree, path, length, text`` of text files of at most ``max_bytes``."""
    at = at.where((F.col("length") <= max_bytes) & ~is_binary(F.col("content")))
    if only_code:
        at = at.where(~F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(NON_CODE))
    return at.select("tree", "path", "length", decoded(F.col("content")).alias("text"))


def skipped_files(at: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``tree, path, length, reason`` of files that ``source_files`` leaves out: too large, or binary."""
    reason = F.when(F.col("length") > max_bytes, "too large").when(is_binary(F.col("content")), "binary")
    return at.select("tree", "path", "length", reason.alias("reason")).where("reason is not null")


def path_index(files: DataFrame) -> DataFrame:
    """``path, is_dir``: every file and every folder above one."""
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("is_dir")))).alias("x"))
    return above.select("x.path", "x.is_dir").distinct()


def notebook_lines(files: DataFrame) -> DataFrame:
    """Code cells of notebooks: ``path, cell, line, source``, cells and lines from 1.  A text that isn't a notebook gives no rows."""
    cell = "struct<cell_type:string,source:variant>"
    cells = files.where(F.col("path").endswith(".ipynb")).select("path", F.posexplode(F.from_json("text", f"struct<cells:array<{cell}>>")["cells"]).alias("n", "c")).where("c.cell_type = 'code'")
    # a cell's source is a string or a list of lines that keep their line ends
    source = F.coalesce(F.array_join(F.expr("try_variant_get(c.source, '$', 'array<string>')"), ""), F.expr("try_variant_get(c.source, '$', 'string')"))
    lines = cells.select("path", (F.col("n") + 1).alias("cell"), F.posexplode(F.split(source, "\n")).alias("i", "source"))
    return lines.select("path", "cell", (F.col("i") + 1).alias("line"), "source")
