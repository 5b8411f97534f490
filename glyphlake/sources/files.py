"""Files as corpora: walks with ignore rules, decompression, encodings.

Files are listed and read by Spark's binaryFile source, so any store Spark reads will do; rules and filters are
predicates on paths, applied before bodies are decoded.
"""

from __future__ import annotations

import codecs
import re
import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.paths import IgnoreRule, PathFilter, extension, hidden, ignored, in_skipped_dir, parse_ignore

IGNORE_FILES = (".gitignore", ".ignore", ".rgignore")


def walk(spark: SparkSession, root: str, *, show_hidden: bool = False, skip_dirs: bool = True, respect_ignore: bool = True, paths: PathFilter | None = None, max_size: int | None = None) -> DataFrame:
    """(path, mtime, length, content) of the files below a root that the rules let through, by relative path.

    Spark's file sources never list names that begin with a dot or an underscore; those few are listed and read by the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    schema = "path string, mtime timestamp, length long, content binary"
    found = files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), "length", "content")
    unseen = _unlisted(spark, root, base)
    rules: list[IgnoreRule] = []
    if respect_ignore:
        rank = {n: i for i, n in enumerate(IGNORE_FILES)}
        named = [(p, body) for p, _, _, body in unseen if p.rpartition("/")[2] in rank]
        for path, body in sorted(named, key=lambda r: (r[0].rpartition("/")[0], rank[r[0].rpartition("/")[2]])):
            rules += parse_ignore(body.decode("utf-8", "replace"), path.rpartition("/")[0], len(rules))
    if unseen:
        found = found.unionByName(spark.createDataFrame(unseen, schema))
    if max_size is not None:
        found = found.where(F.col("length") <= max_size)
    if not show_hidden:
        found = found.where(~hidden(F.col("path")))
    if skip_dirs:
        found = found.where(~in_skipped_dir(F.col("path")))
    if rules:
        found = found.where(~ignored(found, rules))
    return found.where(paths.admits(F.col("path"))) if paths else found


def _unlisted(spark: SparkSession, root: str, base: str) -> list[tuple[str, datetime.datetime, int, bytes]]:
    """Files below a root with a folder or name that begins with a dot or an underscore."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, every = [], system.listFiles(top, True)
    while every.hasNext():
        status = every.next()
        path = status.getPath().toUri().getPath().removeprefix(base)
        if any(part[:1] in "._" for part in path.split("/")) and not path.endswith(".crc"):
            stream = system.open(status.getPath())
            try:
                body = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            found.append((path, datetime.datetime.fromtimestamp(status.getModificationTime() / 1000), status.getLen(), body))
    return found


def as_corpus(files: DataFrame, encoding: str | None = None, decompress: bool = False) -> Corpus:
    """Documents of files: an id by hash of the path, and the decoded text."""
    body = inflate(F.col("content"), F.col("path")) if decompress else F.col("content")
    text = decode(body, encoding) if encoding else legible(body)
    return Corpus(files.select(F.xxhash64("path").alias("doc_id"), "path", "mtime", text.alias("text")))


def legible(content: Column) -> Column:
    """UTF-8 with or without a mark, UTF-16 by its mark, and anything else with replacement characters."""
    two = F.hex(F.substring(content, 1, 2))
    strip = lambda t: F.regexp_replace(t, "\\A\\x{FEFF}", "")
    return F.when(two == "FFFE", strip(F.decode(content, "UTF-16LE"))).when(two == "FEFF", strip(F.decode(content, "UTF-16BE"))).otherwise(strip(F.make_valid_utf8(content.cast("string"))))


#: Fixed by the encoding standard: labels that mean another encoding than their name says.
LABELS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "x-cp1252": "cp1252", "iso-8859-9": "cp1254", "latin5": "cp1254", "l5": "cp1254",
    "iso-8859-11": "cp874", "tis-620": "cp874", "dos-874": "cp874", "gb2312": "gbk", "chinese": "gbk", "x-gbk": "gbk", "euc-kr": "cp949", "korean": "cp949", "ks_c_5601-1987": "cp949", "ksc5601": "cp949",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "ms_kanji": "cp932", "windows-31j": "cp932", "big5": "big5hkscs", "big5-hkscs": "big5hkscs", "cn-big5": "big5hkscs", "x-x-big5": "big5hkscs",
    "utf-16": "utf-16le", "ucs-2": "utf-16le", "unicode": "utf-16le", "iso-10646-ucs-2": "utf-16le", "csunicode": "utf-16le", "unicodefeff": "utf-16le", "unicodefffe": "utf-16be", "unicode-1-1-utf-8": "utf-8", "x-mac-roman": "mac-roman",
    "macintosh": "mac-roman", "mac": "mac-roman", "csmacintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "x-mac-ukrainian": "mac-cyrillic", "iso-8859-8-i": "iso-8859-8", "logical": "iso-8859-8", "visual": "iso-8859-8", "x-euc-jp": "euc-jp",
}


def from_label(label: str) -> str:
    """The codec that an encoding label stands for: white space around it and case don't matter; windows-, cp and x-cp
    names are one family."""
    name = label.strip("\t\n\f\r ").lower()
    name = LABELS.get(name) or re.sub(r"^(?:windows-|x-cp|cp)(?=125\d$|874$|866$)", "cp", name)
    return codecs.lookup(name).name


def decode(content: Column, encoding: str) -> Column:
    """By label, a mark at the start left out; encodings that the JVM functions lack go through an Arrow function."""
    known = from_label(encoding)
    strip = lambda t: F.regexp_replace(t, "\\A\\x{FEFF}", "")
    if known == "utf-8":
        return strip(F.make_valid_utf8(content.cast("string")))
    if known in ("utf-16-le", "utf-16-be"):
        # a mark says more than the label
        two, own = F.hex(F.substring(content, 1, 2)), "UTF-16LE" if known.endswith("le") else "UTF-16BE"
        return strip(F.when(two == "FFFE", F.decode(content, "UTF-16LE")).when(two == "FEFF", F.decode(content, "UTF-16BE")).otherwise(F.decode(content, own)))
    if known.startswith("utf-32"):
        return strip(F.decode(content, "UTF-32"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda raw: None if raw is None else bytes(raw).decode(known, "replace"))

    return run(content)


def inflate(content: Column, path: Column) -> Column:
    """Bodies of compressed files by extension: gz, zlib, bz2, xz, lzma, zst; others, and broken ones, as they are."""

    @F.pandas_udf("binary")
    def run(content: pd.Series, kind: pd.Series) -> pd.Series:
        import bz2
        import gzip
        import lzma
        import zlib

        import zstandard

        open_by: dict[str, Callable[[bytes], bytes]] = {
            "gz": gzip.decompress, "tgz": gzip.decompress, "zlib": zlib.decompress, "z": zlib.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress,
            "zst": lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b),
        }

        def of(raw: bytes | None, ext: str | None) -> bytes | None:
            opener = open_by.get((ext or "").lower())
            if raw is None or opener is None:
                return raw
            try:
                return opener(bytes(raw))
            except (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error, zstandard.ZstdError):
                return raw

        return pd.Series([of(r, e) for r, e in zip(content, kind, strict=True)])

    return run(content, extension(path))


def preprocess(files: DataFrame, function: Callable[[str, bytes], bytes], globs: list[str]) -> DataFrame:
    """Bodies of files that a glob names go through a function of path and content."""
    from ..functions.paths import any_glob

    @F.pandas_udf("binary")
    def run(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([function(p, bytes(c)) for p, c in zip(path, content, strict=True)])

    return files.withColumn("content", F.when(any_glob(F.col("path"), globs), run(F.col("path"), F.col("content"))).otherwise(F.col("content")))
