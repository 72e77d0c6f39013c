"""Any file that the library reads, as one table: texts and redacted files of (path, ext, content), each by the reader of its kind.

Kinds are told by the ending. A kind without a reader, and a file that its reader can't read, has a row with the reason; a redaction
never returns the content of a file that it couldn't read."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import validators
from inkveil.sources import legacy, packages, pdf
from inkveil.sources.xml import xml_content

KINDS = (*packages.EXTENSIONS, *legacy.EXTENSIONS, "pdf", "xml")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ext, content) of the files below a folder."""
    return packages.read(spark, folder)


def unsupported(files: DataFrame) -> DataFrame:
    """(path, ext, error) of the files that no reader takes."""
    return files.where(~F.coalesce(F.col("ext").isin(*KINDS), F.lit(False))).select("path", "ext", F.lit("unsupported kind of file").alias("error"))


def texts(files: DataFrame) -> DataFrame:
    """(path, ext, text, error): the text of each file. One row a file: of what can't be read the text is null."""
    members, runs, words = packages.members(files), legacy.runs(files), pdf.words(files)
    xml = files.where("ext = 'xml'").select("path", "ext", xml_content("content")["text"].alias("text"))
    found = packages.texts(members).unionByName(legacy.texts(runs)).unionByName(pdf.texts(words)).unionByName(xml)
    faults = members.where("member is null").select("path", "error").unionByName(runs.where("error is not null").select("path", "error")).unionByName(words.where("error is not null").select("path", "error")).unionByName(unsupported(files).select("path", "error"))
    faults = faults.groupBy("path").agg(F.min("error").alias("error"))
    own = files.select("path", "ext").join(found.select("path", "text"), "path", "left").join(faults, "path", "left")
    # a file that was read and holds no text has the empty one
    return own.select("path", "ext", F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")


def redact_xml(files: DataFrame, policy: dict[str, str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, ext, content, hits, error) of XML files: text nodes redacted, in the encoding they had."""
    own = packages.decode_xml("content")
    found = files.where("ext = 'xml'").select("path", "ext", F.lit("file.xml").alias("member"), F.lit(0).alias("place"), F.col("content").alias("data"), F.lit(None).cast("string").alias("error"), own["encoding"].alias("encoding"), own["text"].alias("xml"))
    done = packages.redact_members(found, policy, as_of=as_of, only=".*")
    return done.select("path", "ext", F.col("data").alias("content"), "hits", "error")


def redact(files: DataFrame, policy: dict[str, str] | None = None, literals: list[str] | None = None, as_of: datetime.date = validators.AS_OF) -> DataFrame:
    """(path, ext, content, hits, error): each file with its sensitive values masked, by the reader of its kind."""
    zipped = files.where(F.col("ext").isin(*packages.EXTENSIONS)).select("path", "ext")
    packed = packages.redact_packages(files, policy, literals, as_of).select("path", "content", "hits")
    whole = zipped.join(packed, "path", "left").select("path", "ext", "content", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("content").isNull(), F.lit("the package can't be read")).alias("error"))
    columns = ["path", "ext", "content", "hits", "error"]
    others = unsupported(files).select("path", "ext", F.lit(None).cast("binary").alias("content"), F.lit(0).alias("hits"), "error")
    parts = [whole, legacy.redact(files, policy, as_of), pdf.redact(files, as_of=as_of), redact_xml(files, policy, as_of), others]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out
