"""Licence scans: whole texts joined with known licences by the digest of a canonical form.

Canonical form, by built-in functions alone: A-Z in lower case, copyright lines and the
phrase "all rights reserved" removed, the copyright sign spelled out, punctuation and white
space (ASCII and the common Unicode ranges) turned into single breaks, equivalent spellings
replaced by one of them. Letters beyond ASCII stay as they are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazecast.llm.license_texts import EQUIVALENT, KNOWN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that opens with a copyright mark and a year, a second mark or a placeholder.
COPYRIGHT_LINE = (r"\n[^a-z0-9\n\x{a9}(]*(copyright[^a-z0-9\n\x{a9}(<\[]*(\(c\)|\x{a9}|[0-9]{4}|<|\[)"
                  r"|(\(c\)|\x{a9})[^a-z0-9\n<\[]*(copyright|[0-9]{4}|<|\[))[^\n]*")
RESERVED = r"all[ \t\n]+rights[ \t\n]+reserved"
SIGN = r"(copyright[ \t]*)?(\(c\)|\x{a9})"
BREAKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}-\x{bf}\x{2000}-\x{206f}\x{3000}]+"


def canonical(text: Column) -> Column:
    """Words of the canonical form, each between two blanks of its own; null counts as empty."""
    t = F.concat(F.lit("\n"), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))
    for pattern, put in ((COPYRIGHT_LINE, ""), (RESERVED, " "), (SIGN, " copyright ")):
        t = F.regexp_replace(t, pattern, put)
    t = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), BREAKS, "  ")
    for spelling, kept in EQUIVALENT:
        t = F.replace(t, F.lit(f" {spelling.replace(' ', '  ')} "), F.lit(f" {kept.replace(' ', '  ')} "))
    return t


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark) -> DataFrame:
    """(license, digest) of the texts in ``license_texts``, one row per digest."""
    texts = spark.createDataFrame(KNOWN, "license string, text string")
    return texts.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """Id, canonical digest and licence (null: none known) per row of ``docs``.

    ``known`` has (license, digest) and any size: Spark chooses the join by its size. Of
    several licences with one digest the smallest name is given. A null text has the digest
    of the empty text, repeated rows repeat, other columns are left out.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    known = known.groupBy("digest").agg(F.min("license").alias("license"))
    ours = docs.select(F.col(id_column), digest(F.col(text_column)).alias("digest"))
    return ours.join(known, "digest", "left").select(id_column, "digest", "license")
