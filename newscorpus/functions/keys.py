"""Column expressions for keys, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newscorpus import values

SHORT_KEY_LENGTH = 8


def article_key(url: Column) -> Column:
    """Full digest of the URL: what joins use."""
    return F.md5(url.cast("binary"))


def short_key(url: Column, width: int = SHORT_KEY_LENGTH) -> Column:
    """Leading hex digits of the digest: the name shown to people."""
    return F.substring(article_key(url), 1, width)


def capitalized(word: Column) -> Column:
    """First letter upper, rest lower; unlike ``initcap`` it leaves later words alone."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2147483647)))


def month_of(published: Column, fetched: Column) -> Column:
    """Month of publication, or of ingest when the page carries no date."""
    return F.date_format(F.coalesce(published, fetched), "yyyy-MM")


def canonical_stem(name: Column) -> Column:
    """Repair a stored name: ``.html`` and the tuple marks ``('`` and ``',`` go, ends are trimmed."""
    for junk in (".html", "('", "',"):
        name = F.replace(name, F.lit(junk), F.lit(""))
    return F.btrim(name, F.lit(" \t\n\r\f\x0b\u00a0"))


def output_name(section_name: Column, month: Column, prefix: str = values.OUTPUT_PREFIX) -> Column:
    """Path of a compilation below the output folder."""
    return F.concat_ws("/", section_name, F.concat_ws("_", F.lit(prefix), section_name, month))
