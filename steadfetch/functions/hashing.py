"""Portable hashes: sampling order and document identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts) -> Column:
    """First 32 bits of md5 over the parts joined by '|', as a non-negative bigint.

    It depends on the values alone, never on file order or partitioning.
    """
    cols = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def text_key(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.coalesce(text, F.lit("")).cast("binary")))


def doc_key(passage_idx: Column, idx: Column, text: Column) -> Column:
    """`pid:<id>` where an id is known, else `sha1:<hash of the text>`."""
    pid = F.concat(F.lit("pid:"), F.coalesce(passage_idx, idx).cast("string"))
    return F.coalesce(pid, text_key(text))
