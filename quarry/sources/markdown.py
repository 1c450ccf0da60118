"""Markdown texts as rows of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position int, title, content): a text cut at the lines that begin with `## `.

    What stands before the first heading has an empty title. Deeper headings stay in the content, which is trimmed.
    A blank or null text has no sections. No shuffle: each text is cut within its row.
    """
    # the line end before a heading separates; an empty heading without lines is no section
    pieces = F.filter(F.split(F.col(text), "\n(?=## )", -1), lambda p: p != "## ")
    rows = documents.where(F.col(text).rlike(r"\S")).select(key, F.posexplode(pieces).alias("position", "piece"))
    heading, end = F.startswith("piece", F.lit("## ")), F.instr("piece", "\n")
    title = F.when(heading, F.substring(F.substring_index("piece", "\n", 1), F.lit(4), F.char_length("piece"))).otherwise("")
    lines = F.when(~heading, F.col("piece")).when(end > 0, F.substring(F.col("piece"), end + 1, F.char_length("piece"))).otherwise("")
    return rows.select(key, "position", title.alias("title"), _trim(lines).alias("content"))
