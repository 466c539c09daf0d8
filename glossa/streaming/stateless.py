"""Stateless operators on streaming tables (an extension): normalising and scoring work unchanged, as they hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import normalise_sentence, tokens


def normalised_stream(rows: DataFrame, text: str = "text", lang: str = "e") -> DataFrame:
    """``rows`` with toks, batch or stream."""
    return rows.withColumn("toks", tokens(normalise_sentence(F.col(text), lang)))
