"""The masking plan over a stream of texts. An extension: each row stands alone, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


def _either_case(pattern: str) -> str:
    """``pattern`` for texts that are not folded: either case, full-width letters and digits."""
    wide = pattern.replace("a-z", "a-zａ-ｚＡ-Ｚ").replace("0-9", "0-9０-９").replace("@", "[@＠]")
    return f"(?i){wide}"


EMAIL, DIGIT_RUN = _either_case(V.EMAIL), _either_case(V.DIGIT_RUN)


def mask_stream(texts: DataFrame, text_col: str = "text", mark: str = "█") -> DataFrame:
    """``texts`` with ``masked``: the text with addresses and digit runs replaced, else as it was. For batches and streams."""
    hidden = F.regexp_replace(F.regexp_replace(F.col(text_col), EMAIL, mark), DIGIT_RUN, mark)
    return texts.withColumn("masked", hidden)
