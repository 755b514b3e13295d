"""Names that are spread over several morphemes, found by windows over classes of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V


def with_name_runs(units: DataFrame, keys: list[str], idx: str = "unit_idx") -> DataFrame:
    """``units`` (with ``token``) with ``name_run``: ``kanji-run``, ``kana-name`` or null.

    A run is a stretch of kanji words; blanks stand in it but do not count. It may be a name if it has at least two
    members of two to four kanji in all, one of them a single kanji or a proper noun. A short kana noun right after a
    person's name closes a run and proves it by itself. A unit without a token ends a run.
    """
    token = F.col("token")
    surface, detail = token["surface_form"], token["pos_detail_1"]
    noun = token["pos"] == "名詞"
    blank = (token["pos"] == "記号") & ((detail == "空白") | (F.btrim(surface, F.lit(V.SPACES)) == ""))
    word = (noun & detail.isin(*V.KANJI_DETAILS)) | ((token["pos"] == "形容詞") & (detail == "自立"))
    kind = (
        F.when(surface.isNull(), "end")
        .when(blank, "blank")
        .when(surface.rlike(V.KANJI.replace("$", "\\z")) & word, "kanji")
        .when(surface.rlike(V.KANA_NAME.replace("$", "\\z")) & noun & detail.isin(*V.KANA_DETAILS), "kana")
        .otherwise("end")
    )
    proper = F.coalesce(detail == "固有名詞", F.lit(False))
    order = Window.partitionBy(*keys).orderBy(idx)
    rows = units.withColumn("_kind", F.coalesce(kind, F.lit("end")))
    rows = rows.withColumn("_person", proper & F.coalesce(token["pos_detail_2"] == "人名", F.lit(False)))
    solid = F.last(F.when(F.col("_kind") != "blank", F.struct("_kind", "_person")), True)
    rows = rows.withColumn("_before", solid.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    after_kanji = F.coalesce(F.col("_before._kind") == "kanji", F.lit(False))
    given = (F.col("_kind") == "kana") & after_kanji & F.col("_before._person")
    rows = rows.withColumn("_given", given).withColumn("_run", F.sum(((F.col("_kind") == "kanji") & ~after_kanji).cast("int")).over(order))
    is_kanji = F.col("_kind") == "kanji"
    of_run = Window.partitionBy(*keys, "_run")
    size = F.length(surface)
    many = lambda c: F.coalesce(F.count_if(c).over(of_run), F.lit(0))
    total = F.coalesce(F.sum(F.when(is_kanji, size)).over(of_run), F.lit(0))
    sure = many(is_kanji & ((size == 1) | proper)) > 0
    member = F.when(is_kanji | F.col("_given"), F.col(idx))
    inside = F.col(idx).between(F.min(member).over(of_run), F.max(member).over(of_run))
    named = F.when(many(F.col("_given")) > 0, "kana-name").when((many(is_kanji) >= 2) & total.between(2, 4) & sure, "kanji-run")
    out = rows.withColumn("name_run", F.when(inside & (F.col("_run") > 0), named))
    return out.drop("_kind", "_person", "_before", "_given", "_run")
