"""Scalar rules as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


def fold(text: Column) -> Column:
    """Full-width letters, digits and @ to half width, then lower case. Most texts hold none of these, which is told
    faster than they are changed."""
    wide = (F.octet_length(text) != F.length(text)) & text.rlike(f"[{V.WIDE}]")
    return F.lower(F.when(wide, F.translate(text, V.WIDE, V.NARROW)).otherwise(text))


def _stands(text: Column) -> Column:
    """Whether a text begins with a character that is surely no white space."""
    between = lambda low, high: (text >= low) & (text < high)
    return between("!", "\u00a0") | between("\u00a1", "\u1680")


def trim(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.when(_stands(text) & _stands(F.substring(text, -1, 1)), text).otherwise(F.btrim(text, F.lit(V.SPACES)))


def normalize(text: Column) -> Column:
    """``fold`` of the trimmed text."""
    return fold(trim(text))


def normalize_phrase(text: Column) -> Column:
    """``fold`` of the text without white space and punctuation."""
    return fold(F.regexp_replace(text, f"[{V.PHRASE_DROP}]+", ""))


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def is_long(norm: Column) -> Column:
    """Whether a text has ``LONG_TEXT`` UTF-16 units or more; most texts are decided by their characters alone."""
    chars = F.length(norm)
    # a character of two units has four bytes
    pairs = F.octet_length(norm) - chars >= 3 * (V.LONG_TEXT - chars)
    return (chars >= V.LONG_TEXT) | ((2 * chars >= V.LONG_TEXT) & pairs & (utf16_length(norm) >= V.LONG_TEXT))


#: Reasons that keep a text; all others mask it. So do reasons that begin with one of the second.
KEPT_REASONS = ("user", "unit-metric", "empty", "allowlist", "punct", "symbol", "dom-label", "label")
KEPT_FAMILIES = ("pos:", "noise(")


def masks(reason: Column) -> Column:
    """Whether a reason masks: all that is not known to be harmless does."""
    kept = reason.isin(*KEPT_REASONS)
    for family in KEPT_FAMILIES:
        kept = kept | reason.startswith(family)
    return ~kept


def word_reason(norm: Column, raw: Column, labels: tuple[str, ...] = V.LABELS) -> Column:
    """The reason for a raw word, given in normal form and trimmed."""
    return (
        F.when(norm == "", "empty")
        .when(norm.contains("@"), "at-mark")
        .when(norm.rlike("[0-9]"), "digit")
        .when(is_long(norm), "long-text")
        .when(norm.isin(*labels), "allowlist")
        .when((raw >= "\u3005") & raw.rlike(V.NAME_LIKE.replace("$", "\\z")), "jp-name-like")
        .when(raw.rlike(V.ASCII_WORD.replace("$", "\\z")), "ascii-word")
        .otherwise("unknown")
    )


def token_reason(norm: Column, token: Column, labels: tuple[str, ...] = V.LABELS) -> Column:
    """The reason for a morpheme (``surface_form, pos, pos_detail_1, word_type``), given its normal form."""
    noun, unknown = token["pos"] == "名詞", token["word_type"] == "UNKNOWN"
    return (
        F.when(norm == "", "empty")
        .when(norm.contains("@"), "at-mark")
        .when(norm.rlike("[0-9]"), "digit")
        .when(norm.rlike("^[^\\p{L}\\p{N}]+\\z"), "punct")
        .when(is_long(norm), "long-text")
        .when(norm.isin(*labels), "allowlist")
        .when(token["surface_form"].isin(*V.ADDRESS_SUFFIX), "address-suffix")
        .when(noun & (token["pos_detail_1"] == "固有名詞"), "proper-noun")
        .when(noun & (token["pos_detail_1"] == "数"), "number")
        .when(unknown & (token["pos"] == "記号"), "symbol")
        .when(unknown, "unknown-token")
        .otherwise(F.concat(F.lit("pos:"), F.coalesce(token["pos"], F.lit(""))))
    )


def _verdict(reason: Column) -> Column:
    return F.struct(masks(reason).alias("mask"), reason.alias("reason"))


def judge(text: Column, labels: tuple[str, ...] = V.LABELS) -> Column:
    """Verdict ``mask, reason`` on a raw word."""
    return _verdict(word_reason(normalize(text), trim(text), labels))


def judge_token(token: Column, labels: tuple[str, ...] = V.LABELS) -> Column:
    """Verdict ``mask, reason`` on a morpheme."""
    return _verdict(token_reason(normalize(token["surface_form"]), token, labels))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once: projections are not merged over the generator between them.

    Where one column is made from another that is used in it several times, two calls keep the generated code short
    enough to be compiled (the virtual machine interprets methods of more than 8,000 bytes)."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), made)


def judged(df: DataFrame, text: str, labels: tuple[str, ...] = V.LABELS) -> DataFrame:
    """``df`` with the ``reason`` of the raw word in ``text``."""
    forms = once(once(df, _raw=trim(F.col(text))), _norm=fold(F.col("_raw")))
    return once(forms, reason=word_reason(F.col("_norm"), F.col("_raw"), labels)).drop("_norm", "_raw")


def unit_reason(text: Column) -> Column:
    """The line-pattern reason of a unit that stands between white space: no pattern reaches over it."""
    return folded_reason(fold(text))


def folded_reason(norm: Column) -> Column:
    """``unit_reason`` of a text that is folded already; plain characters are looked for before patterns."""
    at = norm.contains("@")
    return (
        F.when(norm.rlike(V.DIGIT_RUN), "digit-run")
        .when(at & norm.rlike(V.EMAIL), "email")
        .when(norm.rlike(V.EMAIL_HEAD) | (at & norm.rlike(V.EMAIL_TAIL)), "email-frag")
    )


def unit_is_metric(text: Column) -> Column:
    """Whether a unit between white space is a measure with its unit."""
    return folded_is_metric(fold(text))


def folded_is_metric(norm: Column) -> Column:
    return norm.rlike(f"^{V.METRIC}\\z")


def reason_hue(reason: Column) -> Column:
    """A colour's hue for a reason, without its parameter: a 31-hash in 32 bits."""
    base = F.regexp_replace(reason, "\\(.*\\)\\z", "")
    codes = F.transform(F.split(base, ""), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.abs(F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % 360


def round_half_up(value: Column, places: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale
