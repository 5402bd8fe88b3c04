"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.tables import small
from plumbline.params import BAND_SCHEMA, BANDS, PARAMS


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round4(x: Column) -> Column:
    """To four places, halves up; noise of products beyond the tenth place does not decide halves."""
    return F.round(F.round(x, 10), 4)


def places3(x: Column) -> Column:
    """A number as text with three places, halves up; noise beyond the tenth place does not decide halves."""
    return F.round(x.cast("decimal(28,10)"), 3).cast("string")


def logit(p: Column, eps: float = PARAMS.logit_eps) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def apply_temperature(score: Column, temperature: Column, strict: bool = False) -> Column:
    """Score at a temperature. Temperatures of 0 or less leave the score as it is, or are an error where ``strict``."""
    scaled = sigmoid(logit(score) / temperature)
    other = F.raise_error(F.lit("temperature must be positive")).cast("double") if strict else score
    return F.when(temperature > 0, scaled).otherwise(other)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by their maximum."""
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def shrink_to_half(raw: Column, confidence: Column) -> Column:
    return 0.5 + (raw - 0.5) * confidence


def half_width(spread: Column, confidence: Column) -> Column:
    return 2 * spread + 0.5 * (1 - confidence)


def interval(score: Column, spread: Column, confidence: Column) -> Column:
    """Struct (lo, hi) around a score, within 0 and 1, to four places."""
    width = half_width(spread, confidence)
    return F.struct(round4(clip(score - width)).alias("lo"), round4(clip(score + width)).alias("hi"))


def confidence(penalties: Column) -> Column:
    """Product of the factors of an array of penalties; 1 where there is none."""
    return F.aggregate(penalties, F.lit(1.0), lambda a, p: a * p["factor"])


def band(score: Column) -> Column:
    """Band of a score; null stays null, NaN and values outside 0..1 are an error."""
    chain = F.when(F.isnan(score) | (score < 0) | (score > 1), F.raise_error(F.lit("score must be within 0 and 1")).cast("string"))
    for name, low, _, _ in reversed(BANDS):
        chain = chain.when(score >= low, name)
    return chain


def band_table(spark: SparkSession) -> DataFrame:
    """The bands as a table: five rows."""
    return spark.createDataFrame([(n, lo, hi, label, n == BANDS[-1][0]) for n, lo, hi, label in BANDS], BAND_SCHEMA)


def band_join(scores: DataFrame, bands: DataFrame) -> DataFrame:
    """Range join of ``scores(score, ...)`` with a user's band table, for which it must be small; scores in no band, NaN included, are dropped."""
    s = scores["score"]
    inside = ~F.isnan(s) & (s >= bands["min"]) & ((s < bands["max"]) | (bands["last"] & (s <= bands["max"])))
    return scores.join(small(bands), inside).select(scores["*"], bands["band"], bands["label"])


def quality_from_scale(scale: Column) -> Column:
    """Quality setting that a quantisation scale stands for."""
    return F.round(clip(F.when(scale > 100, 5000 / scale).otherwise((200 - scale) / 2), 1.0, 100.0)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex64(text: Column) -> Column:
    """A 64-bit value from 16 hex digits; another length is an error."""
    return F.when(F.length(text) == 16, F.conv(text, 16, -10).cast("long")).otherwise(F.raise_error(F.lit("a fingerprint has 16 hex digits")).cast("long"))


def pack_bits(values: Column) -> Column:
    """Up to 64 values as bits, most significant first: above the median of all but the first, which a missing value is not. Null for more."""
    median = F.get(F.array_sort(F.slice(values, 2, 63)), F.lit(31))
    # the median enters as an array, so that it is found once and not for each bit
    bits = F.zip_with(values, F.array_repeat(median, F.when(F.size(values) <= 64, F.size(values))), lambda v, m: F.coalesce(v > m, F.lit(False)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, bit: F.shiftleft(a, 1).bitwiseOR(bit))


def fixed(x: Column, digits: int = 4, missing: str = "—") -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x)).otherwise(missing)


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)
