"""Rule tables: engine choice, preprocessing plans, image flags, line routing. Each is one ordered CASE over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the image flags.
DARK, LOW_CONTRAST, BUSY_EDGES, CHAT_WIDTH = 110.0, 60, 0.12, 700
SMALL_SIDE = 900
CHAT_NAMES = r"(?i)chat|telegram|whatsapp|discord|screenshot"


def image_flags(stats: DataFrame) -> DataFrame:
    """Image statistics with dark, low_contrast, small_text and chat_like."""
    return stats.withColumns(
        {
            "dark": F.col("avg_luminance") < DARK,
            "low_contrast": F.col("contrast_range") < LOW_CONTRAST,
            "small_text": (F.greatest("pixel_w", "pixel_h") < SMALL_SIDE) & (F.col("edge_density") > BUSY_EDGES),
            "chat_like": (F.col("pixel_w") < CHAT_WIDTH) & (F.col("pixel_h") > F.col("pixel_w")),
        }
    )


def engine_choice(mode: Column, language: Column, path: Column) -> Column:
    """Fast or Accurate, by request, language, then the image: what is hard to read goes to the accurate engine."""
    hard = F.col("dark") | F.col("low_contrast") | F.col("small_text")
    return (
        F.when(mode == "Accurate", "Accurate")
        .when(language.isin("Russian", "EnglishRussian"), "Accurate")
        .when(mode == "Fast", "Fast")
        .when(hard, "Accurate")
        .when(F.col("chat_like") | path.rlike(CHAT_NAMES), "Fast")
        .otherwise("Fast")
    )


def engine_order(choice: Column) -> Column:
    """The chosen engine and then the other one."""
    return F.when(choice == "Accurate", F.array(F.lit("Accurate"), F.lit("Fast"))).otherwise(F.array(F.lit("Fast"), F.lit("Accurate")))


def preprocessing_plan(language: Column | None = None, most: int = 4800) -> dict[str, Column]:
    """Columns of the plan for an image: scale, passes and segmentation modes. Cyrillic runs fewer passes."""
    language = F.lit("English") if language is None else language
    side = F.greatest("pixel_w", "pixel_h")
    wanted = F.when(F.col("small_text") & (side < 600), 3.0).when(F.col("small_text") | (side < SMALL_SIDE), 2.0).otherwise(1.0)
    cyrillic = language.isin("Russian", "EnglishRussian")
    return {
        "scale": F.least(wanted, F.lit(float(most)) / F.greatest(side, F.lit(1))),
        "invert": F.col("dark"),
        "stretch_contrast": F.col("low_contrast") | F.col("dark"),
        "binarise": F.col("low_contrast") & ~F.col("chat_like"),
        "sharpen": F.col("small_text") & ~cyrillic,
        "sparse_pass": F.col("chat_like") & ~cyrillic,
        "second_pass": (F.col("dark") | F.col("low_contrast") | F.col("small_text")) & ~cyrillic,
    }


def variants(plans: DataFrame) -> DataFrame:
    """One row per image variant and segmentation mode that the plan asks for, in order."""
    steps = [("plain", F.lit(True)), ("inverted", F.col("invert")), ("stretched", F.col("stretch_contrast")), ("binary", F.col("binarise")), ("sharp", F.col("sharpen"))]
    modes = F.when(F.col("sparse_pass"), F.array(F.lit("block"), F.lit("sparse"))).otherwise(F.array(F.lit("block")))
    names = F.filter(F.array(*[F.when(on, F.lit(n)) for n, on in steps]), lambda n: n.isNotNull())
    out = plans.withColumn("_modes", modes).select("*", F.posexplode(names).alias("variant_rank", "variant"))
    return out.withColumn("page_mode", F.explode("_modes")).drop("_modes")


def line_route(latin: Column, cyrillic: Column, english_score: Column, russian_score: Column, margin: float = 1.15) -> Column:
    """Which reading of a line to take: by telling letters, then by score with a margin, else both fused."""
    return (
        F.when((cyrillic == 0) & (latin > 0) & (english_score >= russian_score), "English")
        .when((latin == 0) & (cyrillic > 0) & (russian_score >= english_score), "Russian")
        .when(english_score > russian_score * margin, "English")
        .when(russian_score > english_score * margin, "Russian")
        .otherwise("Fused")
    )


def page_score(n_words: Column, mean_confidence: Column, alnum: Column, corrupted: Column) -> Column:
    return mean_confidence * 0.5 + F.log1p(alnum.cast("double")) * 8 + F.least(n_words, F.lit(200)) * 0.05 - corrupted * 4


def needs_second_pass(n_words: Column, least: int = 8) -> Column:
    return F.col("dark") | F.col("low_contrast") | (n_words < least)


def better_result(score: Column, other: Column, words: Column, other_words: Column) -> Column:
    """Whether a second result replaces the first: a higher score, or as many words more as make up for it."""
    return (score > other) | ((score >= 0.95 * other) & (words > other_words * 1.2))
