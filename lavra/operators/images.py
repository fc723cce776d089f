"""Image analytics as column expressions over pixels and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Start of each colour's range of hues in degrees, and the known proportions.
HUES = [
    (0, "vermelho"), (30, "laranja/amarelo"), (60, "amarelo/verde"), (90, "verde"), (150, "ciano"), (180, "azul claro"), (210, "azul"), (270, "roxo/violeta"),
    (330, "rosa/vermelho"),
]
RATIOS = [(1.0, "1:1"), (1.33, "4:3"), (1.5, "3:2"), (1.78, "16:9"), (2.39, "21:9")]
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff")


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """Name of a colour by brightness, saturation and hue."""
    rf, gf, bf = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(rf, gf, bf), F.least(rf, gf, bf)
    delta = top - low
    turn = (gf - bf) / delta
    hue = F.when(top == rf, 60 * (turn - 6 * F.floor(turn / 6))).when(top == gf, 60 * ((bf - rf) / delta + 2)).otherwise(60 * ((rf - gf) / delta + 4))
    name = F.lit(HUES[0][1])
    for start, colour in HUES[1:]:
        name = F.when(hue >= start, F.lit(colour)).otherwise(name)
    return F.when(top < 0.15, "preto").when(low > 0.85, "branco").when((delta < 0.12) | (delta / top < 0.2), "cinza").otherwise(name)


def colour_histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", colour_name(F.col("r"), F.col("g"), F.col("b")).alias("cor")).agg(F.count("*").alias("n"))


def unique_colour_share(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img").agg((F.count_distinct("r", "g", "b") / F.count("*")).alias("razao"))


def brightness(pixels: DataFrame) -> DataFrame:
    """Mean and deviation of the three channels, averaged, with their classes."""
    out = pixels.groupBy("img").agg(
        ((F.avg("r") + F.avg("g") + F.avg("b")) / 3).alias("brilho"), ((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3).alias("desvio")
    )
    return out.withColumn("exposicao", F.when(F.col("brilho") > 200, "clara").when(F.col("brilho") < 50, "escura").otherwise("equilibrada")).withColumn(
        "contraste", F.when(F.col("desvio") > 60, "alto").when(F.col("desvio") < 15, "baixo").otherwise("medio")
    )


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h * 1.5, "paisagem").when(h > w * 1.5, "retrato").otherwise("quadrada")


def aspect_ratio(w: Column, h: Column) -> Column:
    """The nearest known proportion within 0.15, else width×height."""
    ratio = w / F.when(h > 0, h)
    nearest = F.array_min(F.array(*[F.struct(F.abs(ratio - r).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (r, name) in enumerate(RATIOS)]))
    return F.when(h == 0, "?").when(nearest.getField("d") < 0.15, nearest.getField("name")).otherwise(F.concat(w.cast("string"), F.lit("×"), h.cast("string")))


def megapixels(w: Column, h: Column) -> Column:
    return F.round(w * h / 1e6, 2)


def resized(w: Column, h: Column, most: int = 4096) -> Column:
    """Width and height scaled down to at most `most`, else as they are."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return F.struct(F.floor(w * scale).cast("int").alias("largura"), F.floor(h * scale).cast("int").alias("altura"))


def valid_extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1)).isin(*EXTENSIONS)
