"""What a model sees of a URL: characters, their ids, and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsight.functions.rows import unnest
from urlsight.functions.text import characters, model_text, normalize_url

VOCABULARY = 128
SEQUENCE = 200
WIDTHS = (3, 5, 7)
FIRST_ID = 2  # 0 pads, 1 stands for an unknown character


def char_vocab(
    df: DataFrame, url: str = "url", size: int = VOCABULARY, strip_punct: bool = True
) -> DataFrame:
    """Learned characters ``(id, token, n)``: most frequent first, higher character on ties."""
    text = model_text(normalize_url(F.col(url)), strip_punct)
    counted = (
        unnest(df.select(characters(text).alias("tokens")), "tokens", "token")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    order = [F.col("n").desc(), F.col("token").desc()]
    # The window sees at most ``size`` rows: the limit comes before it.
    learned = counted.orderBy(*order).limit(size - FIRST_ID)
    rank = F.row_number().over(Window.orderBy(*order))
    return learned.select((rank + F.lit(FIRST_ID - 1)).alias("id"), "token", "n")


def vectorize(
    df: DataFrame,
    vocab: DataFrame,
    url: str = "url",
    length: int = SEQUENCE,
    strip_punct: bool = True,
) -> DataFrame:
    """Add ``ids``: the URL's characters as vocabulary ids, cut or padded to ``length``.

    The vocabulary becomes one string in id order, so an id is a position in it plus one
    and an unknown character, at position 0, gets 1.
    """
    ordered = F.sort_array(F.collect_list(F.struct("id", "token")))
    alphabet = vocab.agg(F.array_join(F.transform(ordered, lambda v: v["token"]), "")).scalar()
    text = F.substring(model_text(normalize_url(F.col(url)), strip_punct), 1, length)
    ids = F.transform(characters(text), lambda c: F.position(c, F.col("_alphabet")) + 1)
    padding = F.array_repeat(F.lit(0), length)
    return (
        df.withColumn("_alphabet", alphabet)
        .withColumn("ids", F.slice(F.concat(ids, padding), 1, length))
        .drop("_alphabet")
    )


def char_grams(text: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """The distinct character n-grams of a text, for each width.

    One pass of a pattern that looks ahead and goes on by a character; cutting each n-gram out by
    its place would read the text from its start every time.
    """
    known = F.coalesce(text, F.lit(""))

    def of_width(width: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(known, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1)))

    return F.concat(*[of_width(w) for w in widths])


def with_grams(
    df: DataFrame,
    url: str = "url",
    widths: tuple[int, ...] = WIDTHS,
    strip_punct: bool = True,
) -> DataFrame:
    """Add ``grams``, the patterns a URL contains. Presence is kept, not frequency."""
    text = model_text(normalize_url(F.col(url)), strip_punct)
    return df.withColumn("_text", text).withColumn("grams", char_grams(F.col("_text"), widths)).drop("_text")


def gram_counts(df: DataFrame, url: str = "url", widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Number of rows that contain each n-gram."""
    exploded = unnest(with_grams(df.select(url), url, widths).select("grams"), "grams", "gram")
    return (
        exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        .select(F.length("gram").alias("width"), "gram", "n")
    )
