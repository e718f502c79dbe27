"""Text expressions: folding, tokens, segments with exact offsets. Native functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"
#: The empty place between a run of stops and white space.
SENTENCE_END = r"(?<=[.!?])(?=[ \t\n\r\f])"


def casefold(text: Column) -> Column:
    """Lower case with the sharp s written out; null stays null."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_name(text: Column) -> Column:
    """Key of a name: folded, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(casefold(text), r"\s+", " "))


def tokenize(text: Column) -> Column:
    """Words in folded form, in order. No stemming, no stop list."""
    return F.regexp_extract_all(casefold(text), F.lit(f"({WORD})"), F.lit(1))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote starts in a text, overlapping places counted; 0 for an empty quote. One pass of a look-ahead for the quoted quote."""
    ahead = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(quote) == 0, 0).otherwise(F.regexp_count(text, ahead))


def _segments(df: DataFrame, key: str, pieces: Column, gap: int) -> DataFrame:
    """``key, ordinal, start, end, text`` of contiguous pieces; ``gap`` characters lie between two. Offsets are added up
    within the row, so nothing is shuffled: in blocks of 256 pieces, as a running sum copies what it has so far."""
    lens = F.transform("_pieces", lambda x: F.length(x) + gap)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    running = lambda xs, add: F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + add(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_pieces") - 1) / 256).cast("int")), lambda i: F.slice("_lens", i * 256 + 1, F.lit(256)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
    rows = df.select(F.col(key), pieces.alias("_pieces")).where(F.size("_pieces") > 0).withColumn("_lens", lens).select(key, "_pieces", blocks.alias("_blocks"))
    rows = rows.withColumn("_at", running(F.col("_blocks"), total))
    starts = F.flatten(F.zip_with("_blocks", "_at", lambda xs, at: F.transform(running(xs, lambda x: x), lambda y: y + at)))
    rows = rows.select(F.col(key), F.posexplode(F.arrays_zip(starts.alias("start"), F.col("_pieces").alias("text"))).alias("ordinal", "x"))
    return rows.select(key, "ordinal", F.col("x.start").alias("start"), (F.col("x.start") + F.length("x.text")).alias("end"), F.col("x.text").alias("text"))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentence segments: they cover the text, offsets count code points, end exclusive."""
    return _segments(df, key, F.split(F.col(text), SENTENCE_END), 0)


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines without their line break."""
    return _segments(df, key, F.split(F.col(text), "\n"), 1)
