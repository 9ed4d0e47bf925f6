"""Decoding of score frames: best class, runs, words, confidences. All windows are by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import argmax, top_probability

def best_classes(frames: DataFrame, max_width: int | None = 1600, stride: int = 2) -> DataFrame:
    """frames (line_id, t, logits) -> (line_id, t, cls, p): first best class and its probability; frames beyond max_width go."""
    rows = frames if max_width is None else frames.where(F.col("t") * stride < max_width)
    return rows.select("line_id", "t", argmax(F.col("logits")).alias("cls"), top_probability(F.col("logits")).alias("p"))


def emitted(symbols: DataFrame, symbol: str = "cls", blank=0) -> DataFrame:
    """Frames whose symbol isn't blank and isn't the one before."""
    none = F.coalesce(F.col(symbol).eqNullSafe(F.lit(blank)), F.lit(False)) | F.col(symbol).isNull()
    before = F.lag(symbol).over(Window.partitionBy("line_id").orderBy("t"))
    return symbols.withColumn("emit", ~none & ~before.eqNullSafe(F.col(symbol))).where("emit").drop("emit")


def decode(frames: DataFrame, vocab: DataFrame) -> DataFrame:
    """frames and vocab (idx, ch) -> (line_id, text, conf, n_chars); lines that emit nothing have an empty text and conf 0."""
    chars = emitted(best_classes(frames)).join(F.broadcast(vocab), F.col("cls") == F.col("idx"))
    made = chars.groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ch"))), lambda x: x["ch"]), "").alias("text"), F.avg("p").alias("conf"), F.count("*").alias("n_chars"))
    lines = frames.select("line_id").distinct()
    return lines.join(made, "line_id", "left").select("line_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("conf"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


def text_of(chars: DataFrame, *keys: str) -> DataFrame:
    """Emitted (.., t, ch) -> text in the order of t."""
    return chars.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ch"))), lambda x: x["ch"]), "").alias("text"))


def word_spans(chars: DataFrame, *keys: str) -> DataFrame:
    """Emitted (keys, t, ch) -> (keys, word_idx, word, t0, t1). A word ends one step before the space after it, the last one
    with its last character; several spaces make no empty word."""
    w = Window.partitionBy(*keys).orderBy("t")
    marked = chars.withColumn("space", F.col("ch") == " ").withColumn("island", F.sum(F.col("space").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("next_t", F.lead("t").over(w)).withColumn("next_space", F.coalesce(F.lead("space").over(w), F.lit(False)))
    made = marked.where("NOT space").groupBy(*keys, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ch"))), lambda x: x["ch"]), "").alias("word"), F.min("t").alias("t0"), F.max("t").alias("last_t"),
        F.max(F.when(F.col("next_space"), F.col("next_t") - 1)).alias("stop"),
    )
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("island")) - 1
    return made.select(*keys, order.alias("word_idx"), "word", "t0", F.coalesce("stop", "last_t").alias("t1"))


def emitted_of(frames: Column) -> Column:
    """emitted() of a line whose symbols are one array, null for blank: an array of (t, ch)."""
    marked = F.transform(frames, lambda x, i: F.struct(i.alias("t"), x.alias("ch"), F.get(frames, i - 1).alias("before")))
    return F.transform(F.filter(marked, lambda x: x["ch"].isNotNull() & ~x["before"].eqNullSafe(x["ch"])), lambda x: F.struct(x["t"].alias("t"), x["ch"].alias("ch")))


def joined_of(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda x: x["ch"]), "")


def words_of(lines: DataFrame, chars: str, *keep: str) -> DataFrame:
    """word_spans() of lines whose emitted (t, ch) are one array: (keep, word_idx, word, t0, t1)."""
    spaces = F.filter(F.transform(F.col(chars), lambda x, i: F.when(x["ch"] == " ", i)), lambda i: i.isNotNull())
    rows = lines.select(*keep, F.col(chars).alias("chars"), F.concat(F.array(F.lit(-1)), spaces, F.array(F.size(chars))).alias("bounds"))

    def word(a, i):
        b = F.get("bounds", i + 1)
        return F.struct(F.slice("chars", a + 2, b - a - 1).alias("own"), F.get("chars", b)["t"].alias("space_t"))

    between = F.transform(F.slice("bounds", 1, F.size("bounds") - 1), word)
    made = rows.select(*keep, F.posexplode(F.filter(between, lambda x: F.size(x["own"]) > 0)).alias("word_idx", "x"))
    return made.select(*keep, "word_idx", joined_of(F.col("x.own")).alias("word"), F.get("x.own", F.lit(0))["t"].alias("t0"), F.coalesce(F.col("x.space_t") - 1, F.element_at("x.own", -1)["t"]).alias("t1"))
