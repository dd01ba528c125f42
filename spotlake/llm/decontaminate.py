"""Benchmark decontamination by a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small

#: What separates words, once A-Z are lower case: ASCII other than digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A token that no text has; it stands for the end of a document.
END = ""


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def item_windows(items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): each run of `window` words of an item, the whole item if it has fewer, nothing if it has none."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_all")).where(F.size("_all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_all") - (window - 1), F.lit(1)))
    return rows.select("item_id", "_all", F.explode(starts).alias("_at")).select("item_id", F.slice("_all", F.col("_at"), F.lit(window)).alias("words"))


def _merged(parts: str) -> Column:
    """Sorted ranges that do not overlap, with those that touch made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        parts,
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["start"]),
            F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), x["end"].alias("end"))),
        ).otherwise(F.array_append(acc, x)),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """Hit words and items of each document.

    Set join with containment 1: of each window it is necessary that its rarest word (by count over all documents;
    ties to the smaller word, then the earlier place) is in the document, so that one prefix token a window is joined.
    A joined word gives the one place where the window can lie (positional bound), which must lie within the
    document (length bound); the words there are then compared with the window's. The words of a document are never
    shuffled: each is joined where it was read, with the words around it. Item words and prefix tokens are broadcast
    while there are at most `broadcast_rows` of them; beyond, the same joins are shuffled.

    Returns doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted array of the item_ids that
    have an occurrence, as strings), spans (array of word ranges start, end, sorted, exclusive end). Null texts have no
    words; null item_ids count for hits but are not listed; repeated items count once; every document row, repeated
    or not, gives a row. Empty tables: no documents, no rows; no items, no hits.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("doc_id", F.md5(F.coalesce("_text", F.lit("")).cast("binary")).alias("_md5"), words(F.col("_text")).alias("_words"))
    windows = materialize(item_windows(items, window).distinct(), "windows")
    vocabulary = materialize(windows.select(F.explode("words").alias("word")).distinct(), "item-words")

    seen = rows.select(F.explode("_words").alias("word")).join(small(vocabulary, broadcast_rows), "word", "left_semi")
    counts = materialize(seen.groupBy("word").agg(F.count("*").alias("n")), "item-word-counts")
    places = windows.select("item_id", "words", F.posexplode("words").alias("at", "word"))
    places = places.join(small(counts, broadcast_rows), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = places.groupBy("item_id", "words").agg(F.min(F.struct("n", "word", "at")).alias("r"))
    rarest = rarest.where("r.n > 0").select(F.col("r.word").alias("word"), F.col("r.at").alias("_at"), F.col("item_id"), F.col("words").alias("_window"))
    ends = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(None).cast("int").alias("_at"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("array<string>").alias("_window"))
    prefixes = materialize(rarest.unionAll(ends), "prefixes")

    # window - 1 words on either side of a prefix token hold every place of its windows
    first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    tokens = rows.withColumn("_words", F.array_append("_words", END)).select("doc_id", "_md5", "_words", F.posexplode("_words").alias("pos", "word"))
    tokens = tokens.select("doc_id", "_md5", "pos", "word", first.alias("_first"), F.slice("_words", first + 1, F.lit(2 * window - 1)).alias("_near"))
    found = tokens.join(small(prefixes, broadcast_rows), "word")
    start, size = F.col("pos") - F.col("_at"), F.size("_window")
    here = F.slice("_near", start - F.col("_first") + 1, size)
    is_end = F.col("_window").isNull()
    exact = (start >= F.col("_first")) & (here == F.col("_window"))
    found = found.where(is_end | F.when(start >= F.col("_first"), exact))
    found = found.select("doc_id", "_md5", "item_id", F.when(is_end, F.col("pos")).alias("n_words"), F.when(~is_end, start).alias("start"), F.when(~is_end, start + size).alias("end"))
    # what ends before a place: the word ranges that do not overlap are counted whole, the others from there on
    same = Window.partitionBy("doc_id", "_md5").orderBy(F.asc_nulls_first("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(same), F.lit(0))
    found = found.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    per = found.groupBy("doc_id", "_md5").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").alias("_copies"),
        F.coalesce(F.sum("_new"), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("_new") > 0, F.struct((F.col("end") - F.col("_new")).alias("start"), "end")))).alias("_parts"),
    )
    per = per.withColumn("spans", _merged("_parts"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return per.select("doc_id", "n_words", "n_hit", "items", "spans", copies.alias("_copy")).drop("_copy")
