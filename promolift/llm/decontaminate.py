"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of a text are hashed in runs of ``GRAM`` words; of every ``WINDOW``
consecutive hashes the least one is kept with its position. ``GRAM + WINDOW -
1`` is the contract's window of 13 words, so each shared span of 13 words or
more shares a kept fingerprint, at the same place inside the span. Kept document
fingerprints are joined with those of the benchmark windows; every hit is
extended to the whole window around it and compared word by word. Items shorter
than a window are found through their first word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut, row_key

SPAN = 13
GRAM = 6
WINDOW = SPAN - GRAM + 1
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1 << 18  # benchmark windows that are broadcast at most
PLACES = 1 << 24  # a fingerprint carries its position modulo this in its low bits


def words_of(text: Column) -> Column:
    """Words of a text in order: runs of 0-9, a-z and characters above 0x7F."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with hashes: for each run of 6 words (column words) a hash whose
    low bits are the run's position. Built by doubling, two words, four, six;
    entries past the last whole run are cut off."""
    pair = lambda x, y: F.xxhash64(x, y)
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two", F.zip_with("hashes", _shifted(F.col("hashes"), 1), pair))
    rows = rows.withColumn("hashes", F.zip_with("two", _shifted(F.col("two"), 2), pair))
    rows = rows.withColumn("hashes", F.zip_with("hashes", _shifted(F.col("two"), 4), pair)).drop("two")
    whole = F.slice("hashes", 1, F.greatest(F.size("hashes") - GRAM + 1, F.lit(0)))
    return rows.withColumn("hashes", F.transform(whole, lambda h, i: h.bitwiseAND(F.lit(-PLACES)).bitwiseOR(
        (i % PLACES).cast("long"))))


def _with_kept(rows: DataFrame) -> DataFrame:
    """``rows`` with kept: the distinct least hashes of 8 consecutive ones, by
    doubling as well. Texts shorter than a window of words have none."""
    least = lambda x, y: F.least(x, y)
    rows = rows.withColumn("kept", F.col("hashes"))
    for step in (1, 2, 4):
        rows = rows.withColumn("kept", F.zip_with("kept", _shifted(F.col("kept"), step), least))
    whole = F.slice("kept", 1, F.greatest(F.size("kept") - WINDOW + 1, F.lit(0)))
    return rows.withColumn("kept", F.array_distinct(whole)).drop("hashes")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, items): each distinct benchmark window with the texts of
    the ids of its items. An item has the windows of 13 consecutive words, or
    one of all its words; none without words. Null ids are left out."""
    base = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    start = F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("words") - SPAN + 1, F.lit(1))))
    return (base.where(F.size("words") > 0).select("item", "words", start.alias("at"))
            .select("item", F.slice("words", F.col("at"), SPAN).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items"))
            .withColumn("len", F.size("window")).withColumn("whash", F.xxhash64("window")))


def anchors(wins: DataFrame) -> DataFrame:
    """(kind, hash, spots): where a window may begin around a document position.
    kind 0: a winnowed hash (every place of the least one counts), kind 1: the
    first word of a short item."""
    high = lambda x: x.bitwiseAND(F.lit(-PLACES))
    long = _with_hashes(wins.where(F.col("len") == SPAN).select(F.col("window").alias("words"))).select(
        F.transform("hashes", high).alias("h"))
    long = long.select(F.array_min("h").alias("hash"), F.posexplode("h").alias("back", "x")).where("x = hash").select(
        F.lit(0).alias("kind"), "hash", F.struct("back", F.lit(SPAN).alias("len")).alias("spot"))
    short = wins.where(F.col("len") < SPAN).select(
        F.lit(1).alias("kind"), F.xxhash64(F.element_at("window", 1)).alias("hash"),
        F.struct(F.lit(0).alias("back"), F.col("len").alias("len")).alias("spot"))
    return long.union(short).groupBy("kind", "hash").agg(F.collect_set("spot").alias("spots"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the row's content key (_hash,
    _bytes), n_words, n_hit (words inside any occurrence of a window), spans
    (hit word ranges from 0, end exclusive, merged), items (ids of items with
    occurring windows, as sorted texts), contaminated (n_hit > 0 and
    20 * n_hit >= n_words).

    Null and empty texts have no words and no hits; items without words have no
    windows; items that share a text each count, a null item id counts as none;
    repeated rows give equal rows; other columns are ignored; an empty
    benchmark leaves every document clean, an empty corpus gives no rows.

    Benchmark tables of up to ``broadcast_rows`` rows (counted) are broadcast.
    Larger ones are joined by shuffle, where a document's row carries the words
    around its position instead of all of them.
    """
    wins = cut(windows(items, item_col, item_text_col))
    marks = cut(anchors(wins))
    facts = wins.agg(F.count("*"), F.coalesce(F.max((F.col("len") < SPAN).cast("int")), F.lit(0))).first()
    small, has_short = facts[0] <= broadcast_rows, facts[1] == 1
    hint = F.broadcast if small else (lambda df: df)

    texts = docs.select(*row_key(text_col, id_col), words_of(F.col(text_col)).alias("words"))
    key = ["_id", "_hash", "_bytes"]

    def near(rows, at):
        """What extension needs of a row at position ``at`` (from 1)."""
        context = F.col("words") if small else F.slice("words", F.greatest(at - WINDOW + 1, F.lit(1)), SPAN + WINDOW - 1)
        shift = F.lit(0) if small else F.greatest(at - WINDOW, F.lit(0))
        return rows.select(*key, "n_words", context.alias("words"), shift.alias("shift"), at.alias("at"), "kind", "hash")

    # a null place stands for the document itself; so no array is empty, and
    # explode_outer adds no filter that would compute the arrays twice
    rows = _with_kept(_with_hashes(texts)).withColumn("kept", F.array_append("kept", F.lit(None).cast("long")))
    rows = rows.select(*key, "words", F.explode_outer("kept").alias("place"))
    place = (F.col("place").bitwiseAND(F.lit(PLACES - 1)) + 1).cast("int")
    rows = rows.select(
        *key, "words", F.size("words").alias("n_words"), F.when(F.col("place").isNull(), 2).otherwise(0).alias("kind"),
        F.coalesce(F.col("place").bitwiseAND(F.lit(-PLACES)), F.lit(0)).alias("hash"),
        F.coalesce(place, F.lit(1)).alias("place"))

    def later(rows, at):
        """Beyond ``PLACES`` words, a position may stand for later ones as well."""
        return rows.withColumn(at, F.explode_outer(F.when(
            (F.col("kind") == 0) & (F.col("n_words") > PLACES), F.sequence(F.col(at), F.col("n_words"), F.lit(PLACES)))
            .otherwise(F.array(at))))

    rows = near(rows if small else later(rows, "place"), F.col("place"))
    # one mark stands for the documents themselves, so each stays in the result
    itself = marks.sparkSession.range(1).select(
        F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("hash"),
        F.expr("array(named_struct('back', 0, 'len', 0))").cast(marks.schema["spots"].dataType).alias("spots"))
    found = rows.join(hint(marks.where("kind = 0").union(itself)), ["kind", "hash"])
    if has_short:
        firsts = texts.select(*key, "words", F.size("words").alias("n_words"), F.posexplode("words").alias("place", "word"))
        firsts = near(firsts.select(*key, "words", "n_words", F.lit(1).alias("kind"), F.xxhash64("word").alias("hash"),
                                    (F.col("place") + 1).alias("place")), F.col("place"))
        found = found.unionByName(firsts.join(hint(marks.where("kind = 1")), ["kind", "hash"]))
    found = found.withColumn("spot", F.explode("spots"))
    if small:
        found = later(found, "at")
    found = found.withColumn("start", F.col("at") - F.col("spot.back"))
    found = found.where((F.col("kind") == 2) | (
        (F.col("start") >= 1) & (F.col("start") + F.col("spot.len") - 1 <= F.col("n_words"))))
    found = found.select(
        *key, "n_words", "kind", "start", F.col("spot.len").alias("len"),
        F.when(F.col("kind") < 2, F.slice("words", F.col("start") - F.col("shift"), F.col("spot.len"))).alias("window"))
    found = found.withColumn("whash", F.when(F.col("kind") < 2, F.xxhash64("window")))
    known = wins.select(F.col("whash").alias("k"), F.col("window").alias("same"), "items")
    hits = found.join(hint(known), (F.col("whash") == F.col("k")) & (F.col("window") == F.col("same")), "left")
    hits = hits.where((F.col("kind") == 2) | F.col("k").isNotNull())
    span = F.struct((F.col("start") - 1).alias("start"), (F.col("start") + F.col("len") - 1).alias("end"))
    per_doc = hits.groupBy("_id", "_hash", "_bytes").agg(
        F.first("n_words").alias("n_words"), F.sum((F.col("kind") == 2).cast("long")).alias("_rows"),
        F.collect_set(F.when(F.col("kind") < 2, span)).alias("spans"), F.collect_set("items").alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                             F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    per_doc = per_doc.select(
        F.col("_id").alias("doc_id"), "_hash", "_bytes", F.col("n_words").cast("long").alias("n_words"), "_rows",
        merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    per_doc = per_doc.withColumn("n_hit", F.aggregate(
        "spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"])))
    per_doc = per_doc.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return per_doc.withColumn("_rows", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int")))).drop("_rows")
