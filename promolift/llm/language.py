"""Language identification by compression: a text belongs to the language whose
dictionary lets zstandard encode it in the fewest bytes.

Each language's dictionary is raw text of a bounded sample of its labelled
rows. Texts and dictionaries are compared in lower case, without ASCII digits
and punctuation. A prediction whose margin over the second language is narrow is
marked as rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE = 200  # texts up to SAMPLE_BYTES of each language that are looked at for its dictionary
SAMPLE_BYTES = 8192  # larger texts are used where those don't fill it
DICTIONARY = 110_000  # bytes of each dictionary at most
LEVEL = 6  # of every text, so that sizes and margins compare
UNKNOWN = "und"
MARKS = dict.fromkeys(map(ord, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def learn(docs: DataFrame, rows: Column, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """{language: dictionary}, frequent languages first, from the rows of ``docs`` where ``rows`` holds and
    text and language aren't null. Of each language, up to ``SAMPLE`` distinct
    texts of at most ``SAMPLE_BYTES``, those with the least hashes, are joined
    until the dictionary is full; where they don't fill it, larger texts
    follow."""
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    labelled = (docs.where(rows & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
                .select(lang.alias("lang"), text.alias("text"), F.xxhash64(text).alias("hash"),
                        F.octet_length(text).alias("bytes")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("hash").alias("texts"))
    # a hash below this share keeps about eight times the sample of the distinct texts; copies collapse before any
    # shuffle of text
    share = F.least(F.lit(1.0), F.lit(8.0 * SAMPLE) / F.col("texts"))
    some = (labelled.join(F.broadcast(counts), "lang")
            .where(F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53)) <= share)
            .select("lang", "text", "hash", "bytes").distinct())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = [t.as_py().lower().translate(MARKS).encode("utf-8", "replace") + b"\n" for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([p[:DICTIONARY] for p in parts], pa.binary()), *batch.columns[2:]],
                                  names=["lang", "part", "hash", "bytes"])

    parts = some.mapInArrow(run, "lang string, part binary, hash bigint, bytes int")
    first = Window.partitionBy("lang").orderBy((F.col("bytes") > SAMPLE_BYTES), "hash", "part")
    filled = F.coalesce(F.sum(F.octet_length("part")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = (parts.withColumn("n", F.row_number().over(first))
              .where((F.col("n") <= SAMPLE) | (F.col("bytes") > SAMPLE_BYTES))
              .withColumn("filled", filled).where(F.col("filled") < DICTIONARY))
    out: dict[str, bytes] = {}
    for r in needed.join(F.broadcast(counts), "lang").orderBy(F.desc("rows"), "lang", "n").select("lang", "part").collect():
        out[r["lang"]] = out.get(r["lang"], b"") + bytes(r["part"])
    return {k: v[:DICTIONARY] for k, v in out.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             min_margin: float = 0.02) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the second
    language's size less the first's, in shares of the second's: 0 to 1),
    accepted (score from ``min_margin`` on).

    ``und`` with score 0 and not accepted where the text is null or has no
    letter, or no dictionary is known. Of equal sizes the first language of
    ``dictionaries`` wins with score 0. One known language always wins, with score
    1. Repeated rows get equal results; other columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(dictionaries.items()))

    def run(batches):
        import pyarrow as pa
        import regex
        import zstandard

        names, compressors = [name for name, _ in shared.value], []
        for _, raw in shared.value:
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                                        write_dict_id=False, write_checksum=False))
        letter = regex.compile(r"\p{L}")

        def one(text):
            if not names or text is None or not letter.search(text):
                return UNKNOWN, 0.0
            data = text.lower().translate(MARKS).encode("utf-8", "replace")
            sizes = [len(c.compress(data)) for c in compressors]
            order = sorted(range(len(names)), key=sizes.__getitem__)
            if len(order) == 1:
                return names[0], 1.0
            first, second = sizes[order[0]], sizes[order[1]]
            return names[order[0]], (second - first) / second

        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([
                batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[0] != UNKNOWN and f[1] >= min_margin for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
