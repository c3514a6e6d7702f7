"""Spelling variants of a corpus' words, by reduced-alphabet generation.

Letters are dealt out to a few symbols. Every word's full one-edit neighbourhood
is generated over those symbols and joined with the reduced vocabulary; words
that meet are compared as they are written. An edit of a word is an edit of its
reduced form, or leaves it as it is, so no pair of near words is missed.

Reduced words are 64-bit polynomial hashes (their neighbours follow from prefix
sums); a collision only costs a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

LETTERS = "A-Za-zÀ-ÿ"
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
MIX = 0xD6E8FEB86659FD93
FLUSH = 100_000  # distinct words counted in a task before they are passed on
FILTER_BITS = 28  # the filter of reduced words has at most this power of two of bits (32 MB)
CHUNK_BITS = 19  # and is put together in chunks of 64 kB
BLOCK = 1 << 19  # neighbours generated at once


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
               min_letters: int = 7, min_count: int = 2, drop_every: int | None = 31) -> DataFrame:
    """(word, n): the maximal runs of ``letters`` in the whole texts, A-Z in
    lower case, with at least ``min_letters`` code points and ``min_count``
    occurrences.

    Where crc32 of ``<id>:<run>`` is a multiple of ``drop_every`` the run first
    loses the code point at crc32 modulo its length (None: never). A null id
    counts as the text 'null'; null and empty texts have no words; repeated rows
    count each time; an empty table has no words."""

    def run(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        runs, counts = re.compile(f"[{letters}]{{{min_letters},}}"), {}

        def out():
            words = [w.decode() for w in counts]
            return pa.record_batch([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                                   names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                for found, n in Counter(runs.findall(text.as_py())).items():
                    word = found.encode().lower()  # of bytes: A-Z only
                    if drop_every and (h := zlib.crc32(word, start)) % drop_every == 0:
                        if len(found) <= min_letters:
                            continue
                        whole, at = word.decode(), h % len(found)
                        word = (whole[:at] + whole[at + 1:]).encode()
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def symbols(words: DataFrame, n_symbols: int | None = None) -> dict[str, int]:
    """{letter: symbol from 1}: letters dealt out, frequent ones first, each to
    the symbol with the least share of the vocabulary so far. Without
    ``n_symbols`` there are enough of them for six letters to tell all words
    apart (8 to 32), so that words per reduced word don't grow with the
    vocabulary. The letters, not the words, come to the driver."""
    if n_symbols is None:
        n_symbols = min(max(8, round(words.count() ** (1 / 6) + 0.5)), 32)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        counts = Counter()
        for batch in batches:
            for word in batch.column(0):
                counts.update(word.as_py())
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                              names=["letter", "n"])

    shares = words.select("word").mapInArrow(run, "letter string, n bigint").groupBy("letter").agg(F.sum("n").alias("n"))
    load, out = [0] * n_symbols, {}
    for r in shares.orderBy(F.desc("n"), "letter").collect():
        symbol = load.index(min(load))
        load[symbol] += r["n"]
        out[r["letter"]] = symbol + 1
    return out


def _by_length(words: list[str], deal: dict[str, int]):
    """(rows, symbols) arrays of the words of each length."""
    import numpy as np

    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.array([deal[c] for c in "".join(words)], np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, codes[starts[rows][:, None] + np.arange(length)]


def _prefixes(codes):
    """Prefix sums of the polynomial hash and the powers of its base."""
    import numpy as np

    powers = np.full(codes.shape[1] + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(codes * powers[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums, powers


def neighbourhoods(words: list[str], deal: dict[str, int], known=None):
    """(row, key) arrays: for every word the keys of its reduced form and of all
    reduced forms one edit away, repeats included, that are not below its own
    key (an unordered pair is met from one side) and that ``known`` lets pass."""
    import numpy as np

    n_symbols = np.uint64(max(deal.values(), default=0))
    new = np.arange(1, n_symbols + np.uint64(1), dtype=np.uint64)
    inverse, base = np.uint64(pow(BASE, -1, 1 << 64)), np.uint64(BASE)
    found_rows, found_keys = [], []

    def keep(rows, own, keys):
        keys = keys.reshape(len(rows), -1)
        passed = keys >= own[:, None]
        if known is not None:
            passed &= known(keys)
        at, _ = np.nonzero(passed)
        found_rows.append(rows[at])
        found_keys.append(keys[passed])

    for all_rows, all_codes in _by_length(words, deal):
        length = all_codes.shape[1]
        step = max(1, BLOCK // ((length + 1) * len(new) or 1))
        wide = max(1, BLOCK // (len(new) or 1))  # positions at once, for very long words
        for at in range(0, len(all_rows), step):
            rows, codes = all_rows[at:at + step], all_codes[at:at + step]
            sums, powers = _prefixes(codes)
            own = sums[:, -1]
            keep(rows, own, own[:, None])
            for i in range(0, length, wide):
                here = slice(i, min(i + wide, length))
                after = slice(here.start + 1, here.stop + 1)
                keep(rows, own, sums[:, here] + (own[:, None] - sums[:, after]) * inverse)
                keep(rows, own, own[:, None, None] + (new - codes[:, here, None]) * powers[here][:, None])
            for i in range(0, length + 1, wide):
                here = slice(i, min(i + wide, length + 1))
                keep(rows, own, (sums[:, here] + (own[:, None] - sums[:, here]) * base)[:, :, None]
                     + new * powers[here][:, None])
    if not found_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found_rows), np.concatenate(found_keys)


def _slots(keys, bits: int):
    import numpy as np

    return (keys * np.uint64(MIX)) >> np.uint64(64 - bits)


def _filter(keyed: DataFrame, bits: int) -> bytes:
    """One bit for the slot of every reduced word: of a size fixed by ``bits``,
    built chunk by chunk. False alarms only cost rows."""

    def slots(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)).astype(np.int64)
            yield pa.record_batch([pa.array(found >> CHUNK_BITS), pa.array(found)], names=["chunk", "slot"])

    def chunk(table):
        import numpy as np
        import pyarrow as pa

        flags = np.zeros(1 << CHUNK_BITS, np.uint8)
        flags[table.column("slot").to_numpy() & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": table.column("chunk")[:1],
                         "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    made = (keyed.select("key").mapInArrow(slots, "chunk bigint, slot bigint").distinct()
            .groupBy("chunk").applyInArrow(chunk, "chunk bigint, bits binary"))
    out = bytearray(1 << (bits - 3))
    for r in made.toLocalIterator():
        size = len(r["bits"])
        out[r["chunk"] * size:(r["chunk"] + 1) * size] = r["bits"]
    return bytes(out)


def near_pairs(words: DataFrame, n_symbols: int | None = None) -> DataFrame:
    """(word, n, other, other_n): every unordered pair of different words of
    ``words`` (word, n; words are distinct) that differ by exactly one inserted,
    deleted or replaced code point, once."""
    deal = symbols(words, n_symbols)
    spark = words.sparkSession

    def key(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = np.zeros(len(texts), np.uint64)
            for rows, codes in _by_length(texts, deal):
                keys[rows] = _prefixes(codes)[0][:, -1]
            yield pa.record_batch([pa.array(keys.view(np.int64)), *batch.columns], names=["key", "word", "n"])

    keyed = cut(words.select("word", "n").mapInArrow(key, "key bigint, word string, n bigint"))
    bits = min(max(CHUNK_BITS, (16 * keyed.count()).bit_length()), FILTER_BITS)
    shared = spark.sparkContext.broadcast(_filter(keyed, bits))

    def generate(batches):
        import numpy as np
        import pyarrow as pa

        flags = np.frombuffer(shared.value, np.uint8)

        def known(keys):
            slots = _slots(keys, bits)
            return (flags[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = part.column(0).to_numpy(zero_copy_only=False)
                rows, keys = neighbourhoods(part.column(1).to_pylist(), deal, known)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order].view(np.int64)
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
                rows, keys = rows[first], keys[first]
                taken = pa.array(rows)
                yield pa.record_batch(
                    [pa.array(keys), pa.array(own[rows] == keys), part.column(1).take(taken), part.column(2).take(taken)],
                    names=["key", "same", "word", "n"])

    sources = keyed.mapInArrow(generate, "key bigint, same boolean, word string, n bigint")
    others = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    length, other_length = F.length("word"), F.length("other")
    return (sources.join(others, "key")
            .where((~F.col("same") | (F.col("word") < F.col("other")))
                   & (F.abs(length - other_length) <= 1) & (F.levenshtein("word", "other", 1) == 1))
            .select("word", "n", "other", "other_n"))


def group_variants(words: DataFrame, ratio: int = 10, n_symbols: int | None = None) -> DataFrame:
    """One row per word of ``words`` (word, n): form, its near word of largest n
    (ties: the smallest in code-point order) if that n is at least ``ratio``
    times the word's own, else null; root, reached by following forms to the
    last; n_near; form_n.

    Words are pre-aggregated, so a word that is a third of the corpus is one
    row. A word's near words are counted by an aggregate, never gathered. Roots
    come by pointer doubling: a form is ``ratio`` times as frequent as its word,
    so the greatest n bounds the rounds. An empty vocabulary gives no rows."""
    if ratio < 2:
        raise ValueError(f"ratio must be 2 or more, not {ratio}")
    words = cut(words.select("word", "n"))
    pairs = near_pairs(words, n_symbols)
    # one pass over the pairs: each gives both of its directions
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = cut(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    links = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    steps, top = 0, words.agg(F.max("n")).first()[0] or 0
    while top >= ratio:
        steps, top = steps + 1, top // ratio
    for _ in range(max(steps - 1, 0).bit_length()):
        links = cut(links)
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return (out.join(links, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
