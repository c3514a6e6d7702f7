"""Best-fit packing of token sequences by linear grouping.

A text becomes pieces of at most ``CAPACITY`` tokens. What the packing needs of
them is the histogram of piece lengths, at most ``CAPACITY`` numbers whatever
the corpus, so the plan is made on it and then substituted back: large lengths
are rounded up within groups of equal cardinality, configurations of the few
rounded sizes are optimised by column generation, actual lengths replace the
rounded ones, and the rest goes best-fit into the space left. The plan is a
list of runs (length, first rank, count, first sequence, offset); each piece
finds its place by its rank among the pieces of its length. Texts, tokens and
pieces stay on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import filterfalse

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, worker_cache

CAPACITY = 4096
END = 1
CACHE = 300_000  # words and chunks whose ids a Python worker keeps at most, give or take one call's
AT_ONCE = 256  # texts that a Python worker takes out of a batch at a time
KEPT_LENGTH = 64  # characters of a word or chunk that is kept at most


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and nth, the
    piece's number among those of its length in its partition.

    A row's ids are those that ``tokenizers`` gives its whole text with the
    file ``tokenizer``, then id 1; a null text counts as empty. Where its parts
    say that it lower-cases, drops white space and never joins across it
    (``_splits_at_blanks``), texts are split at blanks and line ends and each
    worker keeps the ids of frequent words; others get whole texts.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = _encoder(tokenizer)
        end = np.array([END], "<u4").tobytes()
        nth = defaultdict(int)
        for batch in batches:
            out = {k: [] for k in ("row", "piece", "start", "length", "crc", "nth")}
            parts = (batch.column(1).slice(at, AT_ONCE).to_pylist() for at in range(0, batch.num_rows, AT_ONCE))
            for k, ids in enumerate(ids for part in parts for ids in encode([t or "" for t in part])):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - start)
                    for name, value in (("row", k), ("piece", piece), ("start", start), ("length", size),
                                        ("crc", zlib.crc32(ids[4 * start:4 * (start + size)])), ("nth", nth[size])):
                        out[name].append(value)
                    nth[size] += 1
            yield pa.record_batch([
                batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()),
                pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()),
                pa.array(out["crc"], pa.int64()), pa.array(out["nth"], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint")


def _parts(node: dict | None, inner: str) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer, in order."""
    if not node:
        return []
    return [x for n in node[inner] for x in _parts(n, inner)] if node["type"] == "Sequence" else [node]


def _splits_at_blanks(spec: dict) -> bool:
    """True if a tokenizer (its JSON form) surely gives a text the ids of its
    chunks between blanks and line ends, one after another, and ids of a word of
    letters whatever its case: normalized by composition, white space to a blank
    and lower case only, split by a pattern whose matches alone stay and hold
    runs of letters and no white space, words ended by ``</w>``, and no added
    token that holds white space or takes it from beside it."""
    normal = [(n["type"], (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in _parts(spec.get("normalizer"), "normalizers")]
    if [n[0] for n in normal if n[0] != "NFC"] not in (["Replace", "Lowercase"], ["Lowercase"]):
        return False
    if any(n[0] == "Replace" and n[1:] != ("\\s+", " ") for n in normal):
        return False
    split, *rest = _parts(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": None}]
    pattern = (split.get("pattern") or {}).get("Regex") or ""
    branches = set(pattern.split("|"))
    plain = {b for b in branches if not set(b) & set("[]\\.(){}^$*+?")}
    if (split["type"], split.get("behavior"), split.get("invert")) != ("Split", "Removed", True):
        return False
    if branches - plain != {"[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"} or any(c.isspace() for b in plain for c in b):
        return False
    if any(r["type"] != "ByteLevel" or r.get("use_regex") or r.get("add_prefix_space") for r in rest):
        return False
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
        return False
    return not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding") and not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
        for t in spec.get("added_tokens") or [])


def _encoder(path: str):
    """texts -> their ids as little-endian 32-bit numbers. Texts of ASCII and
    accented Latin letters are lower-cased and split as the tokenizer does, others
    at blanks. The worker process keeps the ids of up to ``CACHE`` words and chunks
    of up to ``KEPT_LENGTH`` characters, in two halves: when the newer one is full,
    it takes the place of the older, from which words that are met again come back.
    New words of a call are tokenized together, as words between blanks don't
    affect each other. A tokenizer of another kind gets whole texts."""
    kept_here = worker_cache()
    if path in kept_here:
        return kept_here[path]
    import json
    import re

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # letters whose lower case and composition are one to one, then plain punctuation
    plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)\\Z")

    def ask(text):
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    spec = json.loads(tokenizer.to_str())
    if not _splits_at_blanks(spec):
        kept_here[path] = lambda texts: [ask(t) for t in texts]
        return kept_here[path]

    # the tokenizer's own split, for lower-cased texts of these letters and ASCII
    letters, space = "a-zß-öø-ÿ", "\\t-\\r "
    latin = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
    is_word = re.compile(f"[{letters}]+").fullmatch
    own = {"[\\p{L}]+": f"[{letters}]+", "[\\p{N}]": "[0-9]", "[^\\s\\p{L}\\p{N}]+": f"[^{space}0-9{letters}]+"}
    branches = _parts(spec["pre_tokenizer"], "pretokenizers")[0]["pattern"]["Regex"].split("|")
    words_of = re.compile("|".join(own.get(b) or re.escape(b) for b in branches)).findall
    added = [t["content"] for t in spec.get("added_tokens") or []]

    def chunks(text):
        low = text.lower()
        if latin(text) and not any(t in text or t in low for t in added):
            return words_of(low)
        return text.replace("\n", " ").split(" ")

    class Kept(dict):
        """text -> its ids, for words, punctuation and whole chunks alike."""

        def __missing__(self, text):
            ids = ask(text)
            if len(text) <= KEPT_LENGTH:
                self[text] = ids
            return ids

    kept, older = Kept(), {}

    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that end a word
    last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(new):
        for at in range(0, len(new), 500):
            part = new[at:at + 500]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) == len(part) and ends[-1] == len(ids):  # else the words are asked for one by one
                data, start = ids.tobytes(), 0
                for word, end in zip(part, ends):
                    kept[word] = data[4 * start:4 * end]
                    start = end

    def encode(texts):
        nonlocal older
        if len(kept) > CACHE // 2:
            older = dict(kept)
            kept.clear()
        split = [chunks(t) for t in texts]
        new = set()
        for s in split:
            new.update(filterfalse(kept.__contains__, s))
        again = new & older.keys()
        kept.update((chunk, older[chunk]) for chunk in again)
        new -= again
        words, made = set(), []
        for chunk in new:
            if len(chunk) > KEPT_LENGTH:
                continue  # asked where it stands
            if is_word(chunk):
                words.add(chunk)
            elif found := plain.match(chunk):
                word = found[1].lower()
                made.append((chunk, word, found[2]))
                if word not in kept:
                    words.add(word)
        learn(list(words))
        for chunk, word, marks in made:
            kept[chunk] = kept[word] + kept[marks] if marks else kept[word]
        return [b"".join(map(kept.__getitem__, s)) for s in split]

    kept_here[path] = encode
    return encode


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 48, large: float = 1 / 8):
    """Runs (length, first rank, count, first sequence, offset) for a histogram
    {length: pieces}, and the number of sequences. Bounded by the number of
    lengths, not of pieces: work and result don't grow with the corpus."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, count)
    total = 0

    def put(length, count, first, offset):
        runs.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    def fill(room, first, count, top):
        """Best-fit into ``count`` equal sequences from ``first``, all alike."""
        if room:
            space[room].append((first, count))

    for length in sorted(n for n in left if n == capacity):
        count = left[length]
        put(length, count, total, 0)
        total += count

    big = sorted((n for n in left if n > capacity * large), reverse=True)
    if big:
        # linear grouping: equal numbers of pieces, each rounded up to its group's largest length
        share = sum(left[n] for n in big) / groups
        sizes, members, seen = [], [], 0
        for n in big:
            if not sizes or seen >= share * len(sizes):
                sizes.append(n)
                members.append([])
            members[-1].append(n)
            seen += left[n]
        demand = [sum(left[n] for n in m) for m in members]
        for config, times in configurations(sizes, demand, capacity):
            # substitute actual pieces, largest first in each group; sequences of one run are alike
            while times > 0:
                picks, take, taken = [], times, defaultdict(int)
                for g, copies in config:
                    for _ in range(copies):
                        n = next((n for n in members[g] if left.get(n, 0) > taken.get(n, 0)), None)
                        if n is not None:
                            picks.append(n)
                            taken[n] += 1
                if not picks:
                    break
                take = min([take, *(left[n] // c for n, c in taken.items())])
                offset = 0
                for n in picks:
                    put(n, take, total, offset)
                    offset += n
                fill(capacity - offset, total, take, offset)
                total += take
                times -= take
    for n in sorted(left, reverse=True):
        while n in left:
            room = min((r for r, s in space.items() if r >= n and s), default=None)
            if room is None:
                many = capacity // n
                count = max(1, left[n] // many)
                each = min(many, left[n])
                for i in range(each):
                    put(n, count, total, i * n)
                fill(capacity - each * n, total, count, each * n)
                total += count
                continue
            first, count = space[room].pop()
            copies = max(1, min(room // n, left[n] // count))
            # as many whole layers over these sequences as fit, at least part of one
            done = min(count, left[n])
            if done < count:
                space[room].append((first + done, count - done))
                copies = 1
            for i in range(copies):
                put(n, done, first, capacity - room + i * n)
            fill(room - copies * n, first, done, 0)
    return runs, total


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(configuration, times)] for the cutting-stock problem of a few sizes:
    the linear relaxation by column generation (revised simplex, unbounded
    knapsack pricing), rounded down; the rest of the demand follows best-fit."""
    import numpy as np

    k = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(40 * k):
        amounts = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(size, price, capacity)
        if price @ column <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        ahead = direction > 1e-9
        if not ahead.any():
            break
        ratio = np.where(ahead, amounts / np.where(ahead, direction, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amounts = np.linalg.solve(basis, need)
    out = []
    for j in np.argsort(-(size @ basis)):
        times = int(amounts[j] + 1e-6)
        config = [(g, int(round(c))) for g, c in enumerate(basis[:, j]) if c > 0.5]
        if times and config:
            out.append((config, times))
    return out


def _knapsack(size, price, capacity: int):
    """The configuration (pieces of each size) of the greatest total price."""
    import numpy as np

    layers = capacity // int(size.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(layers):
        nxt, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, p) in enumerate(zip(size, price)):
            if p <= 0:
                continue
            value = best[:capacity + 1 - s] + p
            better = value > nxt[s:] + 1e-12
            nxt[s:][better] = value[better]
            pick[s:][better] = g
        if (pick < 0).all():
            break
        best = nxt
        picks.append(pick)
    column, room = np.zeros(len(size)), capacity
    for pick in reversed(picks):
        g = pick[room]
        if g >= 0:
            column[g] += 1
            room -= int(size[g])
    return column


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, groups: int = 48,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Sequences hold ``capacity`` tokens at most;
    offsets in one are gapless from 0. Only rows of more tokens are cut.

    Null and empty texts have one piece of one token; repeated rows and null ids
    are packed like any other; other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    pieces = cut(tokenized(docs, tokenizer, capacity, id_col, text_col)
                 .withColumn("part", F.spark_partition_id()))
    # read twice: summed again from the written pieces, which is less than to write it
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("rows"))
    histogram = {r["length"]: r["rows"] for r in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    runs, _ = plan(histogram, capacity, groups)
    before = F.sum("rows").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts.hint("shuffle_hash"), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    table = spark.sparkContext.broadcast(sorted(runs))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        all_runs = np.array(table.value, np.int64).reshape(-1, 5)
        # runs of a length follow each other without a gap: one search over (length, rank) finds a piece's run
        span = 1 + max(histogram.values(), default=0)
        keys = all_runs[:, 0] * span + all_runs[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = all_runs[at, 3] + rank - all_runs[at, 1]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(all_runs[at, 4])],
                                  names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                                  "sequence_id bigint, offset bigint")
