"""Line dedup by pairwise alignment.

Lines are hashed. A pair of documents is a candidate if they share a rare run
of line hashes: the shortest run of lines that starts or ends at some line and
holds ``min_words`` words (a single long line is such a run). Every line of a
common block lies in such a run within the block. Each run has one owner,
the earliest document with it, so every later document is paired with the
owners of its runs, and pairs grow with the lines, not with the square of a
group. Each pair is then aligned by patience diff, on the lines of its runs;
what it leaves, such as a block in another order than the rest, is compared run
by run. Common blocks of ``min_words`` words or more are deleted from the later
document.

Earlier means a smaller id (nulls last), then a smaller content key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, row_key

MIN_WORDS = 50


def spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs of ``min_words`` words from and up to
    each line, given the lines' numbers of words. Runs aren't longer than
    ``min_words`` lines, and there are at most two for each line."""
    found, end, total = set(), 0, 0
    for start in range(len(words)):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        found.add((start, end - 1))
        total -= words[start]
    start, total = 0, 0
    for end in range(len(words)):
        total += words[end]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            found.add((start, end))
    return sorted(found)


def profiles(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct content key: lines, an array of (hash, words, at:
    the numbers of the non-blank lines of that hash, from 0), and runs, an array
    of (run: its hash, first, last) with the shortest runs of ``min_words``
    words from and up to a line."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_digest
        line = pa.struct([("hash", pa.int64()), ("words", pa.int32()), ("at", pa.list_(pa.int32()))])

        def number(data):
            return int.from_bytes(data, "little", signed=True)

        for batch in batches:
            lines, runs, firsts, lasts, ends = [], [], [], [], [0]
            for text in batch.column(3):
                hashes, words, where = [], [], {}
                for part in (text.as_py() or "").encode("utf-8", "replace").split(b"\n"):
                    if n := len(part.split()):
                        hashes.append(digest(part.strip()))
                        words.append(n)
                for i, h in enumerate(hashes):
                    where.setdefault(h, ([], words[i]))[0].append(i)
                lines.append([{"hash": number(h), "words": n, "at": at} for h, (at, n) in where.items()])
                for first, last in spans(words, min_words):
                    runs.append(number(digest(b"".join(hashes[first:last + 1]))))
                    firsts.append(first)
                    lasts.append(last)
                ends.append(len(runs))
            flat = pa.StructArray.from_arrays([pa.array(runs, pa.int64()), pa.array(firsts, pa.int32()),
                                               pa.array(lasts, pa.int32())], ["run", "first", "last"])
            yield pa.record_batch([*batch.columns[:3], pa.array(lines, pa.list_(line)),
                                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                                  names=["_id", "_hash", "_bytes", "lines", "runs"])

    rows = docs.select(*row_key(text_col, id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"_id {kind}, _hash bigint, _bytes int, "
                                "lines array<struct<hash:bigint,words:int,at:array<int>>>, "
                                "runs array<struct<run:bigint,first:int,last:int>>")
    whole = F.first(F.struct("lines", "runs")).alias("x")
    key = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_hash", "_bytes").alias("doc")
    return made.groupBy("_id", "_hash", "_bytes").agg(whole).select(key, "x.lines", "x.runs")


def _patience(a: list[int], b: list[int], depth: int = 64) -> list[tuple[int, int]]:
    """Matching positions of two sequences: equal ends are trimmed, lines unique
    on both sides in one order are anchors, and the parts between anchors are
    treated alike. A part without unique lines, or ``depth`` anchors deep, is
    left to the caller, so that work stays near linear."""
    from bisect import bisect_left

    out, todo = [], [(0, len(a), 0, len(b), 0)]
    while todo:
        lo_a, hi_a, lo_b, hi_b, level = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a >= hi_a or lo_b >= hi_b or level == depth:
            continue
        once_a, once_b = {}, {}
        for seq, lo, hi, seen in ((a, lo_a, hi_a, once_a), (b, lo_b, hi_b, once_b)):
            for i in range(lo, hi):
                seen[seq[i]] = -1 if seq[i] in seen else i
        unique = sorted((i, once_b[line]) for line, i in once_a.items() if i >= 0 and once_b.get(line, -1) >= 0)
        if not unique:
            continue
        tops, tails, back = [], [], {}  # longest increasing chain by patience sorting
        for k, (_, j) in enumerate(unique):
            pile = bisect_left(tops, j)
            tops[pile:pile + 1] = [j]
            tails[pile:pile + 1] = [k]
            back[k] = tails[pile - 1] if pile else None
        chain, k = [], tails[-1]
        while k is not None:
            chain.append(unique[k])
            k = back[k]
        chain.reverse()
        out.extend(chain)
        last_a, last_b = lo_a, lo_b
        for i, j in [*chain, (hi_a, hi_b)]:
            todo.append((last_a, i, last_b, j, level + 1))
            last_a, last_b = i + 1, j + 1
    return sorted(out)


def aligned(pairs, min_words: int):
    """Ranges (first, last) of line numbers of the later document that lie in
    common blocks: those that patience diff aligns, then, in what it leaves
    (blocks in another order, repeated lines), every shortest run of
    ``min_words`` words that the earlier document has too. ``pairs``: (words,
    lines of the later document, lines of the earlier one) for each line both have."""
    import numpy as np
    import xxhash

    words = [p[0] for p in pairs]
    a = sorted((i, k) for k, p in enumerate(pairs) for i in p[1])
    b = sorted((j, k) for k, p in enumerate(pairs) for j in p[2])
    blocks = []  # lists of positions in a
    before = None
    for i, j in _patience([k for _, k in a], [k for _, k in b]):
        if before and a[i][0] == a[before[0]][0] + 1 and b[j][0] == b[before[1]][0] + 1:
            blocks[-1].append(i)
        else:
            blocks.append([i])
        before = i, j
    found = [x for x in blocks if sum(words[a[i][1]] for i in x) >= min_words]
    ranges = [(a[x[0]][0], a[x[-1]][0]) for x in found]

    def runs(lines):
        """(digest, first line, last line) of each shortest run in stretches of neighbouring lines."""
        cuts = [0, *(i for i in range(1, len(lines)) if lines[i][0] != lines[i - 1][0] + 1), len(lines)]
        for lo, hi in zip(cuts, cuts[1:]):
            ids = np.array([k for _, k in lines[lo:hi]], np.int32).tobytes()
            for first, last in spans([words[k] for _, k in lines[lo:hi]], min_words):
                yield xxhash.xxh64_intdigest(ids[4 * first:4 * last + 4]), lines[lo + first][0], lines[lo + last][0]

    gone = {i for x in found for i in x}
    left = list(runs([x for i, x in enumerate(a) if i not in gone]))
    if left:
        there = {run for run, _, _ in runs(b)}
        ranges += [(first, last) for run, first, last in left if run in there]
    return sorted(ranges)


def _covered(batches):
    """(doc, hits: (owner, first, last) of each run, lines) -> one row for each
    owner and each line in its runs: doc, owner, hash, words, later_at."""
    import pyarrow as pa

    for batch in batches:
        hits, owners, at_doc, at_owner, lines = batch.column(1).to_pylist(), batch.column(1).flatten().field(0), [], [], []
        start = 0

        def made():
            return pa.record_batch([batch.column(0).take(pa.array(at_doc, pa.int64())), owners.take(pa.array(at_owner, pa.int64())),
                                    pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int32()),
                                    pa.array([x[2] for x in lines], pa.list_(pa.int32()))],
                                   names=["doc", "owner", "hash", "words", "later_at"])

        for row, found in enumerate(hits):
            known = batch.column(2)[row].as_py()
            number = {i: k for k, x in enumerate(known) for i in x["at"]}
            parts: dict[tuple, tuple[int, list]] = {}
            for i, hit in enumerate(found):
                parts.setdefault(tuple(hit["owner"].values()), (start + i, []))[1].append((hit["first"], hit["last"]))
            start += len(found)
            for where, ranges in parts.values():
                at: dict[int, list[int]] = {}
                after = 0
                for first, last in sorted(ranges):
                    for i in range(max(first, after), last + 1):
                        at.setdefault(number[i], []).append(i)
                    after = max(after, last + 1)
                for k, numbers in at.items():
                    at_doc.append(row)
                    at_owner.append(where)
                    lines.append((known[k]["hash"], known[k]["words"], numbers))
            if len(lines) >= 100_000:
                yield made()
                at_doc, at_owner, lines = [], [], []
        yield made()


def deletions(profile: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, ranges, owners): merged ranges of non-blank line numbers to delete
    from each later document, and the ids of the documents they came from.
    A pair is aligned on the lines of the runs that the owner owns, so that rows
    grow with the lines, however many owners a document has. ``profile`` is
    read several times: write it out before."""
    runs = profile.select("doc", F.inline("runs"))
    owned = (runs.groupBy("run").agg(F.min("doc").alias("owner"), F.max("doc").alias("last_doc"))
             .where("owner != last_doc").select("run", "owner"))
    hits = cut(runs.join(owned, "run").where("doc != owner")
               .groupBy("doc").agg(F.collect_set(F.struct("owner", "first", "last")).alias("hits")))
    kind = profile.schema["doc"].dataType.simpleString()
    later = hits.join(profile.select("doc", "lines"), "doc").mapInArrow(
        _covered, f"doc {kind}, owner {kind}, hash bigint, words int, later_at array<int>")
    earlier = (hits.select(F.explode("hits.owner").alias("doc")).distinct().join(profile.select("doc", "lines"), "doc")
               .select(F.col("doc").alias("owner"), F.explode("lines").alias("line"))
               .select("owner", "line.hash", F.col("line.at").alias("earlier_at")))
    both = (later.join(earlier, ["owner", "hash"]).groupBy("doc", "owner")
            .agg(F.collect_list(F.struct("words", "later_at", "earlier_at")).alias("shared")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [aligned(sorted((x["words"], x["later_at"], x["earlier_at"]) for x in shared.as_py()), min_words)
                     for shared in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array([[{"first": a, "last": b} for a, b in f] for f in found],
                                            pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                                  names=["doc", "owner", "ranges"])

    cuts = both.mapInArrow(run, f"doc {kind}, owner {kind}, ranges array<struct<first:int,last:int>>")
    return (cuts.where(F.size("ranges") > 0).groupBy("doc")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"),
                 F.array_sort(F.collect_set("owner._id")).alias("owners")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text column replaced by what is left of it, and three
    more columns: n_lines (non-blank lines before), n_deleted, owners (ids of
    the earlier documents that keep the deleted blocks).

    Lines are compared without white space at their ends; blank lines don't
    interrupt a block, and go with it. Texts from which nothing is deleted stay
    as they are, null and empty ones too; one that loses every line becomes
    empty. Rows that agree in id and text are one document repeated: they get
    equal results. Other columns pass through (existing columns n_lines,
    n_deleted and owners are replaced); an empty table gives no rows.
    """
    profile = cut(profiles(docs, min_words, id_col, text_col))
    found = cut(deletions(profile, min_words).select("doc._id", "doc._hash", "doc._bytes", "ranges", "owners"))
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *row_key(text_col, id_col))
    same = marked["_id"].eqNullSafe(found["_id"]) & (marked["_hash"] == found["_hash"]) & (marked["_bytes"] == found["_bytes"])
    joined = marked.join(found, same, "left").select("row", "ranges", "owners")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, total, gone = [], [], []
            for text, ranges in zip(batch.column(0), batch.column(1)):
                text, ranges, number, dropped, out = text.as_py(), ranges.as_py() or [], 0, 0, []
                lines = (text or "").split("\n")
                at, inside = 0, False
                for line in lines:
                    if not line.encode("utf-8", "replace").split():
                        if not inside:
                            out.append(line)
                        continue
                    while at < len(ranges) and ranges[at]["last"] < number:
                        at += 1
                    inside = at < len(ranges) and ranges[at]["first"] <= number
                    number += 1
                    if inside:
                        dropped += 1
                    else:
                        out.append(line)
                texts.append(text if not dropped else "\n".join(out))
                total.append(number)
                gone.append(dropped)
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()),
                                   *batch.columns[2:]], names=["text", "n_lines", "n_deleted", "owners", *batch.schema.names[3:]])

    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_deleted", "owners")]
    ranges = F.transform(F.col("ranges"), lambda r: r)
    flat = joined.select(F.col("row")[text_col].cast("string").alias("text"), ranges.alias("ranges"),
                         F.coalesce("owners", F.array().cast(found.schema["owners"].dataType)).alias("owners"),
                         *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(rest)])
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    made = flat.mapInArrow(run, ", ".join(["text string", "n_lines int", "n_deleted int",
                                           f"owners {found.schema['owners'].dataType.simpleString()}", *kinds]))
    names = {c: f"c{i}" for i, c in enumerate(rest)}
    return made.select(*[F.col("text" if c == text_col else names[c]).alias(c) for c in docs.columns
                         if c == text_col or c in names], "n_lines", "n_deleted", "owners")
