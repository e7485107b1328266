"""Long exact spans shared between records: a count-min prefilter, then exact groups.

Every window of ``SPAN`` characters has a smallest k-gram among those inside it, its anchor; equal windows have equal
anchors. The first pass counts anchors (once a document) in a count-min sketch: every partition sends the cells it has
touched, and they are merged by ranges of cells. The estimate is never too low, so the second pass keeps every anchor
held by two documents, and groups exactly only those estimated so. The sketch is as wide as the texts ask for. Where it
is too wide to be sent to every worker, the anchors' 8-byte hashes are counted where the shuffle brings them together,
and texts are read again only for the documents that hold a hash that two have. Nothing shared is lost, and no pair of
documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.operators.skew import join_groups
from quirewright.session import broadcast_if_small, written

SPAN = 160
#: Characters of an anchor; a window holds SPAN - ANCHOR + 1 of them.
ANCHOR = 80
#: Rows of the sketch, and the least cells of a row (bits).
DEPTH, LEAST_BITS = 2, 16
#: Bytes of a merged sketch up to which it is sent to every worker.
SKETCH_BYTES = 64 << 20
#: Pairs of document and hash up to which they are broadcast rather than shuffled with the texts.
BROADCAST_PAIRS = 1_000_000
#: Contexts of one anchor that a task compares at once; anchors with more are grouped by window.
GROUPED_AT_ONCE = 256
_CHUNK = 1 << 20
_SHARD_BITS = 20
_FLUSH = 1 << 20


class _Roller:
    """Rolling hashes of all k-grams of up to _CHUNK characters, modulo 2**64."""

    def __init__(self) -> None:
        import numpy as np

        base = 0x9E3779B97F4A7C15
        self.table = np.random.default_rng(20240607).integers(1, 2**64 - 1, 0x110000, np.uint64)
        self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK, base, np.uint64)]))
        self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK, pow(base, -1, 2**64), np.uint64)]))

    def hashes(self, codes, k: int):
        import numpy as np

        n = len(codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[codes] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _sliding_min(x, w: int):
    import numpy as np

    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width : w - width + len(x) - w + 1]) if width < w else out


def _pieces(texts: list[str | None], span: int, chunk: int) -> Iterator[list[tuple[int, int, str]]]:
    """(index, offset, piece of text) in lists of at most ``chunk`` characters; each window lies in exactly one piece."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if not t or len(t) < span:
            continue
        for at in range(0, len(t) - span + 1, chunk - span + 1):
            piece = t[at : at + chunk]
            if some and size + len(piece) > chunk:
                yield some
                some, size = [], 0
            some.append((i, at, piece))
            size += len(piece)
    if some:
        yield some


def _anchored(roller: _Roller, pieces: list[tuple[int, int, str]], span: int, k: int):
    """Anchors of all windows: hash, piece, first window in the piece, number of windows, place of the anchor."""
    import numpy as np

    codes = np.frombuffer("".join(p for _, _, p in pieces).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(lengths) - lengths
    h = roller.hashes(codes, k)
    n = len(codes) - span + 1
    low = np.uint64(_CHUNK * 2 - 1)
    ordered = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(ordered, span - k + 1)[:n] & low).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    whole = owner[:n] == owner[span - 1 : span - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1]) | (whole[1:] != whole[:-1])
    firsts = np.flatnonzero(new)
    counts = np.diff(np.append(firsts, n))
    good = whole[firsts]
    firsts, counts = firsts[good], counts[good]
    at = anchor[firsts]
    piece = owner[firsts]
    return h[at], piece, firsts - begins[piece], counts, at - begins[piece]


def _cells(h, bits: int):
    import numpy as np

    mask = np.uint64((1 << bits) - 1)
    return [(h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)]


def _once(roller: _Roller, texts: list[str | None], span: int, k: int, chunk: int) -> Iterator:
    """(index of the text, anchor hash), each pair once a piece of text."""
    import numpy as np

    for pieces in _pieces(texts, span, chunk):
        h, piece, *_ = _anchored(roller, pieces, span, k)
        if len(h):
            doc = np.array([i for i, _, _ in pieces])[piece]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            yield doc[new], h[new]


def _sketcher(span: int, k: int, bits: int, chunk: int):
    """Cells that a partition touches, in rows (r, shard, cells): offsets in the shard times two, plus one if touched twice."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        roller, held, size = _Roller(), [], 0

        def flushed():
            rows, shards, packed = [], [], []
            for r, cells in enumerate(_cells(np.concatenate(held), bits)):
                cell, count = np.unique(cells, return_counts=True)
                shard = cell >> _SHARD_BITS
                words = (((cell & ((1 << _SHARD_BITS) - 1)) << 1) | (count > 1)).astype("<u4")
                at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                for x, y in zip(at, np.append(at[1:], len(cell)), strict=True):
                    rows.append(r)
                    shards.append(int(shard[x]))
                    packed.append(words[x:y].tobytes())
            return pa.record_batch([pa.array(rows, pa.int32()), pa.array(shards, pa.int64()), pa.array(packed, pa.binary())], names=["r", "shard", "cells"])

        for b in batches:
            for _, h in _once(roller, b.column(1).to_pylist(), span, k, chunk):
                held.append(h)
                size += len(h)
                if size >= _FLUSH:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return run


def _merge(shard: pd.DataFrame) -> pd.DataFrame:
    """Bitmap of the cells of a shard that are touched twice in one sketch or in two of them."""
    import numpy as np

    count = np.zeros(1 << _SHARD_BITS, np.uint8)
    for packed in shard["cells"]:
        words = np.frombuffer(packed, "<u4")
        at = words >> 1
        count[at] = np.minimum(count[at] + 1 + (words & 1), 2)
    return pd.DataFrame({"r": [shard["r"].iloc[0]], "shard": [shard["shard"].iloc[0]], "two": [np.packbits(count == 2).tobytes()]})


def repeated_cells(docs: DataFrame, span: int, k: int, bits: int, chunk: int = _CHUNK) -> list[bytes]:
    """The merged sketch, as one bitmap per row of the cells that count two or more.

    Its size is set by ``bits`` alone (DEPTH * 2**bits / 8 bytes). A partition sends at most four bytes per row and
    anchor; a shard has 2**20 cells, so with four cells or more per anchor few of them, wherever they come from.
    """
    import numpy as np

    sketches = docs.mapInArrow(_sketcher(span, k, bits, chunk), "r INT, shard BIGINT, cells BINARY")
    merged = sketches.groupBy("r", "shard").applyInPandas(_merge, "r INT, shard BIGINT, two BINARY").collect()
    maps = [np.zeros(max(1 << bits, 1 << _SHARD_BITS) // 8, np.uint8) for _ in range(DEPTH)]
    for r, shard, two in merged:
        at = shard << _SHARD_BITS - 3
        maps[r][at : at + len(two)] = np.frombuffer(two, np.uint8)
    return [m.tobytes() for m in maps]


_ANCHORS = "key BINARY, context BINARY, doc_id BIGINT, pos BIGINT, windows INT, text STRING"


def _keeper(maps, span: int, k: int, bits: int, chunk: int):
    """Anchors to group exactly, with the text of their windows.

    With ``maps``, those that the sketch estimates to stand in two documents; without, those among the row's own hashes.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        roller, bitmaps = _Roller(), [np.frombuffer(m, np.uint8) for m in maps.value] if maps is not None else []
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for pieces in _pieces(b.column(1).to_pylist(), span, chunk):
                h, piece, first, count, at = _anchored(roller, pieces, span, k)
                keep = np.ones(len(h), bool)
                for m, cells in zip(bitmaps, _cells(h, bits), strict=False):
                    keep &= (m[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                if maps is None:
                    signed = h.view(np.int64)
                    for p, (i, _, _) in enumerate(pieces):
                        of = slice(*np.searchsorted(piece, [p, p + 1]))
                        keep[of] = np.isin(signed[of], b.column(2)[i].values.to_numpy(zero_copy_only=False))
                for x in np.flatnonzero(keep).tolist():
                    i, offset, text = pieces[piece[x]]
                    f, c, a = int(first[x]), int(count[x]), int(at[x])
                    part = text[f : f + c - 1 + span]
                    out.append((digest(text[a : a + k].encode()), digest(part.encode()), ids[i], offset + f, c, part))
            if out:
                key, context, doc, pos, n, text = zip(*out, strict=True)
                yield pa.record_batch(
                    [pa.array(key, pa.binary()), pa.array(context, pa.binary()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string())],
                    names=["key", "context", "doc_id", "pos", "windows", "text"],
                )

    return run


def _hasher(span: int, k: int, chunk: int):
    """(h, doc_id) of all anchors, once a piece of text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        roller = _Roller()
        for b in batches:
            for doc, h in _once(roller, b.column(1).to_pylist(), span, k, chunk):
                yield pa.record_batch([pa.array(h.view(np.int64)), b.column(0).take(pa.array(doc))], names=["h", "doc_id"])

    return run


def _by_counted_hashes(rows: DataFrame, span: int, k: int, chunk: int) -> DataFrame:
    """The anchors to group exactly, found without a sketch that every worker holds.

    Hashes are counted with partial sums; the pairs of document and repeated hash are joined with the texts. Only
    hashes and ids are shuffled, and the texts of documents with a repeated hash if there are too many pairs to broadcast.
    """
    hashes = written(rows.mapInArrow(_hasher(span, k, chunk), "h BIGINT, doc_id BIGINT"), "hashes")
    counts = written(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated_hashes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = broadcast_if_small(counts, BROADCAST_PAIRS)
    pairs = join_groups(hashes, counts, ["h"], "n", total) if few is counts else hashes.join(few, "h")
    lists = pairs.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))
    if total <= BROADCAST_PAIRS:
        lists = F.broadcast(lists)
    return rows.join(lists, "doc_id").select("doc_id", "text", "hashes").mapInArrow(_keeper(None, span, k, 0, chunk), _ANCHORS)


def _comparer(span: int):
    """Runs of shared windows of each context, from partitions sorted by anchor: (context, n, low, high)."""

    def runs(group: list[dict]) -> Iterator[tuple]:
        import xxhash

        seen: dict[bytes, list[int]] = {}
        digests = []
        for c in group:
            wide = c["text"].encode("utf-32-le")
            digests.append([xxhash.xxh3_128_digest(wide[4 * j : 4 * (j + span)]) for j in range(c["windows"])])
            for d in digests[-1]:
                bounds = seen.setdefault(d, [c["a"], c["z"]])
                bounds[0], bounds[1] = min(bounds[0], c["a"]), max(bounds[1], c["z"])
        shared = {d for d, (a, z) in seen.items() if a != z}
        for c, own in zip(group, digests, strict=True):
            low = None
            for j, d in enumerate([*own, None]):
                if d in shared:
                    low = j if low is None else low
                elif low is not None:
                    yield c["context"], c["n"], low, j - 1
                    low = None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(found: list[tuple]):
            context, n, low, high = zip(*found, strict=True)
            return pa.record_batch(
                [pa.array(context, pa.binary()), pa.array(n, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["context", "n", "low", "high"]
            )

        group: list[dict] = []
        for b in batches:
            found = []
            for row in b.to_pylist():
                if group and row["key"] != group[0]["key"]:
                    found += runs(group)
                    group = []
                group.append(row)
            if found:
                yield out(found)
        if group and (found := list(runs(group))):
            yield out(found)

    return run


def _windows(span: int):
    """Every window of a context, by its 128-bit hash, with the documents that the context stands in."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in batches:
            keys, rows, offsets = [], [], []
            for r, (n, text) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                wide = text.encode("utf-32-le")
                keys += [xxhash.xxh3_128_digest(wide[4 * j : 4 * (j + span)]) for j in range(n)]
                rows += [r] * n
                offsets += range(n)
            if keys:
                at = pa.array(rows, pa.int64())
                columns = [pa.array(keys, pa.binary()), *(b.column(c).take(at) for c in range(3)), pa.array(offsets, pa.int32())]
                yield pa.record_batch(columns, names=["key", "context", "a", "z", "offset"])

    return run


def _in_two(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, n) of the keys that stand in two documents or more, written, and how many rows they have in all.

    ``rows`` has the key and the first and last document ``a`` and ``z`` it stands in.
    """
    groups = rows.groupBy(key).agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.where("a <> z").select(key, "n"), "repeated")
    return groups, groups.agg(F.sum("n")).first()[0] or 0


def shared_runs(
    docs: DataFrame, doc_id: str, text: str, span: int = SPAN, bits: int | None = None, chunk: int = _CHUNK, sketch_bytes: int = SKETCH_BYTES, grouped: int = GROUPED_AT_ONCE
) -> DataFrame:
    """(doc_id, first, last): runs of windows of ``span`` code points that also stand in another document.

    A window is named by the place of its first character; a document's runs cover all its shared windows, one run or
    more for a stretch. The text around an anchor, its context, is what copies have in common, so equal contexts are
    counted once, and only where one anchor has several contexts are their windows compared one by one.

    ``bits`` sets the width of the sketch; by default four to eight cells per anchor, counted from the characters of
    all texts. A sketch of more than ``sketch_bytes`` is not built: hashes are counted in its place. Neither these
    nor ``grouped``, the contexts of one anchor that a task compares at once, change the result.
    Texts that are null or shorter than the span have no window. Rows that repeat an id count as one document.
    ``chunk`` is how many characters a worker hashes at a time (2**20 at most); longer texts are taken in pieces.
    """
    k = span // 2
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= span)
    if bits is None:
        characters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        cells = 8 * 2 * characters // (span - k + 2)
        bits = max(LEAST_BITS, int(cells).bit_length() - 1)
    if DEPTH * (1 << bits) // 8 <= sketch_bytes:
        maps = docs.sparkSession.sparkContext.broadcast(repeated_cells(rows, span, k, bits, chunk))
        anchors = rows.mapInArrow(_keeper(maps, span, k, bits, chunk), _ANCHORS)
    else:
        anchors = _by_counted_hashes(rows, span, k, chunk)
    anchors = written(anchors, "anchors")

    contexts = anchors.groupBy("key", "context").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"), F.first("text").alias("text")
    )
    contexts = written(contexts, "contexts")
    held = contexts.groupBy("key").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.count(F.lit(1)).alias("held"))
    held = written(held.where("a <> z").select("key", "held"), "held")
    whole = contexts.join(held.where("held = 1"), "key").select("context", "n", F.lit(0).alias("low"), (F.col("windows") - 1).alias("high"))

    some = contexts.join(held.where((F.col("held") > 1) & (F.col("held") <= grouped)).select("key"), "key").repartition("key").sortWithinPartitions("key")
    compared = some.mapInArrow(_comparer(span), "context BINARY, n BIGINT, low INT, high INT")

    many = held.where(F.col("held") > grouped)
    total = many.agg(F.sum("held")).first()[0] or 0
    shared = whole.union(compared)
    if total:
        shared = shared.union(_shared_windows(contexts, many, total, span))
    shared = written(shared.groupBy("context").agg(F.max("n").alias("n"), F.collect_set(F.struct("low", "high")).alias("runs")), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    found = join_groups(anchors.select("context", "doc_id", "pos"), shared, ["context"], "n", total)
    return found.select("doc_id", "pos", F.explode("runs").alias("r")).select(
        "doc_id", (F.col("pos") + F.col("r.low")).alias("first"), (F.col("pos") + F.col("r.high")).alias("last")
    )


def _shared_windows(contexts: DataFrame, keys: DataFrame, total: int, span: int) -> DataFrame:
    """(context, n, low, high) for anchors of very many contexts: every window by itself, grouped by its hash."""
    varied = join_groups(contexts.select("key", "context", "a", "z", "windows", "text"), keys, ["key"], "held", total)
    windows = varied.select("context", "a", "z", "windows", "text").mapInArrow(_windows(span), "key BINARY, context BINARY, a BIGINT, z BIGINT, offset INT")
    windows = written(windows, "windows")
    groups, total = _in_two(windows, "key")
    offsets = join_groups(windows.select("key", "context", "offset"), groups, ["key"], "n", total)
    # at most SPAN // 2 + 1 offsets a context: whole stretches of them
    step = F.transform("o", lambda x, i: x - i)
    some = offsets.groupBy("context").agg(F.array_sort(F.collect_set("offset")).alias("o")).withColumn("s", F.arrays_zip("o", step.alias("g")))
    runs = some.select("context", F.explode("s").alias("s")).groupBy("context", F.col("s.g").alias("g")).agg(F.min("s.o").alias("low"), F.max("s.o").alias("high"))
    return runs.join(contexts.select("context", "n").distinct(), "context").select("context", "n", "low", "high")


def shared_spans(runs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, span_start, span_length): the stretches that the shared runs of a document cover, merged."""
    by_doc = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") - before > span, F.lit(False)).cast("int")
    islands = runs.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by_doc))
    spans = islands.groupBy("doc_id", "island").agg(F.min("first").alias("span_start"), F.max("last").alias("last"))
    return spans.select("doc_id", "span_start", (F.col("last") - F.col("span_start") + span).alias("span_length"))


def shared_parts(docs: DataFrame, doc_id: str, text: str, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, spans) of every document: how much of it stands elsewhere too."""
    sums = spans.groupBy("doc_id").agg(F.sum("span_length").alias("shared_chars"), F.count(F.lit(1)).alias("spans"))
    size = F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), size)
    zero = F.lit(0).cast("bigint")
    out = rows.join(sums, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", zero).alias("shared_chars"), F.coalesce("spans", zero).alias("spans"))
    return out.withColumn("shared_share", F.coalesce(F.col("shared_chars") / F.nullif("n_chars", zero), F.lit(0.0)))
