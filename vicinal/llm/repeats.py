"""Repeated byte strings across a collection, by column-wise construction of its Burrows-Wheeler transform.

Every byte covered by an n-byte string that also starts elsewhere is found, in whole texts, exactly:

1. Alignment. Each n-byte window has an anchor: the k-byte string with the least hash in it (the last, on ties). Equal
   windows have equal anchors at equal offsets, so a window can only be repeated among the contexts of its anchor. Anchors
   that occur once end here; with k = 64 that is nearly all of a clean text.
2. Equal contexts collapse to one document with a count. A context that occurs twice is repeated as a whole. Equality is
   that of two 64-bit hashes together, the anchor's and the context's.
3. The other contexts of an anchor form a collection, aligned on the anchor. Column by column from the right, one symbol
   per document is inserted: the documents' order by their suffixes is the previous order, stably sorted by the inserted
   symbols, which are that column of the collection's transform; common prefixes with the neighbour in that order grow by
   one where the symbols agree, and are otherwise taken as the least over the documents in between. Columns are read from,
   and marks written to, sequential files in the task's temporary folder, which go when the task ends.
4. A window is repeated if its common prefix with a neighbour reaches n. Marks go back to all occurrences of a context.

An anchor with more than ``hot`` different contexts (a short text that stands everywhere) is no collection of one task:
its windows are dealt by where the anchor lies in them, ``NARROW`` places together, and by all the bytes that these have in
common, so only windows that share nearly n bytes still meet.

This departs from the plain column-wise construction, which inserts a symbol a document and round over whole texts, and so
takes as many rounds over all files as the longest text has bytes: here the rounds are over aligned contexts of at most
2 n - k bytes, only the current column's part of the transform is kept, and that with the common prefixes in memory.

Defined results: a null text is empty. Texts under n bytes have no window. Matches never cross documents. Rows that
share a doc_id must be copies of each other, and count as several occurrences; a null doc_id is an id of its own. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, powers, prefix_hash, table

_DOC = "coalesce(doc_id, 9223372036854775807L)"
_FAR = np.uint64(0xFFFFFFFF)
#: Places of the anchor in a window that are dealt together, under an anchor with many contexts.
NARROW = 42
BITES = "g long, a long, c long, base int, off int, bytes binary"


def anchors(data: np.ndarray, offsets: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """For a block of texts: text, anchor position, first and last window start, anchor hash, context hash.

    Positions are relative to the block. Each window start of each text belongs to exactly one row.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    size = len(data)
    if size < n:
        return none
    p = prefix_hash(data)
    _, inv = powers(size + 1)
    wide = n - k + 1
    h = mix((p[k:] - p[:-k]) * inv[: size - k + 1])
    key = (h & ~_FAR) | (_FAR - np.arange(len(h), dtype=np.uint64))
    pad = -len(key) % wide
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = size - n + 1
    at = (_FAR - (np.minimum(back[:m], ahead[wide - 1 : wide - 1 + m]) & _FAR)).astype(np.int64)
    del grid, ahead, back, key
    ok = np.zeros(m, bool)
    text = np.zeros(m, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a >= n:
            ok[a : b - n + 1] = True
            text[a : b - n + 1] = i
    s = np.flatnonzero(ok)
    if not len(s):
        return none
    q, t = at[s], text[s]
    new = np.ones(len(s), bool)
    new[1:] = (q[1:] != q[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    lo, hi, q = s[first], s[last], q[first]
    whole = (p[hi + n] - p[lo]) * inv[lo]
    context = mix(mix(whole) + (q - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    return t[first], q, lo, hi, h[q], context


def _anchored(n: int, k: int):
    """One row per document and context: its anchor, and all its first and last window starts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                t, _, lo, hi, a, c = anchors(data, offsets, n, k)
                by = np.lexsort((c, t))
                t, lo, hi, a, c = t[by], lo[by], hi[by], a[by], c[by]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
                at = np.flatnonzero(new)
                cuts = pa.array(np.append(at, len(t)).astype(np.int32))
                starts, ends = (pa.ListArray.from_arrays(cuts, pa.array((x - offsets[t]).astype(np.int32))) for x in (lo, hi))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + t[at])), pa.array(a[at].view(np.int64)), pa.array(c[at].view(np.int64)), starts, ends], ["doc", "a", "c", "lo", "hi"])

    return run


def _contexts(n: int, k: int):
    """From (doc, text, wanted contexts) the bytes of each wanted context, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [set(w or ()) for w in batch.column(2).to_pylist()]
            for first, data, offsets in blocks(batch.column(1)):
                t, q, lo, hi, a, c = anchors(data, offsets, n, k)
                c = c.view(np.int64)
                keep = []
                for i, (x, y) in enumerate(zip(t.tolist(), c.tolist())):
                    if y in wanted[first + x]:
                        wanted[first + x].discard(y)
                        keep.append(i)
                keep = np.array(keep, np.int64)
                raw = data.tobytes()
                bites = [raw[b : e + n] for b, e in zip(lo[keep].tolist(), hi[keep].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)[keep]), pa.array(c[keep]), pa.array((q - lo)[keep].astype(np.int32)), pa.array(bites, pa.binary())], ["a", "c", "off", "bytes"])

    return run


def _narrowed(n: int):
    """Contexts of anchors with many of them, cut by where the anchor lies in the windows; ``base`` is the first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for a, c, off, raw in zip(*(x.to_pylist() for x in batch.columns)):
                last = len(raw) - n  # window w has the anchor at off - w
                for near in range(max(0, off - last) // NARROW, off // NARROW + 1):
                    first, end = max(0, off - near * NARROW - NARROW + 1), min(last, off - near * NARROW)
                    if first > end:
                        continue
                    shared = raw[off - near * NARROW : off - near * NARROW - NARROW + 1 + n]
                    key = hashlib.blake2b(a.to_bytes(8, "little", signed=True) + bytes([near]) + shared, digest_size=8).digest()
                    for to, x in zip(out, (int.from_bytes(key, "little", signed=True), a, c, first, off - first, raw[first : end + n])):
                        to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["g", "a", "c", "base", "off", "bytes"])

    return run


class Columns:
    """Aligned documents in sequential files, one file a block of documents, last column first."""

    BLOCK = 1 << 14

    def __init__(self, width: int):
        self.width, self.files, self.rows = width, [], []

    def add(self, bites: list[bytes], begins: np.ndarray) -> None:
        for at in range(0, len(bites), self.BLOCK):
            part = bites[at : at + self.BLOCK]
            grid = np.zeros((len(part), self.width), np.uint8)
            for row, b, x in zip(grid, begins[at:].tolist(), part):
                row[b : b + len(x)] = np.frombuffer(x, np.uint8)
            f = tempfile.TemporaryFile()
            f.write(np.ascontiguousarray(grid[:, ::-1].T).tobytes())
            f.seek(0)
            self.files.append(f)
            self.rows.append(len(part))

    def __iter__(self) -> Iterator[np.ndarray]:
        for _ in range(self.width):
            yield np.concatenate([np.frombuffer(f.read(r), np.uint8) for f, r in zip(self.files, self.rows)])

    def close(self) -> None:
        for f in self.files:
            f.close()


def repeated_starts(group: np.ndarray, bites: list[bytes], offs: np.ndarray, n: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, window offsets from its context's start) of windows that another document of its group has too.

    ``group`` is sorted; ``offs`` is where each context has its anchor. Columns count from the farthest window start.
    """
    m, wide = len(bites), n - k + 1
    begins = (wide - 1) - offs
    ends = begins + np.array([len(x) for x in bites])
    columns = Columns(wide - 1 + n)
    marks = tempfile.TemporaryFile()
    try:
        columns.add(bites, begins)
        order = np.arange(m)
        common = np.zeros(m + 1, np.int32)  # of each document in the order with the one before; an end mark
        base = group.astype(np.int64) << 9
        for j, symbols in zip(range(columns.width - 1, -1, -1), columns):
            here = (begins <= j) & (j < ends)
            key = base + np.where(here, symbols, 256)
            key = key[order]  # the transform's column, in the order of the suffixes to its right
            by = np.argsort(key, kind="stable")
            order, key = order[by], key[by]
            same = np.flatnonzero((key[1:] == key[:-1]) & here[order[1:]])
            grown = np.zeros(m + 1, np.int32)
            if len(same):
                spans = np.stack([by[same] + 1, by[same + 1] + 1], axis=1).ravel()
                grown[same + 1] = np.minimum.reduceat(common, spans)[::2] + 1
            common = grown
            if j < wide:
                mark = np.zeros(m, np.uint8)
                mark[order] = np.maximum(common[:m], common[1:]) >= n
                marks.write(np.packbits(mark).tobytes())
        row = (m + 7) // 8
        for at in range(0, m, 1 << 12):  # the marks of some documents at a time, columns in rising order
            some = slice(at // 8, (min(at + (1 << 12), m) + 7) // 8)
            part = np.zeros((wide, some.stop - some.start), np.uint8)
            for j in range(wide):
                marks.seek((wide - 1 - j) * row + some.start)
                part[j] = np.frombuffer(marks.read(part.shape[1]), np.uint8)
            bits = np.unpackbits(part, axis=1)
            for i in range(at, min(at + (1 << 12), m)):
                found = np.flatnonzero(bits[:, i - at]) - begins[i]
                if len(found):
                    yield i, found
    finally:
        columns.close()
        marks.close()


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.append(0, cut + 1)].tolist(), x[np.append(cut, len(x) - 1)].tolist()


def _marked(n: int, k: int, most: int = 1 << 14):
    """From contexts sorted by group, the runs of repeated windows of each."""

    def flush(g: list[int], a: list[int], c: list[int], base: list[int], off: list[int], bites: list[bytes]) -> pa.RecordBatch:
        group = np.cumsum(np.append(0, np.diff(np.array(g)) != 0))
        rows = [(a[i], c[i], *_runs(s + base[i])) for i, s in repeated_starts(group, bites, np.array(off), n, k)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["a", "c", "b", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = tuple([] for _ in range(6))
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(held[0]) >= most and row[0] != held[0][-1]:
                    yield flush(*held)
                    held = tuple([] for _ in range(6))
                for to, x in zip(held, row):
                    to.append(x)
        if held[0]:
            yield flush(*held)

    return run


def _applied(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, spans_b, spans_e, kept = [], [], [], []
            starts, stops = batch.column(2), batch.column(3)
            texts = batch.column(1).fill_null("")
            for i in range(batch.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                size.append(len(raw))
                b = np.array(starts[i].as_py() or [], np.int64)
                e = np.array(stops[i].as_py() or [], np.int64)
                by = np.argsort(b, kind="stable")
                b, e = b[by], np.maximum.accumulate(e[by]) + n if len(b) else e
                new = np.ones(len(b), bool)
                new[1:] = b[1:] > e[:-1]
                at = np.flatnonzero(new)
                b, e = b[at], e[np.append(at[1:], len(e)) - 1] if len(at) else e
                spans_b.append(b)
                spans_e.append(e)
                edges = [0, *np.stack([b, e], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(spans_b, pa.list_(pa.int64())), pa.array(spans_e, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "starts", "ends", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, n: int = 400, k: int = 64, hot: int = 4096) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, starts and ends of removed runs, kept bytes."""
    texts = docs.select("doc_id", "text", F.expr(_DOC).alias("doc"))
    found = table(texts.select("doc", "text").mapInArrow(_anchored(n, k), "doc long, a long, c long, lo array<int>, hi array<int>"), "anchors")
    again = table(found.groupBy("a").agg(F.sum(F.size("lo")).alias("n")).where("n > 1").select("a"), "repeated")
    occurrences = table(found.join(again, "a", "left_semi").select("doc", "a", "c", "lo", "hi"), "occurrences")
    kinds = table(occurrences.groupBy("a", "c").agg(F.sum(F.size("lo")).alias("copies"), F.min("doc").alias("doc")), "contexts")
    mixed = table(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1"), "mixed")
    wanted = kinds.join(mixed.select("a"), "a", "left_semi").groupBy("doc").agg(F.collect_list("c").alias("wanted"))
    bites = texts.select("doc", "text").join(wanted.hint("shuffle_hash"), "doc").select("doc", "text", "wanted").mapInArrow(_contexts(n, k), "a long, c long, off int, bytes binary")
    many = mixed.where(F.col("kinds") > hot).select("a")
    whole = [F.col("a").alias("g"), "a", "c", F.lit(0).alias("base"), "off", "bytes"]
    if many.limit(1).count():
        bites = table(bites, "bites")
        cut = bites.join(many, "a", "left_semi").select("a", "c", "off", "bytes").mapInArrow(_narrowed(n), BITES)
        grouped = bites.join(many, "a", "left_anti").select(*whole).union(cut)
    else:
        grouped = bites.select(*whole)
    marks = grouped.repartition("g").sortWithinPartitions("g", "a", "c", "base").mapInArrow(_marked(n, k), "a long, c long, b array<int>, e array<int>")
    marks = table(marks, "marks").groupBy("a", "c").agg(F.flatten(F.collect_list("b")).alias("b"), F.flatten(F.collect_list("e")).alias("e"))
    verdicts = kinds.select("a", "c", "copies").join(marks, ["a", "c"], "left").where("copies > 1 or b is not null")
    ranges = F.expr("if(copies > 1, arrays_zip(lo, hi), transform(arrays_zip(b, e), r -> struct(lo[0] + r.b as lo, lo[0] + r.e as hi)))")
    lists = occurrences.join(verdicts, ["a", "c"]).groupBy("doc").agg(F.flatten(F.collect_list(ranges)).alias("r"))
    lists = lists.select("doc", F.col("r.lo").alias("b"), F.col("r.hi").alias("e"))
    out = texts.join(lists.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "b", "e")
    return out.mapInArrow(_applied(n), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
