"""Removal of every byte under a long string that stands elsewhere too, exactly.

1. Fragments. Each start of a ``length``-byte string (a window) is filed under the
   least hash of the GRAM-byte strings in it. Equal windows have equal such anchors,
   wherever they stand. A run of neighbouring starts with one anchor is a fragment;
   every window is in just one fragment. Texts are scanned once.
2. An anchor met in one fragment alone can't hold a repeated window, unless the fragment
   repeats itself, and goes.
3. The distinct fragments under an anchor meet with their bytes, each with the number of
   its occurrences, and a suffix array finds the windows they share: two-stage sorting
   (only suffixes smaller than their successors are compared, the others are induced by
   bucket scans), then the common prefixes of neighbours. A window is repeated if the
   occurrences of all fragments with it, in a run of neighbours whose common prefixes are
   long enough, are two or more: so the arrays decide on copies of whole texts as well.
4. An anchor with more than HOT distinct fragments would be too much for one task: its
   fragments are cut again by a second anchor, of other hashes. What lies within a common
   passage is then cut alike in all of them and becomes one. Under a pair of anchors that is still
   too much, windows are counted one by one, pre-aggregated.
5. Spans, merged within a fragment, go back to all its occurrences, and to the texts by the
   texts' 128-bit hash.

Fragments are told apart by 128 bits (anchor and fragment hash), lone windows of step 4 by 192;
suffix arrays compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import TEXTS, Scratch, cut, mix, named, prefix_hash, sized, slices, span_hash, tidied

GRAM = 24
#: Starts in a fragment at most.
RUN = 256
#: Distinct fragments of an anchor that one suffix array takes; bytes in one suffix array, about.
HOT, ARRAY_BYTES = 4096, 1 << 19
#: A text is scanned in pieces of so many bytes, overlapping by a window.
PIECE = 1 << 19
#: Texts whose fragments are cut out at a time.
CUT = 256
SEPARATOR = 255  # never in UTF-8
#: Turn bytes and hashes into others.
ODD, SECOND = np.uint8(0x5B), np.uint64(0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """m[i] = min(x[i : i + width]) for each full window."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have :]) if have < width else m


def fragments(data: np.ndarray, at: np.ndarray, length: int, *, second: bool = False) -> tuple[np.ndarray, ...]:
    """(row, start, run, anchor, hash, again) of the fragments of concatenated texts; start counts from the row's text.

    second: by other hashes.

    again: the fragment may hold a window twice. Of two equal windows in it, the first
    holds its first anchor before the other begins, and the second its last anchor past
    the first's end: the anchor starts a window and ends a window, at two places.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    gram = min(GRAM, length)
    prefix = prefix_hash(data)
    begin = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, begin, begin + gram)
    grams = mix(grams ^ SECOND) if second else grams
    anchor = sliding_min(grams, length - gram + 1)
    del begin
    n = len(anchor)
    first, last = np.flatnonzero(grams[:n] == anchor), np.flatnonzero(grams[length - gram :] == anchor)
    del grams
    size = np.diff(at)
    # starts whose window lies within one text
    step = np.zeros(n + 1, np.int64)
    fits = size >= length
    np.add.at(step, at[:-1][fits], 1)
    np.add.at(step, np.minimum(at[1:][fits] - length + 1, n), -1)
    valid = np.cumsum(step[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    starts = at[:-1][fits]
    new[starts] = True
    cuts = np.flatnonzero(new)
    ends = np.append(cuts[1:], n)
    keep = valid[cuts]
    cuts, ends = cuts[keep], ends[keep]
    parts = -(-(ends - cuts) // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(cuts, parts) + nth * RUN
    end = np.minimum(begin + RUN, np.repeat(ends, parts))
    row = np.searchsorted(at, begin, "right") - 1
    a, b = np.append(first, n)[np.searchsorted(first, begin)], np.append(-1, last)[np.searchsorted(last, end)]
    again = (a < end) & (b >= begin) & (a != b + length - gram)
    return row, begin - at[row], end - begin, anchor[begin], span_hash(prefix, begin, end + length - 1), again


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As slices(), with a text of over PIECE bytes cut into overlapping pieces: (row, offset in it, bytes, offsets)."""
    for lo, hi, data, at in slices(texts, PIECE):
        if hi - lo > 1 or len(data) <= 2 * PIECE:
            yield lo, 0, data, at
        else:
            for off in range(0, len(data) - length + 1, PIECE):
                part = data[off : off + PIECE + length - 1]
                yield lo, off, part, np.array([0, len(part)])


def types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successors; the end of the text is smaller than all."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[:-1] < t[1:]
    change = np.ones(n, bool)
    change[:-1] = t[:-1] != t[1:]
    at = np.flatnonzero(change)
    return up[np.repeat(at, np.diff(at, prepend=-1))]


def words(t: np.ndarray, depth: int) -> np.ndarray:
    """A view of the eight bytes from every place as one number, zeros after the end."""
    padded = np.zeros(len(t) + depth + 16, np.uint8)
    padded[: len(t)] = t
    return np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))


def sort_directly(who: np.ndarray, word: np.ndarray, equal: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``who`` in the order of their first ``depth`` bytes.

    equal: hashes of the depth bytes from each place; a group with but one is not looked at further.
    """
    key = word[who].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    who, key = who[order], key[order]
    tie = np.zeros(len(who) + 1, bool)
    tie[1:-1] = key[1:] == key[:-1]
    for off in range(8, depth, 8):
        open_ = np.flatnonzero(tie[:-1] | tie[1:])
        if not len(open_):
            break
        group = np.cumsum(~tie[open_])
        if off >= 16:
            h = equal[who[open_]]
            differs = np.zeros(group[-1] + 1, bool)
            differs[group[1:][(h[1:] != h[:-1]) & (group[1:] == group[:-1])]] = True
            stay = differs[group]
            open_, group = open_[stay], group[stay]
            if not len(open_):
                break
        key = word[who[open_] + off].astype(np.uint64)
        order = np.lexsort((key, group))
        who[open_] = who[open_][order]
        key = key[order]
        same = np.zeros(len(open_), bool)
        same[1:] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        # closed groups, equal to the depth, are done
        tie[:] = False
        tie[open_] = same
    return who


def two_stage(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of t in the order of their first ``depth`` bytes at least."""
    n = len(t)
    small = types(t)
    word = words(t, depth)
    padded = np.zeros(n + depth, np.uint8)
    padded[:n] = t
    prefix = prefix_hash(padded)
    begin = np.arange(n)
    direct = sort_directly(np.flatnonzero(small), word, span_hash(prefix, begin, begin + depth), depth)
    del prefix, begin
    first = np.searchsorted(t[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    found: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(scanned: np.ndarray, own: int) -> np.ndarray:
        """Predecessors of scanned suffixes, if greater than them, to their buckets; those of the own bucket come back."""
        p = scanned[scanned > 0] - 1
        p = p[~small[p]]
        back = np.zeros(0, np.int64)
        if not len(p):
            return back
        c = t[p].astype(np.int16)
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        edges = np.flatnonzero(np.diff(c, prepend=-1))
        for lo, hi in zip(edges, np.append(edges[1:], len(p)), strict=True):
            if c[lo] == own:
                back = p[lo:hi]
            else:
                found[c[lo]].append(p[lo:hi])
        return back

    if n and not small[n - 1]:
        found[t[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        wave = np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = direct[first[c] : first[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shared_windows(t: np.ndarray, starts: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each place of t is one of ``starts``, and it and those equal to it occur more than once.

    times: how often what stands at each of the starts occurs.
    """
    weight = np.zeros(len(t), np.int64)
    weight[starts] = times
    order = two_stage(t, length)
    order = order[weight[order] > 0]
    word = words(t, length)
    same = np.arange(len(order) - 1)  # neighbours whose common prefix has come up to here
    for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]:
        same = same[word[order[same] + off] == word[order[same + 1] + off]]
    first = np.ones(len(order), bool)
    first[same + 1] = False
    group = np.cumsum(first) - 1
    out = np.zeros(len(t), bool)
    out[order] = (np.bincount(group, weight[order]) > 1)[group] if len(order) else False
    return out


def merged(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal spans under the windows at ascending places."""
    cuts = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.append(0, cuts + 1)].tolist(), (places[np.append(cuts, len(places) - 1)] + length).tolist(), strict=True)) if len(places) else []


def scan(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, m, start, run, anchor, frag, again) of docs (t1, t2, text). Equal texts of a batch are one that counts m times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            keys, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
            for lo, off, data, at in pieces(batch.column(2).take(pa.array(first)), length):
                row, start, n, anchor, h, again = fragments(data, at, length)
                out = [np.ascontiguousarray(keys[lo + row, 0]), np.ascontiguousarray(keys[lo + row, 1]), times[lo + row], start + off, n, anchor.view(np.int64), h.view(np.int64), again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["t1", "t2", "m", "start", "run", "anchor", "frag", "again"])

    return docs.select("t1", "t2", "text").mapInArrow(tidied(run), "t1 long, t2 long, m long, start long, run long, anchor long, frag long, again boolean")


def extract(wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, frag, run, n, hot, raw) from wanted (text, t1, t2, frags); a text that a batch repeats gives its fragments once."""
    fields = ["anchor", "frag", "run", "n", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (1, 2)], 1)
            batch = batch.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))
            for lo in range(0, batch.num_rows, CUT):
                part = batch.slice(lo, CUT)
                texts, lists = part.column(0).cast(pa.large_binary()), part.column(3)
                flat, owner = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                raws, held, now = [], b"", -1
                for i, a, n in zip(owner.tolist(), flat.field("start").to_pylist(), flat.field("run").to_pylist(), strict=True):
                    if i != now:
                        held, now = texts[i].as_py(), i
                    raws.append(held[a : a + n + length - 1])
                yield pa.RecordBatch.from_arrays([*(flat.field(f) for f in fields), pa.array(raws, pa.binary())], [*fields, "raw"])

    return wanted.select("text", "t1", "t2", "frags").mapInArrow(tidied(run), "anchor long, frag long, run long, n long, hot boolean, raw binary")


def arrays(met: DataFrame, length: int) -> DataFrame:
    """(anchor, frag, s, e): spans of repeated windows in fragments met (anchor, frag, run, n, raw), from suffix arrays over whole anchors."""

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        sizes = np.array([len(r[4]) for r in rows])
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        t = np.frombuffer(bytes([SEPARATOR]).join(r[4] for r in rows) + bytes([SEPARATOR]), np.uint8)
        n = np.array([r[2] for r in rows])
        starts = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = shared_windows(t, starts, np.repeat(np.array([r[3] for r in rows]), n), length)
        for k, r in enumerate(rows):
            for a, b in merged(np.flatnonzero(hit[at[k] : at[k] + n[k]]), length):
                yield r[0], r[1], a, b

    def pack(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "frag", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole anchors
        group: list[tuple] = []  # the anchor being read
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != r[0]:
                    held += group
                    group = []
                    if size >= ARRAY_BYTES:
                        yield pack(list(solve(held)))
                        held, size = [], 0
                if group and group[-1][1] == r[1]:
                    continue  # given by two batches
                group.append(r)
                size += len(r[4])
        held += group
        yield pack(list(solve(held)) if held else [])

    dealt = met.select("anchor", "frag", "run", "n", "raw").repartition("anchor").sortWithinPartitions("anchor", "frag")
    return dealt.mapInArrow(tidied(run), "anchor long, frag long, s long, e long")


def by_window(met: DataFrame, length: int) -> DataFrame:
    """As arrays(), for anchors with very many fragments: windows counted by anchor and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                anchor, frag, n, times = (part.column(c).to_numpy() for c in ("anchor", "frag", "run", "n"))
                raws = part.column("raw").to_pylist()
                data = np.frombuffer(b"".join(raws), np.uint8)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(np.cumsum([0, *map(len, raws)])[:-1], n) + nth
                one, two = (span_hash(prefix_hash(x), begin, begin + length).view(np.int64) for x in (data, data ^ ODD))
                out = [np.repeat(anchor, n), np.repeat(frag, n), nth, np.repeat(times, n), one, two]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["anchor", "frag", "s", "n", "h1", "h2"])

    def spans(lists: pa.Array) -> pa.Array:
        found = [[{"s": a, "e": b} for a, b in merged(np.sort(x.values.to_numpy()), length)] for x in lists]
        return pa.array(found, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))

    spans.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    each = met.dropDuplicates(["anchor", "frag"]).select("anchor", "frag", "run", "n", "raw").mapInArrow(tidied(run), "anchor long, frag long, s long, n long, h1 long, h2 long")
    key = ["anchor", "h1", "h2"]
    repeated = each.groupBy(*key).agg(F.sum("n").alias("total")).where("total > 1").select(*key)
    # a fragment has RUN windows at most
    found = each.join(repeated, key, "left_semi").groupBy("anchor", "frag").agg(F.collect_list("s").alias("places"))
    return found.select("anchor", "frag", F.explode(F.arrow_udf(spans, "array<struct<s: long, e: long>>")("places")).alias("x")).select("anchor", "frag", "x.s", "x.e")


def flagged(distinct: DataFrame) -> tuple[DataFrame, bool]:
    """(distinct fragments (anchor, ...) with hot: whether the anchor has too many; whether any has)."""
    hot = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(f"c > {HOT}").select("anchor", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return distinct.withColumn("hot", F.lit(False)), False
    return distinct.join(sized(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), True


def cut_again(met: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """As arrays(), for anchors with very many fragments: by second anchors within them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                anchor, frag, times = (part.column(c).to_numpy() for c in ("anchor", "frag", "n"))
                raws = part.column("raw").to_pylist()
                at = np.cumsum([0, *map(len, raws)])
                data = np.frombuffer(b"".join(raws), np.uint8)
                row, start, n, other, h, _ = fragments(data, at, length, second=True)
                both = mix(anchor.view(np.uint64)[row] * np.uint64(3) + other).view(np.int64)
                cuts = [raws[i][a : a + b + length - 1] for i, a, b in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (both, h.view(np.int64), n, times[row], anchor[row], frag[row], start)), pa.array(cuts, pa.binary())], ["anchor", "frag", "run", "n", "anchor1", "frag1", "off", "raw"])

    once = met.dropDuplicates(["anchor", "frag"]).select("anchor", "frag", "n", "raw")
    parts = scratch.written(once.mapInArrow(tidied(run), "anchor long, frag long, run long, n long, anchor1 long, frag1 long, off long, raw binary"))
    distinct, some = flagged(parts.groupBy("anchor", "frag").agg(F.sum("n").alias("n"), F.first("run").alias("run"), F.first("raw").alias("raw")))
    distinct = scratch.written(distinct.select("anchor", "frag", "run", "n", "hot", "raw"))
    spans = arrays(distinct.where("not hot"), length)
    if some:
        spans = spans.union(by_window(distinct.where("hot"), length))
    return parts.drop("raw").join(spans, ["anchor", "frag"]).select(F.col("anchor1").alias("anchor"), F.col("frag1").alias("frag"), (F.col("off") + F.col("s")).alias("s"), (F.col("off") + F.col("e")).alias("e"))


def with_spans(docs: DataFrame, length: int) -> DataFrame:
    """docs (text, not null; rid, a hash of the row) with t1, t2 (hashes of the text) and spans (of bytes to remove, unordered, null if none)."""
    keyed = docs.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("text"), "text"))
    slim = keyed.select("t1", "t2", "text", "rid")
    scratch = Scratch(docs.sparkSession)
    copies = cut(slim.select("t1", "t2", "rid").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("only")).where("m > 1").select("t1", "t2", "only"))
    found = scratch.written(scan(slim, length), rows=TEXTS)
    anchors = found.groupBy("anchor").agg(F.sum("m").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("anchor")
    place = ["anchor", "frag", "t1", "t2", "start", "run"]
    again = scratch.written(found.join(anchors, "anchor").select(*place, "m"))
    distinct = cut(again.groupBy("anchor", "frag").agg(F.sum("m").alias("n"), F.min(F.struct("t1", "t2", "start", "run")).alias("at")))
    distinct, some = flagged(distinct)
    asked = distinct.select("at.*", "anchor", "frag", "n", "hot").groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "run", "anchor", "frag", "n", "hot")).alias("frags"))
    # of a text that occurs often, one row gives the bytes (equal rows all do)
    givers = slim.join(asked.join(copies, ["t1", "t2"], "left"), ["t1", "t2"]).where("only is null or rid = only")
    met = scratch.written(extract(givers, length), rows=TEXTS)
    spans = arrays(met.where("not hot"), length)
    if some:
        spans = spans.union(cut_again(met.where("hot"), length, scratch))
    # a text's copies in several batches give the same places
    placed = again.join(spans, ["anchor", "frag"]).select("t1", "t2", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e")).distinct()
    per_text = cut(placed.groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    scratch.emptied()
    return keyed.join(per_text, ["t1", "t2"], "left")


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs under the spans; spans that touch make one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept_bytes(text: str, gone: list[tuple[int, int]]) -> bytes:
    raw = text.encode()
    parts, at = [], 0
    for s, e in gone:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def digests(docs: DataFrame, *, length: int = 200, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    A byte goes if a string of ``length`` bytes over it starts anywhere else too, in the
    same text or in another row; all occurrences go. Null is the empty text. Rows that
    are equal are each other's elsewhere; repeated and null ids are rows like others.
    Texts shorter than ``length`` stay as they are. Other columns don't matter.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = union_of(spans or [])
                kept = kept_bytes(t, gone)
                removed = sum(e - s for s, e in gone)
                out.append((len(kept) + removed, removed, len(gone), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names) if out else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, [pa.int64(), *kinds], strict=True))))

    slim = docs.select(docs["doc_id"].cast("long"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.lit("row"), docs["doc_id"]).alias("rid"))
    return with_spans(slim, length).select("doc_id", "text", "spans").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, *, length: int = 200, text: str = "text") -> DataFrame:
    """docs with repeated strings removed from the text; characters cut in half go too.

    Null texts stay null. Rows that repeat an id or a text are each other's elsewhere; texts of
    any length are judged whole; the other columns, whatever their names, stay as they
    are. An empty table gives an empty table.
    """
    hashable = [named(c) for c, t in docs.dtypes if c != text and "map" not in t and "variant" not in t]
    others = [named(c) for c in docs.columns if c != text]
    packed = docs.select(F.struct(F.lit(0).alias("none"), *others).alias("row"), named(text).cast("string").alias("was"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.lit("row"), *hashable).alias("rid"))
    joined = with_spans(packed, length)

    def strip(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([t if not x else kept_bytes(t, union_of(x)).decode("utf-8", "ignore") for t, x in pairs], pa.string())

    strip.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    strip = F.arrow_udf(strip, "string")
    new = F.when(F.col("spans").isNull(), F.col("was")).otherwise(strip("text", "spans"))
    return joined.select(*(new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
