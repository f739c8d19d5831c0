"""SimHash near-duplicates: every pair of fingerprints within a Hamming radius, exactly.

Fingerprints that are equal become one. Of ``blocks`` groups of bits, two fingerprints
that differ in at most ``radius`` bits agree in blocks - radius groups at least, so the
pairs are found within the sets of fingerprints that agree in some choice of that many
groups (no pair is missed, whatever the data). The number of groups follows the number
of fingerprints, so that sets of chance neighbours stay small. Each set is compared in tiles with numpy's
exclusive-or and bit counts, fingerprints sorted by population count, and tile pairs
whose counts differ by more than the radius are skipped. A set of more than TILE
fingerprints is cut into tiles by population count (and a hash, where one count alone
has too many), and its tile pairs are separate units of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components, forest
from weftline.llm.shared import TEXTS, Scratch, cut, mix, named, prefix_hash, runs, sized, slices, span_hash, tidied

#: Fingerprints in a tile, and in the piece of a tile that is compared at once.
TILE, PIECE = 2048, 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def joined_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words of a text in lower case (A to Z), joined by one blank each."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    start, end = runs(~BLANK[raw])
    if not len(start):
        return raw[:0], start, end
    # word k of n starts at its start less the blanks dropped before it
    gap = np.maximum(start - np.concatenate(([start[0]], end[:-1])) - 1, 0)
    off = start[0] + np.cumsum(gap)
    keep = ~BLANK[raw]
    keep[end[:-1]] = True
    raw[end[:-1]] = 32
    return raw[keep], start - off, end - off


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text in order, repeats included."""
    words, start, end = joined_words(text)
    n, joined = len(start), words.tobytes()
    if not n:
        return np.zeros(0, np.uint64)
    start, end = start.tolist(), end.tolist()
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, 42)], np.uint64)
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(start, end[width - 1 :])), np.uint64, n - width + 1)  # noqa: B905


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int) -> int:
    """Of one text: bit b is set if it is set in over half of the shingle hashes."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, *, width: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, data, at in slices(batch.column(1)):
                for i in range(hi - lo):
                    out[lo + i] = fingerprint(data[at[i] : at[i + 1]].tobytes(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), docs[text].cast("string")).mapInArrow(tidied(run), "doc_id long, fp long")


def layout(n: int, radius: int) -> list[int]:
    """Masks, one for each choice of groups of bits that must agree, for n distinct fingerprints."""
    agree = 1 if n < 1 << 25 else 2 if n < 1 << 31 else 4
    if radius == 0:
        return [(1 << 64) - 1]
    blocks = min(64, radius + agree)
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]  # noqa: B905
    return [sum(c) for c in combinations(each, blocks - radius)]


def near(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """Index pairs (into a, and into a or len(a) + b) within the radius; of a dense set, a spanning part.

    Rows are fingerprints of one 64-bit word or more. Both sides are compared piece by
    piece in the order of their population counts; of several words, the later half is
    looked at only where the first half is within the radius.
    """
    both = a if b is None else np.concatenate([a, b])
    both = both.reshape(len(both), -1)
    ones = np.bitwise_count(both).sum(1, dtype=np.int64)
    left = np.argsort(ones[: len(a)], kind="stable")
    right = left if b is None else len(a) + np.argsort(ones[len(a) :], kind="stable")
    head = (both.shape[1] + 1) // 2
    found = np.zeros((0, 2), np.int64)
    for i in range(0, len(left), PIECE):
        x = left[i : i + PIECE]
        for j in range(i if b is None else 0, len(right), PIECE):
            y = right[j : j + PIECE]
            if ones[y[0]] > ones[x[-1]] + radius:
                break
            if ones[y[-1]] < ones[x[0]] - radius:
                continue
            off = np.bitwise_count(both[x, 0][:, None] ^ both[y, 0][None, :])
            for w in range(1, head):
                off = off + np.bitwise_count(both[x, w][:, None] ^ both[y, w][None, :])
            p, q = np.nonzero(off <= radius)
            p, q = x[p], y[q]
            if both.shape[1] > head:
                yes = np.bitwise_count(both[p] ^ both[q]).sum(1, dtype=np.int64) <= radius
                p, q = p[yes], q[yes]
            new = np.stack([p, q], 1)[p != q]
            if len(new):
                found = np.concatenate([found, new])
                if len(found) > 8 * len(both):
                    found = forest(len(both), found)
    return forest(len(both), found) if len(found) else found


def links(distinct: DataFrame, radius: int, *, count: int | None = None) -> DataFrame:
    """(a, b): links between fingerprints, enough of them to connect all that is within the radius.

    distinct: (fp), each once; count: how many to lay out for (None: as many as there are).
    """
    masks = layout(distinct.count() if count is None else count, radius)
    key = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(masks)]
    banded = distinct.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*key)).alias("k")).select("k.band", "k.key", "fp", "ones")
    sized = banded.groupBy("band", "key", "ones").agg(F.count(F.lit(1)).alias("n"))
    # at most 65 population counts a set
    per_set = sized.groupBy("band", "key").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("ones", F.expr(f"cast(ceil(n / {TILE}) as int)").alias("cuts")))).alias("classes")).where("total > 1")
    joined = banded.join(per_set, ["band", "key"])
    own = F.expr("filter(classes, c -> c.ones = ones)[0].cuts")
    tile = F.pmod(F.xxhash64("fp"), own).cast("int")
    # a tile is (ones, part); its units pair it with every tile whose count is within the radius
    units = F.expr(
        f"""if(total <= {TILE}, array(named_struct('unit', '', 'side', 0)),
        flatten(transform(filter(classes, c -> abs(c.ones - ones) <= {radius}), c -> transform(sequence(0, c.cuts - 1), p ->
          if((c.ones, p) = (ones, tile), named_struct('unit', concat_ws('.', ones, tile, ones, tile), 'side', 0),
          if((ones, tile) < (c.ones, p), named_struct('unit', concat_ws('.', ones, tile, c.ones, p), 'side', 0), named_struct('unit', concat_ws('.', c.ones, p, ones, tile), 'side', 1)))))))"""
    )
    work = joined.withColumn("tile", tile).select("band", "key", "fp", F.explode(units).alias("u")).select("band", "key", "u.unit", "u.side", "fp")
    # a unit by 128 bits of hash, so that the rows are plain numbers
    dealt = work.select(F.xxhash64("band", "key", "unit").alias("g"), F.xxhash64(F.lit("unit"), "band", "key", "unit").alias("g2"), F.col("side").cast("long").alias("side"), "fp").repartition("g").sortWithinPartitions("g", "g2")

    return compared(dealt, 1, radius)


def compared(dealt: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b) from units (g, g2, side, node, n words of fingerprint), each unit's rows together and in order.

    Rows of side 1, if there are any, are compared with those of side 0, or else these
    with each other. node and the word are one column where the word is the node.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches, 4 if n == 1 else 4 + n):
            out = [np.zeros((0, 2), np.int64)]
            for g in groups:
                one = g[:, 2] == 0
                a, b = g[one], g[~one]
                if len(a):
                    fp = [np.ascontiguousarray(x[:, -n:]).view(np.uint64) if len(x) else None for x in (a, b)]
                    out.append(np.concatenate([a[:, 3], b[:, 3]])[near(fp[0], fp[1], radius)])
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.mapInArrow(tidied(compare), "a long, b long")


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """For each batch the groups that end in it: rows of ``width`` longs, two at least, alike in the first two."""
    rest = np.zeros((0, width), np.int64)
    for block, last in with_last(batches):
        rows = np.stack([c.to_numpy() for c in block.columns], 1) if block is not None else rest
        rows = np.concatenate([rest, rows]) if block is not None and len(rest) else rows
        edge = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1
        bounds = np.concatenate(([0], edge, [len(rows)]))
        whole = bounds if last else bounds[:-1]  # the last group may go on in the next batch
        yield [rows[lo:hi] for lo, hi in zip(whole[:-1].tolist(), whole[1:].tolist(), strict=True) if hi - lo > 1]
        rest = rows[whole[-1] :]


def with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, bool]]:
    """Each batch, and whether it is the last; (None, True) at the end if there are none."""
    held = None
    for batch in batches:
        if held is not None:
            yield held, False
        held = batch
    yield held, True


def simhash_components(docs: DataFrame, *, width: int = 5, radius: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Texts are lower-cased in A to Z; words are runs of bytes other than blank and
    U+0009 to U+000D; shingles are ``width`` words joined by a blank, repeats included.
    Fewer words are one shingle; null, empty and blank texts have fingerprint zero, which
    links like any other. component_id is the smallest doc_id reachable over links of at
    most ``radius`` differing bits, itself included. Links are between texts: rows that repeat
    an id come back as often, each by its own text. A row with a null id keeps its place
    but names no component (null ids alone: a null name). Other columns of docs don't
    matter; an empty table gives an empty table.
    """
    prints = cut(fingerprints(docs, width=width, text=text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(distinct.select("fp"), radius)).withColumnsRenamed({"id": "fp", "component": "part"})
    parts = distinct.join(found, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    names = parts.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = parts.join(names, "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The rest is for texts that share most of their shingles but not nearly all. 64 bits can't
# tell a similarity of 0.8 from one of 0.7, so their fingerprints are parities, as long as a
# text needs: compared by exclusive-or and bit counts in the same tiles, they show at least how
# far two sets differ, so they rule pairs out and the shingles themselves decide the rest.

#: Least similarity of near-duplicates, as a fraction: shingles in both by shingles in either.
SHARE = 4, 5
#: 64-bit words of the shortest parity, and those looked at before pairs are left out.
WIDE, STEP = 32, 8
#: Shingle sets in a tile, and in the piece of a tile that is compared at once.
WIDE_TILE, WIDE_PIECE = 4096, 512
#: Bands, and least shingle hashes in one. They only bring most links early; none is lost without them.
BANDS, LEAST = 14, 5
#: Times that the parts found so far are checked against each other by bands, before prefixes.
TURNS = 2
#: Odd multipliers, one for each order in which shingle hashes are least.
ORDERS = mix(np.arange(1, BANDS * LEAST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Shingles a task counts at once, the share of its texts that makes one common, and common ones that are broadcast at most.
COUNTED, OFTEN, COMMON = 1 << 15, 1 / 1024, 1 << 17


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, ascending."""
    joined, start, end = joined_words(text)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64)
    if n <= width:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: n - width + 1], end[width - 1 :]
    return np.unique(span_hash(prefix_hash(joined), start, end))


def prefix_size(n: int) -> int:
    """Of two sets that share SHARE, the first so many of each, in any one order, have one in common."""
    p, q = SHARE
    return n - -(-p * n // q) + 1 if n else 0


def parity(h: np.ndarray) -> np.ndarray:
    """Words of a set's parity: bit k is set if an odd number of its hashes is k mod the number of bits, at least two a hash.

    Parities of two sets, of one length, differ in no more bits than the sets do in members.
    """
    bits = 64 * WIDE
    while bits < 2 * len(h):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """A parity of ``to`` words from a longer one."""
    while len(words) > to:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def bands(h: np.ndarray) -> np.ndarray:
    """BANDS hashes of the least shingle hashes."""
    least = np.full(len(ORDERS), 2**64 - 1, np.uint64)
    for lo in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, lo : lo + 4096] * ORDERS[:, None]).min(1))
    band = least.reshape(BANDS, LEAST)
    key = np.zeros(BANDS, np.uint64)
    for k in range(LEAST):
        key = mix(key + band[:, k])
    return key.view(np.int64)


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, ascending, and about how many of all texts (column text) have each.

    A task keeps its COUNTED commonest shingles, with all counts lowered by that of the
    first to go (so a shingle in a share of over 1 / COUNTED of what was counted is
    never lost), and gives those in OFTEN of its texts. They put common shingles
    last, so that few texts meet by them. Which they are changes the work, not the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(0)):
                seen += hi - lo
                new, n = np.unique(np.concatenate([shingle_set(data[at[i] : at[i + 1]].tobytes(), width) for i in range(hi - lo)]), return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                times = np.bincount(back, np.concatenate([times, n]), len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    times = times - np.partition(times, len(times) - COUNTED - 1)[len(times) - COUNTED - 1]
                    keys, times = keys[times > 0], times[times > 0]
        some = times >= max(3, OFTEN * seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(times[some])], ["h", "n"])

    found = texts.select("text").mapInArrow(tidied(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(t1, t2, n, s1, s2, parity, bands, firsts, often) of texts (t1, t2, text).

    n, s1 and s2 are the size and the hash of the set of shingles; firsts its prefix, rare
    shingles first, and often whether each is among the common ones.
    """
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(2)):
                rows, words, keys, firsts, oft = np.zeros((hi - lo, 3), np.int64), [], [], [], []
                for i in range(hi - lo):
                    h = shingle_set(data[at[i] : at[i + 1]].tobytes(), width)
                    raw = h.tobytes()
                    rows[i] = [len(h), *np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh64_intdigest(raw, 2)], np.uint64).view(np.int64)]
                    often = np.zeros(len(h), np.int64)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = known[place] == h
                        often[hit] = times[place[hit]]
                    take = np.lexsort((mix(h), often))[: prefix_size(len(h))]
                    firsts.append(h[take].view(np.int64))
                    oft.append(often[take] > 0)
                    words.append(parity(h))
                    keys.append(bands(h))
                own = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (words, keys, firsts, oft)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)), *lists], ["t1", "t2", "n", "s1", "s2", "parity", "bands", "firsts", "often"])

    return texts.select("t1", "t2", "text").mapInArrow(tidied(run), "t1 long, t2 long, n long, s1 long, s2 long, parity array<long>, bands array<long>, firsts array<long>, often array<boolean>")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that neither sizes nor whole parities (nodes: node, n, parity) show to be too different."""
    p, q = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.stack([batch.column(k).to_numpy() for k in (2, 3)], 1)
            yes = q * n.min(1) >= p * n.max(1)
            for i in np.flatnonzero(yes).tolist():
                x, y = (batch.column(k)[i].values.to_numpy() for k in (4, 5))
                to = min(len(x), len(y))
                off = int(np.bitwise_count((folded(x, to) ^ folded(y, to)).view(np.uint64)).sum())
                yes[i] = off * (p + q) <= n[i].sum() * (q - p)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(yes)) for k in (0, 1)], ["a", "b"])

    of = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"of_{x}")) for x in ("a", "b")]
    return pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(tidied(run), "a long, b long")


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of distinct shingles share SHARE; pairs must be cheap to read again.

    nodes: (node, t1, t2), a text of each; texts: (t1, t2, text).
    """
    p, q = SHARE
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(nodes.select("node", "t1", "t2").join(ends, "node"))
    held = texts.join(sized(wanted), ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
    of = [held.select(F.col("node").alias(x), F.col("text").alias(f"of_{x}")) for x in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes, last = np.zeros(batch.num_rows, bool), (None, np.zeros(0, np.uint64))
            for i, b in enumerate(batch.column(1).to_pylist()):
                if last[0] != b:
                    last = b, shingle_set(batch.column(3)[i].as_py().encode(), width)
                x = shingle_set(batch.column(2)[i].as_py().encode(), width)
                both = len(np.intersect1d(x, last[1], assume_unique=True))
                yes[i] = both * (p + q) >= (len(x) + len(last[1])) * p
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(yes)) for k in (0, 1)], ["a", "b"])

    return pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "of_a", "of_b").mapInArrow(tidied(run), "a long, b long")


def met_again(rows: DataFrame) -> DataFrame:
    """The rows (k, node) whose k more than one row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            if batch.num_rows:
                now = np.concatenate([waiting, np.stack([c.to_numpy() for c in batch.columns], 1)])
                same = now[1:, 0] == now[:-1, 0]
                keep = np.append(False, same) | np.append(same, False)
                keep[0] |= now[0, 0] == last
                # a last row that is alone so far waits for the next batch
                waiting, last = (now[:0], now[-1, 0]) if keep[-1] else (now[-1:], None)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(now[keep, k])) for k in (0, 1)], ["k", "node"])

    return rows.select("k", "node").repartition("k").sortWithinPartitions("k").mapInArrow(tidied(run), "k long, node long")


def candidates(dealt: DataFrame) -> DataFrame:
    """(a, b) from units (g, g2, side, node, part, n, WIDE words of parity), each unit's rows together and in order.

    Pairs of two parts that neither their sizes nor their parities, folded to WIDE words, show to be too
    different: sets that share SHARE differ in (n_a + n_b) * (1 - share) / (1 + share) members
    at most. Rows of side 1, if there are any, are paired with those of side 0, or else
    these with each other.
    """
    p, q = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches, 6 + WIDE):
            out, size = [], 0
            for g in groups:
                one = g[:, 2] == 0
                a, b = g[one], g[~one]
                b, alone = (b, False) if len(b) else (a, True)
                b = b[np.argsort(b[:, 5], kind="stable")]
                a = b if alone else a[np.argsort(a[:, 5], kind="stable")]
                for i in range(0, len(a), WIDE_PIECE):
                    x = a[i : i + WIDE_PIECE]
                    for j in range(i if alone else 0, len(b), WIDE_PIECE):
                        y = b[j : j + WIDE_PIECE]
                        if p * y[0, 5] > q * x[-1, 5]:
                            break
                        if q * y[-1, 5] < p * x[0, 5]:
                            continue
                        n, m = x[:, 5][:, None], y[:, 5][None, :]
                        ok = (x[:, 4][:, None] != y[:, 4][None, :]) & (q * np.minimum(n, m) >= p * np.maximum(n, m))
                        s, t = np.nonzero(ok)
                        off = np.zeros(len(s), np.int64)
                        for lo in range(6, 6 + WIDE, STEP):
                            for w in range(lo, min(lo + STEP, 6 + WIDE)):
                                off += np.bitwise_count((x[s, w] ^ y[t, w]).view(np.uint64))
                            close = off * (p + q) <= (x[s, 5] + y[t, 5]) * (q - p)
                            s, t, off = s[close], t[close], off[close]
                        u, v = x[s, 3], y[t, 3]
                        out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
                        size += len(u)
                        if size > 1 << 16:
                            found = np.unique(np.concatenate(out), axis=0)
                            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
                            out, size = [], 0
            if size:
                found = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return dealt.mapInArrow(tidied(run), "a long, b long")


def wide_components(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """(t1, t2, part) of the distinct texts of docs: part is one number for each group of near-duplicates.

    t1 and t2 are xxhash64(text) and xxhash64('text', text). Two texts are linked if their
    sets of distinct shingles share SHARE; equal sets are one node, and texts without a word
    are one group. First each node is checked against one other of each band it is in
    (LEAST least shingle hashes in an order of their own), then one node of each part that has come
    about, which finds most groups from few pairs. Then nodes of different groups meet by prefixes: with all shingles in one order,
    rare ones first, two sets that share SHARE have one in common among the first
    prefix_size() of each, so no pair is missed. Of those that meet, sizes and parities
    leave out only what can't be similar, and the shingles decide. Shingles and sets are
    told apart by hashes, of 64 and 128 bits. A shingle that more than WIDE_TILE sets meet
    by is compared in tiles.
    """
    words = [f"f{k}" for k in range(WIDE)]
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("text"), "text"))
    scratch = Scratch(docs.sparkSession)
    prints = scratch.written(sketches(texts, width).withColumn("row", F.monotonically_increasing_id()), rows=TEXTS)
    named = scratch.written(prints.groupBy("s1", "s2", "n").agg(F.min("row").alias("node")))
    nodes = prints.join(named.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("k"))
    early, reps = None, banded.withColumn("part", F.col("node"))
    for turn in range(TURNS):
        # each band has an order of nodes of its own: a group has a centre for each band, so that one that is like few others doesn't matter
        order = F.struct(F.xxhash64(F.lit(turn), "band", "node"), "node")
        if early is not None:  # one node for each part that has come about so far
            joined = banded.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
            reps = joined.groupBy("band", "k", "part").agg(F.min(order).alias("r")).select("band", "k", "part", F.col("r.node").alias("node"))
        centres = reps.groupBy("band", "k").agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1").select("k", F.col("c.node").alias("c"))
        stars = cut(reps.join(centres, "k").where("node != c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct())
        new = scratch.written(similar(cut(possible(stars, nodes)), nodes, texts, width))
        early = new if early is None else early.union(new)
        found = components(early).withColumnsRenamed({"id": "node", "component": "part"})
    narrow = F.expr(f"transform(sequence(0, {WIDE - 1}), w -> aggregate(sequence(w, size(parity) - 1, {WIDE}), 0L, (x, j) -> x ^ parity[j]))")
    parts = cut(nodes.select("node", "n", narrow.alias("f")).join(found, "node", "left").select("node", "n", F.coalesce("part", "node").alias("part"), *(F.col("f")[k].alias(w) for k, w in enumerate(words))))
    each = nodes.select("node", F.explode(F.arrays_zip("firsts", "often")).alias("x")).select(F.col("x.firsts").alias("k"), "node", F.col("x.often").alias("often"))
    # common shingles are known to be met; the others, far more, are seen once mostly and go
    filed = scratch.written(met_again(each.where("not often")).union(each.where("often").select("k", "node")))
    rated = filed.join(parts.select("node", "part"), "node")
    who = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    known = rated.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi"), *who).where("lo < hi")
    # of the shingles of a passage, by which the same texts meet, one is enough
    met = cut(known.groupBy("m", "x1", "x2").agg(F.min("k").alias("k")).select("k", F.expr(f"cast(ceil(m / {WIDE_TILE}) as int)").alias("cuts")))
    tile = F.expr("cast(pmod(xxhash64(node), cuts) as int)")
    units = F.expr("transform(sequence(0, cuts - 1), p -> named_struct('unit', concat_ws('.', least(p, tile), greatest(p, tile)), 'side', if(p < tile, 1L, 0L)))")
    work = filed.join(met, "k").withColumn("tile", tile).select("k", "node", F.explode(units).alias("u"))
    given = work.select(F.xxhash64("k", "u.unit").alias("g"), F.xxhash64(F.lit("unit"), "k", "u.unit").alias("g2"), F.col("u.side").alias("side"), "node")
    dealt = given.join(parts, "node").select("g", "g2", "side", "node", "part", "n", *words).repartition("g").sortWithinPartitions("g", "g2")
    pairs = cut(candidates(dealt).distinct())
    late = scratch.written(similar(cut(possible(pairs, nodes)), nodes, texts, width))
    found = components(early.union(late)).withColumnsRenamed({"id": "node", "component": "part"})
    groups = named.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("part", "node").alias("part"))
    out = cut(prints.select("t1", "t2", "s1", "s2", "n").distinct().join(groups, ["s1", "s2", "n"]).select("t1", "t2", "part"))
    scratch.emptied()
    return out


def distinct_documents(docs: DataFrame, *, width: int = 5) -> DataFrame:
    """One row of docs, with its own columns, for each group of near-duplicate texts: that of the smallest id.

    Near-duplicates share four fifths of their distinct shingles or more; groups are what such links connect.

    Ties of ids (repeated rows) go to the row that sorts first by its other columns'
    hash; a null id sorts last, a null text is the empty one. Texts of any length count whole;
    columns may have any names; an empty table gives an empty table.
    """
    hashable = [named(c) for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    tie, text = F.xxhash64(F.lit("tie"), *hashable), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("doc_id").alias("id"), text.alias("text"), tie.alias("tie")).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit("text"), "text"))
    slim = own.select("id", "tie", "t1", "t2").join(wide_components(own.select("text"), width=width), ["t1", "t2"])
    least = slim.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "tie", "t1", "t2")).alias("least")).select("least.tie", "least.t1", "least.t2")
    kept = own.select("row", "tie", "t1", "t2").join(least, ["tie", "t1", "t2"], "left_semi")
    return kept.dropDuplicates(["tie", "t1", "t2"]).select(*(F.col("row")[c].alias(c) for c in docs.columns))
