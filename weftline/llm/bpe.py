"""Byte-level BPE by the ranks of a public vocabulary file.

Merges are taken from a queue of merge ranks that many pre-tokens share. A bitmap marks
the blocks of BLOCK ranks that have candidates, and find-first-set gives the lowest one.
Its bucket holds positions of linked lists of parts, one list for each pre-token; entries
that an earlier merge has made stale are skipped. Each pre-token with entries in the block takes its
lowest rank there, which is its lowest of all, and merges from left to right; its other
entries go back to the bucket, and the pairs that have come up go to theirs. All that is done
for all these pre-tokens at once, in numpy. Every pre-token that is no token itself, of any
length, goes through the queue, once for as long as a task remembers its ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from weftline.llm.shared import tidied

#: Once more than so many distinct pre-tokens are remembered, a task forgets them all before its next batch.
KEPT = 400_000
#: Pre-tokens of more bytes than this aren't remembered.
SHORT = 40
#: Ranks of one bit of the bitmap.
BLOCK = 256
NONE = np.int32(2**31 - 1)
#: Texts split, merged and digested at a time: so many rows, or fewer of about so many characters.
ROWS, CHARS = 512, 1_000_000

#: Texts of these characters alone are split by the faster standard library, with the classes spelled out.
PLAIN = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]").search
PLAIN_CLASSES = {r"\p{L}": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"\p{N}": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\s": "\t-\r \u0085\u00a0"}


def plain(pattern: str) -> str:
    """The pattern for texts without characters that PLAIN finds: each class becomes a list of characters."""
    out, inside = "", False
    while pattern:
        for name, chars in PLAIN_CLASSES.items():
            if pattern.startswith(name):
                out += chars if inside else f"[{chars}]"
                pattern = pattern[len(name) :]
                break
        else:
            if pattern.startswith(r"\S"):
                out, pattern = out + f"[^{PLAIN_CLASSES[r'\s']}]", pattern[2:]
                continue
            inside = pattern[0] == "[" or inside and pattern[0] != "]"
            out, pattern = out + pattern[0], pattern[1:]
    return out


class Pairs:
    """Ranks of pairs of ids in an open hash table, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, of = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    of.append(r)
        key = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(2 * len(key)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.of = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        at, value = self.at(key), np.array(of, np.int32)
        while len(key):
            free = self.keys[at] == 2**64 - 1
            self.keys[at[free]] = key[free]  # of several with one place, the last stays
            mine = free & (self.keys[at] == key)
            self.of[at[mine]] = value[mine]
            key, value, at = key[~mine], value[~mine], (at[~mine] + 1) & self.mask

    def at(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self.at(key)
        out, seen = self.of[at], self.keys[at]
        out[seen != key] = NONE
        more = np.flatnonzero((seen != key) & (seen != 2**64 - 1))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            seen = self.keys[at[more]]
            hit = seen == key[more]
            out[more[hit]] = self.of[at[more[hit]]]
            more = more[~hit & (seen != 2**64 - 1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.pairs = Pairs(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split_plain = re.compile(plain(pattern)).findall
        # \s of the reference library is the White_Space property, without U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.kept: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes], *, single: bool = False) -> list[bytes]:
        """The packed ids of each pre-token; none may be empty. single: a pre-token makes one merge at a time.

        Merges of one rank that a pre-token makes at once are the same as one after
        another unless one brings a pair of a lower rank; then it is done again, singly.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        n = len(owner)
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        first, last, gone = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        ends = np.cumsum(sizes)
        first[ends - sizes] = last[ends - 1] = True
        of = np.full(n, NONE, np.int32)  # the rank of the pair that starts here
        again = np.zeros(len(pieces), bool)
        now = np.zeros(len(pieces), np.int32)  # of several merges at once, their rank
        bitmap, buckets = 0, {}

        def rank(at: np.ndarray) -> None:
            """Look up the pairs that start at the places given, and put them into their buckets."""
            nonlocal bitmap
            of[at] = r = self.pairs(ids[at], ids[after[at]])
            some = r < NONE
            at, r = at[some], r[some]
            again[owner[at[r < now[owner[at]]]]] = True
            block = r // BLOCK
            order = np.argsort(block, kind="stable")
            at, block = at[order], block[order]
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=NONE)).tolist()
            for lo, hi, b in zip(edges[:-1], edges[1:], block[edges[:-1]].tolist(), strict=True):
                buckets.setdefault(b, []).append(at[lo:hi])
                bitmap |= 1 << b

        rank(np.flatnonzero(~last))
        while bitmap:
            b = (bitmap & -bitmap).bit_length() - 1
            at = np.concatenate(buckets.pop(b))
            at = np.sort(at[of[at] // BLOCK == b])
            at = at[np.diff(at, prepend=-1) > 0]
            new = np.diff(owner[at], prepend=-1) != 0
            take = of[at] == np.minimum.reduceat(of[at], np.flatnonzero(new))[np.cumsum(new) - 1] if len(at) else new
            if single:
                some = np.flatnonzero(take)
                take[some[np.diff(owner[at[some]], prepend=-1) == 0]] = False
            i = at[take]
            if len(i) == len(at):
                bitmap &= bitmap - 1
            else:
                buckets[b] = [at[~take]]
            # of pairs that overlap every second one is merged
            nth = np.arange(len(i))
            chained = np.zeros(len(i), bool)
            chained[1:] = after[i[:-1]] == i[1:]
            i = i[(nth - np.maximum.accumulate(np.where(chained, 0, nth))) % 2 == 0]
            r, j = of[i], after[i]
            k, end = after[j], last[j]
            more = np.flatnonzero(np.diff(owner[i]) == 0)
            now[owner[i[more]]] = r[more]
            # what is a pair only until the next merge of the same rank
            near = more[k[more] == i[more + 1]]
            again[owner[i[near[self.pairs(r[near], ids[i[near + 1]]) < r[near]]]]] = True
            ids[i], after[i], last[i] = r, k, end
            of[i] = of[j] = NONE
            gone[j] = True
            before[k[~end]] = i[~end]
            rank(np.concatenate([i[~end], before[i[~first[i]]]]))
            now[owner[i[more]]] = 0
        edges = 4 * np.cumsum(np.bincount(owner[~gone], minlength=len(pieces)))
        raw = ids[~gone].astype("<u4").tobytes()
        out = [raw[lo:hi] for lo, hi in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True)]
        if again.any():
            some = np.flatnonzero(again).tolist()
            for i, packed in zip(some, self.merge([pieces[i] for i in some], single=True), strict=True):
                out[i] = packed
        return out

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        texts_ids, holes, new = [], [], {}
        for t in texts:
            pieces = (self.split if PLAIN(t) else self.split_plain)(t) if t else []
            found = list(map(kept.get, pieces))
            at = [i for i, ids in enumerate(found) if ids is None] if None in found else []
            texts_ids.append(found)
            holes.append([(i, pieces[i]) for i in at])
            new.update(dict.fromkeys(pieces[i] for i in at))
        raw = {p: p.encode() for p in new}
        queued = []
        for p, r in raw.items():
            if (whole := self.ranks.get(r)) is None:
                queued.append(p)
            else:
                new[p] = whole.to_bytes(4, "little")
        if queued:
            new.update(zip(queued, self.merge([raw[p] for p in queued]), strict=True))
        kept.update((p, new[p]) for p, r in raw.items() if len(r) <= SHORT)
        for found, at in zip(texts_ids, holes, strict=True):
            for i, p in at:
                found[i] = new[p]
            yield b"".join(found)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """Once in each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(ranks, pattern)


def bpe(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, with ``ids`` the ids themselves, and the columns ``keep``.

    The vocabulary file must be readable at ``path`` on every executor. Null and
    empty texts have no tokens (the digests are those of no bytes). Rows are
    independent, so repeated ids and rows give as many rows; other columns of docs
    don't matter. No shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        try:
            for batch in batches:
                lo = 0
                while lo < batch.num_rows:
                    n = pc.fill_null(pc.utf8_length(batch.column(1).slice(lo, ROWS)), 0).to_numpy(zero_copy_only=False)
                    rows = batch.slice(lo, max(1, int(np.searchsorted(np.cumsum(n), CHARS, "right"))))
                    lo += rows.num_rows
                    found = [(len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(e.decode(p)).hexdigest(), *([np.frombuffer(p, "<u4").astype(np.int32)] * ids)) for p in e.packed(rows.column(1).to_pylist())]
                    out = [rows.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types[1:], strict=True)), *rows.columns[2:]]
                    yield pa.RecordBatch.from_arrays(out, names)
        finally:
            e.kept.clear()  # the worker lives on, in other stages too

    return docs.select(docs["doc_id"].cast("long"), docs[text].cast("string"), *(docs[c] for c in keep)).mapInArrow(tidied(run), schema)
