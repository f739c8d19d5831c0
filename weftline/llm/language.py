"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of ORDER characters is estimated
from a sample of its texts. Lower-cased letters count as they are; anything else is one
blank. n-grams are 64-bit hashes in sorted arrays, one array for each order with a
column for each language: the interpolated probability of the n-gram, and for contexts
the weight of the shorter n-gram. A text's language has the lowest cross-entropy per
character. The largest cross-entropy that all but a share REJECT of the language's own
held-back sample texts have bounds what is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import fold, tidied

ORDER = 4
#: Sample texts of a language that are counted, at most (in expectation); a tenth more calibrate.
TEXTS = 2000
#: Share of a language's own texts that calibration may reject.
REJECT = 0.005
#: The score takes the evidence of so many characters at most.
EVIDENCE = 64
#: Characters handled at a time, about.
CHARS = 1_000_000
BLANK = 32
ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: 0 at the break between texts, the letter itself, or BLANK."""
    out = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    out[0] = 0
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit characters with ORDER - 1 breaks before each text, the text of each): runs of blanks are one blank."""
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join(t.replace("\0", " ").lower() for t in texts)
    c = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    c = c[keep]
    owner = np.cumsum(c == 0) // (ORDER - 1) - 1
    # letters beyond the basic plane share its private-use places
    return np.where(c > 0xFFFF, 0xE000 + c % 0x1900, c).astype(np.uint64), owner


def grams(c: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """The ``order`` characters that end at each place, packed in 64 bits."""
    out = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        out = (out << np.uint64(16)) | c[at - k]
    return out


def hashed(gram: np.ndarray) -> np.ndarray:
    """One to one, so that packed n-grams and their hashes tell the same apart."""
    return gram * ODD


class Models:
    """keys[n], prob[n]: hashes of n-grams and their probability in each language (0: not seen);
    context[n], back[n]: hashes of contexts of n-grams and the weight of the shorter n-gram (1: not seen)."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.keys: dict[int, np.ndarray] = {}
        self.prob: dict[int, np.ndarray] = {}
        self.context: dict[int, np.ndarray] = {}
        self.back: dict[int, np.ndarray] = {}
        self.floor = np.full(len(languages), 1e-5)
        self.limit = np.full(len(languages), np.inf)

    def add(self, order: int, what: str, per_language: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([g for g, _ in per_language] or [np.zeros(0, np.uint64)]))
        table = np.full((len(keys), len(self.languages)), 0.0 if what == "prob" else 1.0, np.float64)
        for j, (g, v) in enumerate(per_language):
            table[np.searchsorted(keys, g), j] = v
        h = hashed(keys)
        sort = np.argsort(h)
        (self.keys if what == "prob" else self.context)[order] = h[sort]
        (self.prob if what == "prob" else self.back)[order] = table[sort]

    @staticmethod
    def find(keys: np.ndarray, table: np.ndarray, gram: np.ndarray, missing: float) -> np.ndarray:
        h = hashed(gram)
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        out = np.full((len(h), table.shape[1]), missing)
        if len(keys):
            hit = keys[at] == h
            out[hit] = table[at[hit]]
        return out

    def logs(self, gram: np.ndarray) -> np.ndarray:
        """Log-probabilities of the last character of packed n-grams after the others, in each language."""
        p = np.broadcast_to(self.floor, (len(gram), len(self.languages)))
        for n in range(1, ORDER + 1):
            tail = gram & np.uint64((1 << 16 * n) - 1) if n < 4 else gram
            seen = self.find(self.keys[n], self.prob[n], tail, 0.0)
            weight = self.find(self.context[n], self.back[n], tail >> np.uint64(16), 1.0)
            p = np.where(seen > 0, seen, weight * p)
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character in each language, number of letters) of each text."""
        c, owner = characters(texts)
        at = np.flatnonzero(c)
        distinct, back = np.unique(grams(c, ORDER, at), return_inverse=True)
        logs, own = self.logs(distinct), owner[at]
        n = np.maximum(np.bincount(own, minlength=len(texts)), 1)
        ce = np.stack([-np.bincount(own, logs[back, j], len(texts)) / n for j in range(len(self.languages))], 1) if self.languages else np.zeros((len(texts), 0))
        return ce, np.bincount(own, c[at] != BLANK, len(texts))


def estimate(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """counts: for each language its packed ORDER-grams and how often each occurs."""
    models = Models(languages)
    level: dict[str, tuple[np.ndarray, np.ndarray]] = counts
    tables = {}
    for n in range(ORDER, 0, -1):
        tables[n] = level
        # below the top: in how many ways the n-gram is preceded
        level = {}
        for lang, (g, _) in tables[n].items():
            tail, ways = np.unique(g & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
            level[lang] = tail, ways
    lower = {lang: None for lang in languages}
    for n in range(1, ORDER + 1):
        probs, backs, kept = [], [], {}
        for j, lang in enumerate(languages):
            g, c = tables[n][lang]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 else 0.5
            context, place = np.unique(g >> np.uint64(16), return_inverse=True)
            total = np.bincount(place, c, len(context))
            back = d * np.bincount(place, minlength=len(context)) / total
            if n == 1:
                models.floor[j] = 1.0 / (len(g) + 1000)
                below = np.full(len(g), models.floor[j])
            else:
                keys, p = lower[lang]
                below = p[np.searchsorted(keys, g & np.uint64((1 << 16 * (n - 1)) - 1))]
            p = (c - d) / total[place] + back[place] * below
            kept[lang] = g, p
            probs.append((g, p))
            backs.append((context, back))
        lower = kept
        models.add(n, "prob", probs)
        models.add(n, "back", backs)
    return models


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHARS characters; null is empty."""
    lo, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHARS:
            yield lo, held
            lo, size, held = i + 1, 0, []
    if held:
        yield lo, held


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text") -> Models:
    """From a sample of texts with a language, of the folds that aren't held out."""
    rows = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 2))
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Models([])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 1.1 * TEXTS / n) * (1 << 30)))))
    # a row that repeats counts once, so the sample stays bounded
    sample = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).select("doc_id", "text", "lang").distinct().withColumn("test", F.pmod(F.xxhash64(F.lit("test"), "doc_id", "text"), F.lit(11)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(names)):
                for _, texts in chunks(batch.column(0).filter(pa.array(names == name)).to_pylist()):
                    c, _ = characters(texts)
                    g, n = np.unique(grams(c, ORDER, np.flatnonzero(c)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def counted(texts: DataFrame, among: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        found = texts.select("text", "lang").mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        names, gram, n = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
        out = {}
        for name in among:
            own = names == name
            sort = np.argsort(gram[own])
            out[name] = gram[own][sort], n[own][sort]
        return out

    counts = counted(sample.where("not test"), languages)
    # where all texts of a language were set aside they are counted, and don't calibrate
    bare = [name for name in languages if not len(counts[name][0])]
    if bare:
        counts |= counted(sample.where(F.col("test") & F.col("lang").isin(bare)), bare)
    languages = [name for name in languages if len(counts[name][0])]
    models = estimate(languages, {name: counts[name] for name in languages})
    held = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, texts in chunks(batch.column(0).to_pylist()):
                ce, size = held.value.entropies(texts)
                own = [held.value.languages.index(x) if x in held.value.languages else -1 for x in names[lo : lo + len(texts)]]
                rows = [(o, ce[i, o]) for i, o in enumerate(own) if o >= 0 and size[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["lang", "ce"])

    tested = sample.where(F.col("test") & ~F.col("lang").isin(bare)).select("text", "lang").mapInArrow(tidied(measure), "lang long, ce double").toArrow()
    own, ce = tested.column("lang").to_numpy(), tested.column("ce").to_numpy()
    for j in range(len(languages)):
        if (own == j).any():
            models.limit[j] = np.quantile(ce[own == j], 1 - REJECT, method="higher")
    return models


def predicted(docs: DataFrame, models: Models, *, text: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, accepted); evidence: characters that the score takes into account at most."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_rows
            name, score, entropy, ok = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if m.languages:
                for lo, texts in chunks(batch.column(1).to_pylist()):
                    ce, size = m.entropies(texts)
                    best = ce.argmin(1)
                    low = ce[np.arange(len(texts)), best]
                    odds = np.exp(-(ce - low[:, None]) * np.clip(size, 1, evidence)[:, None])
                    for i in np.flatnonzero(size).tolist():
                        name[lo + i], score[lo + i], entropy[lo + i] = m.languages[best[i]], 1 / odds[i].sum(), low[i]
                        ok[lo + i] = low[i] <= m.limit[best[i]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(ok)], ["doc_id", "lang_pred", "score", "entropy", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, lang_pred string, score double, entropy double, accepted boolean")


def languages(docs: DataFrame, *, evidence: int = EVIDENCE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) for each row of docs.

    Learned from the text and non-null lang of folds other than 2; only texts are read
    for a prediction. score is the share of the chosen language in exp(-cross-entropy *
    characters, ``evidence`` at most); ties go to the language that sorts first. Null texts
    and texts without a letter, and all texts if nothing could be learned, are ``und``
    with score 0 and no entropy. accepted is false where the cross-entropy is above what
    calibration allows. Repeated and null ids are rows like others; texts of any length
    count whole, about CHARS characters at a time; other columns don't matter. The model's size is bounded by the sample's.
    """
    out = predicted(docs, fit(docs), evidence=evidence)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "entropy", "accepted")
