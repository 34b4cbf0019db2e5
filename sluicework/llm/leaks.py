"""Evaluation texts leaking into training text (problem 9).

The test items form a BM25 inverted index over character grams of their reduced text. Every
passage of every document queries it; block-max WAND returns all items that score at least the
item's own threshold, and an exact check of common runs follows. The threshold of an item is
the least score that any of its windows of ``min_run`` characters can give, so that retrieval
loses no document that holds such a window.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 8
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_KEPT = re.compile(r"[^\W_]+")


def reduced(text: str | None) -> str:
    """Letters and digits of the NFKC form in lower case."""
    return "".join(_KEPT.findall(unicodedata.normalize("NFKC", text or "").lower()))


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each run of eight code points, by doubling."""
    h, step = points.astype(np.uint64) + np.uint64(1), 1
    for m in _MULTIPLIERS:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * m + h[step:]
        step *= 2
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class ItemIndex:
    """BM25 postings of the items' grams, in blocks with their greatest impact."""

    K1, B, BLOCK = 1.2, 0.75, 32

    def __init__(self, ids: list, texts: list[str], answers: list[str], min_run: int):
        if min_run < GRAM:
            raise ValueError(f"min_run is at least {GRAM}")
        self.ids, self.min_run = ids, min_run
        self.texts = [reduced(t) for t in texts]
        self.answers = [reduced(a) for a in answers]
        grams = [gram_hashes(code_points(t)) for t in self.texts]
        counts = [Counter(g.tolist()) for g in grams]
        mean = max(1.0, sum(map(len, grams)) / max(1, len(grams)))
        df = Counter(g for c in counts for g in c)
        n = len(ids)
        idf = {g: math.log(1 + (n - k + 0.5) / (k + 0.5)) for g, k in df.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.thresholds = []
        for i, (c, g) in enumerate(zip(counts, grams)):
            norm = self.K1 * (1 - self.B + self.B * len(g) / mean)
            impact = {x: idf[x] * k * (self.K1 + 1) / (k + norm) for x, k in c.items()}
            for x, w in impact.items():
                postings[x].append((i, w))
            self.thresholds.append(self._least(g.tolist(), impact))
        self.least = min((t for t in self.thresholds if t is not None), default=math.inf)
        self.postings = {x: ([i for i, _ in p], [w for _, w in p], [max(w for _, w in p[b : b + self.BLOCK]) for b in range(0, len(p), self.BLOCK)], max(w for _, w in p)) for x, p in postings.items()}
        self.keys = np.array(sorted(self.postings), np.uint64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True
        self.runs: dict[int, set[str]] = {}

    def _least(self, grams: list[int], impact: dict[int, float]) -> float | None:
        """The least score of a window: the sum over the different grams in it."""
        width = self.min_run - GRAM + 1
        if len(grams) < width:
            return None
        inside: Counter = Counter()
        total, least = 0.0, math.inf
        for at, g in enumerate(grams):
            inside[g] += 1
            total += impact[g] if inside[g] == 1 else 0.0
            if at >= width:
                old = grams[at - width]
                inside[old] -= 1
                total -= impact[old] if not inside[old] else 0.0
            if at >= width - 1:
                least = min(least, total)
        return least * (1 - 1e-6)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of grams that the index holds."""
        at = np.flatnonzero(self.bits[h >> np.uint64(42)])
        if not len(at) or not len(self.keys):
            return at[:0]
        found = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[found] == h[at]]

    def retrieve(self, grams: set[int]) -> list[int]:
        """Block-max WAND: all items whose score reaches their threshold."""
        lists = [self.postings[g] for g in grams]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        out = []
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]])
            upper, pivot = 0.0, -1
            for n, k in enumerate(live):
                upper += lists[k][3]
                if upper >= self.least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            head = live[: pivot + 1]
            bound, border = 0.0, math.inf
            for k in head:
                ids, _, maxima, _ = lists[k]
                b = at[k] // self.BLOCK
                while b < len(maxima) - 1 and ids[min((b + 1) * self.BLOCK, len(ids)) - 1] < item:
                    b += 1
                bound += maxima[b]
                border = min(border, ids[min((b + 1) * self.BLOCK, len(ids)) - 1])
            if bound < self.least:
                # No item up to the nearest border of these blocks can reach it, nor beyond the next list's item.
                following = lists[live[pivot + 1]][0][at[live[pivot + 1]]] if pivot + 1 < len(live) else math.inf
                target = max(item + 1, min(border + 1, following))
            else:
                score = sum(lists[k][1][p] for k in head if (p := self._seek(lists[k][0], at[k], item)) < len(lists[k][0]) and lists[k][0][p] == item)
                if self.thresholds[item] is not None and score >= self.thresholds[item]:
                    out.append(item)
                target = item + 1
            for k in head:
                at[k] = self._seek(lists[k][0], at[k], target)
            live = [k for k in live if at[k] < len(lists[k][0])]
        return out

    @staticmethod
    def _seek(ids: list[int], start: int, target: float) -> int:
        while start < len(ids) and ids[start] < target:
            start += 1
        return start

    def verified(self, passage: str, starts: list[int], item: int) -> tuple[int, bool] | None:
        """Length of the longest common run, and whether the answer follows it; None if the run is short."""
        if item not in self.runs:
            t = self.texts[item]
            self.runs[item] = {t[i : i + self.min_run] for i in range(len(t) - self.min_run + 1)}
        runs, best, end, length, last = self.runs[item], 0, 0, 0, -2
        for s in starts:
            if passage[s : s + self.min_run] in runs:
                length = length + 1 if s == last + 1 else self.min_run
                last = s
                if length > best:
                    best, end = length, s + self.min_run
        if not best:
            return None
        answer = self.answers[item]
        return best, bool(answer) and answer in passage[end : end + len(answer) + 20]


def _passages(text: str, size: int, overlap: int) -> Iterator[str]:
    for at in range(0, max(1, len(text) - overlap), size):
        yield text[at : at + size + overlap]


def leaked_in(index: ItemIndex, texts: list[str], passage_chars: int) -> Iterator[tuple[int, int, int, bool]]:
    """(text number, item number, longest run, answer follows) of each leak in the reduced texts."""
    width = index.min_run - GRAM + 1
    h = gram_hashes(code_points("\0" * GRAM + ("\0" * GRAM).join(texts) + "\0" * GRAM))
    at = index.hits(h)
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths + GRAM)[:-1]]) + GRAM if len(texts) else np.zeros(0, int)
    owner = np.searchsorted(begins, at, side="right") - 1
    for n in np.flatnonzero(np.bincount(owner[owner >= 0], minlength=len(texts)) >= width):
        mine = at[owner == n] if len(at) < 4096 else at[np.searchsorted(owner, n) : np.searchsorted(owner, n, side="right")]
        positions = mine - begins[n]
        values = h[mine]
        found: dict[int, tuple[int, bool]] = {}
        for k, passage in enumerate(_passages(texts[n], passage_chars, index.min_run - 1)):
            low = k * passage_chars
            inside = (positions >= low) & (positions <= low + len(passage) - GRAM)
            grams = set(values[inside].tolist())
            if not grams:
                continue
            starts = (positions[inside] - low).tolist()
            for item in index.retrieve(grams):
                if got := index.verified(passage, starts, item):
                    old = found.get(item, (0, False))
                    found[item] = (max(old[0], got[0]), old[1] or got[1])
        for item, (run, answer) in found.items():
            yield int(n), item, run, answer


#: The index that this worker built last, by the digest of its items.
_BUILT: dict[str, ItemIndex] = {}


def index_of(digest: str, items: tuple[list, list[str], list[str]], min_run: int) -> ItemIndex:
    """The index of the items, built once in a worker, however many tasks it runs."""
    if digest not in _BUILT:
        _BUILT.clear()
        _BUILT[digest] = ItemIndex(*items, min_run)
    return _BUILT[digest]


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = "answer",
    min_run: int = 30, passage_chars: int = 2000, index_chars: int = 20_000_000,
) -> DataFrame:
    """Documents that hold ``min_run`` consecutive letters or digits of a test item.

    Returns doc_id, item_id, ``run_chars`` (longest common run, in letters and digits) and
    ``answer_follows``. Null and empty texts and items shorter than ``min_run`` give nothing;
    repeated documents give repeated rows; items with the same text are all reported; other
    columns aren't read. Texts are read whole, in passages of ``passage_chars`` that overlap so that
    no run is cut. The corpus is never shuffled; the index of at most ``index_chars`` characters is
    sent to the executors, and a larger test set is worked off in so many blocks.
    """
    chosen = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit("")).alias("a")).where("i is not null and t is not null")
    total = chosen.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // index_chars))
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("run_chars", T.IntegerType()), T.StructField("answer_follows", T.BooleanType())])
    corpus = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t is not null")
    out = None
    for block in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i").collect() if blocks > 1 else chosen.orderBy("i").collect()
        own = ([r.i for r in rows], [r.t for r in rows], [r.a for r in rows])
        digest = hashlib.sha256(repr((own, min_run)).encode("utf-8", "surrogatepass")).hexdigest()
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def search(batches: Iterator[pd.DataFrame], sent=sent, digest=digest) -> Iterator[pd.DataFrame]:
            index = index_of(digest, sent.value, min_run)
            for batch in batches:
                found = list(leaked_in(index, [reduced(t) for t in batch["t"]], passage_chars))
                yield pd.DataFrame(
                    {doc_id: [batch["d"].iat[n] for n, *_ in found], item_id: [index.ids[i] for _, i, *_ in found], "run_chars": pd.array([r for *_, r, _ in found], "int32"), "answer_follows": [bool(a) for *_, a in found]}
                )

        part = corpus.mapInPandas(search, schema)
        out = part if out is None else out.unionByName(part)
    return out
