"""Garbled text from wrong character encoding (problem 6).

A hidden Markov model with a clean state and a state per encoding pair or chain of two labels the characters of
each line. A state's emissions depend on the character and the class of the one before it. The
clean state's come from counts over the distinct cells of all rows, without those found garbled;
a pair's come from a bounded sample of rows, encoded in the pair's first encoding and decoded in its second. Each labelled span then gets its
state's inverse transform.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.session import stored

#: (written in, read as)
PAIRS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "big5"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"),
    ("utf-8", "koi8-r"), ("utf-8", "cp949"), ("gb18030", "cp1252"), ("gb18030", "latin-1"), ("gb18030", "big5"), ("gb18030", "utf-8"), ("gb18030", "cp437"), ("gb18030", "cp932"), ("gb18030", "cp949"),
    ("big5", "gb18030"), ("big5", "cp1252"), ("cp932", "gb18030"), ("cp932", "cp1252"), ("cp1252", "utf-8"),
)
#: Readings after which a text is often garbled once more.
_LATIN = (("utf-8", "cp1252"), ("utf-8", "latin-1"))
#: The states: each pair, and the pairs that give text which a Latin reading garbles again, composed with it.
CHAINS = tuple((p,) for p in PAIRS) + tuple((a, b) for a in PAIRS if a[0] in ("utf-8", "gb18030") and a[1] in ("cp1252", "latin-1") for b in _LATIN)
#: Symbols: a code point of the first plane each, beyond it one for each 256 code points.
_N = 0x11000
#: Borders of the classes of code points; _SYMBOL overrides.
_BORDERS = np.array([0x00, 0x21, 0x30, 0x3A, 0x41, 0x5B, 0x61, 0x7B, 0x80, 0xC0, 0x100, 0x250, 0x370, 0x2500, 0x2600, 0x3000, 0x3040, 0x3100, 0x3130, 0x4E00, 0xA000, 0xE000, 0xF900, 0xFF00, 0xFF61, 0xFFA0, 0xFFF0])
_CLASS_OF = np.array([1, 2, 3, 2, 4, 2, 4, 2, 5, 6, 7, 5, 8, 9, 5, 10, 11, 10, 12, 12, 13, 14, 10, 10, 15, 10, 16], np.uint8)
CLASSES = 17
_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
#: cp1252 with its five undefined bytes read as latin-1, as browsers do.
_FROM_LATIN1 = {b: chr(b) if b in _UNDEFINED else bytes([b]).decode("cp1252") for b in range(128, 160)}
_TO_LATIN1 = {ord(c): chr(b) for b, c in _FROM_LATIN1.items()}
_CP1252 = "".join(_FROM_LATIN1.get(b, chr(b)) for b in range(256))


def _read(data: bytes, decoder: str, errors: str) -> str:
    return codecs.charmap_decode(data, errors, _CP1252)[0] if decoder == "cp1252" else data.decode(decoder, errors)


def _written(text: str, encoder: str, errors: str = "strict") -> bytes:
    return text.translate(_TO_LATIN1).encode("latin-1", errors) if encoder == "cp1252" else text.encode(encoder, errors)


#: A UTF-8 sequence read as Latin; no clean text of any language is likely to hold one.
_TAIL = "[\x80-\xbf" + "".join(_FROM_LATIN1.values()) + "]"
_LATIN_UTF8 = re.compile(f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}")


def garble(text: str, *chain: tuple[str, str]) -> str:
    for written, read in chain:
        text = _read(text.encode(written, "ignore"), read, "replace")
    return text


def code_points(text: str) -> np.ndarray:
    """The text's symbols."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x10000, points, 0xFF00 + (points >> np.uint32(8)))


def class_table() -> np.ndarray:
    return _CLASS_OF[np.searchsorted(_BORDERS, np.minimum(np.arange(_N), 0xFFFF), side="right") - 1]


def keys_of(points: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the character before, times the symbols, plus the character; class 0 at a line's start."""
    before = np.zeros(len(points), np.uint32)
    before[1:] = classes[points[:-1]]
    before[starts[starts < len(points)]] = 0
    return before * _N + points


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def _flat(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    return code_points("".join(lines)), starts, lengths


def _tally(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    points, starts, _ = _flat(lines)
    counts = np.bincount(keys_of(points, starts, class_table()), minlength=1)
    keys = np.flatnonzero(counts)
    return keys, counts[keys]


def _rises(gains: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The greatest sum of a run of gains in each line, over all columns, if there are such; lengths are above 0."""
    if not len(lengths):
        return np.zeros(0)
    ends = np.cumsum(lengths)
    first = ends - lengths
    sums = np.cumsum(gains, axis=0, dtype=np.float64)
    # Each line's sums lie below all of the lines before, so the running least never looks back over its start.
    drop = np.repeat(np.arange(len(lengths)) * 1e7, lengths)
    sums -= drop if gains.ndim == 1 else drop[:, None]
    before = np.empty_like(sums)
    before[1:] = sums[:-1]
    # A line's first has the sum of the lines before, at its own height.
    before[first[1:]] -= 1e7
    before[0] = 0
    sums -= np.minimum.accumulate(before, axis=0, out=before)
    return np.maximum.reduceat(sums if gains.ndim == 1 else sums.max(axis=1), first)


@dataclass
class Model:
    """Log odds of each chain's state against the clean one."""

    slot: np.ndarray  # symbol -> column of gains, 0 for unknown
    gains: np.ndarray  # (classes, columns, chains), float16, so that a model is some 20 MB
    enter: float
    leave: float
    common: np.ndarray  # symbol -> log probability in clean text

    def __post_init__(self):
        self.classes = class_table()
        self.best = self.gains.max(axis=2).astype(np.float32)
        self.least = self.enter + self.leave

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray, tallies: Sequence[tuple[np.ndarray, np.ndarray]], backoff: float, enter: float = 7.5, leave: float = 2.5) -> Model:
        """keys, counts: of clean text. tallies: the same of each chain's garbled text. backoff: weight of unconditioned counts, as a share of all."""
        alphabet = np.unique(np.concatenate([k % _N for k, _ in [(keys, counts), *tallies]]))
        slot = np.zeros(_N, np.uint16)
        slot[alphabet] = np.arange(1, len(alphabet) + 1)
        width = len(alphabet) + 1

        def logs(k: np.ndarray, n: np.ndarray, strength: float) -> np.ndarray:
            """Class-conditioned probabilities, backed off to the unconditioned ones."""
            joint = np.zeros((CLASSES, width), np.float64)
            np.add.at(joint, (k // _N, slot[k % _N]), n)
            alone = joint.sum(axis=0)
            alone = (alone + 0.02) / (alone.sum() + 0.02 * width)
            total = joint.sum(axis=1, keepdims=True)
            return np.log((joint + strength * alone) / (total + strength))

        clean = logs(keys, counts, 20.0 + backoff * counts.sum())
        gains = np.stack([logs(k, n, 20.0) - clean for k, n in tallies], axis=2)
        # Characters that no transform of this chain gives are near impossible there; ASCII after ASCII tells nothing.
        ascii_columns = slot[alphabet[alphabet < 128]]
        for c in (1, 2, 3, 4):
            gains[c, ascii_columns] = 0
        gains[0, ascii_columns] = 0
        alone = np.bincount(slot[keys % _N], counts, width)
        common = np.log((alone + 0.01) / (alone.sum() + 0.01 * width))[slot]
        return cls(slot, np.clip(gains, -12, 12).astype(np.float16), enter, leave, common.astype(np.float32))

    def suspects(self, lines: Sequence[str]) -> list[int]:
        """Lines on which some path beats the clean one.

        Such a path holds a span whose gain in one state pays for entering and leaving it; so the
        greatest sum of a run of gains, for each state, tells all of them and no others.
        """
        points, starts, lengths = _flat(lines)
        if not len(points):
            return []
        keys = keys_of(points, starts, self.classes)
        slots, kinds = self.slot[points], keys // _N
        filled = np.flatnonzero(lengths)
        rough = filled[_rises(self.best[kinds, slots], lengths[filled]) >= self.least]
        out, at = [], 0
        while at < len(rough):
            end = at + 1
            size = lengths[rough[at]]
            while end < len(rough) and size + lengths[rough[end]] < 100_000:
                size += lengths[rough[end]]
                end += 1
            chosen = rough[at:end]
            own = lengths[chosen]
            first = np.concatenate([[0], np.cumsum(own)[:-1]])
            where = np.repeat(starts[chosen] - first, own) + np.arange(own.sum())
            out += chosen[_rises(self.gains[kinds[where], slots[where]], own) >= self.least].tolist()
            at = end
        return out

    def spans(self, line: str) -> list[tuple[int, int, int, np.ndarray]]:
        """Viterbi: (start, end, number of the chain, gain of each chain) of each span that isn't clean."""
        return next(self.spans_of([line]))[1]

    def spans_of(self, lines: Sequence[str]) -> Iterator[tuple[int, list[tuple[int, int, int, np.ndarray]]]]:
        """Each line's place with its spans, longest first: lines of like length take each step at once, some 20,000 characters at a time."""
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        at = 0
        while at < len(order):
            end = at + max(1, 20_000 // max(1, len(lines[order[at]])))
            yield from zip(order[at:end], self._labelled([lines[i] for i in order[at:end]]))
            at = end

    def _labelled(self, lines: Sequence[str]) -> list[list[tuple[int, int, int, np.ndarray]]]:
        """The spans of lines in falling order of length."""
        points, starts, lengths = _flat(lines)
        keys = keys_of(points, starts, self.classes)
        g = np.zeros((lengths[0], len(lines), len(CHAINS)))
        row = np.repeat(np.arange(len(lines)), lengths)
        g[np.arange(len(points)) - starts[row], row] = self.gains[keys // _N, self.slot[points]]
        clean, other = np.zeros(len(lines)), np.full((len(lines), len(CHAINS)), -np.inf)
        entered = np.zeros(g.shape, bool)
        left = np.full((lengths[0] + 1, len(lines)), -1)
        # How many lines are longer than so many characters.
        longer = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
        rows = np.arange(len(lines))
        for t, n in enumerate(longer):
            own, fresh = other[:n], clean[:n] - self.enter
            np.less_equal(own, fresh[:, None], out=entered[t, :n])
            k = own.argmax(axis=1)
            after = own[rows[:n], k] - self.leave
            better = after > clean[:n]
            left[t, :n][better] = k[better]
            clean[:n][better] = after[better]
            np.maximum(own, fresh[:, None], out=own)
            own += g[t, :n]
        last = other.argmax(axis=1)
        last = np.where(other[rows, last] - self.leave > clean, last, -1).tolist()
        return [self._traced(g[:size, i], entered[:size, i], left[: size + 1, i].tolist(), last[i]) for i, size in enumerate(lengths.tolist())]

    @staticmethod
    def _traced(g: np.ndarray, entered: np.ndarray, left: list[int], state: int) -> list[tuple[int, int, int, np.ndarray]]:
        out, t, end = [], len(g), len(g)
        while t > 0:
            if state < 0:
                if left[t] >= 0 and t < len(g):
                    state, end = left[t], t
                    continue
                t -= 1
            else:
                t -= 1
                if entered[t, state]:
                    out.append((t, end, state, g[t:end].sum(axis=0)))
                    state = -1
                    if left[t] >= 0 and t < len(g) and t > 0:
                        state, end = left[t], t
        return out[::-1]

    def restore(self, span: str, chain: int) -> tuple[str | None, bool]:
        """The inverse transforms: the text, or None if too much of it is lost, and whether it is whole."""
        text = span
        try:
            if "\ufffd" in span:
                raise UnicodeError
            for written, read in reversed(CHAINS[chain]):
                text = _written(text, read).decode(written)
            return text, True
        except UnicodeError:
            pass
        text = span
        for written, read in reversed(CHAINS[chain]):
            text = _written(text.replace("\ufffd", "?"), read, "replace").decode(written, "replace")
        lost = text.count("\ufffd") + text.count("?") - span.count("?")
        return (text, False) if lost <= 0.5 * len(text) else (None, False)

    def likelihood(self, text: str) -> float:
        """Mean log probability of the characters beyond ASCII in clean text."""
        points = code_points(text)
        points = points[points >= 128]
        return float(self.common[points].mean()) if len(points) else 0.0

    def _undone(self, line: str, start: int, end: int, chain: int, gain: float) -> tuple[int, int, str | None, bool] | None:
        """(start, end, text, whole) of the span as the chain's inverse gives it; None if that speaks against the label."""
        while start < end and line[start] < "\x80":
            start += 1
        while end > start and line[end - 1] < "\x80" and not (CHAINS[chain][-1][0] != "utf-8" and line[end - 1] > "?"):
            end -= 1
        span = line[start:end]
        if len(span) <= 4 and "\ufffd" not in span and (line[start - 1 : start] >= "\u2e80" or line[end : end + 1] >= "\u2e80"):
            return None  # a wrong decoding spoils the whole of a cell or sentence, not a few characters in a word
        text, exact = self.restore(span, chain)
        if exact and text is not None:
            # The shorter the span, the more its inverse must have in its favour; a text garbled again has it only after all rounds.
            asked = self.likelihood(span) + max(1.0, 6.0 - 2 * len(span))
            good = self.likelihood(text) > asked or (len(text) < len(span) and bool(self.suspects([text])) and self.likelihood(self.repaired(text)[0]) > asked)
        elif text is not None and "\ufffd" not in span:
            good = gain >= self.least + 6 and self.likelihood(text.replace("\ufffd", "")) > self.likelihood(span) + 1
        else:
            good = gain >= self.least + 6 or "\ufffd" in span
        return (start, end, text, exact) if good else None

    def _tries(self, line: str, first: int, last: int, best: int, gains: np.ndarray) -> Iterator[tuple[int, int, str | None, bool]]:
        """What the labelled state's inverse gives, then those of the others that would pay for the span as well: what one can't undo, another may."""
        for k in (best, *(int(k) for k in np.argsort(-gains, kind="stable") if k != best and gains[k] >= self.least)):
            if x := self._undone(line, first, last, k, float(gains[k])):
                yield x

    def is_garbled(self, line: str, spans: Sequence[tuple] | None = None) -> bool:
        """Whether ``repaired`` finds a span; none is restored but for the first that tells."""
        return any(True for span in (self.spans(line) if spans is None else spans) for _ in self._tries(line, *span))

    def repaired(self, line: str, spans: Sequence[tuple] | None = None) -> tuple[str, int, int]:
        """(text with spans restored where possible, number of garbled spans, of those restored whole).

        What no state undoes at once is restored in rounds, as long as a round makes the text shorter.
        """
        out, at, found, whole = [], 0, 0, 0
        for span in self.spans(line) if spans is None else spans:
            chosen = None  # the first that is whole, else the first; none is tried behind a whole one
            for x in self._tries(line, *span):
                chosen = x if chosen is None or x[3] else chosen
                if x[3]:
                    break
            if chosen is None:
                continue
            start, end, text, exact = chosen
            found += 1
            out.append(line[at:start])
            out.append(line[start:end] if text is None else text)
            whole += exact
            at = end
        text = "".join(out) + line[at:]
        if whole and len(text) < len(line) and self.suspects([text]):
            text = self.repaired(text)[0]
        return text, found, whole


def pieces_of(text: Column) -> Column:
    """A text's lines, cut at quotes and tabs into cells: each with the sign before it, a line's first with the line feed."""
    return F.split(F.replace(F.replace(F.replace(F.concat(F.lit("\n"), F.replace(text, F.lit("\0"), F.lit(" "))), F.lit("\n"), F.lit("\0\n")), F.lit('"'), F.lit('"\0"')), F.lit("\t"), F.lit("\t\0\t")), "\0")


def _weights(counts: np.ndarray) -> np.ndarray:
    """What a piece counts that occurs so often: copies add up as their logarithm, so that neither a line of a third of all rows drowns the rest, nor a site's line on each of its pages looks rare."""
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def _tally_pieces(pieces: Sequence[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted counts of the pieces' keys, without their first signs, which belong to the pieces before, and without pieces that hold UTF-8 read as Latin."""
    kept = [k for k, x in enumerate(pieces) if len(x) > 1 and not _LATIN_UTF8.search(x)]
    points, starts, lengths = _flat([pieces[k] for k in kept])
    classes = class_table()
    classes[10] = 0  # a line's start; no line holds a line feed
    inner = np.ones(len(points), bool)
    inner[starts] = False
    counts = np.bincount(keys_of(points, starts, classes)[inner], np.repeat(weights[kept], lengths)[inner], minlength=1).astype(np.int64)
    keys = np.flatnonzero(counts)
    return keys, counts[keys]


def _counted(pieces: DataFrame, model: Model | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the different pieces p with their numbers n, in order, and their weighted counts; with a model, of the pieces in which it finds
    something garbled. At most the classes times the symbols reach the driver.
    """
    sent = pieces.sparkSession.sparkContext.broadcast(model)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(CLASSES * _N, np.int64)
        for batch in batches:
            own, n = batch["p"].tolist(), batch["n"].to_numpy()
            if sent.value is not None:
                bare = [x[1:] if x[:1] == "\n" else x for x in own]
                doubted = sent.value.suspects(bare)
                bad = sorted(doubted[j] for j, spans in sent.value.spans_of([bare[i] for i in doubted]) if sent.value.is_garbled(bare[doubted[j]], spans))
                own, n = [own[i] for i in bad], n[bad]
            if len(own):
                k, w = _tally_pieces(own, _weights(n))
                sums[k] += w
        k = np.flatnonzero(sums)
        yield pd.DataFrame({"k": k, "n": sums[k]})

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    counts = pieces.mapInPandas(tally, schema).groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    sent.destroy()  # a model takes its size on each machine
    return counts["k"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)


class Repairs:
    """A model's findings on lines, each different line looked at once; what is remembered is bounded, what is found isn't."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.known: dict[str, tuple[str, int, int]] = {}

    def of(self, lines: Sequence[str]) -> dict[str, tuple[str, int, int]]:
        """Of the lines with something garbled: what ``Model.repaired`` gives."""
        different = list(dict.fromkeys(lines))
        if len(self.known) > self.most:
            self.known.clear()
        out = {}
        doubted = [different[i] for i in self.model.suspects(different)]
        fresh = [x for x in doubted if x not in self.known]
        for i, spans in self.model.spans_of(fresh):
            self.known[fresh[i]] = self.model.repaired(fresh[i], spans)
        for line in doubted:
            if self.known[line][1]:
                out[line] = self.known[line]
        return out


def fit_model(df: DataFrame, text: str, sample_rows: int = 3000, passes: int = 2, **options) -> Model:
    """Clean counts come from all rows, each distinct cell by the logarithm of its copies; what a first model finds
    garbled in any of them leaves the counts of a second, and so on for so many passes. ``sample_rows`` different texts, of the least
    hash, are garbled for the pairs' emissions. The distinct cells are written to the shared folder meanwhile.
    """
    rows = df.select(F.col(text).alias("t")).where("t is not null")
    # Hashes below a bound leave about twice the sample, whatever the number of rows; the least of them are taken.
    texts = rows.select(F.approx_count_distinct(F.xxhash64("t"), 0.02)).first()[0]
    hashed = rows.select("t", F.xxhash64("t").alias("h")).where(F.pmod("h", F.lit(1 << 40)) < int(min(1.0, 2 * sample_rows / max(1, texts)) * (1 << 40)) + 1)
    picked = hashed.dropDuplicates(["h"]).orderBy("h").limit(sample_rows).collect()
    once = "\n".join(dict.fromkeys(x for r in picked for x in lines_of(r.t)))
    tallies = [_tally(garble(once, *chain).split("\n")) for chain in CHAINS]
    with stored(rows.select(F.explode(pieces_of(F.col("t"))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))) as pieces:
        keys, counts = _counted(pieces)
        # The replacement sign is the mark of a failed decoding; no clean text has it.
        clean = keys % _N != 0xFFFD
        keys, counts = left, kept = keys[clean], counts[clean]
        for _ in range(passes):
            k, n = _counted(pieces, Model.fit(left, kept, tallies, 0.05, **options))
            dense = np.zeros(CLASSES * _N)
            dense[keys] = counts
            dense[k] -= n
            dense[0xFFFD::_N] = 0
            left = np.flatnonzero(dense > 0)
            kept = dense[left]
    return Model.fit(left, kept, tallies, 0.0005, **options)


def find_garbled(df: DataFrame, keys: Sequence[str], text: str, model: Model | None = None, sample_rows: int = 3000) -> DataFrame:
    """Records with a garbled passage.

    Returns the key columns, ``restored`` (the whole text, with the spans restored that can be),
    ``spans`` and ``spans_restored``. Null and empty texts give nothing; repeated rows are all
    reported; only keys and text are read; texts are read whole, line by line. Map-only: the model
    (a few MB, bounded by the 65,536 code points and the pairs) is sent to the executors.
    """
    model = model or fit_model(df, text, sample_rows)
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("restored", T.StringType()), T.StructField("spans", T.IntegerType()), T.StructField("spans_restored", T.IntegerType())])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairs = Repairs(sent.value)
        for batch in batches:
            texts = [lines_of(t) for t in batch["__t"]]
            fixed = repairs.of([x for own in texts for x in own])
            if not fixed:
                continue
            at = [n for n, own in enumerate(texts) if any(x in fixed for x in own)]
            out = batch.iloc[at][list(keys)].copy()
            out["restored"] = ["\n".join(fixed[x][0] if x in fixed else x for x in texts[n]) for n in at]
            for column, k in (("spans", 1), ("spans_restored", 2)):
                out[column] = [sum(fixed[x][k] for x in texts[n] if x in fixed) for n in at]
            yield out

    return df.select(*(df[k] for k in keys), df[text].alias("__t")).where("__t is not null").mapInPandas(search, schema)
