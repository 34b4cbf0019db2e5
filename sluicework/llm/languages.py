"""Missing or wrong document language labels (problem 10).

Each language has unigram probabilities over the pieces of a fixed public vocabulary. A text's
score in a language is its probability summed over all of its segmentations into pieces, by a
forward algorithm. No piece of the vocabulary crosses a word border, so the sum over a text's
segmentations is the product of the sums over its words, and a word is scored once however often
it occurs. Sentences are scored, and a Viterbi pass over a document's sentences, which charges for a
change of language, gives the segments.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("zh", "en", "fr", "de", "es", "pt", "ja")
# Three-letter codes and names of the languages.
_NAMES = {
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语", "en": "en eng english", "fr": "fr fra fre french français", "de": "de deu ger german deutsch",
    "es": "es spa spanish español castilian", "pt": "pt por portuguese português", "ja": "ja jp jpn japanese 日本語",
}
_CODE = {name: lang for lang, names in _NAMES.items() for name in names.split()}

_LINK = re.compile(r"(?:https?://|www\.)[!-~]+|[\w.+-]+@[\w-]+\.[\w.]+")
_JOINED = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\u31f0-\u31ff"  # scripts without spaces: Han and kana
_STOP = re.compile(r"([.!?;；])[ \t\u3000\xa0]+")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(f"(?:(?![{_JOINED}])[^\\W\\d_])+")
_FAST_WORD = re.compile("[a-zß-öø-ɏ]+")
_OTHER = re.compile(f"(?![{_JOINED}a-zß-öø-ɏ])[^\\W\\d_]")


def label_language(label: str | None) -> str | None:
    """The language that a label names, in whatever spelling; None for none of the seven."""
    return _CODE.get(re.split(r"[-_]", (label or "").strip().lower())[0])


def load_pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces; path: a SentencePiece model, by default the installed public one of 32,000 pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class Scorer:
    """Piece probabilities of each language, and words' scores by the forward algorithm.

    A word is a run of letters or, in scripts without spaces, one character; where pieces of several
    such characters overlap, the whole chain is one word.
    """

    FLOOR = 0.02
    SCALE = 1e4  # a power of it for each character keeps the sums within a float's range
    LONG = 48  # words of more characters are summed by logarithms, which no length can take out of range

    def __init__(self, pieces: Sequence[str]):
        letters = [p for p in pieces if _LETTER.search(p) and "▁" not in p[1:]]
        self.ids = {p: i for i, p in enumerate(dict.fromkeys(letters))}
        self.longest = max(map(len, self.ids), default=1)
        chained = sorted((p for p in self.ids if len(p) > 1 and re.fullmatch(f"[{_JOINED}]+", p)), key=len, reverse=True)
        self.chain = re.compile("(?:" + "|".join(map(re.escape, chained)) + ")+") if chained else None
        self.odds = np.ones((len(self.ids) + 1, len(LANGUAGES)))  # of pieces, times SCALE for each character; the last: of a character that is no piece
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES)))
        self.joined: np.ndarray | None = None

    def lattice(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Length and (start, end, piece) of all pieces in a word; -1: a character that is no piece."""
        marked = word if re.match(f"[{_JOINED}]", word) else "▁" + word
        out = []
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + self.longest) + 1):
                k = self.ids.get(marked[i:j])
                if k is not None:
                    out.append((i, j, k))
            if marked[i] not in self.ids:
                out.append((i, i + 1, -1))
        return len(marked), out

    def forward(self, word: str) -> np.ndarray:
        """Log probability in each language, over all segmentations of the whole word."""
        n, edges = self.lattice(word)
        if n > self.LONG:
            return self._logs(n, edges)[n] - n * math.log(self.SCALE)
        alpha = np.zeros((n + 1, len(LANGUAGES)))
        alpha[0] = 1
        for i, j, k in edges:
            alpha[j] += alpha[i] * self.odds[k]
        return np.log(alpha[n]) - n * math.log(self.SCALE)

    def _logs(self, n: int, edges: Sequence[tuple[int, int, int]], backward: bool = False) -> np.ndarray:
        """Logarithms of the sums over all segmentations up to each place, or from it on; every place can be reached."""
        out = np.full((n + 1, len(LANGUAGES)), -np.inf)
        out[n if backward else 0] = 0
        for i, j, k in reversed(edges) if backward else edges:
            here, there = (i, j) if backward else (j, i)
            out[here] = np.logaddexp(out[here], out[there] + np.log(self.odds[k]))
        return out

    def fit(self, counts: dict[str, np.ndarray], rounds: int = 1) -> None:
        """Expectation maximisation over words with their counts in each language."""
        lattices = {w: self.lattice(w) for w in counts}
        sizes = np.array([*map(len, self.ids), 1], float)[:, None]
        weights = np.full(self.odds.shape, self.FLOOR)
        for w, (_, edges) in lattices.items():
            for _, _, k in edges:
                weights[k] += counts[w] / len(edges) * (k >= 0)
        for _ in range(rounds):
            self.odds = weights / weights.sum(axis=0) * self.SCALE**sizes
            weights = np.full(self.odds.shape, self.FLOOR)
            for w, (n, edges) in lattices.items():
                if n > self.LONG:
                    ahead, behind = self._logs(n, edges), self._logs(n, edges, backward=True)
                    for i, j, k in edges:
                        if k >= 0:
                            weights[k] += counts[w] * np.exp(ahead[i] + np.log(self.odds[k]) + behind[j] - ahead[n])
                    continue
                alpha, beta = np.zeros((n + 1, len(LANGUAGES))), np.zeros((n + 1, len(LANGUAGES)))
                alpha[0] = beta[n] = 1
                for i, j, k in edges:
                    alpha[j] += alpha[i] * self.odds[k]
                for i, j, k in reversed(edges):
                    beta[i] += beta[j] * self.odds[k]
                scale = counts[w] / alpha[n]
                for i, j, k in edges:
                    if k >= 0:
                        weights[k] += alpha[i] * self.odds[k] * beta[j] * scale
        self.odds = weights / weights.sum(axis=0) * self.SCALE**sizes
        self._forget()

    def _number(self, word: str, table_of=None) -> int:
        n = self.known[word] = len(self.known)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = (table_of or self.forward)(word)
        return n

    def _joined_scores(self) -> np.ndarray:
        """Code point -> score of a character of a script without spaces, 0 for all others."""
        if self.joined is None:
            out = np.zeros((0x10000, len(LANGUAGES)))
            for c in re.findall(f"[{_JOINED}]", "".join(map(chr, range(0x3040, 0xFB00)))):
                out[ord(c)] = np.log(self.odds[self.ids.get(c, -1)]) - math.log(self.SCALE)
            self.joined = out
        return self.joined

    def _chain_gain(self, chain: str) -> np.ndarray:
        """What a chain of overlapping pieces scores beyond its characters."""
        return self.forward(chain) - self._joined_scores()[[min(ord(c), 0xFFFF) for c in chain]].sum(axis=0)

    def scores(self, sentences: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each sentence in each language, and its number of words."""
        text = unicodedata.normalize("NFKC", "\n".join(sentences)).lower()
        text = _LINK.sub(" ", text) if "://" in text or "@" in text or "www." in text else text
        lines = text.split("\n")
        table = self._joined_scores()
        if len(self.known) > 300_000:  # bounds the memory, not the result
            self.known, self.table = {}, np.zeros((1024, len(LANGUAGES)))
        get, number = self.known.get, self._number
        words = [_FAST_WORD.findall(x) for x in lines]
        if _OTHER.search(text):
            words = [_WORD.findall(x) if _OTHER.search(x) else w for x, w in zip(lines, words)]
        lengths = np.array([len(w) for w in words])
        flat = np.array([n if (n := get(w)) is not None else number(w) for x in words for w in x], np.int64)
        out = np.zeros((len(lines), len(LANGUAGES)))
        filled = np.flatnonzero(lengths)
        if len(filled):
            out[filled] = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]])[filled], axis=0)
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        at = np.flatnonzero(table[points, 0])
        if len(at):
            sizes = np.array([len(x) for x in lines])
            owner = np.searchsorted(np.cumsum(sizes + 1), at, side="right")
            some, first = np.unique(owner, return_index=True)
            out[some] += np.add.reduceat(table[points[at]], first, axis=0)
            lengths = lengths + np.bincount(owner, minlength=len(lines))
            if self.chain and self.chain.search(text):
                for n, x in enumerate(lines):
                    for c in self.chain.findall(x):
                        k = get("=" + c)
                        out[n] += self.table[number("=" + c, lambda w: self._chain_gain(w[1:])) if k is None else k]
        return out, lengths


def sentences_of(text: str) -> list[str]:
    text = text.replace("。", "。\n").replace("！", "！\n").replace("？", "？\n")
    return [s for s in _STOP.sub(r"\1\n", text).splitlines() if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    return re.findall(f"[{_JOINED}]|{_WORD.pattern}", _LINK.sub(" ", unicodedata.normalize("NFKC", sentence).lower()))


def path_of(scores: np.ndarray, change: float) -> np.ndarray:
    """The best language of each sentence where a change of language costs ``change``."""
    best, back = scores[0].copy(), np.zeros(scores.shape, int)
    for t in range(1, len(scores)):
        k = int(best.argmax())
        stay = best >= best[k] - change
        back[t] = np.where(stay, np.arange(len(best)), k)
        best = np.where(stay, best, best[k] - change) + scores[t]
    out = [int(best.argmax())]
    for t in range(len(scores) - 1, 0, -1):
        out.append(int(back[t][out[-1]]))
    return np.array(out[::-1])


def segments_of(scorer: Scorer, texts: Sequence[str], change: float, least_words: int = 2) -> Iterator[tuple[int, list[tuple[str, float, str]]]]:
    """(text number, [(language, confidence, passage)]) of the texts that have letters.

    A sentence of fewer than ``least_words`` words is no segment of its own: it belongs to its
    neighbours, and only a text that has nothing else is judged by it.
    """
    sentences, owner = [], []
    for n, text in enumerate(texts):
        own = sentences_of(text)
        sentences += own
        owner += [n] * len(own)
    if not sentences:
        return
    scores, sizes = scorer.scores(sentences)
    owner = np.array(owner)
    strong = sizes >= least_words
    has_strong = np.bincount(owner, strong, len(texts)) > 0
    kept = np.flatnonzero(np.where(has_strong[owner], strong, sizes > 0))
    if not len(kept):
        return
    tops = scores[kept].argmax(axis=1)
    borders = np.flatnonzero(np.diff(owner[kept])) + 1
    for rows, top in zip(np.split(kept, borders), np.split(tops, borders)):
        uniform = (top == top[0]).all()
        path = np.full(len(rows), top[0]) if uniform else path_of(scores[rows], change)
        out = []
        for run in [np.arange(len(rows))] if uniform else np.split(np.arange(len(rows)), np.flatnonzero(np.diff(path)) + 1):
            own = rows[run]
            mean = scores[own].sum(axis=0) / math.sqrt(sizes[own].sum())
            odds = np.exp(mean - mean.max())
            out.append((LANGUAGES[path[run[0]]], float(odds[path[run[0]]] / odds.sum()), "\n".join(sentences[i].strip() for i in own)))
        yield int(owner[rows[0]]), out


def fit_scorer(df: DataFrame, text: str, lang: str, sample_rows: int = 150, vocabulary: str | None = None) -> Scorer:
    """Fits the languages on at most ``sample_rows`` labelled rows of each, those of the least hash.

    Labels may be wrong: a second round takes each sentence in the language the first gave it.
    """
    label = F.lower(F.element_at(F.split(F.trim(F.col(lang)), "[-_]"), 1))
    code = F.coalesce(*(F.when(label.isin(*names.split()), F.lit(k)) for k, names in _NAMES.items()))
    named = df.select(code.alias("l"), F.col(text).alias("t")).where("l is not null")
    counts = {r.l: r.n for r in named.groupBy("l").agg(F.count("*").alias("n")).collect()}
    # Hashes below a language's bound leave about four times its sample, whatever the number of rows.
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 4 * sample_rows / n) * (1 << 40)) + 1)))) if counts else F.create_map(F.lit(""), F.lit(0))
    rows = named.withColumn("h", F.xxhash64("t")).where("length(trim(t)) > 0").where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("l"))).dropDuplicates(["h"])
    picked = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= sample_rows).select("l", "t").collect()
    sentences = [(LANGUAGES.index(r.l), x) for r in sorted(picked) for x in sentences_of(r.t)]
    return fit_from([k for k, _ in sentences], [x for _, x in sentences], load_pieces(vocabulary))


def fit_from(labels: Sequence[int], sentences: Sequence[str], pieces: Sequence[str]) -> Scorer:
    scorer = Scorer(pieces)
    words = [Counter(words_of(x)) for x in sentences]
    for _ in range(2):
        counts: dict[str, np.ndarray] = {}
        for k, own in zip(labels, words):
            for w, n in own.items():
                counts.setdefault(w, np.zeros(len(LANGUAGES)))[k] += n
        scorer.fit(counts)
        labels = scorer.scores(sentences)[0].argmax(axis=1).tolist()
    scorer._forget()
    return scorer


def label_segments(df: DataFrame, key: str, text: str, lang: str, scorer: Scorer | None = None, change: float = 8.0, **options) -> DataFrame:
    """The language of each document's segments, with a confidence.

    Returns the key, ``segment_no`` from 1, ``lang``, ``confidence``, ``segment`` (its sentences),
    ``n_segments`` and ``label_right``: whether the label names the first segment's language. Null,
    blank and letterless texts give no row; repeated documents give repeated rows; only the three
    columns are read. Texts are read whole. Map-only once the scorer is fitted; it is as large as the
    vocabulary, whatever the corpus.
    """
    scorer = scorer or fit_scorer(df, text, lang, **options)
    sent = df.sparkSession.sparkContext.broadcast(scorer)
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("segment_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("segment", T.StringType()), T.StructField("n_segments", T.IntegerType()), T.StructField("label_right", T.BooleanType()),
    ])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            ids, labels, rows = batch["__k"].tolist(), batch["__l"].tolist(), []
            for n, parts in segments_of(model, batch["__t"].tolist(), change):
                right = label_language(labels[n]) == parts[0][0]
                rows += [(ids[n], i, k, c, s, len(parts), right) for i, (k, c, s) in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=schema.names)

    rows = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(lang).cast("string").alias("__l")).where("__t is not null")
    return rows.mapInPandas(label, schema)
