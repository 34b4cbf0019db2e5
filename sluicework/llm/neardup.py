"""Near-duplicate records with small edits (problem 4).

Anchor-point covering. A text's fingerprint is a word of ``exact`` min-hashes and seven one-bit
min-hashes of its character grams, over the mixed space of both. The anchors are a covering code of that space: all
words in the min-hashes, and the perfect Hamming code in the bits, so that each fingerprint lies within
radius 1 of an anchor. A fingerprint is replicated to every anchor within the radius plus the
threshold of 1; two fingerprints that differ in no min-hash and at most one bit meet at the anchor
of either. Several independent fingerprints make up for those that differ in more. At each anchor
a second fingerprint of 64 bits is compared, and an exact check of the grams follows.

Exact copies are one class: its texts are compared once, whatever their number.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.session import checkpointed

BITS = 7
#: The perfect Hamming code of length 7: words whose syndrome is 0.
_SYNDROME = np.array([int(np.bitwise_xor.reduce([k + 1 for k in range(BITS) if w >> k & 1] or [0])) for w in range(1 << BITS)])
_CODE = np.flatnonzero(_SYNDROME == 0)
_DISTANCE = np.array([[bin(w ^ int(c)).count("1") for c in _CODE] for w in range(1 << BITS)])
#: Of each word: anchors within radius 1 plus threshold 1, the home (within the radius) first.
_ANCHORS = [[int(_CODE[k]) for k in np.argsort(_DISTANCE[w], kind="stable") if _DISTANCE[w, k] <= 2] for w in range(1 << BITS)]
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """NFKC, no byte order mark, no white space, lower case."""
    return _SPACE.sub("", unicodedata.normalize("NFKC", text).replace("\ufeff", "")).lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, gram: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < gram:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(points) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)] + np.uint64(1)
    return _mixed(h)


def min_hashes(hashes: list[np.ndarray], count: int) -> np.ndarray:
    """(texts, count) uint32 min-hashes; every text has a gram."""
    out = np.empty((len(hashes), count), np.uint32)
    at = 0
    while at < len(hashes):
        end, size = at + 1, len(hashes[at])
        while end < len(hashes) and size + len(hashes[end]) <= 40_000:  # small enough for the cache
            size += len(hashes[end])
            end += 1
        flat = np.concatenate(hashes[at:end])
        starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes[at : end - 1]])]).astype(np.int64)
        low, step = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        mixed = np.empty_like(low)
        for k in range(count):
            low += step
            np.multiply(low ^ (low >> np.uint32(15)), np.uint32(0x2C1B3C6D), out=mixed)
            out[at:end, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(13)), starts)
        at = end
    return out


def signatures(texts: list[str], gram: int, exact: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the texts that have a gram, (texts, rounds) keys of the exact part, (texts, rounds) bits, fingerprints in 64-bit parts)."""
    hashes = [gram_hashes(t, gram) for t in texts]
    some = np.array([n for n, h in enumerate(hashes) if len(h)], np.int64)
    if not len(some):
        empty = np.zeros((0, rounds), np.int64)
        return some, empty, empty, np.zeros((0, 1), np.int64)
    m = min_hashes([hashes[n] for n in some], rounds * (exact + BITS) + 64)
    parts = m[:, : rounds * exact].reshape(len(some), rounds, exact).astype(np.uint64)
    keys = np.broadcast_to(np.arange(rounds, dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for k in range(exact):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    bits = (m[:, rounds * exact : rounds * (exact + BITS)] >> np.uint32(7) & np.uint32(1)).reshape(len(some), rounds, BITS)
    words = (bits.astype(np.int64) << np.arange(BITS)).sum(axis=2)
    # The fingerprint proper: 64 bits of its own, then those of all rounds.
    own = (m[:, -64:] >> np.uint32(7) & np.uint32(1)).astype(np.uint64)
    every = np.concatenate([own, bits.reshape(len(some), -1), np.zeros((len(some), -rounds * BITS % 64), np.uint32)], axis=1).astype(np.uint64)
    longs = (every.reshape(len(some), -1, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return some, (keys & ~np.uint64(127)).view(np.int64), words, longs.view(np.int64)


def likeness(a: str, b: str, gram: int) -> float:
    """Share of the distinct grams of either that both have."""
    x = {a[i : i + gram] for i in range(len(a) - gram + 1)}
    y = {b[i : i + gram] for i in range(len(b) - gram + 1)}
    return len(x & y) / len(x | y) if x and y else 0.0


def meeting_probability(similarity: float, exact: int) -> float:
    """That one round brings two texts of this similarity together at an anchor."""
    flip = (1 - similarity) / 2
    meets = np.zeros(1 << BITS)
    for e in range(1 << BITS):
        both = [bool({_ANCHORS[w][0]} & set(_ANCHORS[w ^ e]) or {_ANCHORS[w ^ e][0]} & set(_ANCHORS[w])) for w in range(1 << BITS)]
        n = bin(e).count("1")
        meets[e] = np.mean(both) * flip**n * (1 - flip) ** (BITS - n)
    return similarity**exact * float(meets.sum())


def rounds_for(similarity: float, exact: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting_probability(similarity, exact))))


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted, never broadcast: Spark takes the packed size of the input files, and one element of an array, for the size
    of classes, members and texts, which are many times that.
    """
    return df.hint("merge")


def sign(df: DataFrame, key: str, text: str, gram: int, exact: int, rounds: int) -> DataFrame:
    """id, raw (digest of the text as it is), cls (digest of the normal text), the rounds' keys with their bits in the last seven, and fingerprint of each
    text that has a gram, with a number of its own; checkpointed, so the numbers stay.
    """
    schema = T.StructType([
        T.StructField("id", df.schema[key].dataType), T.StructField("raw", T.BinaryType()), T.StructField("cls", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normal(t) for t in batch["__t"]]
            some, keys, words, fp = signatures(texts, gram, exact, rounds)
            chosen = batch.iloc[some]
            yield pd.DataFrame({"id": chosen["__k"].tolist(), "raw": chosen["__raw"].tolist(), "cls": [hashlib.md5(texts[n].encode("utf-8", "surrogatepass")).digest() for n in some], "keys": list(keys | words), "fp": list(fp)})

    rows = df.select(df[key].alias("__k"), df[text].alias("__t"), _raw(df[text]).alias("__raw")).where("__k is not null and __t is not null and __t <> ''")
    return checkpointed(rows.mapInPandas(run, schema)).withColumn("no", F.monotonically_increasing_id())


def _raw(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _maybe_in(df: DataFrame, key: str, chosen: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """The rows of which the key's hash is that of a chosen key: all that are chosen, and few others.

    The hashes are sent as a bitmap of so many bits, 1 MB, whatever the number of keys; once it is
    full, nothing is filtered and nothing is wrong.
    """
    part = 1 << 15  # bits of one of Spark's bitmaps
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    bitmaps = chosen.select((h / part).cast("int").alias("__part"), (h % part).alias("__bit")).groupBy("__part").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits"))
    placed = df.withColumn("__h", h).withColumn("__part", (F.col("__h") / part).cast("int")).withColumn("__bit", (F.col("__h") % part).cast("int"))
    found = placed.join(F.broadcast(bitmaps), "__part")
    byte = F.conv(F.hex(F.expr("substring(__bits, __bit div 8 + 1, 1)")), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.col("__bit") % 8) == 1).drop("__h", "__part", "__bit", "__bits")


def similar_classes(
    df: DataFrame, key: str, text: str, gram: int, threshold: float, exact: int = 3, recall: float = 0.995, rounds: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(class pairs, membership) of the texts of which at least ``threshold`` of the distinct grams of either are in both.

    Class pairs: ``a``, ``b``, ``likeness`` between different normal texts; membership: ``cls``, ``id`` (a row
    for each different id). Texts that are equal in normal form are one class. ``rounds``
    is by default the number that brings a pair right at the threshold together with
    probability ``recall``; no bucket or partner is capped. Null ids and texts, and texts shorter than a
    gram, give nothing; repeated rows count once; only key and text are read, whole.
    """
    rounds = rounds or rounds_for(threshold, exact, recall)
    flip = (1 - threshold) / 2

    def apart(bits: int) -> int:
        """Bits of so many in which a pair right at the threshold differs at most, but for 4.5 standard deviations."""
        return math.ceil(bits * flip + 4.5 * math.sqrt(bits * flip * (1 - flip)))

    signed = sign(df, key, text, gram, exact, rounds)
    # A class is known by the least number of its rows: eight bytes that no two classes share.
    classes = signed.groupBy("cls").agg(F.min("no").alias("c"), F.min_by(F.struct("id", "raw", "keys", "fp"), "no").alias("s"))
    members = signed.select("cls", "id").distinct().join(_large(signed.groupBy("cls").agg(F.min("no").alias("c"))), "cls").select(F.col("c").alias("cls"), "id")
    table = F.array(*(F.array(*(F.lit(a) for a in own)) for own in _ANCHORS))
    rounds_of = classes.select("c", F.element_at("s.fp", 1).alias("fp"), F.explode("s.keys").alias("k"))
    anchors = rounds_of.select("c", "fp", "k", F.posexplode(F.get(table, F.col("k").bitwiseAND(F.lit(127)).cast("int"))).alias("n", "w"))
    anchors = anchors.select(F.col("k").bitwiseAND(F.lit(~127)).bitwiseOR(F.col("w").cast("long")).alias("anchor"), "c", "fp", (F.col("n") == 0).alias("home"))
    a, b = anchors.alias("a"), anchors.alias("b")
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= apart(64)) & (F.col("a.home") | F.col("b.home"))
    met = a.join(_large(b), (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.c") < F.col("b.c")) & near)
    met = met.select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()
    # The fingerprints go to all that met, the ids and digests only to those that stay.
    part = lambda side, *names: _large(classes.select(F.col("c").alias(side), *(F.col(f"s.{n}").alias(f"{n}_{side}") for n in names)))
    met = met.join(part("a", "fp"), "a").join(part("b", "fp"), "b")
    differing = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    met = met.where(differing <= apart(64 + rounds * BITS)).select("a", "b")
    met = met.join(part("a", "id", "raw"), "a").join(part("b", "id", "raw"), "b")
    # Only texts that are in a pair need be shuffled, and both joins read the same shuffle. An id may have several texts: the
    # one that the class was signed by is told by its digest.
    texts = df.select(df[key].alias("id"), df[text].alias("t")).where("id is not null and t is not null")
    texts = _maybe_in(texts, "id", met.select(F.explode(F.array("id_a", "id_b")).alias("id"))).withColumn("raw", _raw(F.col("t"))).dropDuplicates(["id", "raw"])
    own = lambda side: _large(texts.select(F.col("id").alias(f"id_{side}"), F.col("raw").alias(f"raw_{side}"), F.col("t").alias(f"t_{side}")))
    met = met.join(own("a"), ["id_a", "raw_a"]).join(own("b"), ["id_b", "raw_b"])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["likeness"] = [likeness(normal(x), normal(y), gram) for x, y in zip(batch["t_a"], batch["t_b"])]
            yield batch.loc[batch["likeness"] >= threshold, ["a", "b", "likeness"]]

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("likeness", T.DoubleType())])
    pairs = met.select("a", "b", "t_a", "t_b").mapInPandas(check, schema)
    return pairs, members


def class_rows(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each id and class of equal texts that it is in: ``id``, ``class_id`` (the class's least id), ``links``: how many other classes are similar.

    Linear in the rows and the class pairs: copies aren't paired.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    named = members.groupBy("cls").agg(F.min("id").alias("class_id")).join(_large(ends), "cls", "left")
    return members.join(_large(named), "cls").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def id_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of different ids whose texts are similar or the same: ``id_a`` < ``id_b``."""
    m = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
    n = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.join(_large(m), "a").join(_large(n), "b").where("x <> y").select("x", "y")
    same = m.join(_large(n.withColumnRenamed("b", "a")), "a").where("x < y").select("x", "y")
    both = across.unionByName(same)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
