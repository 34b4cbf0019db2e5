"""Page boilerplate mixed with main content (problem 1).

The pages of a host become one stream of line tokens, with numbers masked, and a suffix array over
it finds the runs that are repeated across pages of different notices. Lines covered by such runs
are the site's; the unique runs are kept. Two things runs can't tell are learned from them: what the
same site lines look like on hosts too small to repeat, and which unique lines are links to other
notices. A line model of character grams is fitted on what the runs of larger hosts cover, on the
titles of notices, and on the lines no other page has; a unique line that reads like a title is a link
unless it is near to its own notice's title, which is the headline. A short list of forms holds what
notices share: numbering, labels, dates, signatures, remarks.

Garbled lines are judged by their restored form where it can be restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from operator import add
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.llm.mojibake import Model, Repairs, fit_model
from sluicework.session import checkpointed, kept, stored

DEPTH = 64  # lines; longer repeats are seen in parts, each longer than any rule asks for

_NUMBER = re.compile(r"\d+")
_C = "一-鿿"
# Forms of lines that notices share: numbering, labels, dates, file names, remarks, steps to be clicked through.
_NUMBERED = r"^(?:[（(][一二三四五六七八九十]{1,3}[）)]|[一二三四五六七八九十]{1,3}、|\d{1,2}[.、．])\s*\S"
_SHORT = (
    rf"{_NUMBERED}|^.{{0,4}}(?:联\S{{0,3}}人|附\S?件|下载|咨询电话|联系电话|报名网址|咨询方式|监督电话|电子邮箱)\s*[:：]"
    rf"|^[\d{_C}]{{2,6}}年.{{0,2}}\d{{1,2}}.{{0,2}}月.{{1,7}}$"
    rf"|^[（(](?:此件|此文|主动|依申请|本件).*[）)]$"
)
_FILE = r"\.(?:xlsx?|docx?|pdf|zip|rar)$"
_PATH = r"^(?!.{0,6}(?:首页|位置)).+\s[>＞»→]\s.+"
_NOTICE = re.compile(f"{_SHORT}|{_FILE}|{_PATH}")
# The same in parts: a line's start is looked at once, its whole only where it has what the form needs.
_SHORT, _FILE, _PATH, _ARROW = re.compile(_SHORT), re.compile(_FILE), re.compile(_PATH), re.compile("[>＞»→]")
_NUMBERED = re.compile(_NUMBERED)
_DATE = re.compile(rf"^[\d{_C}]{{2,6}}年.{{0,2}}\d{{1,2}}.{{0,2}}月.{{1,7}}$")
_SIGNED = re.compile(rf"^[{_C}（）()]{{4,30}}(?:院|中心|所|站|处|馆|校|局|会|队|室|厂|公司|大学|部|办|委|厅|署|社)$")
_SIGNERS = frozenset("院心所站处馆校局会队室厂司学部办委厅署社")  # the last signs of these
# Forms of the few lines that a site puts between those of a notice.
_BETWEEN = re.compile(r"^第\s*\d+\s*页|展开全文|推广\s*——|公众(?:服务)?号")
_BULLET = re.compile(r"^(?:[▪·•●■◆※»>]|\d{1,2}\s(?!\d))\s*|\[\d{2}-\d{2}\]$")


def _in_notices(line: str) -> bool:
    """Whether _NOTICE is found in a line that isn't blank."""
    return bool(_SHORT.match(line)) or ("." in line[-5:] and bool(_FILE.search(line))) or (_ARROW.search(line) is not None and bool(_PATH.match(line)))


def _is_between(line: str) -> bool:
    """Whether _BETWEEN is found in a line that isn't blank."""
    return (line[0] == "第" or "展开" in line or "推广" in line or "公众" in line) and bool(_BETWEEN.search(line))


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of an integer stream up to DEPTH tokens, and the common length of each suffix with the one before."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while step < DEPTH:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            length += same * (1 << k)
            a, b = a + same * (1 << k), b + same * (1 << k)
        common[1:] = length
    return order, common


def _least_so_far(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of the values from the start of each stretch on; values are from 0 up to twice DEPTH."""
    # Each stretch lies below all of the stretches before.
    drop = np.repeat(np.arange(len(sizes)) * (2 * DEPTH + 1), sizes)
    return np.minimum.accumulate(values - drop) + drop


def repeats(pages: Sequence[Sequence[str]], owners: Sequence[object], masked: dict[str, str] | None = None) -> list[list[tuple[float, int]]]:
    """Of each line of each page: share of the owners that have it, and lines of the longest run around it that another owner has too."""
    masked = masked or masked_forms(pages)
    ids: dict[str, int] = {}
    stream, owner_of = [], []
    numbers = {o: n for n, o in enumerate(dict.fromkeys(owners))}
    number_of = {x: ids.setdefault(m, len(ids)) for x, m in masked.items()}
    for p, lines in enumerate(pages):
        full = [number_of[x] for x in lines if x]
        stream += full
        stream.append(-1 - p)  # ends a page; unlike any other token
        owner_of.append(len(full) + 1)
    if not stream:
        return []
    tokens, owner = np.array(stream, np.int64), np.repeat(np.array([numbers[o] for o in owners], np.int64), owner_of)
    order, common = suffix_array(tokens)
    own, length = owner[order], common
    # Of each stretch of suffixes of one owner in a row, the common length with the other owner's suffix before it, and behind it, falls to the least on the way.
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sizes = np.diff(np.append(first, len(own)))
    run = np.zeros(len(tokens), np.int64)
    run[order] = np.maximum(_least_so_far(length, sizes), _least_so_far(np.append(length[1:], 0)[::-1], sizes[::-1])[::-1])
    # A run covers the lines that follow; each line takes the longest that covers it.
    longest = run.tolist()
    reach = left = 0
    cover = []
    for r in longest:
        left = max(left - 1, 0)
        if r > left:
            left = reach = r
        cover.append(reach if left else 0)
    lines_held = tokens >= 0
    pairs = np.sort(tokens[lines_held] * len(numbers) + owner[lines_held])
    held = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // len(numbers), minlength=len(ids))
    share = (held / len(numbers)).tolist()
    marks = ((share[t], c) for t, c in zip(stream, cover) if t >= 0)
    return [[next(marks) if x else (0.0, 0) for x in lines] for lines in pages]


#: Token under which a block's number of owners is counted; no line holds a line feed.
_OWNERS = "\n"


def _tokens(pages: Sequence[Sequence[str]]) -> tuple[list[list[int]], dict[str, int]]:
    """Of each page its lines as numbers, -1 for blank ones, and the masked lines' numbers."""
    ids: dict[str, int] = {}
    return [[ids.setdefault(_NUMBER.sub("0", x), len(ids)) if x else -1 for x in lines] for lines in pages], ids


def _hashed(ids: dict[str, int]) -> np.ndarray:
    """A 64-bit hash of each masked line, the same in every process."""
    return pd.util.hash_array(np.array([*ids, ""], object), categorize=False)[:-1]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _sequence(numbers: Sequence[int], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a page's lines that aren't blank, their hashes, and those of each two that follow one another."""
    where = np.array([k for k, n in enumerate(numbers) if n >= 0], np.int64)
    own = hashes[[numbers[k] for k in where]] if len(where) else np.zeros(0, np.uint64)
    return where, own, _pair_hash(own[:-1], own[1:])


def block_counts(pages: Sequence[Sequence[str]], owners: Sequence[object], wide: set = frozenset()) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """Hashes of lines and of two lines in a row, and how many of the owners have each; the owners' own number is under _OWNERS.

    wide: owners with pages in other blocks too; each has counts of its own, of 1, that are made distinct over the blocks. All others come first, under None.
    """
    numbered, ids = _tokens(pages)
    hashes = _hashed(ids)
    held: dict[object, list[np.ndarray]] = {}
    for numbers, o in zip(numbered, owners):
        _, own, two = _sequence(numbers, hashes)
        held.setdefault(o, []).extend((own, two))
    every = {o: np.unique(np.concatenate(x)) for o, x in held.items()}
    whole = [x for o, x in every.items() if o not in wide]
    keys, counts = np.unique(np.concatenate(whole), return_counts=True) if whole else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    mark = _hashed({_OWNERS: 0})
    out = [(None, np.append(keys, mark), np.append(counts, len(whole)))]
    return out + [(o, np.append(x, mark), np.ones(len(x) + 1, np.int64)) for o, x in every.items() if o in wide]


def with_host_counts(pages: Sequence[Sequence[str]], seen: list[list[tuple[float, int]]], keys: np.ndarray, counts: np.ndarray, block_owners: int) -> int:
    """Puts the whole host's shares and repeats in place of the block's; keys in order. Returns the host's number of owners.

    A line has a run of at least 1 if another owner of the host has it, of at least 2 if another owner
    has it together with the line before or behind it; no rule asks for more.
    """

    def of(hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, counts[at], 0)

    owners = int(of(_hashed({_OWNERS: 0}))[0])
    numbered, ids = _tokens(pages)
    hashes = _hashed(ids)
    for marks, numbers in zip(seen, numbered):
        where, own, two = _sequence(numbers, hashes)
        alone, both = of(own), of(two) >= 2
        run = np.where(alone >= 2, 1, 0)
        run[:-1][both] = 2
        run[1:][both] = 2
        for k, n, r in zip(where.tolist(), alone.tolist(), run.tolist()):
            # A line that no other block has isn't in the table; its block's count is the host's.
            share, local = marks[k]
            marks[k] = (n / owners if n else share * block_owners / owners, max(local, r))
    return owners


SITE, TITLE, BODY = range(3)
NEITHER, UNKNOWN = -1, -2
_JUDGED = 1000  # pages that are judged at once, which looks at a line of several of them once
_SPARE = 3  # lines that no other page has, of hosts of few notices
_SLOTS = 1 << 17
_HAN = re.compile(f"[{_C}]")


def _halves(masked: Sequence[str]) -> np.ndarray:
    return np.array([_HAN.search(x) is not None for x in masked], np.int64)


def _portions(masked: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Borders of lines of some 100,000 characters together, and of so few that a line's number and a slot fill 32 bits."""
    at = 0
    while at < len(masked):
        end, size = at + 1, len(masked[at])
        while end < len(masked) and end < at + 16_000 and size + len(masked[end]) <= 100_000:
            size += len(masked[end])
            end += 1
        yield at, end
        at = end


def _gram_slots(masked: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the grams of one to three characters that begin at each character of the lines with their borders, _SLOTS where the line ends before
    the gram does, and how many characters each line has.

    Lines with Chinese characters and others have slots of their own, since what sets the lines of a site apart from a
    notice's in one is but the language in the other.
    """
    flat = "".join(f"\2{x}\3" for x in masked)
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, masked), np.int64, len(masked)) + 2
    last = np.cumsum(sizes) - 1
    half = np.repeat(_halves(masked).astype(np.uint64) << np.uint64(16), sizes)
    slots, h = np.full((3, len(points)), _SLOTS, np.int64), np.zeros(len(points), np.uint64)
    for k in range(3):
        h = h[: max(0, len(points) - k)] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += points[k:]
        h += np.uint64(k + 1)
        mixed = h >> np.uint64(29)
        mixed ^= h
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(48)
        mixed |= half[: len(h)]
        slots[k, : len(h)] = mixed
        for before in range(k):
            slots[k, last - before] = _SLOTS
    return slots, sizes


def _line_sums(of_slot: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each line the sum of what its grams have; of_slot: for _SLOTS slots."""
    of_slot = np.append(of_slot, 0.0)  # float64, which holds a line's sum of float32 exactly
    sums = of_slot[slots[0]]
    sums += of_slot[slots[1]]
    sums += of_slot[slots[2]]
    return np.add.reduceat(sums, np.cumsum(sizes) - sizes)


def gram_counts(masked: Sequence[str], kind: int, lean: np.ndarray | None = None) -> np.ndarray:
    """(_SLOTS + 2, 3): in the kind's column how many lines have each gram, and in the last two rows how many lines there are of either half; lean: only
    of lines whose grams sum up to more than 0.
    """
    out = np.zeros((_SLOTS + 2, 3), np.int64)
    for at, end in _portions(masked):
        own = masked[at:end]
        slots, sizes = _gram_slots(own)
        if lean is not None:
            chosen = _line_sums(lean, slots, sizes) > 0
            slots, sizes, own = slots[:, np.repeat(chosen, sizes)], sizes[chosen], [x for x, c in zip(own, chosen.tolist()) if c]
        # A gram counts once for each line that has it. Sorted here: np.unique hashes, which takes twenty times as long.
        pairs = np.repeat(np.arange(len(sizes), dtype=np.uint32) << np.uint32(18), sizes)
        pairs = np.concatenate([pairs | own_slots.astype(np.uint32) for own_slots in slots])
        pairs.sort()
        once = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] & np.uint32(2 * _SLOTS - 1)
        out[:_SLOTS, kind] += np.bincount(once, minlength=_SLOTS + 1)[:_SLOTS]
        out[_SLOTS:, kind] += np.bincount(_halves(own), minlength=2)
    return out


class LineFacts(NamedTuple):
    """What a line tells by itself: its class (NEITHER where nothing speaks for any, UNKNOWN where there were no repeats to learn from), and its forms."""

    group: int
    shared: bool
    numbered: bool
    between: bool
    signed: bool
    dated: bool
    bare: bool


@dataclass
class LineModel:
    """Log odds of the grams of site lines, titles of notices, and lines of notices."""

    odds: np.ndarray  # (_SLOTS, 3), float32; 0 for what one line has at most
    site: frozenset[str] = frozenset()  # masked lines that the runs of two blocks or more cover
    known: bool = True

    @classmethod
    def fit(cls, site: dict[str, int], titles: Sequence[str], unique: Sequence[str], rounds: int = 4, clip: float = 1.0) -> LineModel:
        """From masked lines: what runs cover, with the number of blocks that have it, titles, and what no other page has. The last are a mixture of lines of
        notices and links that read like titles; expectation maximisation parts them. The odds of a gram are
        clipped, so that most grams decide and not a few that all links share.
        """
        if not site or not unique:
            return cls(np.zeros((_SLOTS, 3), np.float32), known=False)
        own = [(SITE, list(site)), (TITLE, list(titles)), (BODY, list(unique))]
        counts = sum((gram_counts(lines, kind) for kind, lines in own), np.zeros((_SLOTS + 2, 3), np.int64))
        return cls.maximised(counts, lambda lean: gram_counts(own[BODY][1], TITLE, lean), frozenset(x for x, n in site.items() if n > 1), rounds, clip)

    @classmethod
    def maximised(cls, counts: np.ndarray, links, elsewhere: frozenset[str], rounds: int = 4, clip: float = 1.0) -> LineModel:
        """From the gram counts of the three kinds of lines; links: from what a gram speaks for a title to the counts, as titles, of those unique lines that read like one."""
        link, titles = np.zeros_like(counts), counts[_SLOTS:, TITLE].any()
        for n in range(rounds + 1):
            of_round = counts + link
            of_round[:, BODY] -= link[:, TITLE]
            of_all = np.repeat(of_round[_SLOTS:], _SLOTS // 2, axis=0)
            logs = np.log((of_round[:_SLOTS] + 0.3) / (of_all + 3))
            odds = np.clip(logs - logs.mean(axis=1, keepdims=True), -clip, clip)
            odds[of_round[:_SLOTS].sum(axis=1) < 2] = 0  # what one line has tells of that line only
            if not titles:
                odds[:, TITLE] = -clip
            model = cls(odds.astype(np.float32), elsewhere)
            if n < rounds:
                before, link = link, links(model.odds[:, TITLE] - model.odds[:, BODY])
                if (link == before).all():
                    break
        return model

    def scores(self, masked: Sequence[str]) -> np.ndarray:
        """(lines, 3): mean log odds of each line's grams."""
        out = np.zeros((len(masked), 3))
        for at, end in _portions(masked):
            slots, sizes = _gram_slots(masked[at:end])
            for k in range(3):
                out[at:end, k] = _line_sums(self.odds[:, k], slots, sizes) / (3 * sizes - 3)
        return out

    def facts(self, masked: dict[str, str]) -> dict[str, LineFacts]:
        """What each different line tells by itself; masked: the lines with their masked forms."""
        different = list(dict.fromkeys(masked.values()))
        if self.known:
            scores = self.scores(different)
            lost = np.array([x.count("\ufffd") > 0.2 * len(x) for x in different], bool)
            scores[[x in self.site for x in different]] = (1.0, 0.0, 0.0)
            best = np.where(lost | (np.abs(scores).max(axis=1, initial=0) < 0.02), NEITHER, scores.argmax(axis=1))
        else:
            best = np.full(len(different), UNKNOWN)
        of = dict(zip(different, best.tolist()))
        # A numbered line and a date are of a notice's forms, so they are looked for only there; what reads like no title isn't asked for its bullet.
        out = {}
        for x, m in masked.items():
            shared = _in_notices(x)
            out[x] = LineFacts(
                of[m], shared, shared and bool(_NUMBERED.match(x)), _is_between(x), x[-1] in _SIGNERS and bool(_SIGNED.search(x)), shared and bool(_DATE.match(x)), of[m] != TITLE or _BULLET.sub("", x) == x
            )
        return out


def masked_forms(pages: Sequence[Sequence[str]]) -> dict[str, str]:
    """The different lines that aren't blank, and their forms with numbers masked."""
    return {x: _NUMBER.sub("0", x) for x in dict.fromkeys(x for lines in pages for x in lines) if x}


def covered(share: float, run: int, owners: int) -> bool:
    """Whether the repeats alone make a line the site's: another page's run covers it, and a fifth of the host's notices, three at least, have it."""
    return run >= 1 and share >= 0.2 and share * owners >= 3


def line_kinds(lines: Sequence[str], seen: Sequence[tuple[float, int]], owners: int, facts: dict[str, LineFacts], forms: bool = True) -> list[str]:
    """Of each line: '' blank, 'n' the notice's, 's' the site's, 'h' one that reads like a title, 'l' such a one with a bullet or a date.

    Repeats decide first: what a fifth of the host's notices have, or what stands in a longer run, unless it reads like a
    paragraph (a notice published again, with all of its lines). What they don't cover is of the class that the line
    model gives; what that can't tell, as a wrong decoding has destroyed it, goes with the line before it, unless it is as long as a paragraph.
    """
    kinds: list[str] = []
    following = [x for x in lines if x][1:]
    last, at = "s", -1
    for line, (share, run) in zip(lines, seen):
        if not line:
            kinds.append("")
            continue
        at += 1
        fact = facts[line]
        group = fact.group
        if forms and fact.between:
            kinds.append("s")
            continue
        if forms and fact.shared and not (group == TITLE and fact.numbered):
            kind = "n"  # a numbered title is a link in a list
        elif covered(share, run, owners) or (run >= 2 and group in (SITE, UNKNOWN)):
            kind = "s"
        elif forms and fact.signed and group != BODY and (last == "n" or (at < len(following) and facts[following[at]].dated)):
            kind = "n"
        elif group in (BODY, UNKNOWN):
            kind = "n"
        elif group == TITLE:
            kind = "h" if fact.bare else "l"
        else:
            kind = "s" if group == SITE else "n" if len(line) > 60 else last if last in ("n", "s") else "s"
        last = kind
        kinds.append(kind)
    first = next((k for k, x in enumerate(kinds) if x == "n"), len(kinds))
    # A headline stands before the body; behind it, only what is near to the title can be one.
    return ["l" if x == "h" and k > first else x for k, x in enumerate(kinds)]


def headline(lines: Sequence[str], kinds: Sequence[str], title: str | None) -> int | None:
    """The line nearest to the title, if it is near; else the first that reads like a title, in no list and before the body."""
    best = None
    for k, kind in enumerate(kinds):
        if kind in ("h", "l"):
            near = title_likeness(lines[k], title)
            if near >= 0.4 or kind == "h":
                rank = (near if near >= 0.4 else 0.0, kind == "h", -k)
                best = max(best, (rank, k)) if best else (rank, k)
    return best[1] if best else None


@lru_cache(4096)
def _grams(text: str) -> frozenset[str]:
    text = "".join(unicodedata.normalize("NFKC", text).split()).lower()
    return frozenset(map(add, text, text[1:]))


def title_likeness(line: str, title: str | None) -> float:
    a, b = _grams(line), _grams(title or "")
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a and b else 0.0


def bare_of(line: str) -> str:
    """The line without blanks and byte order marks around it."""
    return line.strip().strip("\ufeff").strip()


def is_html(content_type: Column) -> Column:
    """A content type that names html, in whatever spelling."""
    return F.coalesce(F.lower(content_type).contains("html"), F.lit(False))


def fit_lines(read: DataFrame, titles: DataFrame | None) -> LineModel:
    """The line model, from every different line of all blocks of three pages or more (smaller ones have no repeats to tell by), and from all titles. What no
    other page has is taken from hosts of eight notices or more, unless all hosts together have fewer than 500 such lines.

    read: the table that ``main_lines`` keeps; each of a block's examples is on the first page that has it. The lines are written to the shared folder and
    counted there, once for each round. What reaches the driver are the counts of the grams' slots, whatever the number of lines, and those site lines that
    two blocks have, as many as sites have.
    """
    most = read.agg(F.max("pages")).first()[0]
    if not most:
        return LineModel.fit({}, [], [])
    kinds = read.where(F.col("pages") >= min(3, most)).select(F.explode(F.arrays_zip("kind", "example")).alias("x")).select("x.kind", F.col("x.example").alias("line"))
    kinds = kinds.groupBy("line").agg(F.count_if(F.col("kind") == 0).alias("n"), F.max(F.col("kind") == 1).alias("wide"))
    lines = kinds.select(F.when(F.col("n") > 0, SITE).when(F.col("wide"), BODY).otherwise(_SPARE).alias("kind"), "line", "n")
    if titles is not None:
        masked = F.regexp_replace(F.trim("__title"), "\\d+", "0").alias("line")
        names = titles.where("__title is not null").select(masked).distinct().where("line <> ''")
        lines = lines.unionByName(names.select(F.lit(TITLE).alias("kind"), "line", F.lit(0).cast("bigint").alias("n")))
    with stored(lines) as lines:
        held = {r.kind: r["count"] for r in lines.groupBy("kind").count().collect()}
        if held.get(BODY, 0) < 500:
            lines = lines.withColumn("kind", F.when(F.col("kind") == _SPARE, BODY).otherwise(F.col("kind")))
            held[BODY] = held.get(BODY, 0) + held.get(_SPARE, 0)
        if not held.get(SITE) or not held.get(BODY):
            return LineModel.fit({}, [], [])
        elsewhere = frozenset(r.line for r in lines.where((F.col("kind") == SITE) & (F.col("n") > 1)).select("line").collect())
        unique = lines.where(F.col("kind") == BODY)
        return LineModel.maximised(_gram_counts_of(lines.where(F.col("kind") != _SPARE)), lambda lean: _gram_counts_of(unique, lean), elsewhere)


def _gram_counts_of(lines: DataFrame, lean: np.ndarray | None = None) -> np.ndarray:
    """``gram_counts`` of a table of lines by their kinds, or of those that lean to titles, as titles."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((_SLOTS + 2, 3), np.int64)
        for batch in batches:
            for kind, own in batch.groupby("kind")["line"]:
                sums += gram_counts(own.tolist(), int(kind) if lean is None else TITLE, lean)
        flat = sums.ravel()
        k = np.flatnonzero(flat)
        yield pd.DataFrame({"k": k, "n": flat[k]})

    counts = lines.select("kind", "line").mapInPandas(tally, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((_SLOTS + 2) * 3, np.int64)
    out[counts["k"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out.reshape(-1, 3)


def host_repeats(texts: Sequence[Sequence[str]], owners: Sequence[object], host_counts: pd.DataFrame, masked: dict[str, str] | None = None) -> tuple[list[list[tuple[float, int]]], int]:
    """Shares and runs of a block's lines in the whole host, and the host's number of owners; host_counts: none if the block is the host."""
    seen, count = repeats(texts, owners, masked), len(set(owners))
    if len(host_counts):
        keys = host_counts["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        count = with_host_counts(texts, seen, keys[order], host_counts["n"].to_numpy(np.int64)[order], count)
    return seen, count


def main_lines(
    pages: DataFrame, key: str, text: str, url: str, owner: str, titles: DataFrame | None = None, title_key: str = "id", title: str = "title", block_pages: int = 1500,
    model: Model | None = None, line_model: LineModel | None = None,
) -> DataFrame:
    """The lines of each page's main body.

    Returns key, ``line_no`` (from 1, blank lines counted) and ``line``. ``owner`` is the notice a page
    belongs to: what only versions of one notice share isn't the site's. Null and empty texts give no
    row; a null url is a host of its own; repeated rows are repeated; without ``titles`` no line reads like one, and
    links stay. Other columns aren't read. Texts are read whole.

    Pages are grouped by host; a host of more than ``block_pages`` pages is split by notice into
    blocks of about that size, so no task holds a whole large host. How many notices of the host have a
    line, or two lines in a row, is summed over its blocks and joined back to each, so a page is judged by
    the whole host. A page without a notice is an owner of its own; a notice of more than ``block_pages`` pages is split by page, and
    counted once. The lists of such hosts and notices have at most a row for every ``block_pages`` pages. Each page's
    restored lines and repeats are kept in the shared folder, as a checkpoint is, and judged there, page by page. The line model is fitted on all lines (``fit_lines``); of the garbling model, the pairs' emissions come from a bounded sample (``fit_model``).
    """
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(text).alias("t"), host.alias("host"), F.col(owner).alias("o")).where("t is not null and t <> ''")
    model = model or fit_model(rows, "t", sample_rows=1500, passes=1)
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / block_pages).alias("blocks")).where("blocks > 1")
    rows = rows.join(F.broadcast(large), "host", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # An owner, be it a notice or a page without one, is whole in one block, unless it fills more than one by itself.
    wide = rows.where("blocks > 1 and o is not null").groupBy("host", "o").agg(F.count("*").alias("n")).where(F.col("n") > block_pages).select("host", "o", F.lit(True).alias("wide"))
    rows = rows.join(F.broadcast(wide), ["host", "o"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    rows = rows.withColumn("block", F.pmod(F.when(F.col("o").isNull() | F.col("wide"), F.xxhash64("k", F.lit("page"))).otherwise(F.xxhash64("o")), F.col("blocks")))
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kt, ot = pages.schema[key].dataType, pages.schema[owner].dataType
    schema = T.StructType([T.StructField("k", kt), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])

    read_type = T.StructType([
        T.StructField("k", kt), T.StructField("title", T.StringType()), T.StructField("t", T.StringType()), T.StructField("fixed_at", T.ArrayType(T.IntegerType())), T.StructField("fixed", T.ArrayType(T.StringType())),
        T.StructField("share", T.ArrayType(T.DoubleType())), T.StructField("run", T.ArrayType(T.IntegerType())), T.StructField("owners", T.LongType()), T.StructField("pages", T.LongType()),
        T.StructField("kind", T.ArrayType(T.IntegerType())), T.StructField("example", T.ArrayType(T.StringType())),
    ])

    def lines_in(group: pd.DataFrame) -> tuple[list[list[str]], list[list[str]], list[object], set[str]]:
        """Lines as they are, lines restored and stripped, owners, and which of the first are restored."""
        raw = [t.split("\n") for t in group["t"]]
        fixed = Repairs(sent.value).of([x for lines in raw for x in lines])
        bare = {x: bare_of(fixed[x][0] if x in fixed else x) for x in dict.fromkeys(x for lines in raw for x in lines)}
        texts = [[bare[x] for x in lines] for lines in raw]
        return raw, texts, [("page", k) if pd.isna(o) else ("notice", o) for k, o in zip(group["k"], group["o"])], set(fixed)

    def count_owners(group: pd.DataFrame) -> pd.DataFrame:
        _, texts, owners, _ = lines_in(group)
        own = block_counts(texts, owners, {o for o, w in zip(owners, group["wide"]) if w})
        parts = [pd.DataFrame({"key": keys.view(np.int64), "n": counts, "own": "" if o is None else f"{o[0]}:{o[1]}"}) for o, keys, counts in own]
        return pd.concat(parts).assign(host=group["host"].iat[0], block=group["block"].iat[0])[["host", "block", "key", "n", "own"]]

    block_type = rows.schema["block"].dataType.simpleString()
    parts = rows.where("blocks > 1").groupBy("host", "block").applyInPandas(count_owners, f"host string, block {block_type}, key bigint, n bigint, own string")
    # What one block alone has needs no sum, but a key goes back to each block that has it.
    totals = parts.groupBy("host", "key").agg((F.sum(F.when(F.col("own") == "", F.col("n")).otherwise(0)) + F.size(F.collect_set(F.nullif("own", F.lit(""))))).alias("n"), F.collect_set("block").alias("b")).where(F.size("b") > 1)
    totals = checkpointed(totals.select("host", F.explode("b").alias("block"), "key", "n"))
    names = None
    if titles is not None:
        names = titles.select(F.col(title_key).alias("o"), F.col(title).alias("__title")).groupBy("o").agg(F.max("__title").alias("__title"))
    # What a block needs beside its pages: the host's counts, and the titles of its notices, with -1 for a count. No number is
    # null, as pandas would make floats of them all.
    beside = totals.select("host", "block", "key", "n", F.lit(None).cast(ot).alias("o"), F.lit(None).cast("string").alias("__title"))
    if names is not None:
        own = rows.select("host", "block", "o").where("o is not null").distinct().join(names, "o")
        beside = beside.unionByName(own.select("host", "block", F.lit(0).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("n"), "o", "__title"))

    def read(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame([], columns=read_type.names)
        raw, texts, owners, restored = lines_in(group)
        masked = masked_forms(texts)
        counted, named = known[known["n"] >= 0], known[known["n"] < 0]
        title_of = dict(zip(named["o"], named["__title"]))
        seen, count = host_repeats(texts, owners, counted, masked)
        examples: set[tuple[int, str]] = set()
        out = []
        for k, o, t, own, lines, marks in zip(group["k"], group["o"], group["t"], raw, texts, seen):
            fixed_at = [n for n, x in enumerate(own) if x in restored]
            of_page: dict[tuple[int, str], None] = {}
            for line, (share, run) in zip(lines, marks):
                # Runs of two lines or more, so that a head or a date which notices share is no example.
                if line and (run == 0 or (run >= 2 and share >= 0.3 and covered(share, run, count) and not _in_notices(line))):
                    x = 0 if run else 1 if count >= 8 else 2, masked[line]
                    if x not in examples:
                        examples.add(x)
                        of_page[x] = None
            shares, runs = zip(*marks)
            out.append((k, None if pd.isna(o) else title_of.get(o), t, fixed_at, [lines[n] for n in fixed_at], shares, runs, count, len(group), [x for x, _ in of_page], [x for _, x in of_page]))
        return pd.DataFrame(out, columns=read_type.names)

    # Each page is read once. What is kept of it, its restored lines, marks and examples, needs neither the host's other pages nor a shuffle to be judged.
    pages_read, _ = kept(rows.groupBy("host", "block").cogroup(beside.groupBy("host", "block")).applyInPandas(read, read_type))
    learned = pages.sparkSession.sparkContext.broadcast(line_model or fit_lines(pages_read, names))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _JUDGED):
                group = batch.iloc[at : at + _JUDGED]
                raw = [t.split("\n") for t in group["t"]]
                bare = {x: bare_of(x) for x in dict.fromkeys(x for lines in raw for x in lines)}
                texts = [[bare[x] for x in lines] for lines in raw]
                for lines, where, fixed in zip(texts, group["fixed_at"], group["fixed"]):
                    for n, x in zip(where, fixed):
                        lines[n] = x
                facts = learned.value.facts(masked_forms(texts))
                keys, places, out = [], [], []
                for k, title_of_page, lines, own, shares, runs, count in zip(group["k"], group["title"], texts, raw, group["share"], group["run"], group["owners"]):
                    kinds = line_kinds(lines, list(zip(shares.tolist(), runs.tolist())), count, facts)
                    head = headline(lines, kinds, title_of_page)
                    main = [n for n, kind in enumerate(kinds) if kind == "n" or n == head]
                    keys += [k] * len(main)
                    places += [n + 1 for n in main]
                    out += [lines[n] if n == head else own[n] for n in main]
                yield pd.DataFrame({"k": keys, "line_no": places, "line": out})

    needed = pages_read.select("k", "title", "t", "fixed_at", "fixed", "share", "run", "owners")
    return needed.mapInPandas(judge, schema).withColumnRenamed("k", key)
