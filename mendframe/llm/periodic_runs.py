"""Periodic runs of words: stretches that repeat themselves at least twice.

A run of period q holds, before its last q words, an aligned block of a power
of two of words that occurs again q words on. So each aligned block asks in
which places of the windows beside it it occurs: a range successor query on its interval
of the suffix array, answered by a wavelet tree over that array. Occurrences
within a window of the block's length form an arithmetic progression, so its
first two and its last give all candidate periods. Candidates are extended both
ways by comparing factors of powers of two, and of equal stretches the one with
the smallest period is the run.

Many documents are one sequence, in which words of different documents differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out

#: Words that are handled as one sequence, if no document is longer.
AT_ONCE = 1 << 16

_WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


class Factors:
    """Suffix array by doubling, with the ranks of all factors of 2**k words on the way.

    `ranks[k][i]` is the first place in the suffix array of the suffixes that
    start with the 2**k symbols at i; past the end stands a symbol of its own.
    Only suffixes that share their rank are sorted again.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n = n = len(symbols)
        self.order = np.argsort(symbols, kind="stable").astype(np.int32)
        s = symbols[self.order]
        new = np.r_[True, s[1:] != s[:-1]]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.ranks = [rank]
        step = 1
        while step < longest:
            alone = new & np.r_[new[1:], True]
            at = np.nonzero(~alone)[0]
            if not len(at):
                break
            who = self.order[at]
            after = who.astype(np.int64) + step
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            key = rank[who].astype(np.int64) * (n + 1) + second + 1
            way = np.argsort(key, kind="stable")
            key, who = key[way], who[way]
            self.order[at] = who
            new[at] = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            # Places of a shared rank lie together, so the last new one is the group's first.
            rank[who] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
            self.ranks.append(rank)
            step *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j > i on."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, most = self.ranks[k], self.n - 1
            same = (j + got + (1 << k) <= self.n) & (rank[np.minimum(i + got, most)] == rank[np.minimum(j + got, most)])
            got += same.astype(np.int64) << k
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree before i and j > i."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, back = self.ranks[k], got + (1 << k)
            same = (i >= back) & (rank[np.maximum(i - back, 0)] == rank[np.maximum(j - back, 0)])
            got += same.astype(np.int64) << k
        return got


class WaveletTree:
    """Range successor on an array of distinct numbers below its length, level by level for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, v = [], values
        for level in range(self.bits - 1, -1, -1):
            low = (v >> level) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(low, dtype=np.int32)].astype(np.int32))
            v = np.concatenate([v[low], v[~low]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are smaller than x."""
        count = np.where(x >= 1 << self.bits, hi - lo, 0)
        x = np.where(x >= 1 << self.bits, 0, x)
        for level, zeros in enumerate(self.zeros):
            up = (x >> (self.bits - 1 - level)) & 1 == 1
            l0, h0 = zeros[lo], zeros[hi]
            count += np.where(up, h0 - l0, 0)
            lo, hi = np.where(up, zeros[-1] + lo - l0, l0), np.where(up, zeros[-1] + hi - h0, h0)
        return count

    def at(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k among those of [lo, hi)."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            l0, h0 = zeros[lo], zeros[hi]
            up = k >= h0 - l0
            k = np.where(up, k - (h0 - l0), k)
            value += up.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(up, zeros[-1] + lo - l0, l0), np.where(up, zeros[-1] + hi - h0, h0)
        return value


def _queries(factors: Factors):
    """(block, log of its length, interval in the suffix array, window) for blocks that occur more than once."""
    n, found = factors.n, []
    for k, rank in enumerate(factors.ranks[1:], 1):
        size = 1 << k
        block = np.arange(0, n - size + 1, size)
        held = np.bincount(rank, minlength=n)
        lo = rank[block].astype(np.int64)
        hi = lo + held[lo]
        many = hi > lo + 1
        block, lo, hi = block[many], lo[many], hi[many]
        # Two words look for periods of 1 to 6, which runs of twelve words and more give room for.
        starts = (1, 3, 5) if k == 1 else (2 * size - 1, 3 * size - 1)
        for first in starts:
            x = block + first
            inside = x < n
            found.append([block[inside], np.full(inside.sum(), k), lo[inside], hi[inside], x[inside], x[inside] + size - 1])
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


def _candidates(factors: Factors, tree: WaveletTree):
    """(block, period) pairs worth extending."""
    asked = _queries(factors)
    if asked is None or not len(asked[0]):
        return None
    block, k, lo, hi, x, y = asked
    before, upto = tree.below(lo, hi, x), tree.below(lo, hi, y + 1)
    hit = upto > before
    block, k, lo, hi, before, upto = block[hit], k[hit], lo[hit], hi[hit], before[hit], upto[hit]
    first = tree.at(lo, hi, before)
    many = upto > before + 1
    second, last = first.copy(), first.copy()
    second[many] = tree.at(lo[many], hi[many], before[many] + 1)
    last[many] = tree.at(lo[many], hi[many], upto[many] - 1)
    step = np.maximum(second - first, 1)
    count = (last - first) // step + 1
    # Where the block and all up to its occurrence have the progression's step as period, multiples of it are no smallest period.
    reach = np.zeros(len(first), np.int64)
    reach[many] = step[many] + factors.ahead(block[many], block[many] + step[many]) - (1 << k[many])
    row = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    period = first[row] - block[row] + place * step[row]
    multiple = many[row] & (period > step[row]) & (period % step[row] == 0) & (period <= reach[row])
    return block[row][~multiple], period[~multiple]


def runs(symbols: np.ndarray, longest: int, shortest: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start, then period.

    `longest` bounds the length of a stretch that can agree with another.
    """
    none = np.empty((0, 3), np.int64)
    if len(symbols) < shortest:
        return none
    factors = Factors(symbols, longest)
    if len(factors.ranks) < 2:
        return none
    found = _candidates(factors, WaveletTree(factors.order.astype(np.int64)))
    if found is None:
        return none
    block, q = found
    start = block - factors.behind(block, block + q)
    end = block + q + factors.ahead(block, block + q)
    keep = end - start >= np.maximum(shortest, 2 * q)
    start, end, q = start[keep], end[keep], q[keep]
    way = np.lexsort((q, end, start))
    start, end, q = start[way], end[way], q[way]
    if not len(start):
        return none
    one = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])]
    out = np.stack([start[one], end[one] - start[one], q[one]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _together(docs: list[list[str]], shortest: int) -> tuple[list[np.ndarray], list[str]]:
    """Runs of each document, and its words without the repeats."""
    sizes = np.array([len(d) for d in docs], np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    words = np.array([w for d in docs for w in d], object)
    codes, known = pd.factorize(words)
    owner = np.repeat(np.arange(len(docs)), sizes)
    found = runs(owner * max(1, len(known)) + codes, int(sizes.max(initial=0)), shortest)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    repeated = np.cumsum(change)[:-1] > 0
    of = np.searchsorted(offsets, found[:, 0], side="right") - 1
    each, texts = [], []
    for i, d in enumerate(docs):
        lo, hi = np.searchsorted(of, [i, i + 1])
        each.append(found[lo:hi] - np.array([offsets[i], 0, 0]))
        gone = repeated[offsets[i] : offsets[i + 1]]
        texts.append(" ".join(w for w, g in zip(d, gone, strict=True) if not g) if hi > lo else " ".join(d))
    return each, texts


def _find(shortest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, ids, n = [], [], 0

            def frame() -> pd.DataFrame:
                each, texts = _together(held, shortest)
                as_rows = [[{"start": s, "length": m, "period": q} for s, m, q in r.tolist()] for r in each]
                return pd.DataFrame({"doc_id": ids, "n_words": [len(d) for d in held], "runs": as_rows, "collapsed": texts})

            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = _WORD.findall(text or "")
                if held and n + len(words) > AT_ONCE:
                    yield frame()
                    held, ids, n = [], [], 0
                held.append(words)
                ids.append(doc_id)
                n += len(words)
            if held:
                yield frame()

    return run


def find_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """doc_id, n_words, runs, collapsed: the periodic runs of every document's words, without a shuffle.

    `runs` lists (start, length, period) by start, then period: stretches with
    smallest period q (words q apart are identical), of at least `shortest` and
    2 * q words, that no neighbouring word extends with that period. `shortest` is at
    least 12. `collapsed` holds the words, joined by one space, without those that stand in a
    run behind its first q words. Words are `[^\\x20\\x09-\\x0D]+` of the whole text.

    A NULL or empty text has no words, no runs and an empty `collapsed`. Repeated
    rows are found each on its own, rows without doc_id stay. A task holds a
    few hundred bytes for a word of its longest text, and time grows with the
    text's length times its logarithm, however repetitive it is. An empty table gives
    an empty result; other columns are ignored.
    """
    if shortest < 12:
        raise ValueError("runs of fewer than 12 words need blocks of one word")
    found = docs.select(id_in("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        _find(shortest),
        "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string",
    )
    return found.withColumn("doc_id", id_out("doc_id"))


def digest(found: DataFrame) -> DataFrame:
    """One row of figures per document: the number of runs, the longest one, hashes of all runs and of the words kept."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    return found.withColumn("_l", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_l.s").alias("start"),
        (-F.col("_l.n")).alias("length"),
        F.col("_l.p").alias("period"),
        F.expr("1000 * -_l.n div _l.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32 of the doc_id is divisible by 10, words from some place on repeat the words there.

    With g = crc32 div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8), each
    word i >= a of n becomes word a + (i - a) % p. Rows without doc_id stay.
    """
    words = F.expr("regexp_extract_all(coalesce(text, ''), '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', 0)")
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    tail = """transform(sequence(0L, size(_w) - 1L), i -> get(_w, cast(CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END as int)))"""
    cut = (
        chosen.withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_g", F.expr("_h div 10"))
        .withColumn("_a", F.expr("CASE WHEN size(_w) > 0 THEN _g % size(_w) END"))
        .withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + _g % 8)"))
    )
    return cut.select("doc_id", F.expr(f"CASE WHEN size(_w) > 0 THEN array_join({tail}, ' ') ELSE text END").alias("text"))
