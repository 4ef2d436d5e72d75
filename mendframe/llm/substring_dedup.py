"""Substring deduplication by sliding runs of sentences.

Every run of consecutive sentences is hashed and all runs meet in one global
join. The run that comes first by (doc_id, position) is kept; the sentences that
any later equal run covers are removed. Runs overlap and end at every sentence, so
a repeated passage is covered from its first shared cut to its last one. Long
sentences are cut by their content, so that the offset of a passage does not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out, saved

#: A sentence ends after . ! or ? before white space, or with its line.
_SENTENCE = re.compile(r"[^\n]*?[.!?]+(?=[ \t\n\x0b\x0c\r]|\Z)[ \t\x0b\x0c\r]*\n*|[^\n]+\n*|\n+")


#: Characters of scripts that put no blanks between words: Thai to Lao, Myanmar, Khmer, kana, Han.
_NO_BLANKS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A word of more characters is counted and cut by characters.
_WORD_CHARS = 64
_CHAR = re.compile(f"[{_NO_BLANKS}]")
_UNIT = re.compile(r"\S+\s*")
#: A word is so many parts; a character of such a script, and one of an overlong word, fewer.
_WORD, _LETTER, _OTHER = 6, 3, 1


def _by_words(text: str) -> bool:
    """Whether all words of a text count as words, none by its characters."""
    return (text.isascii() or not _CHAR.search(text)) and max(map(len, text.split()), default=0) <= _WORD_CHARS


def _size(piece: str) -> int:
    """How much a piece holds, in parts of a word."""
    size = 0
    for w in piece.split():
        letters = len(_CHAR.findall(w))
        rest = len(w) - letters
        size += _LETTER * letters + (_OTHER * rest if len(w) > _WORD_CHARS else _WORD if rest else 0)
    return size


def _units(s: str) -> list[str]:
    """The words of a sentence, and the characters of those that are counted by characters, with the blanks behind them."""
    out = []
    for unit in _UNIT.findall(s):
        word = unit.rstrip()
        if len(word) > _WORD_CHARS:
            at = range(1, len(word))
        else:
            at = sorted({x for c in _CHAR.finditer(word) for x in c.span()} - {0, len(word)})
        out += [unit[a:b] for a, b in zip([0, *at], [*at, len(unit)], strict=True)]
    return out


def _places(words: list[str], sizes: list[int], longest: int) -> np.ndarray:
    """Which units of sentences (`sizes` units each) end a piece: in each window of `longest` units of one
    sentence the unit of the lowest hash, the last such; a unit is hashed with the one before it.

    The places depend on the units around them alone, so that equal passages are cut
    alike from their first full window on wherever they stand. No piece has
    more than `longest` units.
    """
    codes = np.fromiter(map(zlib.crc32, [w.encode("utf-8", "surrogatepass") for w in words]), np.uint64, len(words))
    first = np.cumsum([0, *sizes[:-1]])
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    before = np.roll(codes, 1)
    before[first] = 0
    mixed += before * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.lib.stride_tricks.sliding_window_view(mixed[::-1], longest).argmin(axis=1)[::-1]
    start = np.arange(len(low))
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = of[: len(low)] == of[longest - 1 :]
    ends = np.zeros(len(words), bool)
    ends[(start + longest - 1 - low)[inside]] = True
    ends[first + np.array(sizes) - 1] = False
    return ends


def sentences(text: str, longest: int) -> list[str]:
    """The sentences of a text; joined they are the text. Those of more than `longest` words are cut where their words say."""
    found = _SENTENCE.findall(text)
    plain = _by_words(text)
    long, words, units, sizes = [], [], [], []
    for i, s in enumerate(found):
        if plain and len(s) <= 2 * longest:
            continue
        if plain:
            inside = s.split()
            if len(inside) <= longest:
                continue
            own = _UNIT.findall(s)
        else:
            own = _units(s)
            if len(own) <= longest:
                continue
            inside = [u.rstrip() for u in own]
        long.append(i)
        words += inside
        units += own
        sizes.append(len(own))
    if not long:
        return found
    marks = np.flatnonzero(_places(words, sizes, longest)).tolist()
    out, done, at, k = [], 0, 0, 0
    for i, n in zip(long, sizes, strict=True):
        out += found[done:i]
        done, to = i + 1, at + n
        blank = len(found[i]) - len(found[i].lstrip())
        head = found[i][:blank]
        while k < len(marks) and marks[k] < to:
            out.append(head + "".join(units[at : marks[k] + 1]))
            head, at = "", marks[k] + 1
            k += 1
        out.append(head + "".join(units[at:to]))
        at = to
    return out + found[done:]


def runs(text: str, span: int, least_words: int, longest: int) -> list[tuple[int, int, bytes]]:
    """(first, end, hash) of the shortest run from each sentence on, and of the shortest
    that ends with it, in positions among the sentences with words.

    A run holds the fewest sentences that are at least `span` and hold
    `least_words` words; one that the text's end cuts short is none. White
    space between words does not count.
    """
    parts = [w for w in (" ".join(p.split()) for p in sentences(text, longest)) if w]
    coded = [w.encode("utf-8", "surrogatepass") for w in parts]
    if _by_words(text):
        sizes = [_WORD * (c.count(b" ") + 1) for c in coded]
    else:
        sizes = [_size(w) for w in parts]
    flat = b" ".join(coded)
    at = [0, *accumulate(len(c) + 1 for c in coded)]
    size, n = np.cumsum([0, *sizes]), np.arange(len(parts) + 1)
    ends = np.maximum(np.searchsorted(size, size[:-1] + _WORD * least_words), n[:-1] + span)
    starts = np.minimum(np.searchsorted(size, size[1:] - _WORD * least_words, "right") - 1, n[1:] - span)
    places = {(i, e) for i, e in zip(n.tolist(), ends.tolist()) if e <= len(parts)}
    places |= {(i, e) for i, e in zip(starts.tolist(), n[1:].tolist(), strict=True) if i >= 0}
    return [(i, e, hashlib.blake2b(flat[at[i] : at[e] - 1], digest_size=16).digest()) for i, e in sorted(places)]


def _hashed(span: int, least_words: int, longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                found = [runs(t or "", span, least_words, longest) for t in part["text"]]
                n = [len(f) for f in found]
                keys = np.frombuffer(b"".join(h for f in found for _, _, h in f), np.int64).reshape(-1, 2)
                yield pd.DataFrame(
                    {
                        "k1": keys[:, 0],
                        "k2": keys[:, 1],
                        "rank": np.repeat(part["rank"].to_numpy(), n),
                        "mark": np.repeat(part["mark"].to_numpy(), n),
                        "lo": np.array([i for f in found for i, _, _ in f], np.int32),
                        "hi": np.array([e for f in found for _, e, _ in f], np.int32),
                    }
                )

    return run


def _cut(longest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, later in zip(batch["doc_id"], batch["text"], batch["later"], strict=True):
                text = text or ""
                parts = sentences(text, longest)
                full = [i for i, p in enumerate(parts) if p.split()]
                gone: set[int] = set()
                for r in later if later is not None else ():
                    gone.update(full[r["lo"] : r["hi"]])
                spans, at = [], 0
                for i, p in enumerate(parts):
                    if i in gone:
                        if spans and spans[-1][1] == at:
                            spans[-1][1] = at + len(p)
                        else:
                            spans.append([at, at + len(p)])
                    at += len(p)
                kept = "".join(p for i, p in enumerate(parts) if i not in gone) if gone else text
                out.append((doc_id, len(full), len(gone), ",".join(f"{a}:{b}" for a, b in spans), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_sentences", "n_removed", "removed_spans", "text"])

    return run


def remove_repeated_spans(docs: DataFrame, span: int = 2, least_words: int = 20, longest: int = 16) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_sentences, n_removed, removed_spans, text.

    A run has at least `span` sentences and `least_words` words, so shared
    lines and stock phrases alone are no passage; sentences longer than
    `longest` words are cut by content. Of a repeated passage that starts or ends
    inside a sentence, at most `longest` + 1 words stay at that end; one of
    4 * `longest` + `least_words` words is always found. removed_spans holds start:end in code points of
    the old text, end exclusive, comma-joined; text is what stays.

    NULL texts are empty. Texts shorter than a run stay as they are. Repeated
    rows (same doc_id and text) are one document and stay alike; rows with one
    doc_id and different texts are ordered by a hash of the text; rows without
    doc_id come last. An empty table gives an empty result; other columns are
    ignored.

    Counting combines before its shuffle and only repeated keys are joined
    back, in equi-joins whose hot keys adaptive execution splits. What is
    gathered per document is bounded by the document.
    """
    base = docs.select(
        id_in("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("rank"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"),
    )
    every = saved(
        base.select("rank", "mark", "text").mapInPandas(
            _hashed(span, least_words, longest), "k1 bigint, k2 bigint, rank bigint, mark bigint, lo int, hi int"
        ),
        "sentence-runs",
    )
    shared = every.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1")
    repeated = saved(every.join(shared, "k1"), "repeated-runs")
    first = repeated.groupBy("k1", "k2").agg(F.min(F.struct("rank", "mark", "lo")).alias("first"))
    later = (
        repeated.join(first, ["k1", "k2"])
        .where(F.struct("rank", "mark", "lo") != F.col("first"))
        .groupBy("rank", "mark")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("later"))
    )
    return (
        base.join(later, ["rank", "mark"], "left")
        .select("doc_id", "text", "later")
        .mapInPandas(_cut(longest), "doc_id bigint, n_sentences bigint, n_removed bigint, removed_spans string, text string")
        .withColumn("doc_id", id_out("doc_id"))
    )
