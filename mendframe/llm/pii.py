"""Personal data: fixed patterns, and identifiers found by their context.

The fixed patterns give seed entities. The words in front of the seeds are
candidate patterns; everything that looks like an identifier behind one is an
instance of it. Patterns and instances form a graph whose weights are iterated
on Spark: a pattern is as good as the instances it finds, an instance as good as
the patterns that find it. Patterns that end above a threshold discover
identifiers that no fixed pattern matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.llm.common import id_in, id_out, saved

# The kinds in their order; the forms that match them.
KINDS = ("email", "ip", "card", "phone")
#: From its @ on; the characters in front of the @ are _LOCAL.
_EMAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits does, and a run is never left half-way: possessive, so linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Something that looks like an identifier: a word with a digit or an @, less its outer punctuation.
_WORD = re.compile(r"[0-9A-Za-z_+@][^ \t\n\x0b\x0c\r\"'<>,;()]*")
_TELLING = re.compile(r"[0-9@]")
_EDGE = ".,;:!?\"'()[]<>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the valid leftmost non-overlapping matches of each kind, by start, then kind."""
    out = []
    at, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        tail = _EMAIL.match(text, sign) if start < sign else None
        if tail:
            at = tail.end()
            out.append((start, 0, at))
        sign = text.find("@", max(sign + 1, at))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str, str, int, int]]:
    """(pattern, kind or '', instance, start, end) of all spans and of all look-alikes beside them.

    A pattern is the two words in front, lower-cased; at the start of a line
    the missing words are a dash.
    """
    out = [(_before(text, s), kind, text[s:e].lower(), s, e) for kind, s, e in spans]
    taken = sorted((s, e) for _, s, e in spans)
    i = 0
    for m in _WORD.finditer(text):
        word = m.group().rstrip(_EDGE)
        if not _TELLING.search(word):
            continue
        s, e = m.start(), m.start() + len(word)
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            out.append((_before(text, s), "", word.lower(), s, e))
    return out


def _before(text: str, at: int) -> str:
    line = text[max(0, at - 200) : at].rpartition("\n")[2]
    found = [w.lower().strip(_EDGE + "=") or w for w in line.split()[-2:]]
    return " ".join(["-"] * (2 - len(found)) + found)


_FOUND = "doc_id bigint, mark bigint, base array<string>, seen array<struct<pattern:string,kind:string,instance:string,s:int,e:int>>"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("pattern", "kind", "instance", "s", "e")
    for batch in batches:
        base, seen = [], []
        for text in batch["text"]:
            telling = bool(text) and _TELLING.search(text) is not None
            spans = base_spans(text) if telling else []
            base.append([f"{k}:{s}:{e}" for k, s, e in spans])
            seen.append([dict(zip(names, c, strict=True)) for c in contexts(text, spans)] if telling else [])
        yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "base": base, "seen": seen})


def pattern_scores(edges: DataFrame, rounds: int = 4, least_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, score) of the patterns that reach `confidence` and have `least_seeds` different seeds.

    `edges` (pattern, kind, instance) holds each pair once, kind empty where no
    fixed form matched. One graph per kind: score(pattern) is the mean score of
    its instances, score(instance) is 1 for seeds, 0 for seeds of another kind and
    otherwise 1 - product(1 - score / 2) over its patterns, halved so that
    an instance seen behind one pattern alone does not vouch for it.
    """
    seeded = edges.where("kind <> ''").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    graph = materialize(
        seeded.where(F.col("seeds") >= least_seeds)
        .select("pattern", F.col("kind").alias("of"))
        .join(edges, "pattern")
        .select("of", "pattern", "instance", (F.col("kind") == F.col("of")).cast("double").alias("own"), (F.col("kind") != "").alias("seed"))
    )
    score = graph.groupBy("of", "pattern").agg(F.avg("own").alias("score"))
    for _ in range(rounds):
        belief = (
            graph.where("NOT seed")
            .join(score, ["of", "pattern"])
            .groupBy("of", "instance")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("score") / 2)))).alias("belief"))
        )
        score = materialize(
            graph.join(belief, ["of", "instance"], "left")
            .groupBy("of", "pattern")
            .agg(F.avg(F.when(F.col("seed"), F.col("own")).otherwise(F.coalesce("belief", F.lit(0.0)))).alias("score"))
        )
    return score.where(F.col("score") >= confidence).select("pattern", F.col("of").alias("kind"), "score")


def find_personal_data(docs: DataFrame, rounds: int = 4, least_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, mark, base, added, spans.

    base and added are arrays of kind:start:end (code points, end exclusive),
    spans holds both by start, then kind; mark is a hash of the text. Contexts
    and scores are gathered over all documents. NULL and empty texts have no
    spans. Repeated rows get the same spans each. Added spans never overlap
    base ones. Where no pattern reaches `confidence`, nothing is added. An empty
    table gives an empty result; other columns are ignored.

    Texts are read once and never shuffled; hot patterns and instances are
    combined before each shuffle.
    """
    found = saved(
        docs.select(
            id_in("doc_id"), _mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text")
        ).mapInPandas(_find, _FOUND),
        "pii-spans",
    )
    # From here on NO_ID stands for a NULL doc_id, up to the result.
    seen = found.select("doc_id", "mark", F.explode("seen").alias("c")).select("doc_id", "mark", "c.*")
    edges = materialize(seen.select("pattern", "kind", "instance").distinct())
    patterns = pattern_scores(edges, rounds, least_seeds, confidence)
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("as_kind"))
    added = (
        seen.where("kind = ''")
        .join(best, "pattern")
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_set(F.concat_ws(":", "as_kind", "s", "e"))).alias("added"))
    )
    nothing = F.array().cast("array<string>")
    out = found.join(added, ["doc_id", "mark"], "left")
    out = out.select(id_out("doc_id"), "mark", "base", F.coalesce("added", nothing).alias("added"))
    return out.withColumn("spans", _in_order(F.concat("base", "added")))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _in_order(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.array_position(kinds, F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"),
            s.alias("span"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of `find_personal_data`, one row per row."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: F.startswith(s, F.lit(kind + ":")))).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def masked(text: str, spans: list[str]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by that of the first."""
    parts, at = [], 0
    for s, e, kind in sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans)):
        if s >= at:
            parts += [text[at:s], f"<{kind}>"]
        at = max(at, -e)
    return "".join(parts) + text[at:]


def mask_personal_data(docs: DataFrame, rounds: int = 4, least_seeds: int = 5, confidence: float = 0.8) -> DataFrame:
    """`docs` with its personal data masked in text, and n_chars, where there is one, following the text.

    NULL texts stay NULL; rows without personal data stay as they are. Other
    columns stay, whatever they are called.
    """
    found = find_personal_data(docs, rounds, least_seeds, confidence)
    hit = (
        found.where(F.size("spans") > 0)
        .select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("spans").alias("__spans"))
        .dropDuplicates(["__id", "__mark"])
    )
    joined = docs.join(
        hit, docs["doc_id"].cast("bigint").eqNullSafe(hit["__id"]) & (_mark(docs["text"]) == hit["__mark"]), "left"
    )

    @F.pandas_udf("string")
    def mask(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else masked(t, list(s)) for t, s in zip(text, spans, strict=True)])

    out = joined.withColumn("text", mask("text", "__spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
