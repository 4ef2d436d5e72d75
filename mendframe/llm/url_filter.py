"""URL filtering by rules that are indexed under their rarest literal token.

A pattern rule is a regular expression with the literal tokens (runs of ASCII letters
and digits) that every URL it matches holds whole; they are derived from the parsed
expression, not declared. A count over all URLs finds which of a rule's tokens is rarest; the rule is filed under that one. A URL
fetches candidates by its own tokens, and only those run their expressions.
Host rules come first: the longest that fits decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op
from re import _parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out


_TOKEN_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Parts of an expression beside single characters: a place where no token goes on, and any text.
_END, _ANY = "end", "any"


@dataclass(frozen=True)
class _Optional:
    """Text that may be missing; where it is there, it starts or ends with a place where no token goes on."""

    starts_apart: bool
    ends_apart: bool


def _part_of_token(members) -> bool:
    """Whether a character class may take a token's character."""
    if members[0][0] is op.NEGATE:
        members = members[1:]
        negated = True
    else:
        negated = False
    taken: set[str] = set()
    for kind, value in members:
        if kind is op.LITERAL:
            taken.add(chr(value))
        elif kind is op.RANGE:
            taken.update(c for c in _TOKEN_CHARACTERS if value[0] <= ord(c) <= value[1])
        elif value in (op.CATEGORY_WORD, op.CATEGORY_NOT_SPACE):
            taken.update(_TOKEN_CHARACTERS)
        elif value is op.CATEGORY_DIGIT:
            taken.update("0123456789")
        elif value is op.CATEGORY_NOT_DIGIT:
            taken.update(set(_TOKEN_CHARACTERS) - set("0123456789"))
    held = taken.intersection(_TOKEN_CHARACTERS)
    return len(held) < len(_TOKEN_CHARACTERS) if negated else bool(held)


def _parts(nodes) -> list:
    """An expression as characters, `_END`, `_ANY` and `_Optional` in a row."""
    out: list = []
    for kind, value in nodes:
        if kind is op.LITERAL:
            out.append(chr(value))
        elif kind is op.IN:
            out.append(_ANY if _part_of_token(value) else _END)
        elif kind is op.AT:
            out.append(_ANY if value in (op.AT_NON_BOUNDARY, op.AT_UNI_NON_BOUNDARY) else _END)
        elif kind is op.SUBPATTERN and not value[1] and not value[2]:
            out.extend(_parts(value[3]))
        elif kind is op.ATOMIC_GROUP:
            out.extend(_parts(value))
        elif kind is op.BRANCH:
            ways = [_parts(w) for w in value[1]]
            out += [_END if all(_apart(w, 0, 1) for w in ways) else _ANY, _ANY, _END if all(_apart(w, len(w) - 1, -1) for w in ways) else _ANY]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, sub = value
            some = _parts(sub)
            starts, ends = _apart(some, 0, 1), _apart(some, len(some) - 1, -1)
            if least == most == 1:
                out.extend(some)
            elif least:
                out += [_END if starts else _ANY, _ANY, _END if ends else _ANY]
            else:
                out.append(_Optional(starts, ends))
        else:
            out.append(_ANY)
    return out


def _apart(parts: list, i: int, step: int) -> bool:
    """Whether no token goes on at place i, seen in direction `step`; past the row anything may stand."""
    while 0 <= i < len(parts):
        part = parts[i]
        if not isinstance(part, _Optional):
            return part == _END or (part != _ANY and part not in _TOKEN_CHARACTERS)
        if not (part.starts_apart if step > 0 else part.ends_apart):
            return False
        i += step
    return False


def literal_tokens(regex: str) -> tuple[str, ...]:
    """Tokens that every lower-cased URL which `regex` matches holds whole, in order, once each.

    Only what must be there counts: characters outside of choices and repetitions, with a
    separator or an end of the URL on either side. Expressions that ignore case have none.
    """
    parsed = _parser.parse(regex)
    if parsed.state.flags & re.IGNORECASE:
        return ()
    parts, found, i = _parts(parsed), [], 0
    while i < len(parts):
        end = i
        while end < len(parts) and isinstance(parts[end], str) and parts[end] in _TOKEN_CHARACTERS and len(parts[end]) == 1:
            end += 1
        if end > i and _apart(parts, i - 1, -1) and _apart(parts, end, 1):
            found.append("".join(parts[i:end]))
        i = max(end, i + 1)
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Rule:
    """A pattern rule: `verdict` (block or allow) for lower-cased URLs that `regex` matches."""

    regex: str
    verdict: str = "block"

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return literal_tokens(self.regex)


#: (host, path, verdict): a host with all its subdomains, and the start of the path.
HOST_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: What production blocks beside the host rules.
PATTERN_RULES = (
    Rule(r"[?&]ref=x(?:[&#]|$)"),
    Rule(r"^https?://ads\."),
    Rule(r"/(?:[^/]*/)*login(?:[/?#]|$)"),
    Rule(r"[?&]utm_source="),
    Rule(r"[?&]utm_campaign="),
    Rule(r"[?&]sessionid=[0-9a-f]+"),
    Rule(r"^https?://blog\.[^/]*/en/[0-9]+(?:#|$)"),
    Rule(r"[?&]page=[0-9]{2,}(?:[&#]|$)"),
    Rule(r"[.]html#top$"),
    Rule(r"/wp-admin/"),
    Rule(r"/cgi-bin/"),
    Rule(r"[?&]add-to-cart="),
    Rule(r"^https?://www\.casino\."),
)

#: More rules than this are not kept in every task.
MOST_RULES = 1_000_000
_TOKEN = re.compile("[a-z0-9]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): from the first :// to the next of / ? #, then to the next of ? #; A-Z of the host lower-cased."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(_FOLD), rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:stop]


def _counted(wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for batch in batches:
            for url in batch["url"]:
                n.update(wanted.value.intersection(_TOKEN.findall((url or "").translate(_FOLD))))
        if n:
            yield pd.DataFrame({"token": list(n.keys()), "n": list(n.values())})

    return run


def rarest_tokens(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """The index: each rule under the one of its tokens that the fewest of `urls` (url) hold, ties by name.

    URLs are counted where they lie: what leaves a task is one row per token of the rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not all(r.tokens for r in rules):
        raise ValueError("a rule without literal tokens would have to run on every URL")
    wanted = urls.sparkSession.sparkContext.broadcast(frozenset(t for r in rules for t in r.tokens))
    counts = urls.select("url").mapInPandas(_counted(wanted), "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r["token"]: r["n"] for r in counts.collect()}  # at most one row per token of the rules
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (n.get(t, 0), t)), []).append(rule)
    return index


def host_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it."""
    best: tuple[str | None, str | None] = (None, None)
    labels = host.split(".")
    for i in range(len(labels)):
        domain = ".".join(labels[i:])
        for start, verdict in rules.get(domain, ()):
            if path.startswith(start) and (best[0] is None or len(domain + start) > len(best[0])):
                best = (domain + start, verdict)
    return best


def _judge(index, hosts, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_host, by_token = hosts.value, {}
        for token, some in index.value.items():
            by_token[token] = [(re.compile(r.regex), r.verdict) for r in some]
        for batch in batches:
            out = []
            for url in batch["url"]:
                host, path = split_url(url)
                rule, verdict = host_rule(host, path, by_host)
                tried = 0
                if rule is None:
                    low = (url or "").translate(_FOLD)
                    verdicts = set()
                    for token in set(_TOKEN.findall(low)):
                        for regex, what in by_token.get(token, ()):
                            tried += 1
                            if regex.search(low):
                                verdicts.add(what)
                    verdict = "block" if verdicts == {"block"} else "allow"
                out.append((host, path, rule, verdict, tried))
            judged = pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_tried"])
            yield pd.concat([batch[keep].reset_index(drop=True), judged], axis=1)

    return run


def judge_urls(
    pages: DataFrame,
    host_rules: tuple[tuple[str, str, str], ...] = HOST_RULES,
    pattern_rules: tuple[Rule, ...] = PATTERN_RULES,
) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict, n_tried.

    rule is the host rule that decides, NULL where the pattern rules do: a
    URL is blocked when a block rule matches and no allow rule does. n_tried is
    how many expressions ran on it. NULL URLs and those without :// have an
    empty host and path. Rules are data of the job and bounded by `MOST_RULES`;
    URLs are read once more to count tokens and never shuffled. Repeated rows
    are judged each. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = pages.sparkSession
    pages = pages.select(id_in("page_id"), F.col("url").cast("string").alias("url"))
    hosts: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in host_rules:
        hosts.setdefault(host, []).append((path, verdict))
    send = spark.sparkContext.broadcast
    run = _judge(send(rarest_tokens(pages, pattern_rules)), send(hosts), ["page_id"])
    return pages.mapInPandas(run, "page_id bigint, host string, path string, rule string, verdict string, n_tried bigint").withColumn(
        "page_id", id_out("page_id")
    )
