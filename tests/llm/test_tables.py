"""Operators on vectors, sources, pages and token files against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpus import awkward, documents, prose

from mendframe.llm import embedding_dedup, mixing, token_files, url_filter, warc
from mendframe.llm.common import shared_folder
from mendframe.llm.queries import tokenizer_file

NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base.astype(np.float32))]
    near = base[0] + rng.standard_normal((60, 16)) * 0.12
    rows += [(100 + i, [float(x) for x in v], 0) for i, v in enumerate(near.astype(np.float32))]
    edge = base[1] + rng.standard_normal((60, 16)) * 0.27
    rows += [(200 + i, [float(x) for x in v], 1) for i, v in enumerate(edge.astype(np.float32))]
    rows += [rows[2], (300, rows[2][1], 2), (301, rows[2][1], 1), (302, rows[2][1], None), (303, None, 1), (304, [], 1)]
    rows += [(305, [0.0] * 16, 1), (306, [NAN] + [1.0] * 15, 1), (307, [INF] + [1.0] * 15, 1), (308, [None] + [1.0] * 15, 1)]
    rows += [(309, [1.0] * 8, 1), (310, [2.0] * 8, 1), (None, [1.0] * 8, 1), (None, None, None), (305, [0.0] * 16, 1)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, node int, fp string")
    ok = []
    for _, v, label in rows:
        a = np.array([NAN if c is None else c for c in v or []], np.float32).astype(float)
        ok.append(a if label is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                same = np.array_equal(ok[i], ok[j])
                if same or ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    comp = [low.get(find(i), r[0]) for i, r in enumerate(rows)]
    want = Counter((r[0], n, c, c == r[0]) for r, n, c in zip(rows, links, comp, strict=True))
    # A small block makes every large bucket many blocks.
    for block in (8, 1024):
        got = embedding_dedup.near_vectors(df, miss=1e-9, block=block)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert not embedding_dedup.near_vectors(df.limit(0)).count()


def test_recall_at_the_threshold(spark):
    """Pairs exactly at the cosine are missed no more often than stated."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        c = 0.9301
        rows += [(2 * i, [float(x) for x in a], i % 5), (2 * i + 1, [float(x) for x in c * a + (1 - c * c) ** 0.5 * b], i % 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embedding_dedup.near_vectors(df).where("n_links > 0").count() / 800
    assert found >= 0.99


def plain_budgets(tree, total):
    """{leaf: budget} of a nested {name: subtree or capacity}, by filling up step by step."""

    def cap(t):
        return t if isinstance(t, int) else sum(map(cap, t.values()))

    def share(t, budget, path):
        if isinstance(t, int):
            return {path: budget}
        given, left, open_ = {}, budget, sorted(t, key=lambda k: (cap(t[k]), k))
        while open_:
            k = open_[0]
            if left < cap(t[k]) * len(open_):
                break
            given[k] = cap(t[k])
            left -= given[k]
            open_.pop(0)
        for k in open_:
            given[k] = min(cap(t[k]), left // len(open_))
        out = {}
        for k, b in given.items():
            out |= share(t[k], b, (*path, k))
        return out

    return share(tree, min(total, cap(tree)), ())


def test_mixing(spark):
    data = awkward() + [(1000 + i, prose(i, 40), f"l{i % 3}", f"src{i % 7 % 4}", 1) for i in range(60)]
    rows = [(*r, len((r[1] or "").split())) for r in data]
    leaves: dict = {}
    for r in rows:
        n = len([w for w in (r[1] or "").replace("\x0b", " ").replace("\x0c", " ").split() if w])
        if n:
            source = r[3] or "?"
            digit = int(source[-1]) if source[-1].isdigit() else 0
            domain = ("src" if r[3] else "") + f"-{digit % 2}"
            leaves.setdefault(domain, {}).setdefault(r[2] or "?", {}).setdefault(source, []).append((r[0], r[1], n))
    for total in (None, 300, 50_000, 10**9):
        tree = {d: {x: {s: 4 * sum(n for *_, n in v) for s, v in b.items()} for x, b in a.items()} for d, a in leaves.items()}
        every = sum(n for a in leaves.values() for b in a.values() for v in b.values() for *_, n in v)
        want = plain_budgets(tree, every if total is None else total)
        got = mixing.mix(documents(spark, data, extra=True), total=total).collect()
        taken: Counter = Counter()
        for r in got:
            taken[r.domain, r.lang, r.source] += r.n_taken
        assert {k: v for k, v in want.items() if v} == dict(taken)
        expect = Counter()
        for (d, x, s), budget in want.items():
            docs = leaves[d][x][s]
            size = sum(n for *_, n in docs)
            for e in range(1, budget // size + 1):
                for doc_id, _, n in docs:
                    expect[doc_id, e, n] += 1
            left, e = budget % size, budget // size + 1
            mark = lambda t: hashlib.md5(t.encode()).hexdigest()
            order = lambda v: mark(f"20/{e}/{'' if v[0] is None else v[0]}/{mark(v[1])}")  # noqa: E731, B023
            for doc_id, _, n in sorted(docs, key=order):
                if left > 0:
                    expect[doc_id, e, min(n, left)] += 1
                    left -= n
        assert Counter((r.doc_id, r.epoch, r.n_taken) for r in got) == expect
    assert not mixing.mix(documents(spark, [])).count()


def test_mixing_weights(spark):
    data = [(i, "w " * 10, "en", "a1" if i < 50 else "b1", 1) for i in range(100)]
    table = lambda *rows: spark.createDataFrame(rows, "level string, name string, weight bigint")
    mixed = lambda w: mixing.mix(documents(spark, data), total=400, weights=w, levels=("lang", "source")).groupBy("source").agg({"n_taken": "sum"})
    for rows, want in (
        ([("source", "a1", 3)], {"a1": 300, "b1": 100}),
        ([("source", "a1", 3), ("source", "a1", 1), ("source", "b1", None)], {"a1": 300, "b1": 100}),
        ([("source", "a1", 0)], {"b1": 400}),
        ([("lang", "en", 0)], {}),
    ):
        assert {tuple(r) for r in mixed(table(*rows)).collect()} == set(want.items())
    with pytest.raises(Exception, match="a weight is below 0"):
        mixed(table(("source", "a1", -1))).collect()


def test_mixing_weights_brute_force(spark):
    """Budgets of a tree with unequal weights, one of them 0, filled up step by step."""
    rng = np.random.default_rng(3)
    leaves = [(f"d{a}", f"l{b}", f"s{c}", int(rng.integers(1, 2000))) for a in range(3) for b in range(3) for c in range(5)]
    weights = {("domain", "d0"): 5, ("lang", "l1"): 3, ("lang", "l2"): 0, ("source", "s1"): 7, ("source", "s4"): 2}
    w = lambda depth, name: weights.get((mixing.LEVELS[depth], name), 1)
    alive = [x for x in leaves if all(w(i, x[i]) for i in range(3))]

    def share(rows, budget, depth):
        if depth == 3:
            return {rows[0][:3]: budget}
        groups = {k: [r for r in rows if r[depth] == k] for k in {r[depth] for r in rows}}
        cap = {k: 4 * sum(r[3] for r in g) for k, g in groups.items()}
        given, left, open_ = {}, budget, sorted(groups, key=lambda k: (cap[k] / w(depth, k), k))
        while open_:
            k, among = open_[0], sum(w(depth, x) for x in open_)
            if left * w(depth, k) < cap[k] * among:
                given |= {x: min(cap[x], left * w(depth, x) // among) for x in open_}
                break
            given[k] = cap[k]
            left -= cap[k]
            open_ = open_[1:]
        out = {}
        for k, g in groups.items():
            out |= share(g, given[k], depth + 1)
        return out

    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    table = spark.createDataFrame([(*k, v) for k, v in weights.items()], "level string, name string, weight bigint")
    for total in (0, 1000, 30_000, 10**9):
        got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, total, mixing.LEVELS, 4, table).collect()}
        assert got == share(alive, min(total, 4 * sum(x[3] for x in alive)), 0)


URLS = [
    None, "", "no scheme", "http://", "http://a.NET", "http://a.net/", "https://Sub.Example.net/en/x?y", "http://example.net/EN/",
    "http://example.com/de/1", "http://notexample.com/de/1", "ftp://x.example.com/de/?q", "http://wiki.org/fr/1", "http://wiki.org/de/1?ref=x",
    "http://ADS.site.com/", "http://a.com/login", "http://a.com/logins", "http://a.com/p?utm_source=1", "http://a.com?x#/login", "://net/",
    "a://b://net/", "http://a.com:80/wp-admin/x", "http://user@b.net/x", "HTTP://www.casino.com", "http://a.com/p?page=7", "http://a.com/p?page=77#t",
]


def test_urls(spark):
    rows = [(i, u, "h", "kept") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None), (3, URLS[3], "h", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")
    want = Counter()
    for page_id, url, *_ in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host = re.sub("[A-Z]", lambda c: c.group().lower(), m.group(1)) if m else ""
        path = m.group(2) if m else ""
        fits = [(h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        if rule is None:
            low = re.sub("[A-Z]", lambda c: c.group().lower(), url or "")
            verdict = "block" if any(re.search(r.regex, low) for r in url_filter.PATTERN_RULES) else "allow"
        want[page_id, host, path, rule, verdict] += 1
    got = url_filter.judge_urls(df).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert sum(r.n_tried for r in got) < len(rows) * 2
    assert not url_filter.judge_urls(df.limit(0)).count()


def test_rarest_token(spark):
    urls = spark.createDataFrame([("http://a/x/y",), ("http://a/x",), (None,)], "url string")
    rule = url_filter.Rule("/x/y(?:/|$)")
    assert rule.tokens == ("x", "y")
    assert url_filter.rarest_tokens(urls, (rule,)) == {"y": [rule]}
    with pytest.raises(ValueError):
        url_filter.rarest_tokens(urls, (url_filter.Rule("/x[a-z]"),))


@pytest.mark.parametrize(
    "regex, tokens",
    [
        (r"/a/b", ("a",)),
        (r"[?&]ref=x(?:[&#]|$)", ("ref", "x")),
        (r"^https?://ads\.", ("ads",)),
        (r"/(?:[^/]*/)*login(?:[/?#]|$)", ("login",)),
        (r"/(?:[^/]+)?login/", ()),
        (r"/(?:en|de)/x/", ("x",)),
        (r"/a-?b/", ()),
        (r"/a(?:-c)?/", ("a",)),
        (r"\bfoo\W+bar(?!z)", ("foo",)),
        (r"/(?:foo/)+", ()),
        (r"[^a-z0-9]k[^a-z]m_", ()),
        (r"(?i)/foo/", ()),
        (r"/(?i:foo)/bar/", ("bar",)),
        (r"^x9$", ("x9",)),
        (r"", ()),
    ],
)
def test_literal_tokens(regex, tokens):
    assert url_filter.literal_tokens(regex) == tokens
    # Whatever matches holds every token, whole.
    samples = ["/".join(p) for p in itertools.product(["", "a", "b", "x9", "foo", "en", "login", "a-c", "http:", "ads.k.m_"], repeat=3)]
    samples += [f"http://h/{s}?ref=x&ref={s}" for s in samples] + [f"{s} {s}bar" for s in samples]
    for url in samples:
        if re.search(regex, url):
            assert set(tokens) <= set(re.findall("[a-z0-9]+", url)), url


def test_ten_thousand_rules(spark):
    rules = tuple(url_filter.Rule(rf"/shop/item{i}(?:[/?#]|$)") for i in range(9_000))
    rules += tuple(url_filter.Rule(rf"[?&]id={i}(?:&|$)", "allow") for i in range(1_000))
    urls = [f"http://h/shop/item{i * 7 % 12_000}?id={i % 1_500}" for i in range(1_500)] + ["http://h/shop/", None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(4)
    got = {r.page_id: r for r in url_filter.judge_urls(df, (), rules).collect()}
    for i, url in enumerate(urls):
        m = re.fullmatch(r"http://h/shop/item(\d+)[?]id=(\d+)", url or "")
        blocked = bool(m) and int(m[1]) < 9_000 and int(m[2]) >= 1_000
        assert got[i].verdict == ("block" if blocked else "allow"), url
    # Of 10,000 expressions at most the two of a URL's own tokens run.
    assert max(r.n_tried for r in got.values()) <= 2


def test_warc(spark):
    big = prose(5, 30_000)
    pages = [(i, f"http://a/{i}", prose(i, 50 + i)) for i in range(6)]
    pages += [(10, "http://a\r\nX: y", big), (11, None, big), (12, "u", big), (13, "u", None), (14, "u", ""), (15, "u", "x" * 999), (16, "u", "x" * 999)]
    pages += [(17, "u", "é" * 500), (18, "u", "é" * 500), (19, "u", "\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (12, "u", big), (None, "u", big), (None, None, None)]
    df = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id bigint, url string, html string, digest string, total int")
    last: dict = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            last[body] = max(last.get(body, page_id), page_id)
    want = Counter()
    for page_id, _, html in pages:
        body = (html or "").encode()
        refers = last.get(body) if last.get(body) != page_id else None
        want[page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers is not None else "response", refers] += 1
    for segment, frame, per_file in ((65536, 16384, 500), (100, 33, 7)):
        folder = shared_folder(spark, "warc-test")
        warc.write_archives(df, folder, segment=segment, frame=frame, per_file=per_file)
        read = warc.read_archives(spark, folder)
        assert Counter(tuple(r) for r in warc.digest(read).collect()) == want
        bodies = Counter((r.page_id, bytes(r.payload)) for r in read.where("record_type = 'response'").collect())
        assert bodies == Counter((p, (h or "").encode()) for p, _, h in pages if last.get((h or "").encode(), p) == p)
    text = b"".join(f.read_bytes() for f in sorted(Path(folder.removeprefix("file:")).glob("*.warc"))).decode("latin-1")
    heads = [dict(x.split(": ", 1) for x in h.split("\r\n") if ": " in x) for h in re.findall(r"WARC/1\.1\r\nWARC-Type.*?\r\n\r\n", text, re.S)]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            # Page 12 has repeated rows: no one record to name.
            assert ("WARC-Refers-To" in h) == (h["X-Refers-To-Page-ID"] != "12") and h["WARC-Refers-To-Target-URI"] == "u"
            if "WARC-Refers-To" in h:
                assert ids[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page-ID"]
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(df.limit(0), folder)
    assert not warc.digest(warc.read_archives(spark, folder)).count()


def test_warc_is_linear():
    """A page of 64 MB is cut into as many bytes as it has, not as many as its square."""
    began = time.perf_counter()
    n = sum(len(r) for r in warc.page_records(1, "u", b"x" * (1 << 26), "d", None, None, None, 65536, 16384, "2020-01-01T00:00:00Z"))
    assert (1 << 26) < n < 1.02 * (1 << 26) and time.perf_counter() - began < 5


def test_token_files(spark):
    from tokenizers import Tokenizer

    model = tokenizer_file("word_bpe_49k.json").decode()
    plain = Tokenizer.from_str(model)
    data = awkward() + [(40, "It's 12a-b\x0bc\x1cd  e​f\u3000g's <|startoftext|>x \u0301a", "en", "s", 1)]
    coded = [(r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in data]
    for length, rows in ((2048, 256), (16, 3)):
        folder = shared_folder(spark, "tokens-test")
        files = token_files.write_token_files(documents(spark, data, extra=True), folder, model, length=length, rows=rows, files=3)
        read = token_files.read_token_files(files, folder).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.crc32) for r in read) == Counter(
            (d, tuple(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in coded
        )
        at = 0
        for r in sorted(read, key=lambda r: r.start):
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        order = [-1 if r.doc_id is None else r.doc_id for r in sorted(read, key=lambda r: r.start)]
        assert order == sorted(order)
        # Random access: the sequences of a file, one after the other, are its documents.
        first = files.orderBy("name").first()
        got = []
        for k in range(-(-first.n_ids // length)):
            ids, mask = token_files.sequence(folder, first.name, k)
            assert len(ids) == length and not ids.flags.owndata
            assert not ids.flags.owndata and mask.buffers()[1].is_cpu
            got += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert got == [i for r in sorted(read, key=lambda r: r.start) for i in r.ids][: first.n_ids]
    folder = shared_folder(spark, "tokens-test")
    empty = token_files.write_token_files(documents(spark, []), folder, model)
    assert not token_files.read_token_files(empty, folder).count()


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    model = tokenizer_file("word_bpe_49k.json").decode()
    plain, encode = Tokenizer.from_str(model), token_files.Encoder(model, known_at_most=500)
    assert encode.model is not None
    r = random.Random(6)
    letters = "abcdefzABZ09'.,-%<|>_~!" + "éÉèßüñŁłŸÿſıĿŉ×÷Æœ" + "İΣσςдЖ한中ﬁ①²½ªº\u0301\u00a0\u2028\u200d\x00\x1f\x85"
    tails = ["'s", "'LL", "'re", "<|endoftext|>", "***", ",%%", "''t"]
    for n in range(3000):
        pool = letters[: (23, 41, len(letters))[n % 3]]
        text = " ".join("".join(r.choice(pool) for _ in range(r.randrange(9))) + r.choice(["", *tails]) for _ in range(r.randrange(12)))
        text = text.replace("~", r.choice("~\n\t\x0b"))
        got = np.frombuffer(encode(text), encode.dtype).tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids, text
