"""Operators on texts against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpus import SCHEMA, awkward, documents, prose

from mendframe.llm import minhash_dedup, pii, quality, sentencepiece_codec, substring_dedup
from mendframe.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size):
    w = WORD.findall(fold(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if len(w) >= size else {tuple(w)}


def grouped(items, sets, linked):
    """Smallest id reachable for each position."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(items)), 2):
        if sets[i] and sets[j] and linked(sets[i], sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, doc_id in enumerate(items):
        if doc_id is not None:
            k = find(i)
            low[k] = min(low.get(k, doc_id), doc_id)
    return [low.get(find(i), items[i]) for i in range(len(items))]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    data = awkward() + [(100 + i, prose(500, 150).replace(f"w{i}", "zz"), "en", "s", 1) for i in range(40)]
    sets = [shingles(r[1], size) for r in data]
    comp = grouped([r[0] for r in data], sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    want = Counter((r[0], len(s), c, c == r[0]) for r, s, c in zip(data, sets, comp, strict=True))
    assert rows(minhash_dedup.near_duplicates(documents(spark, data, extra=True), words=size)) == want
    assert not minhash_dedup.near_duplicates(documents(spark, [])).count()


def test_large_group_of_near_copies(spark):
    """One list with most of the rows, and two groups that share its values without being alike."""
    base = prose(1, 400, 5000).split(" ")
    half = prose(2, 400, 5000).split(" ")
    data = [(i, " ".join(base[:i] + ["changed"] + base[i:]), "en", "s", 1) for i in range(300)]
    data += [(1000 + i, " ".join(base[:240] + half[:160] + [f"u{i}"]), "en", "s", 1) for i in range(20)]
    sets = [shingles(r[1], 4) for r in data]
    comp = grouped([r[0] for r in data], sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, data), words=4).collect()}
    assert got == dict(zip([r[0] for r in data], comp, strict=True))
    assert len(set(comp)) == 2


def test_match_threshold():
    assert 0 < minhash_dedup.match_threshold(80, 64) < 51
    assert minhash_dedup.match_threshold(100, 64) == 64


def test_substring(spark):
    passage = prose(900, 70, 5000)
    data = awkward() + [(200 + i, f"{prose(910 + i, 60, 5000)} {passage} {prose(950 + i, 60, 5000)}", "en", "s", 1) for i in range(5)]
    data += [(300, "One shared line of a few words.\n" + prose(970, 80, 5000), "en", "s", 1), (301, "One shared line of a few words.\n" + prose(971, 80, 5000), "en", "s", 1)]
    # Brute force: first place of every run, in (doc_id, hash) order.
    marks = dict(documents(spark, data).selectExpr("text", "xxhash64(coalesce(text, ''))").distinct().collect())
    first, found = {}, []
    for r in data:
        for lo, hi, h in substring_dedup.runs(r[1] or "", 2, 20, 16):
            at = (2**63 - 1 if r[0] is None else r[0], marks[r[1]], lo)
            first[h] = min(first.get(h, at), at)
            found.append((at, hi, h))
    gone = {}
    for at, hi, h in found:
        if at != first[h]:
            gone.setdefault(at[:2], set()).update(range(at[2], hi))
    want = Counter()
    for r in data:
        parts = substring_dedup.sentences(r[1] or "", 16)
        assert "".join(parts) == (r[1] or "")
        full = [i for i, p in enumerate(parts) if p.split()]
        cut = {full[k] for k in gone.get((2**63 - 1 if r[0] is None else r[0], marks[r[1]]), ())}
        want[(r[0], len(cut), "".join(p for i, p in enumerate(parts) if i not in cut))] += 1
    result = substring_dedup.remove_repeated_spans(documents(spark, data, extra=True))
    got = result.collect()
    assert Counter((r.doc_id, r.n_removed, r.text) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[200].n_removed == 0 and all(by[200 + i].n_removed >= 5 for i in range(1, 5))
    assert by[300].n_removed == by[301].n_removed == 0
    texts = {r[0]: r[1] for r in data}
    for r in got:
        if r.doc_id is not None and r.doc_id >= 200 and r.removed_spans:
            spans = [tuple(map(int, s.split(":"))) for s in r.removed_spans.split(",")]
            text = texts[r.doc_id]
            assert "".join(text[b:a] for b, a in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(text)], strict=True)) == r.text
    assert not substring_dedup.remove_repeated_spans(documents(spark, [])).count()


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_substring_at_any_offset(spark):
    """Passages inside long sentences, at all offsets: every repeated window of words goes, but for the ends of a passage."""
    longest, least = 16, 20
    r = random.Random(8)
    word = lambda: f"v{r.randrange(10**6)}"
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = [word() for _ in range(4 * longest + least)]
    mixed = [w + "." * (i % 23 == 9) for i, w in enumerate(word() for _ in range(110))]
    data = [(i, "\t".join([word() for _ in range(5 + i)] + passage + [word() for _ in range(7)]), "en", "s", 1) for i in range(20)]
    data += [(100 + i, " ".join([word() for _ in range(3 + i)] + mixed + [word() for _ in range(9)]), "en", "s", 1) for i in range(20)]
    chinese = han(150)
    data += [(200 + i, han(11 + i) + chinese + han(9), "zh", "s", 1) for i in range(17)]
    result = {x.doc_id: x for x in substring_dedup.remove_repeated_spans(documents(spark, data)).collect()}
    seen: set = set()
    for doc_id, text, *_ in data:
        units = list(text) if doc_id >= 200 else text.split()
        bits = list(re.finditer(r"\S", text) if doc_id >= 200 else re.finditer(r"\S+", text))
        spans = [tuple(map(int, x.split(":"))) for x in result[doc_id].removed_spans.split(",") if x]
        gone = [any(a <= m.start() and m.end() <= b for a, b in spans) for m in bits]
        windows = [tuple(units[i : i + 50]) for i in range(len(units) - 49)]
        again = [any(windows[j] in seen for j in range(max(0, i - 49), min(i + 1, len(windows)))) for i in range(len(units))]
        seen.update(windows)
        assert not any(g and not a for g, a in zip(gone, again, strict=True)), doc_id
        if doc_id % 100:
            left = [i for i, (g, a) in enumerate(zip(gone, again, strict=True)) if a and not g]
            lo, hi = again.index(True), len(again) - again[::-1].index(True)
            assert any(gone) and all(i - lo <= longest or hi - i <= longest + 1 for i in left), doc_id


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card":
                doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


TRICKY = [
    "a@b.com@c.de x@@y.com .%@a.b a@b a@b. é@ü.de joe+x@mail-1.example.org, a@b.c+d@e.fr",
    "1.2.3.4.5 1.2.3.256 001.002.003.0004 10.0.0.1.2.3.4.5.6 1.2.3.4é5 300.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111 1111  1111 1111 0000000000000 12 4111111111111111 4242424242424242",
    "+1 (288) 555-5549 call +49.30.1234567. +1 +12345678 +123456789 (+44 20 7946 0958) +1 (288) 555-5549 10.0.0.1",
    "٤111 ４111 1.2.3.４",
]


def test_personal_data(spark):
    data = awkward() + [(400 + i, t, "en", "s", 1) for i, t in enumerate(TRICKY)]
    # Ten different seeds behind one phrase, and an identifier without the fixed form.
    data += [(500 + i, f"Please write. My badge mail: user{i}@mail{i}.example.com is here", "en", "s", 1) for i in range(10)]
    data += [(600, "Please write. My badge mail: user77@intranet thanks", "en", "s", 1), (601, "My badge mail: user77@intranet again", "en", "s", 1)]
    found = pii.find_personal_data(documents(spark, data, extra=True))
    got = pii.digest(found).collect()
    plain = {(r[0], r[1]): plain_spans(r[1]) for r in data}
    want = Counter(
        (r[0], *[sum(s.startswith(k) for s in plain[r[0], r[1]]) for k in PLAIN], hashlib.sha256(",".join(plain[r[0], r[1]]).encode()).hexdigest())
        for r in data
    )
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    start = data[-2][1].index("user77")
    assert by[600].spans == f"email:{start}:{start + len('user77@intranet')}" and by[600].n_added == by[601].n_added == 1
    assert sum(r.n_added for r in got) == 2
    masked = {r.doc_id: r for r in pii.mask_personal_data(documents(spark, data, extra=True)).collect()}
    assert masked[600].text == "Please write. My badge mail: <email> thanks" and masked[600].n_chars == len(masked[600].text)
    assert masked[12].text is None and masked[500].text.count("<email>") == 1 and masked[0].text == data[0][1]
    assert len(pii.mask_personal_data(documents(spark, data)).collect()) == len(data)
    assert not pii.digest(pii.find_personal_data(documents(spark, []))).count()


def test_long_runs_stay_linear():
    pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " " + "a.b" * 100_000 + "@" * 1000)


def test_sentencepiece(spark):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    data = awkward() + [(700 + i, t, "en", "s", 1) for i, t in enumerate(["\n", "\n\n a", " ", "  \n  ", "▁", "a▁\nb", "\r\n x", "▁n", "a" * 5000])]
    want = Counter()
    for r in data:
        ids = sp.encode(r[1] or "")
        want[(r[0], tuple(ids), sp.decode(ids))] += 1
    coded = sentencepiece_codec.encode_decode(documents(spark, data, extra=True), model, chars=3000, buckets=3)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect()) == want
    again = sentencepiece_codec.digest(sentencepiece_codec.encode_decode(documents(spark, data), model)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in again) == Counter(
        {
            (d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()): n
            for (d, i, t), n in want.items()
        }
    )
    assert not sentencepiece_codec.encode_decode(documents(spark, []), model).count()


def plain_quality(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    junk = [(800 + i, " ".join(f"w{i}{k % 7}" for k in range(80)), "en", "s", 1) for i in range(10)]
    junk += [(820 + i, " ".join(f"{w}***" for w in prose(i, 90, 5000).split()), "en", "s", 1) for i in range(10)]
    clean = [(900 + i, prose(i, 120, 5000), "en", "s", 1) for i in range(80)]
    data = awkward() + junk + clean + [(990, "a b c a b c\nx\n\nx\n x\nx", "en", "s", 1), (991, "a a a a", "en", "s", 1)]
    judged = quality.judge_quality(documents(spark, data, extra=True))
    got = quality.digest(judged).collect()
    want = Counter((r[0], *plain_quality(r[1])) for r in data)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {r[0] for r in junk} and all(r[0] in kept for r in clean)
    assert not quality.digest(quality.judge_quality(documents(spark, []))).count()


def test_label_model(spark):
    """Expectation-maximisation against the same steps in plain Python."""
    import math

    data = [(1, 1, None)] * 50 + [(1, 0, 1)] * 3 + [(0, 0, 0)] * 9 + [(0, None, 0)] * 4 + [(None, None, None)]
    rules = ("a", "b", "c")
    df = spark.createDataFrame(data, "v_a int, v_b int, v_c int")
    model = quality.accuracies(df, rules, rounds=7)
    prior, acc = 0.9, [(0.9995, 0.30)] * 3
    for _ in range(7):
        ps = []
        for v in data:
            o = math.log(prior / (1 - prior))
            for x, (g, b) in zip(v, acc, strict=True):
                o += 0 if x is None else math.log(g / (1 - b)) if x else math.log((1 - g) / b)
            ps.append(1 / (1 + math.exp(-o)))
        prior = (sum(ps) + 1) / (len(ps) + 2)
        new = []
        for k in range(3):
            g1 = sum(p for p, v in zip(ps, data, strict=True) if v[k] == 1)
            g0 = sum(p for p, v in zip(ps, data, strict=True) if v[k] == 0)
            b1 = sum(1 - p for p, v in zip(ps, data, strict=True) if v[k] == 1)
            b0 = sum(1 - p for p, v in zip(ps, data, strict=True) if v[k] == 0)
            trust, power = 30 * len(data) + 1, 0.1 * len(data) + 1
            new.append(((g1 + 0.9995 * trust) / (g1 + g0 + trust), (b0 + 0.3 * power) / (b1 + b0 + power)))
        acc = new
    assert model["prior"] == pytest.approx(prior)
    for r, (g, b) in zip(rules, acc, strict=True):
        assert model[r] == pytest.approx((g, b))


def test_votes_and_posterior_of_plain_texts(spark):
    """The rules' votes and the posterior against plain Python for a few kinds of text."""
    import math

    texts = [prose(1, 120, 5000), "BUY NOW! " * 60, " ".join(f"{w}***" for w in prose(3, 90, 5000).split()), "", None, "word " * 70]
    judged = quality.judge_quality(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    q = {r.doc_id: r.q for r in judged.collect()}
    seen = judged.select("doc_id", *[v.alias(n) for n, v in quality.votes().items()]).collect()
    for r in seen:
        c = q[r.doc_id]
        n, chars = c.n_words, c.word_chars
        low = lambda x, good, bad: None if x is None else 1 if x <= good else 0 if x >= bad else None
        assert r.symbols == low(c.n_symbols / chars if chars else None, 0.01, 0.05)
        assert r.capitals == low(c.n_upper / chars if chars else None, 0.10, 0.30)
        assert r.repeats == low(c.n_repeat_words / n if n else None, 0.10, 0.30)
        assert r.shouts == low(c.n_shouts / n if n else None, 0.05, 0.30)
        assert r.word_length == (None if not n else 1 if 3 <= chars / n <= 9 else 0 if chars / n < 2 or chars / n > 14 else None)
        assert r.stop_words == (None if n < 50 else 1 if c.n_stop >= 3 else 0 if c.n_stop <= 0 else None)
    model = {"prior": 0.8} | {r: (0.9 - 0.01 * i, 0.4 + 0.02 * i) for i, r in enumerate(quality.RULES)}
    votes = judged.select("doc_id", *[v.alias(f"v_{n}") for n, v in quality.votes().items()])
    for r in votes.withColumn("p", quality.posterior(model)).collect():
        o = math.log(0.8 / 0.2)
        for n in quality.RULES:
            g, b = model[n]
            o += {None: 0.0, 1: math.log(g / (1 - b)), 0: math.log((1 - g) / b)}[r[f"v_{n}"]]
        assert r.p == pytest.approx(1 / (1 + math.exp(-o)))


def test_schema_is_that_of_the_table(spark):
    assert documents(spark).columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
