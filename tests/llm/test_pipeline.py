"""The pipeline's stages against plain Python, stage by stage on the rows of the one before."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpus import awkward, documents, prose
from test_texts import grouped, plain_quality, plain_spans, shingles

import corpus_pipeline
from mendframe.llm.common import shared_folder
from mendframe.llm.mixing import mix, target_weights
from mendframe.llm.pii import masked
from mendframe.llm.queries import tokenizer_file


def test_stages(spark):
    import sentencepiece

    data = awkward() + [(1000 + i, prose(2000 + i, 120, 3000) + f" Mail me{i}@host.example.com now.", "en", f"src{i % 4}", 1) for i in range(60)]
    data += [(2000 + i, data[-1 - i][1] + " More.", "en", "src1", 1) for i in range(10)]
    docs = documents(spark, data)
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, "stage-test")
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([tuple(r) for r in docs.collect()])
    kept, once, safe, mixed, coded = seen
    for r in Counter(kept):
        n_words, _, _, _, repeated = plain_quality(r[1])
        assert r in data and n_words >= 50 and 100 * repeated <= 50 * n_words
    assert {r[0] for r in kept} >= set(range(1000, 1060))
    sets = [shingles(r[1], 5) for r in kept]
    # Components by place, as two texts may have one id; each leaves its smallest doc_id, once.
    comp = grouped(list(range(len(kept))), sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    lowest: dict[int, int] = {}
    for r, c in zip(kept, comp, strict=True):
        if r[0] is not None:
            lowest[c] = min(lowest.get(c, r[0]), r[0])
    assert Counter(r[0] for r in once if r[0] is not None) == Counter(lowest.values())
    assert Counter(r for r in once if r[0] is None) == Counter(r for r in kept if r[0] is None)
    assert Counter(lowest.values())[3] == 2
    want = Counter()
    for d, t, *rest in once:
        t = masked(t, plain_spans(t))
        want[(d, t, rest[0], rest[1], len(t))] += 1
    assert Counter(safe) == want
    chosen = {(r.doc_id, r.mark, r.epoch) for r in mix(documents(spark, safe), weights=target_weights(spark)).collect()}
    assert Counter(r[0] for r in mixed) == Counter(d for d, _, _ in chosen)
    assert set(mixed) <= set(safe)
    sp = sentencepiece.SentencePieceProcessor(model_proto=tokenizer_file("piece_bpe_32k.model"))
    assert Counter((d, n, tuple(i)) for d, n, i in coded) == Counter((r[0], len(e), tuple(e)) for r in mixed for e in [sp.encode(r[1])])


def test_repeated_id_is_judged_by_its_own_text(spark):
    """A document goes for its own text, not for that of another one with its doc_id."""
    one, two = prose(4001, 120, 3000), prose(4002, 120, 3000)
    data = [(1, one, "en", "s", 1), (2, two, "en", "s", 1), (2, one + " More.", "en", "s", 1)]
    left = corpus_pipeline.near_duplicate_stage(spark, documents(spark, data), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, one), (2, two)]


def test_repeated_ids_lose_no_text(spark):
    """Different texts with one doc_id stay, whatever else has that id; equal and near-equal ones leave one."""
    a, b, c, d = (prose(4100 + i, 120, 3000) for i in range(4))
    data = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, c, "de", "t", 1), (1, a, "en", "s", 1), (1, a + " More.", "en", "s", 1)]
    data += [(2, b + " More.", "en", "s", 1), (2, d, "en", "s", 1), (2, d, "fr", "u", 1), (3, d + " More.", "en", "s", 1)]
    left = Counter((r.doc_id, r.text.removesuffix(" More.")) for r in corpus_pipeline.near_duplicate_stage(spark, documents(spark, data), "").collect())
    assert left == Counter([(1, a), (1, b), (1, c), (2, d)])


def test_empty(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark, "stage-test")
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
    assert not docs.count()
