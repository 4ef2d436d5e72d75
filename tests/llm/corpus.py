"""Small tables with every awkward row: NULLs, blanks, very long texts, ties, repeated rows, foreign columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = SCHEMA + ", mark string, `row` int, `key` string, q int, kept string, component_id string, epoch string, spans int, url string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}" if r.random() < 0.8 else r.choice(("the", "of", "and")) for _ in range(n)]
    out = []
    while words:
        k = r.randrange(5, 14)
        out.append(" ".join(words[:k]).capitalize() + ".")
        words = words[k:]
    return " ".join(s + ("\n" if r.random() < 0.2 else "") for s in out)


def awkward() -> list[tuple]:
    texts: dict[int, str | None] = {i: prose(i, 60 + 7 * i) for i in range(12)}
    texts[12] = None
    texts[13] = ""
    texts[14] = " \t\n\x0b\x0c\r "
    texts[15] = "one two"
    texts[16] = prose(3, 9000)
    texts[17] = texts[4]
    texts[18] = texts[4].replace("w1", "x1", 1)
    texts[19] = "no break " * 4000
    texts[20] = "é ß ﬁ 한국 👩‍👩‍👧 ▁x▁▁ \x00 <s> <|endoftext|> İSTANBUL ŞŞ  two"
    texts[21] = texts[5] + " " + prose(77, 70)
    texts[22] = prose(78, 50) + " " + prose(77, 70) + " " + prose(79, 40)
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in texts.items()]
    rows += [rows[4], rows[12], (None, texts[4], "en", "src1", 5), (None, None, None, None, None), (3, prose(99, 80), "de", "src2", 1)]
    return rows


def documents(spark, rows=None, extra: bool = False):
    rows = awkward() if rows is None else rows
    if extra:
        rows = [(*r, "m", 1, "k", 2, "kept", "c", "e", 3, "u") for r in rows]
    return spark.createDataFrame(rows, EXTRA if extra else SCHEMA)
