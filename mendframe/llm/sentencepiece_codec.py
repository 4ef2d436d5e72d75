"""SentencePiece encoding by a table of distinct chunks.

In the models this is for, no piece goes on past a whitespace marker, so a text
cut in front of each run of markers, and around line feeds where no piece holds
one, is segmented chunk by chunk with the same result. Each block of documents
lists its distinct chunks; equal chunks of all blocks meet in one bucket by
hash, where each is segmented once; the ids go back to the blocks and are
joined to the texts by position.

Blocks, and not single words, are the rows: a chunk travels once per block and
its ids come back once; the positions are written in buckets of their block and
stay where they are when the ids come. Buckets are streamed, so memory
is bounded by a block and by the cache of distinct chunks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import bucketed, id_in, id_out

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def load(model: bytes):
    """The processor of a model; ValueError where the chunk table would not be exact."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        fixed = sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)
        if not fixed and (MARK in piece.lstrip(MARK) or "\n" in piece):
            raise ValueError(f"piece {i} goes on past a marker or holds a line feed")
    feed = line_feed(sp)
    probe = "a  b\n c "
    ids = [i for c in _CHUNK.findall(marked(probe)) for i in (feed if c == "\n" else segment(sp, [c])[0])]
    if sp.encode(probe) != ids:
        raise ValueError("the model rewrites white space or puts no marker in front")
    return sp


def marked(text: str) -> str:
    """The text as the model sees it: a marker in front and in the place of each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def line_feed(sp) -> list[int]:
    return sp.encode("\n")[1:]


def segment(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of single chunks: encoded behind a marker and a line feed, which are cut off."""
    skip = 1 + len(line_feed(sp))
    return [ids[skip:] for ids in sp.encode(["\n" + c for c in chunks], num_threads=1)]


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Numbers packed with the bytes of one significance together, which compresses better."""
    return _pack(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(_unpack(data), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


def _blocks(chars: int, buckets: int):
    """Rows (block, doc_ids, lengths, positions, bucket_of, chunks), each of about `chars` characters.

    positions holds a number for each chunk of the texts, 0 for the line feed
    and the others from 1 on as they first occur, so frequent ones are small;
    bucket_of says where each went, in whose list they keep their order.
    """

    def close(name: str, ids: list, texts: list[str]) -> pd.DataFrame:
        number = {"\n": 0}
        at = [
            np.array([number.setdefault(c, len(number)) for c in _CHUNK.findall(marked(t))], np.uint32) for t in texts
        ]
        by: list[list[str]] = [[] for _ in range(buckets)]
        where = np.fromiter((zlib.crc32(c.encode()) % buckets for c in number), np.uint32, len(number))[1:]
        for c, b in zip(list(number)[1:], where.tolist(), strict=True):
            by[b].append(c)
        row = {
            "block": name,
            "doc_ids": ids,
            "lengths": [len(a) for a in at],
            "positions": _planes(np.concatenate(at)),
            "bucket_of": _planes(where),
            "chunks": [_pack("\n".join(b).encode()) if b else None for b in by],
        }
        return pd.DataFrame([row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, texts, held, n, part = [], [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= chars:
                    yield close(f"{part}-{n}", ids, texts)
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield close(f"{part}-{n}", ids, texts)

    return run


def _segmented(model, known_at_most: int = 1_000_000):
    """Each distinct chunk of a partition is segmented once; the cache starts anew when it is full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = load(model.value)
        known: dict[str, list[int]] = {}
        for batch in batches:
            out, sizes = [], []
            for packed in batch["chunks"]:
                chunks = _unpack(packed).decode().split("\n")
                new = [c for c in chunks if c not in known]
                if len(known) + len(new) > known_at_most:
                    known.clear()
                    new = chunks
                known.update(zip(new, segment(sp, new), strict=True))
                ids = [known[c] for c in chunks]
                n = np.array([len(i) for i in ids], np.uint32)
                flat = np.array([i for one in ids for i in one], np.uint32)
                out.append(_planes(np.concatenate([n, flat])))
                sizes.append(len(n))
            yield pd.DataFrame({"block": batch["block"], "bucket": batch["bucket"], "ids": out, "n": sizes})

    return run


def _assembled(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = load(model.value)
        feed = np.array(line_feed(sp), np.uint32)
        for batch in batches:
            for row in batch.itertuples():
                where = _from_planes(row.bucket_of)
                size, flat = [np.array([len(feed)], np.uint32)], [feed]
                for part in sorted(row.parts if row.parts is not None else (), key=lambda p: p["bucket"]):
                    packed = _from_planes(part["ids"])
                    size.append(packed[: part["n"]])
                    flat.append(packed[part["n"] :])
                size, flat = np.concatenate(size).astype(np.int64), np.concatenate(flat)
                # From bucket order back to the numbers of the positions.
                place = np.zeros(len(where) + 1, np.int64)
                place[1 + np.argsort(where, kind="stable")] = np.arange(1, len(where) + 1)
                first = (np.cumsum(size) - size)[place]
                size = size[place]
                at = _from_planes(row.positions)
                lo, out = 0, []
                for doc_id, n in zip(row.doc_ids, row.lengths, strict=True):
                    p = at[lo : lo + n]
                    lo += n
                    each = size[p]
                    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    ids = flat[np.repeat(first[p], each) + within].astype(np.int32)
                    out.append((doc_id, ids, sp.decode(ids.tolist())))
                    if len(out) == 500:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, model: bytes, chars: int = 16_000_000, buckets: int | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, ids, decoded.

    ids are those of the model for the whole text, without begin or end ids;
    decoded is what the model makes of them. `model` is the content of a model
    file. `chars` is the size of a block, `buckets` how many share the distinct
    chunks (default: the number of shuffle partitions).

    NULL and empty texts have no ids and decode to an empty text. A text longer
    than a block is a block of its own. Repeated rows are encoded each. An empty
    table gives an empty result; other columns are ignored.
    """
    load(model)
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = spark.sparkContext.broadcast(model)  # one file of fixed size
    blocks = bucketed(
        docs.select(id_in("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
            _blocks(chars, buckets),
            "block string, doc_ids array<bigint>, lengths array<int>, positions binary, bucket_of binary, chunks array<binary>",
        ),
        "piece_blocks",
        "block",
        buckets,
    )
    parts = (
        blocks.select("block", F.posexplode("chunks").alias("bucket", "chunks"))
        .where(F.col("chunks").isNotNull())
        .repartition(buckets, "bucket")
        .mapInPandas(_segmented(model), "block string, bucket int, ids binary, n int")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "ids", "n")).alias("parts"))
    )
    return (
        blocks.select("block", "doc_ids", "lengths", "positions", "bucket_of")
        .join(parts.hint("merge"), "block", "left")
        .mapInPandas(_assembled(model), "doc_id bigint, ids array<int>, decoded string")
        .withColumn("doc_id", id_out("doc_id"))
    )


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
