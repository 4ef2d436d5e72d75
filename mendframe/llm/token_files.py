"""Token ids as Arrow files of fixed-size lists.

Documents in ascending doc_id, each closed by an end id, are one stream of
ids. A file holds a range of documents as record batches with two columns:
`ids`, a fixed-size list of unsigned 16- or 32-bit ids, and `mask`, a fixed-size list
of bits that are 0 on padding. Files are not compressed, so a reader maps
them and finds sequence k of a file at a fixed offset. Sequences are packed
across documents; only the last one of a file is padded. Beside each file lies an
index of its documents.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out, saved


def _open(folder: str):
    """(file system, path) of a folder given as a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


#: The text preparation of a tokenizer for which `Encoder` cuts words itself.
PREPARED = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: Blanks, visible ASCII and Latin letters that are one code point in either case and in composed form.
_PLAIN = re.compile("[ \t\n\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
_PIECE = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\r{_LETTERS}0-9]+")


class Encoder:
    """Ids of texts as bytes, each distinct piece encoded once as long as the cache lasts.

    For tokenizers that cut at white space and drop it: a text's ids are those
    of its words, one after the other. Where the tokenizer prepares text as
    `PREPARED` says, plain text is cut here and goes straight to its model, a
    quarter of the work; all other words, and all words of other tokenizers, take the
    tokenizer's own way.
    """

    def __init__(self, model: str, known_at_most: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = known_at_most
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        as_read = json.loads(model)
        self.model = self.tokenizer.model if all(as_read.get(k) == v for k, v in PREPARED.items()) else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}
        probe = " It's  A-b\r\n\tC1, x9. \u00c9t\u00e9's 50%%'ll <x> \u0141\u00f3d\u017a "
        for text in (probe, probe + "\x0bd"):
            if self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) != self(text):
                raise ValueError("this tokenizer does not drop white space")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def _is_plain(self, text: str) -> bool:
        # The strings of special tokens are matched before anything else.
        return self.model is not None and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def __call__(self, text: str) -> bytes:
        if self._is_plain(text):
            return self._looked_up(self.pieces, _PIECE.findall(text.lower()), self._of_pieces)
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return self._looked_up(self.words, words, self._of_words)

    def _looked_up(self, known: dict[str, bytes], parts: list[str], code) -> bytes:
        coded = list(map(known.get, parts))
        if None in coded:
            gaps = [i for i, c in enumerate(coded) if c is None]
            new = dict.fromkeys([parts[i] for i in gaps])
            fresh = code(new)
            for i in gaps:
                coded[i] = fresh[parts[i]]
            if len(known) + len(fresh) > self.most:
                known.clear()
            known.update(fresh)
        return b"".join(coded)

    def _of_pieces(self, pieces) -> dict[str, bytes]:
        tokenize, table, pack = self.model.tokenize, self.byte_level, self._pack
        return {p: pack([t.id for t in tokenize(p if p.isascii() else p.translate(table))]) for p in pieces}

    def _of_words(self, words) -> dict[str, bytes]:
        out = {w: self(w) for w in words if self._is_plain(w)}
        rest = [w for w in words if w not in out]
        coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return out | {w: self._pack(c.ids) for w, c in zip(rest, coded, strict=True)}


def _schema(dtype, length: int, meta: dict) -> pa.Schema:
    kind = pa.from_numpy_dtype(dtype)
    return pa.schema(
        [pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))],
        metadata={"tokens": json.dumps(meta)},
    )


def _batch(schema: pa.Schema, ids: np.ndarray, real: int, length: int) -> pa.RecordBatch:
    mask = np.zeros(len(ids), bool)
    mask[:real] = True
    return pa.record_batch(
        [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
        ],
        schema=schema,
    )


def _write(folder: str, model, end_id: int, length: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}"
        attempt = f".{name}-{context.taskAttemptId()}"
        system, base = _open(folder)
        encode = Encoder(model.value)
        schema = _schema(encode.dtype, length, {"length": length, "rows": rows, "end_id": end_id})
        end = np.array([end_id], encode.dtype).tobytes()
        docs, starts, sizes, total = [], [], [], 0
        held, pending = [], 0
        writer = sink = None
        step = length * rows
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(encode(text or "") + end, encode.dtype)
                docs.append(doc_id)
                starts.append(total)
                sizes.append(len(ids))
                total += len(ids)
                held.append(ids)
                pending += len(ids)
                if writer is None:
                    sink = system.open_output_stream(f"{base}/{attempt}.arrow")
                    writer = pa.ipc.new_file(sink, schema)
                if pending >= step:
                    flat = np.concatenate(held)
                    cut = pending - pending % step
                    for lo in range(0, cut, step):
                        writer.write_batch(_batch(schema, flat[lo : lo + step], step, length))
                    held, pending = [flat[cut:]], pending - cut
        if writer is None:
            return
        if pending:
            flat = np.concatenate(held)
            padded = np.zeros(-(-pending // length) * length, encode.dtype)
            padded[:pending] = flat
            writer.write_batch(_batch(schema, padded, pending, length))
        writer.close()
        sink.close()
        index = pa.table({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with system.open_output_stream(f"{base}/{attempt}.index") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        # Under their names only when whole; a second attempt writes the same.
        system.move(f"{base}/{attempt}.index", f"{base}/{name}.index")
        system.move(f"{base}/{attempt}.arrow", f"{base}/{name}.arrow")
        yield pd.DataFrame({"name": [name], "n_docs": [len(docs)], "n_ids": [total]})

    return run


def write_token_files(
    docs: DataFrame, folder: str, model: str, end_id: int = 2, length: int = 2048, rows: int = 256, files: int | None = None
) -> DataFrame:
    """Writes `docs` (doc_id, text) to Arrow files in `folder`; returns (name, n_docs, n_ids) per file, written.

    Files follow each other in doc_id order, NULL doc_ids first; repeated rows
    stand in one file. `model` is the JSON of a tokenizer, `length` the ids per
    sequence, `rows` the sequences per record batch, `files` their number
    (default: the number of shuffle partitions). NULL and empty texts have the end id
    alone. An empty table writes no file; other columns are ignored.
    """
    spark = docs.sparkSession
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    model = spark.sparkContext.broadcast(model)  # one file of fixed size
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(id_in("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(files, "doc_id")
        .sortWithinPartitions("doc_id")
    )
    written = ordered.mapInPandas(_write(folder, model, end_id, length, rows), "name string, n_docs bigint, n_ids bigint")
    return saved(written, "token-file-list")


def sequence(folder: str, name: str, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """(ids, mask) of sequence k of a file, neither of them copied.

    On a local disk both are views of the mapped file; on any other file system
    that pyarrow reaches only the file's footer and the batch that holds the
    sequence are read, and both are views of that buffer. The mask is an Arrow
    array of bits; they take a sixteenth of the ids' room, and bytes half of it.
    """
    system, base = _open(folder)
    path = f"{base}/{name}.arrow"
    local = getattr(system, "type_name", "") == "local"
    reader = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
    rows = json.loads(reader.schema.metadata[b"tokens"])["rows"]
    batch = reader.get_batch(k // rows)
    ids, mask = (batch.column(i)[k % rows].values for i in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask


def _read(folder: str):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("crc32", pa.int64())]

    def frame(docs: list[tuple]) -> pa.RecordBatch:
        ids = [i for _, _, i in docs]
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = pa.array(np.concatenate(ids).astype(np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        crcs = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
        columns = [[d for d, _, _ in docs], [s for _, s, _ in docs], sizes, pa.ListArray.from_arrays(offsets, flat), crcs]
        return pa.record_batch([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        for batch in batches:
            for name, before in zip(batch["name"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}.index") as f:
                    index = pa.ipc.open_file(f).read_all()
                with system.open_input_file(f"{base}/{name}.arrow") as f:
                    reader = pa.ipc.open_file(f)
                    out, number, held = [], 0, np.empty(0, np.uint16)
                    for doc_id, start, n in zip(*(index[c].to_pylist() for c in ("doc_id", "start", "n_tokens")), strict=True):
                        parts, have = [held], len(held)
                        while have < n:
                            rows = reader.get_batch(number)
                            number += 1
                            ids, mask = (rows.column(i).flatten().to_numpy(zero_copy_only=not i) for i in (0, 1))
                            parts.append(ids if mask[-1] else ids[mask])
                            have += len(parts[-1])
                        flat = np.concatenate(parts) if len(parts) > 1 else held
                        out.append((doc_id, before + start, flat[:n]))
                        held = flat[n:]
                        if len(out) == 500:
                            yield frame(out)
                            out = []
                    if out:
                        yield frame(out)

    return run


def read_token_files(files: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """One row per document of the files listed in `files` (name, n_ids): doc_id, start, n_tokens, ids, crc32.

    start counts the ids of all documents before it, crc32 is that of the ids as
    little-endian unsigned 32-bit integers. Only the list of files, a row each, is
    numbered in one order, before it is dealt over `tasks` tasks (default: the number of
    shuffle partitions); a file is read batch by batch, and nothing moves after that.
    """
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("name", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    docs = bases.repartition(tasks).mapInArrow(
        _read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids array<int>, crc32 bigint"
    )
    return docs.withColumn("doc_id", id_out("doc_id"))


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
