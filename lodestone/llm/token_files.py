"""Token ids in files of byte-aligned variable-length codes with separate control bytes.

A file is a row of blocks. A block ranks its ids by frequency (so the most frequent 256 take one byte), writes the
ranks in groups of four: two bits of each group's control byte give a rank's length in bytes, and the ranks' bytes
follow in a stream of their own. Ranks are of one block, with the table in the block's header: a file is a pure
function of its rows, can be written again by another executor, and needs no corpus-wide count before the first byte.

Block layout, little-endian: magic, documents D, ids N, table length T, data length B (uint32 each after the magic);
D int64 doc_ids, D uint8 flags (1: the doc_id is null), D uint32 ids per document, T uint32 ids by rank,
ceil(N / 4) control bytes, B data bytes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, small_batches

MAGIC, HEAD = b"TIDB", struct.Struct("<4sIIII")
#: Ids in a block (a longer document gets a block of its own), and words that a worker remembers.
BLOCK_IDS, MEMO_WORDS = 1 << 22, 1 << 21
#: Lengths of the four ranks that a control byte tells.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
#: A space in the vocabulary of a byte-level tokenizer; the mark of a piece that no space precedes.
SPACE, RAW = "\u0120", "\0"
#: What str.split would not keep apart: blanks other than space and line feed, several in a row or at an end, and the mark.
ODD = re.compile(r"[^\S \n]|\s\s|\A\s|\s\Z|\0")
#: The points around a single blank between two non-blank characters.
SEAM = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def encode_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One block. counts: ids of each document; ids: all of them, end to end."""
    n = np.bincount(ids)
    values = np.flatnonzero(n)
    table = values[np.argsort(-n[values], kind="stable")]
    rank_of = np.zeros(len(n), "<u4")
    rank_of[table] = np.arange(len(table))
    ranks = rank_of[ids]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(table), len(data))
    return b"".join([head, known.tobytes(), null.tobytes(), counts.astype("<u4").tobytes(), table.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Ranks from control and data bytes: a table lookup gives the lengths, their running sum the places."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    ranks = data[starts].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= data[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def decode_blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, ids per document and ids of each block of an open file."""
    while head := stream.read(HEAD.size):
        magic, docs, n, table, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        part = lambda kind, k: np.frombuffer(stream.read(np.dtype(kind).itemsize * k), kind)
        known, null, counts, values = part("<i8", docs), part("u1", docs), part("<u4", docs), part("<u4", table)
        control, data = part("u1", -(-n // 4)), part("u1", size)
        ids = values[decode_ranks(control, data, n)] if n else np.zeros(0, np.uint32)
        yield [None if x else int(d) for d, x in zip(known, null)], counts, ids


class _Memo(dict):
    """Number of each word; a new word gets the next number and waits in pending."""

    def __init__(self):
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.pending.append(word)
        return number


class Encoder:
    """Ids of texts by a byte-level tokenizer, with one tokenizer run for each distinct word.

    The pretokens of such a tokenizer never reach across the point before a blank that stands between two non-blank
    characters, so a word with its leading space encodes alike everywhere. Texts of single blanks (spaces and line
    feeds) split by str.split; all others at SEAM.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.clear()

    def clear(self) -> None:
        self.memo = _Memo()
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        """Keys of the pieces: RAW + piece as it stands, or a word that a space precedes."""
        if not text:
            return []
        if ODD.search(text):
            return [RAW + w for w in SEAM.split(text)]
        return (RAW + text.replace("\n", f" {RAW}\n {RAW}")).split(" ")

    def _learn(self) -> None:
        new = self.memo.pending
        spaced = [w for w in new if w[0] != RAW]
        joined = ["".join([f" {w}" for w in spaced[i : i + 256]]) for i in range(0, len(spaced), 256)]
        run = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((i for ids in run(joined) for i in ids), np.uint32)
        heads = np.flatnonzero(self.opens[flat]) if len(flat) else np.zeros(0, np.int64)
        if len(heads) != len(spaced):
            raise ValueError("the tokenizer isn't byte-level with a space at the start of words")
        plain = run([w[1:] for w in new if w[0] == RAW])
        sizes = np.zeros(len(new), np.int64)
        is_raw = np.fromiter((w[0] == RAW for w in new), bool, len(new))
        sizes[~is_raw] = np.diff(np.append(heads, len(flat)))
        sizes[is_raw] = np.fromiter(map(len, plain), np.int64, len(plain))
        begin = np.zeros(len(new), np.int64)
        begin[~is_raw] = heads
        begin[is_raw] = len(flat) + np.cumsum(sizes[is_raw]) - sizes[is_raw]
        self.starts = np.concatenate([self.starts, begin + len(self.flat)])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.flat = np.concatenate([self.flat, flat, np.fromiter((i for ids in plain for i in ids), np.uint32)])
        self.memo.pending = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        known, at, sizes = self.memo.__getitem__, [], []
        for text in texts:
            found = list(map(known, self.words(text)))
            at += found
            sizes.append(len(found))
        if self.memo.pending:
            self._learn()
        at = np.array(at, np.int64)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, np.diff(edges)


_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str) -> Encoder:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def write_token_files(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """Encode all texts and write them to path in ascending doc_id order. Returns (number, file, ids) of each file.

    File k holds the k-th range of ids. A task writes to a name of its own and renames at the end, so a task that
    runs again leaves one whole file. One row for each file comes to the driver.
    """
    from pyarrow import fs

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_json)
        store = out = name = part = None
        total, held = 0, []

        def flush() -> None:
            nonlocal held
            if held:
                out.write(encode_block([d for ds, _, _ in held for d in ds], np.concatenate([c for _, c, _ in held]), np.concatenate([i for _, _, i in held])))
                held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store, where = fs.FileSystem.from_uri(path)
                store.create_dir(where, recursive=True)
                part = batch.column("part")[0].as_py()
                name = f"{where}/ids-{part:06d}"
                temporary = f"{name}.{uuid.uuid4().hex}"
                out = store.open_output_stream(temporary)
            ids, counts = _with_end(*encoder.encode(batch.column("text").to_pylist()), end_id)
            held.append((batch.column("doc_id").to_pylist(), counts, ids))
            total += len(ids)
            if sum(len(i) for _, _, i in held) >= BLOCK_IDS:
                flush()
        if out is not None:
            flush()
            out.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name.rsplit("/", 1)[1]], "ids": pa.array([total], pa.int64())})

    return sorted(tuple(r) for r in ranged.mapInArrow(write, "part long, file string, ids long").collect())


def read_token_files(spark, path: str, files: list[tuple[int, str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    from pyarrow import fs

    starts, seen = [], 0
    for _, name, n in files:
        starts.append((name, seen))
        seen += n
    listed = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{where}/{name}") as stream:
                    for doc_ids, counts, ids in decode_blocks(stream):
                        edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + edges[:-1], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                        start += int(edges[-1])

    return listed.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token-id files and read them back, one row for each document.

    A null text counts as empty and has the end id only; null ids come first; repeated ids follow each other in the
    order of their texts; an empty table gives no file and no rows; other columns aren't read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = path or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, path, write_token_files(docs, path, tokenizer_json, end_id, id_col, text_col))
