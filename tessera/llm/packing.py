"""Packing by power-of-two decomposition: each document is cut into pieces of binary length, and a piece is a sequence."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import portions, tokenizer

# Fixed value: how byte-level BPE splits a text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything but ASCII text and Latin letters.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\u00c0-\u024f]")


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """A byte-level BPE tokenizer file's ids of whole texts, as little-endian unsigned 32-bit integers.

    The file is read by tokenizers. Texts of ASCII and Latin letters without a special token's string are encoded by
    tiktoken with the file's own vocabulary, at four times the speed; all others by tokenizers itself, which may know other
    classes of rare characters. Both give the same ids for the former (the tests compare them).
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.tok = tokenizer(path)
        added = self.tok.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        byte = byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tok.get_vocab(with_added_tokens=True).items() if i not in added}
        self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """Loaded once a Python worker."""
    return Encoder(path)


def binary_pieces(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many tokens: the longest power while it fits, then one for each bit left."""
    full, rest = divmod(tokens, longest)
    out = [(i * longest, longest) for i in range(full)]
    start, size = full * longest, longest >> 1
    while rest:
        if rest >= size:
            out.append((start, size))
            start, rest = start + size, rest - size
        size >>= 1
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece int"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, longest: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for part in portions(batch, "text", 4 << 20):
            doc, start, length, crc, total, piece, ids = [], [], [], [], [], [], []
            for doc_id, raw in zip(part.column(0).to_pylist(), (enc.encode(x or "") for x in part.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for k, (at, size) in enumerate(binary_pieces(n, longest)):
                    own = raw[4 * at : 4 * (at + size)]
                    doc.append(doc_id)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own))
                    total.append(n)
                    piece.append(k)
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            kind = pa.int64()
            columns = [pa.array(doc, kind), pa.array(start, kind), pa.array(length, kind), pa.array(crc, kind), pa.array(total, kind), pa.array(piece, pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of whole documents: doc_id, start, length, ids_crc32, doc_tokens, piece, sequence_id, offset (and ids).

    A document is its tokens, then end_id; a null or empty text is that one token. Every id lies in one piece, every
    piece's length is a power of two up to longest (itself a power of two), and each piece is a sequence of its own:
    offset 0, no padding, no sequence with parts of two documents. Sequences of equal length form a bucket, named by
    the column length; a batch draws from one bucket. sequence_id is a long unique in one result; its upper bits are
    the scan's partition. Repeated rows give repeated pieces in sequences of their own. A null doc_id stays null.
    Nothing is shuffled, and memory follows a few MB of text at a time, or the longest document.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(partial(_pieces, path=tokenizer_path, longest=longest, end_id=end_id, with_ids=with_ids), SCHEMA + ", ids array<int>" * with_ids)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
