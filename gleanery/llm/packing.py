"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows, sliced, staged, text_or_empty

#: Pieces that one task packs together; each group wastes about one sequence.
GROUP_PIECES = 16384
SLICE = 1000  # texts worked on at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizers library.

    The ``.tiktoken`` file beside the ``.json`` one holds the same vocabulary and
    gives the same ids faster; texts with the special token's string, which
    only the ``.json`` file knows, go to the tokenizers library.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if path.endswith("byte_bpe_50k.json"):
            with open(path[: -len("json")] + "tiktoken", "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but, if need be, the first."""
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it starts in its document's ids, its length and a CRC of its ids.

    A null text is an empty one: a single piece with the end id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(tokenizer or default_tokenizer())
        for part in sliced(batches, SLICE):
            rows = []
            for doc, text in zip(part["doc_id"], part["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by the sum-of-squares rule.

    Pieces come longest first.  Each goes to the open bin for which the sum of
    squares of N(g), the number of open bins with gap g, becomes smallest (the
    smaller gap wins a tie); a new bin is opened only if none has room.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        gaps = np.flatnonzero(count[size:capacity])
        if len(gaps):
            change = 2 * (count[gaps] - count[gaps + size]) + 2
            if gaps[0] == 0:
                change[0] = 1 - 2 * count[size]  # a bin that becomes full leaves the sum
            rest = int(gaps[np.argmin(change)])
            gap = rest + size
            which = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, rest, which = capacity, capacity - size, made
            made += 1
        bins[i], offsets[i] = which, capacity - gap
        if rest:
            count[rest] += 1
            open_bins[rest].append(which)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Full
    pieces are sequences by themselves.  The others are dealt by row number into
    groups of about ``group_pieces``, whatever keys they share, and each group
    is packed by itself, so no task holds more than a bounded number of lengths;
    texts and ids are never shuffled.

    Null or repeated doc_ids and equal texts are packed row by row.  An empty
    table gives an empty result.
    """
    pieces = staged(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    part = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    row = F.monotonically_increasing_id()  # of written files: the same whenever a task runs again
    full = pieces.filter(F.col("length") >= capacity).select("*", (-row - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable").drop(columns=["row"])
        bins, offsets = place(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["packing_group"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = part.withColumns({"row": row, "doc_id": F.col("doc_id").cast("string")}).withColumn("packing_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("packing_group").applyInPandas(run, PACKED.replace("doc_id long", "doc_id string"))
    return full.unionByName(packed.withColumn("doc_id", F.col("doc_id").cast("long")))
