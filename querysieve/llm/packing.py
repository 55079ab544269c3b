"""Token packing: best-fit-decreasing with a segment tree over free capacities.

Documents become id sequences; those longer than a training sequence are split without loss; the pieces are packed
into sequences of exactly ``length`` ids.  A packed row holds the ids (one row of the id matrix, padded at the end),
the position of every id within its own piece (it restarts at each), and the cumulative piece lengths that attention
kernels for variable lengths expect.

Best fit decreasing: pieces go by falling size, each into the open sequence with the least room that still holds
it.  Rooms are counted in a segment tree over 0..length, so the search takes log(length) steps however many
sequences are open.

Scale: pieces are dealt to shards by a hash of what they are (doc_id, text and start) and of which of the equal rows of its
input partition theirs is, and each shard is packed by itself.  The number of shards follows the bytes of text, so a shard
has a bounded size whatever the ids and however often a text is repeated; a document of any length is spread over many.
The order of rows within a partition doesn't matter, so a task that is run again after an executor is lost deals the same
pieces to the same shards.

Edge cases: null and empty texts have no ids and appear in no sequence; a null doc_id is carried as null; rows that
repeat a doc_id are packed as often as they occur; of equal sizes the smaller (doc_id, start, ids) goes first, and of
sequences with equal room the one opened first is taken.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import as_bytes, id_and_text, slices

LENGTH = 2048
SHARD_BYTES = 16 << 20  # of text


class RoomTree:
    """How many open sequences have each amount of room; finds the least room of at least n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open: list[list[int]] = [[] for _ in range(most + 1)]
        self.any = [False] * (2 * self.size)

    def add(self, room: int, sequence: int) -> None:
        heappush(self.open[room], sequence)
        at = self.size + room
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least n, of those the first sequence; it is no longer open."""
        at = self.size + n
        if not self.any[at]:
            # Up until a right neighbour has something, then down to its leftmost leaf.
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        sequence = heappop(self.open[room])
        if not self.open[room]:
            self.any[at] = False
            at >>= 1
            while at:
                self.any[at] = self.any[2 * at] or self.any[2 * at + 1]
                at >>= 1
        return room, sequence


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers; ``sizes`` (1..length) must come in falling order."""
    tree, sequences = RoomTree(length), []
    for k, n in enumerate(sizes):
        found = tree.take(n)
        room, at = found if found else (length, len(sequences))
        if found:
            sequences[at].append(k)
        else:
            sequences.append([k])
        if room > n:
            tree.add(room - n, at)
    return sequences


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, place, start, n, ids (binary, 16-bit little-endian): at most ``length`` ids each.

    ``place`` tells rows apart: a hash of doc_id, text, input partition and how many equal rows came before in it.
    """
    if _tokenizer(ranks_path, pattern).max_token_value >= 1 << 16:
        raise ValueError("ids over 65,535 don't fit 16 bits")

    def run(batches):
        encode, partition = _tokenizer(ranks_path, pattern).encode_to_numpy, TaskContext.get().partitionId()
        seen: dict[bytes, int] = {}
        for batch in slices(batches, 2000):
            rows, start, ids, places = [], [], [], []
            for row, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]))):
                who = xxhash.xxh3_128_digest(b"%s:%s" % (str(doc_id).encode(), text))
                seen[who] = times = seen.get(who, -1) + 1
                places.append(xxhash.xxh64_intdigest(b"%s:%d:%d" % (who, partition, times)) >> 1)
                own = encode(text.decode("utf-8", "replace"), disallowed_special=()).astype("<u2")
                for at in range(0, len(own), length):
                    rows.append(row)
                    start.append(at)
                    ids.append(own[at : at + length].tobytes())
            at = np.array(rows, np.int64)
            columns = [batch["doc_id"].take(pa.array(at)), pa.array(np.array(places, np.int64)[at]), pa.array(start, pa.int64()), pa.array([len(b) // 2 for b in ids], pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "start", "n", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, place long, start long, n int, ids binary")


PACKED = (
    "shard int, sequence int, n_tokens int, n_pieces int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, input_ids binary, position_ids binary"
)


def pack(cut_pieces: DataFrame, shards: int, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``pieces`` -> one row per sequence (``PACKED``); ids and positions are 16-bit little-endian, ``length`` each."""

    def one(group: pa.Table) -> pa.RecordBatch:
        n = group["n"].to_numpy()
        doc, start = group["doc_id"].fill_null(-(1 << 63)).to_numpy(), group["start"].to_numpy()
        doc_ids, starts, ids = (group[c].to_pylist() for c in ("doc_id", "start", "ids"))
        order = np.array(sorted(range(len(ids)), key=lambda k: (-n[k], doc[k], start[k], ids[k])), np.int64)
        sequences = best_fit_decreasing(n[order].tolist(), length)
        columns: list[list] = [[] for _ in range(7)]
        for sequence in sequences:
            rows = order[sequence].tolist()
            ends = np.concatenate(([0], np.cumsum(n[rows])))
            total = int(ends[-1])
            positions = np.zeros(length, "<u2")
            positions[:total] = np.arange(total) - np.repeat(ends[:-1], n[rows])
            matrix_row = b"".join(ids[r] for r in rows) + np.full(length - total, pad_id, "<u2").tobytes()
            for column, value in zip(columns, (total, len(rows), [doc_ids[r] for r in rows], [starts[r] for r in rows], ends.tolist(), matrix_row, positions.tobytes())):
                column.append(value)
        k = len(sequences)
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, group["shard"][0].as_py(), np.int32)), pa.array(np.arange(k, dtype=np.int32)), *(pa.array(c, t) for c, t in zip(columns, types))],
            ["shard", "sequence", "n_tokens", "n_pieces", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"],
        )

    def run(batches):
        rows = list(batches)  # one shard, or a few small ones
        if sum(b.num_rows for b in rows):
            table = pa.Table.from_batches(rows)
            for k in pc.unique(table["shard"]).to_pylist():
                yield one(table.filter(pc.equal(table["shard"], k)))

    shard = F.pmod(F.xxhash64("place", "start", "doc_id"), F.lit(shards)).cast("int")
    return cut_pieces.withColumn("shard", shard).drop("place").repartitionById(shards, "shard").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Tokenise, split and pack; ids must fit 16 bits."""
    if not 0 < length <= 1 << 16:
        raise ValueError("positions are 16-bit")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return pack(pieces(docs, ranks_path, pattern, length), max(1, math.ceil(size / shard_bytes)), length)


def write(packed: DataFrame, path: str) -> None:
    """One Parquet dataset; a shard's rows in order of ``sequence`` are its id matrix."""
    packed.sortWithinPartitions("shard", "sequence").write.mode("errorifexists").parquet(path)
