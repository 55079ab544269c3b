import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from querysieve.llm import packing
from querysieve.llm.bpe import read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    """The very sequences: least room that holds the piece, and of equal rooms the sequence opened first."""
    draw = random.Random(seed)
    length = draw.choice([7, 16, 30])
    sizes = sorted((draw.randint(1, length) for _ in range(draw.randint(0, 60))), reverse=True)
    sequences = []
    for k, n in enumerate(sizes):
        rooms = [(length - sum(sizes[j] for j in s), at) for at, s in enumerate(sequences)]
        fits = [r for r in rooms if r[0] >= n]
        if fits:
            sequences[min(fits)[1]].append(k)
        else:
            sequences.append([k])
    assert packing.best_fit_decreasing(sizes, length) == sequences


def test_equal_rows_are_spread(spark):
    """Rows without an id, all of one text, still fill all shards."""
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "'the same words again and again' text")
    packed = packing.pack(packing.pieces(docs, PATH, P.PATTERN, 64), 25, 64)
    counts = {r["shard"]: r["n"] for r in packed.selectExpr("shard", "n_pieces").groupBy("shard").sum("n_pieces").withColumnRenamed("sum(n_pieces)", "n").collect()}
    assert len(counts) == 25 and max(counts.values()) < 300 and sum(counts.values()) == 4000


def test_order_of_rows_does_not_matter(spark, make, tmp_path):
    """A task that reads its rows in another order deals and packs alike; other ids than 16-bit ones are refused."""
    rows = make(7) + make(7)[:20] + [(None, "the same words")] * 5
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = lambda docs: sorted(map(repr, packing.pack(packing.pieces(docs, PATH, P.PATTERN, 64), 7, 64).collect()))
    assert packed(plain) == packed(plain.sortWithinPartitions("text")) == packed(plain.sortWithinPartitions(F.desc("doc_id")))
    with pytest.raises(ValueError, match="16 bits"):
        large = [(bytes([b]), b) for b in range(256)] + [(b"ab", 70_000)]
        (tmp_path / "large").write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in large))
        packing.pieces(plain, str(tmp_path / "large"), P.PATTERN)


def unpacked(rows, length):
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
        assert not positions[r.n_tokens :].any()
    return parts


@pytest.mark.parametrize("length, shard_bytes", [(64, 2000), (2048, 1 << 24)])
def test_lossless(spark, make, length, shard_bytes):
    rows = make(3)
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, length, shard_bytes).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    parts = unpacked(got, length)
    for i, text in rows:
        assert [x for _, ids in sorted(parts.get(i, [])) for x in ids] == library.encode_ordinary(text)


def test_odd_documents(spark, odd, none, tmp_path):
    packed = packing.pack_documents(odd, PATH, P.PATTERN, 128)
    parts = unpacked(packed.collect(), 128)
    assert {1, 2}.isdisjoint(parts) and None in parts and len(parts[4]) == 3
    packing.write(packed, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packed.count()
    assert packing.pack_documents(none, PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, PATH, P.PATTERN, 1 << 17)


def test_whole_rows_by_definition(spark, make):
    """Every column of every sequence: pieces in order of size, doc_id, start and ids, each into the least room, ties to the first."""
    length, shards = 32, 4
    rows = make(11) + make(11)[:15] + [(None, "the same words"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    cut = packing.pieces(docs, PATH, P.PATTERN, length)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("place", "start", "doc_id"), F.lit(shards))).collect()
    want = []
    for shard in range(shards):
        own = sorted((r for r in dealt if r.shard == shard), key=lambda r: (-r.n, -(1 << 63) if r.doc_id is None else r.doc_id, r.start, bytes(r.ids)))
        sequences = []
        for r in own:
            fits = [(length - sum(x.n for x in s), k) for k, s in enumerate(sequences) if sum(x.n for x in s) + r.n <= length]
            sequences[min(fits)[1]].append(r) if fits else sequences.append([r])
        for k, s in enumerate(sequences):
            ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u2") for r in s])
            ends = [0, *np.cumsum([r.n for r in s]).tolist()]
            padded = np.zeros(length, "<u2")
            padded[: len(ids)] = ids
            positions = np.zeros(length, "<u2")
            positions[: len(ids)] = np.concatenate([np.arange(r.n) for r in s])
            want.append((shard, k, len(ids), len(s), [r.doc_id for r in s], [r.start for r in s], ends, padded.tobytes(), positions.tobytes()))
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in packing.pack(cut, shards, length).collect()]
    assert sorted(got, key=lambda r: r[:2]) == want
