"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming decoder.

``encode`` adds the token ids of every text, ``decode`` turns ids back into text.

Encoding.  A token sequence is the BPE encoding of its bytes exactly if each pair of neighbours is the
encoding of the bytes of that pair.  So the encodings of all prefixes of a byte string form a tree, and a
finite-state machine can follow it: a state is the set of tokens still being spelled (a trie node each), each
with the token before it.  A transition says which token ends at this byte in the encoding of what has been
read.  Tokens on which all the alternatives agree leave the machine; the alternatives reach back by no more
than the longest vocabulary entry.  States and transitions are made when first needed and dropped together
when there are too many of them.

Decoding.  Ids are gathered into bytes by table look-up; a UTF-8 state machine, lifted from bytes to whole
tokens, says where the last complete code point ends, so text can leave before the stream is over.

Edge cases: null text has no tokens, as has the empty text; null ids decode to the empty text; malformed
bytes decode to U+FFFD; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from querysieve.llm.common import id_and_text, only_one, slices

DECODE_CHUNK = 1 << 16
LOOKAHEAD = 512
MAX_STATES = 200_000
MAX_REMEMBERED = 150_000
NEVER = 1 << 60
ROWS = 500  # texts whose ids are held at once


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeTransducer:
    """Bytes of one pre-token in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.states, self.index = [start], {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # by state + byte; states count in steps of 256
        self.known: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes, down_to: int = 1) -> list[int]:
        """The definition: join the neighbouring parts of lowest rank until none joins (or few enough are left)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            joined = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == NEVER:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[int]:
        """The parts that stand at one end of the token while its merges run, first the byte, last the token."""
        parts = [token]
        while True:
            if parts[-1] not in self.halves:
                b = self.token_bytes[parts[-1]]
                self.halves[parts[-1]] = tuple(self.merge(b, 2)) if len(b) > 1 else None
            if (halves := self.halves[parts[-1]]) is None:
                return parts[::-1]
            parts.append(halves[side])

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes: no merge across the border comes before theirs."""
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            across = self.ranks.get(self.token_bytes[ends[i]] + self.token_bytes[starts[j]], NEVER)
            grow_left = ends[i + 1] if i + 1 < len(ends) else NEVER
            grow_right = starts[j + 1] if j + 1 < len(starts) else NEVER
            if across < grow_left and across <= grow_right and across != NEVER:
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and the token that ends here in the encoding of what has been read."""
        done, live = -1, []
        for node, before in self.states[state >> 8]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if done < 0 <= token:
                if before < 0:
                    done = token
                else:
                    ok = self.known.get((before, token))
                    if ok is None:
                        ok = self.known[before, token] = self.fits(before, token)
                    if ok:
                        done = token
            if self.children[nxt]:
                live.append((nxt, before))
        if done < 0:
            raise ValueError(f"the vocabulary has no token that reaches byte {byte}")
        key = (*live, (0, done))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states) << 8
            self.states.append(key)
        found = self.moves[state + byte] = to, done
        return found

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens that end at ``at``, in order."""
        out, length = [], self.token_bytes
        while at > 0:
            out.append(ends[at - 1])
            at -= len(length[ends[at - 1]])
        out.reverse()
        return out

    def _agreed(self, ends: list[int], state: int) -> list[int]:
        """The first tokens that all alternatives of the state share."""
        ways = [self._back(ends, len(ends) - self.depth[node]) for node, _ in self.states[state >> 8]]
        shortest = min(ways, key=len)
        n = next((k for k, token in enumerate(shortest) if any(w[k] != token for w in ways)), len(shortest))
        return shortest[:n]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens leave every ``LOOKAHEAD`` bytes, as far as they are settled, and at the end."""
        if len(self.states) > self.max_states:
            self._reset()
        state, out, ends, move_of = 0, [], [], self.moves.get
        for start in range(0, len(piece), LOOKAHEAD):
            if ends:
                agreed = self._agreed(ends, state)
                out += agreed
                del ends[: sum(len(self.token_bytes[t]) for t in agreed)]
            for byte in piece[start : start + LOOKAHEAD]:
                state, done = move_of(state + byte) or self._move(state, byte)
                ends.append(done)
        return out + self._back(ends, len(ends))


class TextEncoder:
    """Whole texts: pre-tokens by the pattern, each through the transducer; recent pre-tokens are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_remembered: int = MAX_REMEMBERED):
        self.split = regex.compile(pattern).findall
        self.machine = machine = MergeTransducer(ranks)
        older: dict[str, bytes] = {}

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                nonlocal older
                found = older.get(piece)
                if found is None:
                    found = np.array(machine.encode(piece.encode("utf-8", "replace")), "<u4").tobytes()
                if len(piece) < 64:
                    if len(self) >= max_remembered:
                        older = dict(self)
                        self.clear()
                    self[piece] = found
                return found

        self.pieces = Pieces()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), "<u4")


# States of the UTF-8 machine: complete, 1..3 continuation bytes to come, the four restricted second bytes, malformed.
COMPLETE, ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, MALFORMED = range(9)


def utf8_moves() -> np.ndarray:
    """(state, byte) -> state, from the ranges of well-formed UTF-8."""
    t = np.full((9, 256), MALFORMED, np.uint8)
    t[COMPLETE, 0x00:0x80] = COMPLETE
    t[COMPLETE, 0xC2:0xE0] = ONE
    t[COMPLETE, 0xE1:0xF0] = TWO
    t[COMPLETE, [0xE0, 0xED]] = AFTER_E0, AFTER_ED
    t[COMPLETE, 0xF1:0xF4] = THREE
    t[COMPLETE, [0xF0, 0xF4]] = AFTER_F0, AFTER_F4
    t[ONE, 0x80:0xC0], t[TWO, 0x80:0xC0], t[THREE, 0x80:0xC0] = COMPLETE, ONE, TWO
    t[AFTER_E0, 0xA0:0xC0], t[AFTER_ED, 0x80:0xA0] = ONE, ONE
    t[AFTER_F0, 0x90:0xC0], t[AFTER_F4, 0x80:0x90] = TWO, TWO
    return t


class DecodeTables:
    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, i in ranks.items():
            tokens[i] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.known = self.length > 0
        self.byte_moves = utf8_moves()
        # The byte machine lifted to tokens: one look-up a token.
        self.moves = np.repeat(np.arange(9, dtype=np.uint8)[:, None], size, axis=1)
        for at in range(int(self.length.max())):
            longer = np.flatnonzero(self.length > at)
            self.moves[:, longer] = self.byte_moves[self.moves[:, longer], self.blob[self.start[longer] + at]]
        self.neutral = self.moves[COMPLETE] == COMPLETE

    def gather(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id outside the vocabulary")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


class StreamingDecoder:
    """``feed`` takes ids as they come and returns the code points completed so far; ``finish`` the rest."""

    def __init__(self, tables: DecodeTables):
        self.tables, self.state, self.pending = tables, COMPLETE, b""

    def feed(self, ids: np.ndarray) -> str:
        t, state = self.tables, self.state
        data = self.pending + t.gather(ids)
        if state == COMPLETE:
            special = np.flatnonzero(~t.neutral[ids])
            at, moves, neutral = -1, t.moves, t.neutral
            for i in special.tolist():
                # A neutral token keeps the machine in COMPLETE and breaks any open code point.
                if state != COMPLETE and i != at + 1:
                    state = MALFORMED
                if state == MALFORMED:
                    break
                state, at = int(moves[state, ids[i]]), i
            if state != COMPLETE and state != MALFORMED and at != len(ids) - 1:
                state = MALFORMED
        else:
            for i in ids.tolist():
                state = int(t.moves[state, i])
        if state == MALFORMED:
            return self._repair(data)
        self.state = state
        done = len(data) - self._open_bytes(data, state)
        self.pending = data[done:]
        return data[:done].decode("utf-8")

    @staticmethod
    def _open_bytes(data: bytes, state: int) -> int:
        """Bytes of the code point that is still open."""
        if state == COMPLETE:
            return 0
        for n in range(1, 4):
            if data[-n] >= 0xC0:
                return n
        return 0

    def _repair(self, data: bytes) -> str:
        """Malformed input: walk the bytes, replace what can't be completed, keep an open end."""
        moves, out, start, state = self.tables.byte_moves, [], 0, COMPLETE
        at = 0
        while at < len(data):
            nxt = int(moves[state, data[at]])
            if nxt == MALFORMED:
                out.append("�")
                at += state == COMPLETE
                start, state = at, COMPLETE
                continue
            at, state = at + 1, nxt
            if state == COMPLETE:
                out.append(data[start:at].decode("utf-8"))
                start = at
        self.state, self.pending = state, data[start:]
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending, self.state = ("�" if self.pending else ""), b"", COMPLETE
        return rest


def _encoder(path: str, pattern: str) -> TextEncoder:
    return only_one(("bpe", path, pattern), lambda: TextEncoder(read_ranks(path), pattern))


@lru_cache(maxsize=4)
def _tables(path: str) -> DecodeTables:
    return DecodeTables(read_ranks(path))


def _texts(column: pa.Array) -> Iterator[str]:
    for b in column.cast(pa.binary()):
        yield "" if not b.is_valid else b.as_py().decode("utf-8", "replace")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, ids array<int>; one row per input row, no shuffle.

    The rank file is read once per Python worker; it must be at ``ranks_path`` on every node.
    """

    def run(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in slices(batches, ROWS):
            arrays = [encoder.ids(t) for t in _texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _id_lists(arrays)], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, "<u4")]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) -> doc_id, text; null ids give the empty text."""

    def run(batches):
        tables = _tables(ranks_path)
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                texts.append("".join(_stream(tables, np.array(ids.as_py() or [], np.int64))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _stream(tables: DecodeTables, ids: np.ndarray) -> Iterator[str]:
    decoder = StreamingDecoder(tables)
    for at in range(0, len(ids), DECODE_CHUNK):
        yield decoder.feed(ids[at : at + DECODE_CHUNK])
    yield decoder.finish()


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode, decode again and hash both: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    The same encoder and decoder as ``encode`` and ``decode``, in one pass so that ids never leave the worker.
    """

    def run(batches):
        encoder, tables = _encoder(ranks_path, pattern), _tables(ranks_path)
        decimal = np.array([str(i) for i in range(len(tables.length))], object)
        for batch in slices(batches, ROWS):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in _texts(batch["text"]):
                ids = encoder.ids(text)
                if with_ids:
                    all_ids.append(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(decimal[ids].tolist()).encode()).hexdigest())
                h = hashlib.sha256()
                for part in _stream(tables, ids):
                    h.update(part.encode())
                text_sha.append(h.hexdigest())
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [_id_lists(all_ids)] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
