"""Byte-level BPE encoding and decoding.

Encoding runs a finite-state transducer over the bytes of each piece of text. The transducer is nondeterministic in where
the current token began; it is determinised lazily, each way on from a state when it is first needed, and a token is put out
as soon as every way to go on agrees on it, which happens after a bounded lookahead (no longer than the longest token). States
are kept in a bounded table that is emptied when full, as lazy regex automata do.

What makes the state small: the last token of the encoding of a prefix is the one vocabulary token that ends there and
fits the last token of the encoding before it; two tokens fit if encoding their bytes together gives these two again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

#: How many pieces and states one Python worker keeps; both tables are dropped or halved when full.
MAX_PIECES, MAX_STATES, MAX_PAIRS = 500_000, 400_000, 1_000_000
#: The letters and numbers below U+0180, for texts that have no other characters (fixed by Unicode).
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"


def read_ranks(path: str) -> bytes:
    """The rank file's content: a line has a token in base64 and its rank. A vocabulary is fixed, so this can be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


class Splitter:
    """All matches of the pattern, as the `regex` module finds them; Latin texts go through the quicker `re`."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern).findall
        self.latin = None
        bare = re.sub(r"\\p\{[LN]\}", "", pattern)
        if r"\p" not in bare:  # only letter and number classes need spelling out
            inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", LATIN_LETTERS).replace(r"\p{N}", LATIN_NUMBERS), pattern)
            spelt = inside.replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]")
            self.latin = re.compile(spelt.replace(r"\s", r"[\t-\r \x85\xa0]").replace(r"[^[\t-\r \x85\xa0]", r"[^\t-\r \x85\xa0").replace(r"\S", r"[^\t-\r \x85\xa0]")).findall
        self.beyond = re.compile("[^\x00-\u017f]").search

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.latin is None or self.beyond(text) else self.latin(text)


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.child: list[dict[int, int] | None] = [{}]  # by trie node; None: no longer token goes on from here
        self.token = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                kids = self.child[node]
                if kids is None:
                    kids = self.child[node] = {}
                if b not in kids:
                    kids[b] = len(self.child)
                    self.child.append(None)
                    self.token.append(-1)
                node = kids[b]
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """The start state alone. A state: its ways on by byte, and its hypotheses."""
        self.states: dict[tuple, tuple[dict, tuple]] = {}
        self.start = self.state(((0, (-1,)),))

    def state(self, key: tuple) -> tuple[dict, tuple]:
        """key: for each place where a token may have begun, latest last, the trie node since and the tokens before, of
        which the first was put out already. If the piece ends here, the last one's tokens remain to be put out."""
        if (found := self.states.get(key)) is None:
            found = self.states[key] = ({}, key)
        return found

    def fit(self, left: int, right: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        b = self.bytes_of[right]
        known = self.merged(b) == [b] if left < 0 else self.fit(-1, right) and self.merged(self.bytes_of[left] + b) == [self.bytes_of[left], b]
        self.pairs[left << 32 | right] = known
        return known

    def merged(self, word: bytes) -> list[bytes]:
        """The plain definition: merge the adjacent parts whose union has the lowest rank until none has one."""
        rank, none = self.ranks.get, 1 << 40
        parts = [word[i : i + 1] for i in range(len(word))]
        of = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
        while of and (best := min(of)) < none:
            at = of.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at:
                of[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(of):
                of[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def step(self, state: tuple[dict, tuple], byte: int) -> tuple[tuple[dict, tuple], tuple[int, ...]]:
        """The next state and what is put out on the way."""
        live, ended = [], None
        child, token, pairs = self.child, self.token, self.pairs
        for node, before in state[1]:
            kids = child[node]
            if byte not in kids:
                continue
            after = kids[byte]
            if child[after] is not None:
                live.append((after, before))
            if ended is None and (t := token[after]) >= 0:
                known = pairs.get(before[-1] << 32 | t)
                if self.fit(before[-1], t) if known is None else known:
                    ended = (*before, t)
        live.append((0, ended))
        sure = 1  # tokens that all hypotheses share; the last is never put out, what comes next must fit it
        while sure < min(len(before) for _, before in live) and all(before[sure] == ended[sure] for _, before in live):
            sure += 1
        if sure > 1:
            live = [(node, before[sure - 1 :]) for node, before in live]
        if len(self.states) >= MAX_STATES:
            self.reset()
        way = state[0][byte] = self.state(tuple(live)), ended[1:sure]
        return way

    def __call__(self, word: bytes) -> bytes:
        """The ids of a piece, as little-endian unsigned 32-bit integers."""
        state, out = self.start, []
        for b in word:
            state, put = state[0].get(b) or self.step(state, b)
            if put:
                out += put
        out += state[1][-1][1][1:]
        return struct.pack(f"<{len(out)}I", *out)


class Codec:
    """Whole texts to ids and back; pieces seen lately are kept, in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.encode_piece = Splitter(pattern), Transducer(ranks)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words = [self.encode_piece.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def piece(self, p: str) -> bytes:
        if len(self.young) >= MAX_PIECES:
            self.old, self.young = self.young, {}
        got = self.old.get(p)
        self.young[p] = got = self.encode_piece(p.encode()) if got is None else got
        return got

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        young = self.young
        got = list(map(young.get, pieces))
        if None in got:
            got = [self.piece(p) if g is None else g for p, g in zip(pieces, got, strict=True)]
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Utf8Stream:
    """Incremental UTF-8: bytes in any cuts, characters out as soon as they are whole. The state is the bytes of the
    character that has begun and how many are to come."""

    #: Bytes that a leading byte asks for; 0: not a leading byte (fixed by UTF-8).
    MORE = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            more = self.MORE[data[-back]]
            if more or data[-back] < 0x80:
                cut -= back if more >= back else 0
                break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


def decode_stream(codec: Codec, chunks: Iterable[bytes]) -> Iterator[str]:
    """Text for chunks of ids, in the order in which they come."""
    stream = Utf8Stream()
    for ids in chunks:
        if text := stream.feed(codec.decode(ids)):
            yield text
    if text := stream.end():
        yield text


_codecs: dict[int, Codec] = {}


def codec_for(content: bytes, pattern: str) -> Codec:
    """One per Python worker and vocabulary."""
    key = hash((content, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(content), pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens): ids as little-endian unsigned 32-bit integers. A null or empty text has none; ids of
    documents may be null or repeated, each row is encoded by itself. No rows in, no rows out."""
    text_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = codec_for(kept.value, pattern)
        for b in batches:
            ids = [codec.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, step: int = 65_536) -> DataFrame:
    """(doc_id, text) for (doc_id, ids); streams each document by `step` ids. Null ids give a null text, unknown ids nothing."""
    kept = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = codec_for(kept.value, pattern)
        for b in batches:
            texts = [None if x is None else "".join(decode_stream(codec, (x[i : i + 4 * step] for i in range(0, len(x), 4 * step)))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, ranks_path: str, pattern: str, step: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) with ids and decoded bytes never leaving the task that makes them.

    A null text counts as empty: no ids, the digests of nothing. Each row is encoded by itself, so repeated ids and texts are
    rows of their own. No rows in, no rows out."""
    text_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = codec_for(kept.value, pattern)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t) if t else b""
                back = hashlib.sha256()
                for text in decode_stream(codec, (ids[i : i + 4 * step] for i in range(0, len(ids), 4 * step))):
                    back.update(text.encode())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
