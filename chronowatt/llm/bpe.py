"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

A sequence of tokens is the one that merging by rank gives exactly if each two neighbours are: merging the
bytes of the two alone gives back the two. So the text is covered from the left by the longest token,
shorter ones are tried where a neighbour does not fit, and a place from which no fitting cover starts is
marked and never tried again, which keeps the number of steps linear. The matches come from an
Aho-Corasick automaton over the tokens, with bytes read as Latin-1 characters; whether two tokens fit is
remembered.

Each match of the pattern is encoded by itself. Between a character that is no white space and a space
the pattern always ends a match, so texts are cut there first, and cut pieces met before are looked up.
All that is remembered is bounded and never changes a result. Null texts count as empty: no tokens. A text of any length
is encoded in one piece, in linear time. Repeated rows each have their result, an empty table gives none. Columns to
``keep`` may not have the name of a result column.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import share, table

REMEMBERED = 300_000
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token in a rank file (base64 token, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        lengths = {}
        # what a token's last merge joins, for tokens that merging reaches
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            parts = self.last_two(token) if len(token) > 1 else None
            if len(token) == 1 or parts is not None:
                self.automaton.add_word(token.decode("latin-1"), rank)
                lengths[rank] = len(token)
            if parts is not None:
                self.halves[rank] = parts
        self.automaton.make_automaton()
        self.lengths = lengths
        # tokens whose parts all come earlier than themselves, as in every trained vocabulary
        self.rising = {rank for rank in lengths if self._rises(rank)}
        self.edges: dict[tuple[int, int], list[int]] = {}
        self.shorter = {rank: self._shorter(self.bytes_of[rank]) for rank in lengths}

    def _shorter(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix of this one."""
        for end in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:end])
            if rank is not None and (end == 1 or rank in self.lengths):
                return rank
        return None

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step: what defines the encoding. Used on two tokens at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((p for p in pairs if p[0] is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def last_two(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that a token's bytes are merged into last; None if merging does not come so far."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not pairs:
                return None
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _rises(self, rank: int) -> bool:
        open_ = [rank]
        while open_:
            at = open_.pop()
            for part in self.halves.get(at, ()):
                if part in self.halves:
                    if part >= at:
                        return False
                    open_.append(part)
        return True

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at the left (0) or right (1) edge of a token while it is merged, from its byte on."""
        found = self.edges.get((token, side))
        if found is None:
            found = [token]
            while found[-1] in self.halves:
                found.append(self.halves[found[-1]][side])
            found.reverse()
            self.edges[(token, side)] = found
        return found

    def fit(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            found = self.fits[key] = self._fit(left, right)
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives back both. Only what stands on either side of their border can join
        over it: the two edges grow in the order of the ranks, and at each step what stands there must not be merged before
        one of them grows."""
        if left not in self.rising or right not in self.rising:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a, b, of, ranks = self.edge(left, 1), self.edge(right, 0), self.bytes_of, self.ranks
        i = j = 0
        last_i, last_j = len(a) - 1, len(b) - 1
        while True:
            joined = ranks.get(of[a[i]] + of[b[j]])
            grows_a = a[i + 1] if i < last_i else _NEVER
            grows_b = b[j + 1] if j < last_j else _NEVER
            # of equal ranks the one further left is merged first
            if joined is not None and joined < grows_a and joined <= grows_b:
                return False
            if i == last_i and j == last_j:
                return True
            if grows_a <= grows_b:
                i += 1
            else:
                j += 1

    def longest(self, data: bytes) -> list[int]:
        """The longest token from each place on."""
        found = [-1] * len(data)
        reach = [0] * len(data)
        lengths = self.lengths
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - lengths[rank]
            if end >= reach[start]:
                reach[start], found[start] = end, rank
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and whole in self.lengths:
            return [whole]
        longest, lengths = self.longest(data), self.lengths
        open_ = bytearray(b"\x01") * (len(data) + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if open_[end] and (not tokens or self.fit(tokens[-1], token)):
                tokens.append(token)
                if end == len(data):
                    return tokens
                at, token = end, longest[end]
                continue
            less = self.shorter[token]
            while less is None:
                # nothing fits from here after what stands before: give up this place, shorten what led to it
                open_[at] = 0
                token = tokens.pop()
                at -= lengths[token]
                less = self.shorter[token]
            token = less

    def _packed(self, piece: str) -> bytes:
        out: list[bytes] = []
        pieces = self.pieces
        for match in self.pattern.findall(piece):
            found = pieces.get(match)
            if found is None:
                ids = self.encode_bytes(match.encode())
                found = pack(f"<{len(ids)}I", *ids)
                # the whole piece is remembered by those who ask for it
                if len(match) <= 64 and match != piece:
                    if len(pieces) >= REMEMBERED:
                        pieces.clear()
                    pieces[match] = found
            out.append(found)
        return b"".join(out)

    def _recall(self, memory: dict[str, bytes], key: str, piece: str) -> bytes:
        found = self._packed(piece)
        if len(key) <= 64:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[key] = found
        return found

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, one after the other."""
        if not text:
            return b""
        parts = text.split(" ")
        # most texts are made of pieces met before, or nearly
        found = list(map(self.after_space.get, parts[1:]))
        first = self.known.get(parts[0])
        if first is None and parts[0] and not parts[0][-1].isspace():
            first = self._recall(self.known, parts[0], parts[0])
        if first is not None and None in found:
            found = [f or (self.after_space.get(p) or self._recall(self.after_space, p, f" {p}") if p and not p[-1].isspace() else None) for f, p in zip(found, parts[1:])]
        if first is not None and None not in found:
            return first + b"".join(found)
        out: list[bytes] = []
        # a piece that is empty or ends in white space runs on into the next one
        first, rest = parts[0], parts[1:]
        pending = first if not first or first[-1].isspace() else None
        if pending is None:
            out.append(self.known.get(first) or self._recall(self.known, first, first))
        memory, recall = self.after_space, self._recall
        for part in rest:
            if pending is not None:
                pending = f"{pending} {part}"
                if part and not part[-1].isspace():
                    out.append(self._packed(pending))
                    pending = None
                continue
            found = memory.get(part)
            if found is None:
                if not part or part[-1].isspace():
                    pending = f" {part}"
                    continue
                found = recall(memory, part, f" {part}")
            out.append(found)
        if pending:
            out.append(self._packed(pending))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The columns ``keep`` of docs, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` also the packed
    ids. The rank file is read once, on the driver; the ranks (of fixed size) are broadcast."""
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(keep):
        raise ValueError(f"columns to keep are also result columns: {sorted(clash)}")
    shared = share(docs.sparkSession, read_ranks(ranks_path))
    codecs: list[Codec] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not codecs:
            codecs.append(Codec(shared.value, pattern))
        codec = codecs[0]
        for b in batches:
            packed = [codec.encode_packed(t) for t in b["text"]]
            out = b[list(keep)].copy()
            out["n_tokens"] = np.array([len(p) // 4 for p in packed], np.int64)
            out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
            out["decoded_sha256"] = [hashlib.sha256(codec.decode_packed(p)).hexdigest() for p in packed]
            if ids:
                out["ids"] = packed
            yield out

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInPandas(run, schema + ", ids binary" * ids)


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
