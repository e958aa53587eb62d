"""Byte-level BPE, encoding and decoding, in linear time.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over all tokens finds every token inside a
piece of text.  A piece is encoded from left to right with the longest token first; a token may follow another only if
the merges leave the two as they are (adjacent tokens of an exact encoding always have this property, and it suffices).
Where no token fits, the last one is taken back and its place is marked as a dead end, so no place is tried twice.  The
answers for pairs of tokens are remembered.

Nulls are encoded as the empty text: no ids.  Rows are independent of each other; repeated rows and ids give repeated
rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: White space as the reference library's regular expressions define it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the ``regex`` module takes for letters or numbers, and the reference library, whose
#: Unicode is a version older, does not.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: What a process remembers at most, about 400 MB in all, since nothing long is kept.
CHUNKS_KEPT, PIECES_KEPT, PAIRS_KEPT = 1_200_000, 300_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain byte pair encoding: the pair of lowest rank is merged first, the leftmost of equals.  Quadratic."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        best = min((rank for rank in found if rank is not None), default=None)
        if best is None:
            break
        at = found.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[part] for part in parts]


class BytePairs:
    """Encoder and decoder for a table of ranks and a pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        inside = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")
        self.split = regex.compile(inside).findall
        newer = "[" + "".join("-".join(f"\\U{int(end, 16):08x}" for end in r.split("-")) for r in NEWER.split()) + "]"
        self.has_newer = re.compile(newer).search
        without = re.sub(r"\\p\{\w+\}", lambda found: f"[{found[0]}--{newer}]", inside)
        self.split_newer = regex.compile(without, regex.VERSION1).findall
        # White space with what follows it up to the next: no piece crosses such a border.  The first form is quicker
        # and right for texts without other white space than blanks and line feeds.
        self.chunks = re.compile("[ \n]*[^ \n]+|[ \n]+").findall
        self.any_chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.other_white = re.compile(f"[\t\x0b-\r{WHITE[4:]}]").search
        self.reached: dict[int, bool] = {}
        self.stays = C.Bounded(self._stays, PAIRS_KEPT)
        self.pieces = C.Bounded(self.encode_piece, PIECES_KEPT)
        self.known = C.Bounded(self._chunk, CHUNKS_KEPT)
        self.kind = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        width = len(str(max(ranks.values()))) + 1
        written = b"".join(f"{rank},".encode().ljust(width, b"\0") for rank in range(max(ranks.values()) + 1))
        self.digits = np.frombuffer(written, np.uint8).reshape(-1, width)

    def _stays(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        return merged(self.token[left] + self.token[right], self.ranks) == [left, right]

    def _reached(self, token: int) -> bool:
        """Whether merges make this token of its own bytes."""
        found = self.reached.get(token)
        if found is None:
            found = self.reached[token] = merged(self.token[token], self.ranks) == [token]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starting: list[list] = [[] for _ in piece]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - found[1]].append(found)  # (token, length), shorter tokens first
        left = [len(tokens) for tokens in starting]
        chosen: list[tuple[int, int]] = []
        at, last, stays = 0, None, self.stays
        while at < len(piece):
            tokens = starting[at]
            while left[at]:
                left[at] -= 1
                token, length = tokens[left[at]]
                fits = stays[last, token] if last is not None else length == 1 or self._reached(token)
                if fits and (at + length == len(piece) or left[at + length]):
                    chosen.append((token, length))
                    at, last = at + length, token
                    break
            else:
                if not chosen:
                    raise ValueError("a byte is missing from the ranks")
                at -= chosen.pop()[1]
                last = chosen[-1][0] if chosen else None
        return [token for token, _ in chosen]

    def _chunk(self, chunk: str) -> bytes:
        split = self.split if chunk.isascii() or not self.has_newer(chunk) else self.split_newer
        ids = list(chain.from_iterable(self.pieces[p.encode()] for p in split(chunk)))
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.kind)
        chunks = self.any_chunks(text) if self.other_white(text) else self.chunks(text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), self.kind)

    def shown(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        digits = self.digits[ids]
        return digits[digits > 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def _coder(shared) -> BytePairs:
    ranks, pattern, digest = shared.value
    return C.per_process(("byte pairs", digest, pattern), lambda: BytePairs(ranks, pattern))


def _share(spark: SparkSession, path: str, pattern: str):
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).digest()
    return spark.sparkContext.broadcast((read_ranks(path), pattern, digest))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """Per document: ``id_col``, n_tokens (long), ids_sha256, decoded_sha256 of the decoded ids, and ids (array of int).

    ``ids=False`` leaves the ids out where only their number and digests are asked for.
    """
    shared = _share(docs.sparkSession, ranks_path, pattern)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def encode(batches):
        import pyarrow as pa

        coder = _coder(shared)
        for batch in batches:
            counts, shown_digests, decoded_digests, all_ids = [], [], [], []
            for text in batch.column(1):
                found = coder.encode(text.as_py())
                counts.append(len(found))
                shown_digests.append(hashlib.sha256(coder.shown(found)).hexdigest())
                decoded_digests.append(hashlib.sha256(coder.decode(found)).hexdigest())
                if ids:
                    all_ids.append(found.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shown_digests), pa.array(decoded_digests)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(encode, schema + (", ids array<int>" if ids else ""))


def decode_documents(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Per row of (``id_col``, ids): the decoded bytes, null where ids is null."""
    shared = _share(tokens.sparkSession, ranks_path, pattern)
    kind = tokens.schema[id_col].dataType.simpleString()

    def decode(batches):
        import pyarrow as pa

        coder = _coder(shared)
        for batch in batches:
            decoded = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], [id_col, "decoded"])

    return tokens.select(id_col, F.col("ids")).mapInArrow(decode, f"`{id_col}` {kind}, decoded binary")
