"""Token ids of the tokenizers library for whole texts, by chunks between white space.

A tokenizer file whose pre-tokenizer drops white space gives a text the ids of its chunks, one after the other: no token,
normalisation or special string reaches across a blank.  So each distinct chunk is encoded by the library once per
process and remembered.  Files of another kind are refused by ``chunked``; their texts are encoded whole.

Where the file also cuts chunks by ``WORD_PATTERN`` and lower-cases them (``pieced``), new chunks of ASCII and Latin-1 are
cut in the same way first, since far fewer pieces than chunks are distinct; the library encodes the new pieces, many to a
call, told apart by the suffix that ends a word's last token.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import SparkSession

from . import common as C

#: Chunks that a process remembers at most, about 250 MB, since no long one is kept.
CHUNKS_KEPT = 1_000_000
#: Pieces of chunks that a process remembers at most, about 100 MB.
PIECES_KEPT = 500_000
#: Pieces in a text that the library encodes at once.
JOINED = 100
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters that are in normal form, have one of these in lower case, and are no white space, and the pattern for them.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def chunked(document: str) -> bool:
    """Whether the tokenizer splits at white space and drops it, so that texts may be encoded by chunks."""
    spec = json.loads(document)
    steps = spec.get("pre_tokenizer") or {}
    splits = [s for s in steps.get("pretokenizers", [steps]) if s.get("type") == "Split"]
    drops = any(s["behavior"] == "Removed" and s["invert"] and "\\s" in s["pattern"].get("Regex", "") for s in splits[:1])
    plain = all(not t["lstrip"] and not t["rstrip"] and not any(map(str.isspace, t["content"])) for t in spec["added_tokens"])
    steps = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": ""}])
    white = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}  # the only replacement known to be safe
    known = all(step == white if step["type"] == "Replace" else step["type"] in ("", "NFC", "Lowercase") for step in steps)
    return drops and plain and known and not spec.get("truncation") and not spec.get("padding")


def pieced(document: str) -> bool:
    """Whether chunks of ``PLAIN`` characters have the ids of their ``PIECE``s in lower case, each a word of the model.

    Special strings hold a letter and a mark other than an apostrophe, so none is found in a piece.
    """
    spec = json.loads(document)
    steps, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), spec["model"]
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    cuts = len(steps) == 2 and steps[0] == split and {k: steps[1].get(k) for k in level} == level
    normal = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
    lower = any(step.get("type") == "Lowercase" for step in normal)
    apart = all(
        not t["normalized"] and re.search("[A-Za-z]", t["content"]) and re.search("[^\\w']", t["content"])
        for t in spec["added_tokens"]
    )
    words = model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
    return bool(chunked(document) and cuts and lower and apart and words)


class WordTokens:
    def __init__(self, document: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(document)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.by_chunks = chunked(document)
        self.known: dict[bytes, bytes] = {}
        self.by_pieces = pieced(document)
        self.pieces: dict[str, bytes] = {}
        if self.by_pieces:
            spec = json.loads(document)
            special = "|".join(re.escape(t["content"]) for t in spec["added_tokens"])
            self.special = re.compile(special or "(?!)")
            self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in coded]

    def _of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces."""
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        new = [p for p in pieces if p not in self.pieces]
        some = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        learned = {}
        for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), (ends * self.kind.itemsize).tolist()
                learned.update(zip(group, map(lambda start, stop: raw[start:stop], [0, *stops], stops)))
            else:  # some piece has no last token
                learned.update(zip(group, self._whole(group)))
        found = {p: self.pieces[p] for p in pieces if p not in learned} | learned
        self.pieces.update((p, ids) for p, ids in learned.items() if len(p) <= C.LONGEST_KEPT)
        return found

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that are not remembered yet."""
        found, whole = {}, list(chunks)
        if self.by_pieces:
            cut, whole = {}, []
            for c in chunks:
                text = c.decode()
                if PLAIN.fullmatch(text) and not self.special.search(text):
                    cut[c] = PIECE.findall(text.lower())
                else:
                    whole.append(c)
            ids = self._of_pieces({p for parts in cut.values() for p in parts})
            found = {c: b"".join(map(ids.__getitem__, parts)) for c, parts in cut.items()}
        found.update(zip(whole, self._whole([c.decode() for c in whole])))
        return found

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian numbers of type ``kind``."""
        if not self.by_chunks:
            return self._whole([(t or b"").decode() for t in texts])
        if len(self.known) > CHUNKS_KEPT:
            self.known.clear()
        split = [text.split() if text else () for text in texts]
        missing = set().union(*split).difference(self.known)
        if missing:
            self.known.update(self._learn(missing))
        found = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for chunk in missing:
            if len(chunk) > C.LONGEST_KEPT:
                del self.known[chunk]
        return found


def share(spark: SparkSession, path: str):
    """The tokenizer file's content, for the tasks."""
    with open(path, encoding="utf-8") as lines:
        return spark.sparkContext.broadcast(lines.read())


def coder(shared) -> WordTokens:
    document = shared.value
    return C.per_process(("word tokens", hash(document)), lambda: WordTokens(document))


def slices(count: int, at_once: int = 500):
    return [(start, min(start + at_once, count)) for start in range(0, count, at_once)]
