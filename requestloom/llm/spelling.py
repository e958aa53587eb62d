"""Groups of spelling variants: frequent words one edit apart, found over a reduced alphabet.

Words are runs of letters, A-Z in lower case, counted over all documents.  For one pair (document, word) of ``MISSPELT`` a
letter is left out first, by rule; that makes variants to be found.

The letters are hashed to ``SYMBOLS`` symbols.  Words that are one edit apart have reduced words that are equal or one
edit apart.  So the full one-edit neighbourhood of each reduced word is generated, joined with the reduced vocabulary,
and what meets is verified on the original strings.  Members of a neighbourhood are 64-bit polynomial hashes, from which
those of a word with one letter replaced, left out or put in follow in a few operations, so a word of n letters costs
n numbers a symbol and not n strings of n letters.  Equal hashes of unlike words only cost a comparison.

Members that surely are no reduced word are left out before the shuffle (``member_bits``, at most 16 MB; it only filters).
Reduced words that more than ``CROWD`` words share are not joined.  Words whose neighbourhoods reach them meet the words
of the crowd by their whole letters instead: words that are one edit apart have a word with a letter left out in common,
or one is such a word of the other.

Null and empty texts have no words.  Rows with a null id are counted as they are, without the rule for misspelling.
Repeated rows count each.  Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MISSPELT = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form has at least this many times its occurrences.
TIMES = 5
SYMBOLS = 8
CROWD = 256
#: Distinct words that a task counts before it hands them on; members of neighbourhoods that it makes at a time.
COUNTED, MADE = 1 << 18, 1 << 20
LETTERS = "[a-zÀ-ÿ]+"
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of rows (id, text), for words of ``LEAST_LENGTH`` letters or more."""

    def count(batches):
        import pyarrow as pa

        letters, total = re.compile(LETTERS), Counter()

        def full():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), C.binary_column(batch.column(1))):
                found = Counter(letters.findall(text.lower().decode())) if text else {}
                for word, n in found.items():
                    if doc is not None:
                        h = zlib.crc32(f"{doc}:{word}".encode())
                        if h % MISSPELT == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield full()
                    total.clear()
        if total:
            yield full()

    return docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def powers(base: int, count: int) -> np.ndarray:
    """base to the powers 0 to count - 1, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, count - 1), np.uint64(base))]), dtype=np.uint64)


def weights(count: int) -> np.ndarray:
    return C.mixed(np.arange(1, count + 1, dtype=np.uint64))


class Hashed:
    """Polynomial hashes of words of one length, given as symbol numbers below ``symbols`` (words x letters)."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.codes, self.weights = codes, weights(symbols)
        self.length = codes.shape[1]
        self.power = powers(BASE, self.length + 1)
        with np.errstate(over="ignore"):
            terms = self.weights[codes] * self.power[: self.length]
            self.before = np.concatenate(
                [np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1
            )
        self.whole = self.before[:, -1]

    def _keys(self, values: np.ndarray, length: int) -> np.ndarray:
        return C.mixed(values ^ C.mixed(np.array([length], np.uint64)))

    def keys(self) -> np.ndarray:
        return self._keys(self.whole, self.length)

    def left_out(self, at: slice) -> np.ndarray:
        """Keys of the words without the letter at each of these positions."""
        with np.errstate(over="ignore"):
            after = self.whole[:, None] - self.before[:, 1:][:, at]
            return self._keys(self.before[:, :-1][:, at] + after * np.uint64(BASE_INVERSE), self.length - 1)

    def replaced(self, at: slice) -> np.ndarray:
        """Keys of the words with each symbol at each of these positions, the words themselves included."""
        with np.errstate(over="ignore"):
            change = self.weights[None, None, :] - self.weights[self.codes[:, at]][:, :, None]
            values = self.whole[:, None, None] + change * self.power[: self.length][at][None, :, None]
        return self._keys(values, self.length).reshape(len(self.codes), -1)

    def put_in(self, at: slice) -> np.ndarray:
        """Keys of the words with each symbol put in before each of these positions, the end being the last."""
        with np.errstate(over="ignore"):
            start = self.before[:, at]
            values = start + (self.whole[:, None] - start) * np.uint64(BASE)
            values = values[:, :, None] + (self.power[at][:, None] * self.weights)[None]
        return self._keys(values, self.length + 1).reshape(len(self.codes), -1)


def by_length(words: list[str], most: int):
    """(numbers, matrix of code points) of words of one length, about ``most`` letters or one word at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        chosen = np.flatnonzero(lengths == length)
        step = max(1, most // length)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4")
            yield part, points.reshape(len(part), length)


def once_a_row(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys, each key once in a row."""
    keys = np.sort(keys, axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def reduced_keys(words: list[str], symbols: int) -> np.ndarray:
    """The key of each reduced word."""
    found = np.empty(len(words), np.uint64)
    for chosen, points in by_length(words, MADE):
        found[chosen] = Hashed(points % symbols, symbols).keys()
    return found


def neighbourhoods(words: list[str], symbols: int):
    """(numbers of words, keys) of the reduced words' one-edit neighbourhoods, the words themselves included."""
    for chosen, points in by_length(words, max(1, MADE // (2 * symbols + 1))):
        hashed = Hashed(points % symbols, symbols)
        step = max(1, MADE // (2 * symbols + 1) // len(chosen))
        for at in range(0, hashed.length + 1, step):
            here = slice(at, at + step)
            row, keys = once_a_row(
                np.concatenate([hashed.replaced(here), hashed.left_out(here), hashed.put_in(here)], axis=1)
            )
            yield chosen[row], keys


def shortened(words: list[str]):
    """(numbers of words, keys) of the words over all letters, whole and with each letter left out."""
    for chosen, points in by_length(words, MADE):
        hashed = Hashed(points.astype(np.int64), 256)
        row, keys = once_a_row(np.concatenate([hashed.keys()[:, None], hashed.left_out(slice(None))], axis=1))
        yield chosen[row], keys


def keyed(words: DataFrame, make, bits: np.ndarray | None = None) -> DataFrame:
    """(word, n, key) for the keys that ``make`` gives for a list of words, without those that ``bits`` rule out."""
    shared = None if bits is None else words.sparkSession.sparkContext.broadcast(bits)

    def expand(batches):
        import pyarrow as pa

        for batch in batches:
            for row, keys in make(batch.column(0).to_pylist()):
                keys = keys.view(np.int64)
                if shared is not None:
                    kept = C.may_be_member(shared.value, keys)
                    row, keys = row[kept], keys[kept]
                columns = [column.take(pa.array(row)) for column in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys)], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(expand, "word string, n bigint, key bigint")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): for each word (word, n) the words that are exactly one edit away."""

    def itself(words):
        yield np.arange(len(words)), reduced_keys(words, symbols)

    def around(words):
        return neighbourhoods(words, symbols)

    reduced = C.staged(keyed(vocabulary, itself), "reduced")
    crowded = C.staged(
        reduced.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"), "crowded"
    )
    bits = C.member_bits(reduced.select("key").distinct(), "key", hashed=True)
    members = C.staged(keyed(vocabulary, around, bits).select("word", "key"), "neighbourhoods")
    one_edit = "l.word <> r.word and abs(length(l.word) - length(r.word)) <= 1 and levenshtein(l.word, r.word, 1) = 1"
    found = [F.col("l.word"), F.col("r.word").alias("near"), F.col("r.n").alias("near_n")]
    few = members.alias("l").join(
        reduced.join(crowded, "key", "left_anti").alias("r"), F.expr(f"l.key = r.key and {one_edit}")
    )
    asking = C.staged(members.join(crowded, "key", "left_semi").groupBy("word").agg(F.lit(0).cast("long").alias("n")), "asking")
    crowd = C.staged(reduced.join(crowded, "key", "left_semi").select("word", "n"), "crowd")
    many = keyed(asking, shortened).alias("l").join(
        keyed(crowd, shortened).alias("r"), F.expr(f"l.key = r.key and {one_edit}")
    )
    return few.select(*found).unionAll(many.select(*found)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain.  A form has ``TIMES`` the occurrences, so chains are short."""
    reached = C.staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        onward = C.staged(
            reached.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"),
            "roots",
        )
        reached = onward.select("word", "root")
        if not onward.where("further is not null").limit(1).count():
            return reached


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS
) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of most occurrences (ties: the smallest), if these are ``TIMES`` the word's; ``root`` the
    last of the chain of forms.
    """
    counts = word_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    vocabulary = C.staged(counts.where(F.col("n") >= LEAST_COUNT), "vocabulary")
    best = (
        near_words(vocabulary, symbols)
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("best"),
        )
    )
    enough = F.expr(f"-best.minus_n >= {TIMES} * n")
    words = C.staged(
        vocabulary.join(best, "word", "left").select(
            "word",
            F.when(enough, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, -F.col("best.minus_n")).alias("form_n"),
        ),
        "words",
    )
    ends = roots(words.where("form is not null"))
    return words.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
