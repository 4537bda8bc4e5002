"""Byte-level BPE encoding and decoding in linear time.

Bytes map to Latin-1 characters, so that pyahocorasick's trie holds any token. From each position the longest token is
tried first. It stands if it is compatible with the token before it, which is memoised for each pair; otherwise the next
shorter one is tried, and if none is left, the token before it is taken back. Two adjacent tokens are compatible if
undoing their merges, latest first, never shows a pair at their border that would have been merged earlier. A sequence
in which all neighbours are compatible is the one that applying the merges by rank gives, so results equal those of the
merges.

Defined results: a null or empty text has no tokens. Repeated rows give repeated results; other columns of the input
aren't read. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

#: Words after which those not seen since as many before are forgotten, and pairs after which all are. These bound a task's
#: memory (some 180 bytes a word), not results.
KEEP_WORDS, KEEP_PAIRS = 100_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks in the tiktoken format. It runs where the file is, on the driver; executors get the ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes single words (matches of the splitting pattern), given as bytes. Made once, on the driver; what tasks get has
    all but the trie, which each builds anew."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest_token = max(map(len, self.ranks), default=1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        # tokens that no merges lead to stand only where they are a whole word
        self.tokens = {token: rank for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]) if self._split(token, rank)}
        self.known.clear()
        self._plant()
        self.shorter = {rank: self._longest(token[:-1]) for token, rank in self.ranks.items() if len(token) > 1}
        self.length = {rank: len(token) for token, rank in self.ranks.items()}

    def _plant(self) -> None:
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for token, rank in self.tokens.items():
            self.trie.add_word(token, rank)

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name not in ("trie", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known={})
        self._plant()

    def _longest(self, text: str) -> int | None:
        """Rank of the longest token that text starts with."""
        n, tokens = self.trie.longest_prefix(text), self.tokens
        while n and (found := tokens.get(text[:n])) is None:
            n -= 1
        return found if n else None

    def _split(self, token: str, rank: int) -> bool:
        """Notes the two tokens whose merge gives this one. False if no merges lead to it."""
        if len(token) == 1:
            self.halves[rank] = (rank, rank)
            return True
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left in self.halves and right in self.halves and max(left, right) < rank and self.compatible(left, right):
                self.pairs[left, right] = rank
                self.halves[rank] = (left, right)
                return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave the two beside each other."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= KEEP_PAIRS:
                self.known.clear()
            found = self.known[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        pairs, halves = self.pairs, self.halves
        before = float("inf")  # merges below this rank took place while the border stood as it stands now
        while True:
            if pairs.get((left, right), before) < before:
                return False
            # undo the later of the two merges; on the right a merge of equal rank comes second
            if left > right:
                before, down = left, halves[left][1]
                if down != left:
                    left = down
                    continue
                before, down = right + 1, halves[right][0]
                if down == right:
                    return True
                right = down
            else:
                before, down = right + 1, halves[right][0]
                if down != right:
                    right = down
                    continue
                before, down = left, halves[left][1]
                if down == left:
                    return True
                left = down

    def encode(self, word: bytes) -> list[int]:
        text = word.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        known, length, longest = self.known, self.length, self._longest
        n, reach, out, at, closed = len(text), self.longest_token, [], 0, set()
        before = token = None
        while at < n:
            if token is None:
                token = longest(text[at : at + reach])
            end = at + length[token]
            if end not in closed and (before is None or known.get((before, token)) or self.compatible(before, token)):
                out.append(token)
                at, before, token = end, token, None
                continue
            token = self.shorter[token] if length[token] > 1 else None
            if token is None:  # the token before doesn't stand
                closed.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else None
        return out


class _Words(dict):
    """Places of the tokens of words seen in a task, by the word."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.flat, self.starts, self.sizes, self.held = array("i"), array("q"), array("i"), 0
        self.forget()

    def forget(self) -> None:
        """Words stay for one more round, in which those that are seen again are taken over."""
        self.older = dict(self), self.flat, self.starts
        self.clear()
        self.flat, self.starts, self.sizes, self.held = array("i"), array("q", [0]), array("i"), 0

    def full(self) -> bool:
        return max(len(self), self.held // 16, len(self.flat) // 16) >= KEEP_WORDS

    def __missing__(self, word: str) -> int:
        places, flat, starts = self.older
        at = places.get(word)
        ids = self.encoder.encode(word.encode("utf-8")) if at is None else flat[starts[at] : starts[at + 1]]
        place = self[word] = len(self.sizes)
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.held += len(word)
        return place

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """Ids of words one after the other."""
        sizes = self.counts(places)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.frombuffer(self.starts, np.int64)[places] - (ends - sizes), sizes)
        return np.frombuffer(self.flat, np.int32)[at]

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Numbers of tokens of words."""
        return np.frombuffer(self.sizes, np.int32)[places].astype(np.int64)


def tokenize(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text and decodes its tokens again.

    Returns id_col, ids (array of int) and decoded (binary, from the ids). The vocabulary file is read once, on the
    driver, and what encodes with it is broadcast: its size is that of the file and doesn't grow with the data.
    """
    shipped = df.sparkSession.sparkContext.broadcast(Encoder(read_ranks(path)))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # unpacked for each task: it takes a fraction of a second, and idle workers then hold no tables
        words, bytes_of, split = _Words(encoder := shipped.value), encoder.bytes_of, regex.compile(pattern).findall
        vocabulary = pa.array([bytes_of.get(rank, b"") for rank in range(max(bytes_of, default=0) + 1)], pa.binary())
        for batch in slices(batches):
            if words.full():
                words.forget()
            places = [np.fromiter(map(words.__getitem__, split((text or b"").decode("utf-8"))), np.int64) for text in texts(batch.column(1))]
            joined = np.concatenate([np.zeros(0, np.int64), *places])
            ids = words.tokens(joined)
            counts = np.concatenate([[0], np.cumsum(words.counts(joined))])
            ends = counts[np.cumsum([0, *map(len, places)])].astype(np.int32)
            # what the ids stand for lies in one buffer, which only needs the ends of texts
            decoded = vocabulary.take(pa.array(ids))
            at = np.frombuffer(decoded.buffers()[1], np.int32, len(ids) + 1, 4 * decoded.offset)[ends] if len(ids) else np.zeros(len(ends), np.int32)
            whole = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at.tobytes()), decoded.buffers()[2] if len(ids) else pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), whole], [id_col, "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
