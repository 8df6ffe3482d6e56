"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

Encoder: Aho-Corasick finds the longest vocabulary entry at every position; a backtracking walk accepts an entry after
the previous one only if the pair is *compatible* (merging their bytes by rank would give exactly these two entries
again), which yields the same ids as applying the merges, in linear time. Decoder: one byte blob with an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcanvas.plans.frames import ship_file, spread, tokenizer_dir

# The pre-tokenisation pattern that the vocabulary was made for.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; beyond it the memory is emptied, results do not change.
MEMORY = 400_000


class BytePairCodec:
    """Exact byte-pair ids for ``ranks`` (bytes -> id, where a smaller id is an earlier merge)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.entry: list[bytes] = [b""] * self.size
        for entry, rank in ranks.items():
            self.entry[rank] = entry
        self.split = regex.compile(pattern).findall
        self.parts, self.pairs = self._merges()
        self.shorter = self._shorter()
        self.matcher = ahocorasick.Automaton()
        for entry, rank in ranks.items():
            self.matcher.add_word(entry.decode("latin-1"), rank)
        self.matcher.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.blob = np.frombuffer(b"".join(self.entry), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.entry])])

    def _merges(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """For each entry the two earlier entries it is merged from, and the reverse table."""
        parts = [(i, i) for i in range(self.size)]
        pairs: dict[tuple[int, int], int] = {}
        for rank, entry in enumerate(self.entry):
            if len(entry) < 2:
                continue
            pieces = [self.ranks[entry[i : i + 1]] for i in range(len(entry))]
            while len(pieces) > 2:
                found = [(pairs.get(p, rank), i) for i, p in enumerate(zip(pieces, pieces[1:]))]
                merged, i = min(found)
                if merged >= rank:
                    break
                pieces[i : i + 2] = [merged]
            if len(pieces) == 2:
                parts[rank] = (pieces[0], pieces[1])
                pairs[pieces[0], pieces[1]] = rank
        return parts, pairs

    def _shorter(self) -> list[int]:
        """For each entry the longest other entry that it begins with, or -1."""
        out = [-1] * self.size
        for rank, entry in enumerate(self.entry):
            for end in range(len(entry) - 1, 0, -1):
                if (x := self.ranks.get(entry[:end])) is not None:
                    out[rank] = x
                    break
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` can stand side by side in a result.

        The seam between them is undone merge by merge, latest first; a merge across the seam that comes before the
        merges on either side would have happened, so the pair is then impossible.
        """
        answer = self.compatible.get((left, right))
        if answer is None:
            a, b, bound, answer = left, right, self.size, True
            while True:
                across = self.pairs.get((a, b))
                if across is not None and across < bound:
                    answer = False
                    break
                whole_a, whole_b = self.parts[a] == (a, a), self.parts[b] == (b, b)
                if whole_a and whole_b:
                    break
                # Of the two sides undo the one merged last; equal ranks undo the right side first, as merges run left to right.
                if not whole_a and (whole_b or a > b):
                    bound, a = a, self.parts[a][1]
                else:
                    bound, b = b + 1, self.parts[b][0]
            self.compatible[left, right] = answer
        return answer

    def _longest(self, data: str) -> list[int]:
        """The longest entry that starts at each position of ``data`` (bytes as Latin-1)."""
        best, entry = [-1] * len(data), self.entry
        for end, rank in self.matcher.iter(data):
            start, size = end + 1 - len(entry[rank]), len(entry[rank])
            if best[start] < 0 or len(entry[best[start]]) < size:
                best[start] = rank
        return best

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            return (whole,)
        data = raw.decode("latin-1")
        size, best = len(data), self._longest(data)
        open_at = bytearray(b"\x01" * (size + 1))
        out: list[int] = []
        at, token = 0, best[0]
        while at < size:
            end = at + len(self.entry[token])
            if open_at[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at = end
                token = best[at] if at < size else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(self.entry[token])
                # The same entry failed from here; its end is closed now, so the walk goes on with a shorter one.
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; an empty and a null text have none."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(known) >= MEMORY:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids`` by two gathers on the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        starts, ends = self.offsets[ids], self.offsets[ids + 1]
        sizes = ends - starts
        shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.blob[np.arange(sizes.sum()) + shift].tobytes()


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    """The codec of a ``.tiktoken`` rank file, built once per worker."""
    with open(path, "rb") as lines:
        return BytePairCodec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def on_worker(path: str) -> str:
    """Where a shipped file lies on the worker (``path`` itself where nothing was shipped)."""
    from pyspark import SparkFiles

    try:
        here = SparkFiles.get(os.path.basename(path))
    except Exception:  # noqa: BLE001 - outside of a task there is no folder of shipped files
        return path
    return here if os.path.exists(here) else path


def default_path() -> str:
    return f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"


def encode_column(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of the column ``text``.

    Null and empty texts give an empty list, never null. Strings of special tokens are ordinary text. Whole texts of
    any length are encoded. No shuffle unless the scan has fewer partitions than cores.
    """
    at = path or default_path()
    ship_file(df.sparkSession, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(on_worker(at))
        for batch in batches:
            lists = [c.encode(x) for x in batch.column(len(keep)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids], names=[*keep, "ids"])

    picked = spread(df.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, ids array<int>")


def count_column(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens bigint``, the number of ids of the column ``text`` (0 for null and empty texts)."""
    at = path or default_path()
    ship_file(df.sparkSession, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(on_worker(at))
        for batch in batches:
            sizes = pa.array([len(c.encode(x)) for x in batch.column(len(keep)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), sizes], names=[*keep, "n_tokens"])

    picked = spread(df.select(*keep, F.col(text).alias("_text")))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, n_tokens bigint")


def decode_column(df: DataFrame, keep: list[str], ids: str, path: str | None = None) -> DataFrame:
    """``keep`` columns and ``text string`` from a column of ids; a null list gives null, invalid UTF-8 gives U+FFFD."""
    at = path or default_path()
    ship_file(df.sparkSession, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(on_worker(at))
        for batch in batches:
            texts = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, type=pa.string())], names=[*keep, "text"])

    picked = df.select(*keep, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{kinds}, text string")
