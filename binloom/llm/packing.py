"""Packing of tokenised documents into sequences of at most ``LENGTH`` tokens.

Pattern packing: the histogram of piece lengths (at most ``LENGTH`` numbers, whatever the corpus) is fitted by repeat
counts of patterns of one to three lengths with non-negative least squares; the counts are rounded down to what the
histogram has, and what is left is packed best fit first, longest pieces first, again by counts. The outcome is a list
of runs: ``k`` sequences alike, and for each of their slots the ranks of the pieces that fill it. The list has some
ten thousands of entries at any scale, so it is broadcast; a piece finds its sequence by its length and its rank among the
pieces of that length. Ranks are counted in each task and offset by a sum over tasks, so no length is one task's.

Odd cases: a null text counts as an empty one and is the single token 0. Repeated rows are packed each by itself. A
null ``doc_id`` stays null. No documents, no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import INT, LONG, own_columns, schema, stored

LENGTH, END = 2048, b"\0\0\0\0"
VOCABULARY = "byte_bpe_50k.json"
#: Second lengths that patterns of three try for each first one, evenly spread over those that occur. Pieces that fit no
#: pattern are packed all the same, best fit first; with every second length (321 470 patterns at sf0.1) the fit takes twelve
#: seconds instead of one and needs as many sequences.
MIDDLES = 8
_CHUNK, _STEP = 1 << 20, 256
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian bytes, by the ``tokenizers`` file of a byte-level vocabulary: those of ``encode(text, add_special_tokens=False)``.

    Where the same vocabulary lies beside the file as ranks, texts are encoded by those, in a fraction of the time; a test holds both to equal ids.
    A text that holds the string of a special token goes through the library. The vocabulary's splitting rule always starts a new part at a single blank or line
    end between two visible characters; long texts are cut at such places, so memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.encode = self.whole
        if os.path.exists(ranked := path.removesuffix(".json") + ".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(ranked, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        if self._library is None:  # only where a text needs it
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return array("I", self.whole(text)).tobytes()
        out, at = [], 0
        while len(text) - at > _CHUNK and (cut := _SAFE.search(text, at + _CHUNK)):
            out.append(array("I", self.encode(text[at : cut.start()])).tobytes())
            at = cut.start()
        out.append(array("I", self.encode(text[at:])).tobytes())
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.ids, texts))


_encoders: dict[str, Encoder] = {}


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        chunk, seen = TaskContext.get().partitionId(), [0] * (LENGTH + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"]
        for b in batches:
            for at in range(0, b.num_rows, _STEP):
                part = b.slice(at, _STEP)
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += END
                    n = len(ids) // 4
                    start, size = 0, (n - 1) % LENGTH + 1
                    for piece in range((n - 1) // LENGTH + 1):
                        rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), chunk, seen[size]))
                        seen[size] += 1
                        start, size = start + size, LENGTH
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names)

    return run


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with its task and its rank there among pieces of its length."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = schema(doc_id=LONG, piece=INT, start=LONG, length=INT, ids_crc32=LONG, chunk=INT, rank=LONG)
    return own.mapInArrow(_tokenise(path or tokenizer_path()), kind)


class Packer:
    """Runs of like sequences over a histogram of lengths. ``slots``: length, first rank, how many, first sequence, offset."""

    def __init__(self, histogram: dict[int, int], length: int = LENGTH):
        self.full, self.left = length, np.zeros(length + 1, np.int64)
        for k, n in histogram.items():
            self.left[k] = n
        self.used = np.zeros(length + 1, np.int64)
        self.sequences, self.slots = 0, []

    def _emit(self, content: list[tuple[int, int, int]], k: int) -> None:
        """content: length, first rank, offset"""
        self.slots += [(size, rank, k, self.sequences, offset) for size, rank, offset in content]
        self.sequences += k

    def patterns(self) -> list[tuple[int, ...]]:
        """Of one to three lengths that occur and fill a sequence, or fill it as well as the lengths that occur allow."""
        have = np.flatnonzero(self.left)
        largest = np.zeros(self.full + 1, np.int64)  # the largest length that occurs, up to each
        largest[have] = have
        largest = np.maximum.accumulate(largest)
        found = {(self.full,)} if self.left[self.full] else set()
        for a in have[::-1].tolist():
            rest = self.full - a
            if b := int(largest[rest]):
                found.add(tuple(sorted((a, b))))
                choice = have[have <= rest]
                for b in choice[np.linspace(0, len(choice) - 1, MIDDLES).astype(int)].tolist():
                    if c := int(largest[rest - b]):
                        found.add(tuple(sorted((a, b, c))))
        return sorted(p for p in found if sum(p) >= self.full - 2)

    def fit(self, rounds: int = 30) -> None:
        """Non-negative least squares by coordinate descent, then rounding down to what there is."""
        patterns = self.patterns()
        columns = [list({x: p.count(x) for x in p}.items()) for p in patterns]
        gap, x = self.left.astype(float).tolist(), [0.0] * len(patterns)
        for _ in range(rounds):
            moved = 0.0
            for j, col in enumerate(columns):
                new = max(0.0, x[j] + sum(gap[i] * m for i, m in col) / sum(m * m for _, m in col))
                if step := new - x[j]:
                    x[j] = new
                    moved += abs(step)
                    for i, m in col:
                        gap[i] -= step * m
            if moved < 0.5:
                break
        for j in sorted(range(len(x)), key=lambda j: -x[j]):
            k = min(int(x[j]), *(int(self.left[i]) // m for i, m in columns[j]))
            if k > 0:
                content, offset = [], 0
                for size in sorted(patterns[j], reverse=True):
                    content.append((size, int(self.used[size]), offset))
                    self.used[size] += k
                    self.left[size] -= k
                    offset += size
                self._emit(content, k)

    def residuals(self) -> None:
        """Best fit, longest first: sequences of equal content are one entry of (how many, content, filled)."""
        open_: dict[int, list] = {}  # by free space
        for size in range(self.full, 0, -1):
            n = int(self.left[size])
            spaces = sorted(s for s in open_ if s >= size)
            while n:
                if spaces:
                    space, group = spaces[0], open_[spaces[0]].pop()
                    if not open_[space]:
                        del open_[space]
                        spaces.pop(0)
                    have, content = group
                else:
                    space, have, content = self.full, n, []
                each = min(space // size, n)
                k = min(have, n // each)
                if k < have and (space != self.full or content):
                    rest = [(s, r + k, o) for s, r, o in content]
                    open_.setdefault(space, []).append((have - k, rest))
                    if space not in spaces:
                        spaces.insert(0, space)
                offset = self.full - space
                new = list(content)
                for _ in range(each):
                    new.append((size, int(self.used[size]), offset))
                    self.used[size] += k
                    offset += size
                n -= k * each
                self.left[size] -= k * each
                if self.full - offset:
                    open_.setdefault(self.full - offset, []).append((k, new))
                    if self.full - offset >= size and self.full - offset not in spaces:
                        spaces = sorted([*spaces, self.full - offset])
                else:
                    self._emit(new, k)
        for groups in open_.values():
            for k, content in groups:
                self._emit(content, k)

    def run(self) -> Packer:
        self.fit()
        self.residuals()
        return self


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        starts = s[:, 0] * (1 << 48) + s[:, 1]
        for b in batches:
            rank = np.asarray(b.column("rank"))
            at = s[np.searchsorted(starts, np.asarray(b.column("length")).astype(np.int64) * (1 << 48) + rank, "right") - 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start")] + [b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path), "pieces")
    counts = cut.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # LENGTH rows at most
    slots = np.array(sorted(Packer(histogram).run().slots), np.int64).reshape(-1, 5)
    ranked = cut.join(counts.hint("merge"), ["chunk", "length"])  # offsets grow with the number of tasks: never a broadcast
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("n", "base", "chunk")
    kind = schema(doc_id=LONG, piece=INT, start=LONG, length=LONG, ids_crc32=LONG, sequence_id=LONG, offset=LONG)
    return ranked.mapInArrow(_placed(spark.sparkContext.broadcast(slots)), kind)
