"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task keeps one lexicon of the distinct words it has met. New words are laid
end to end and all merges are replayed over them together: an inverted index
leads from a rank to the word positions where that merge applies, ranks are taken
in order, and a merge updates only its two neighbours. Texts are then put
together from the lexicon, so a word is merged once per worker however often it
occurs, until the lexicon is full and starts anew.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

#: Unicode White_Space, spelled out: Python's and Rust's ``\s`` differ in U+001C..U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bytes of a worker's lexicons of words and pieces, and what an entry takes beside its characters and ids.
LEXICON, ENTRY = 160 << 20, 190
_DOUBLE = re.compile(r"\s\s")
_MODELS: dict[tuple[str, str], "ByteBpe"] = {}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[bytes]:
    """Token ids (int32 bytes) of each word: all merges over all words, lowest rank first, leftmost first."""
    buf = b"".join(words)
    n = len(buf)
    edge = bytearray(n + 1)
    at = 0
    for w in words:
        edge[at] = 1
        at += len(w)
    edge[n] = 1
    stop = list(range(1, n + 1))
    back = list(range(-1, n))
    index: dict[int, list[int]] = defaultdict(list)
    for p in range(n - 1):
        if not edge[p + 1]:
            r = ranks.get(buf[p : p + 2])
            if r is not None:
                index[r].append(p)
    alive = bytearray(b"\1" * n)
    heap = list(index)
    heapify(heap)
    while heap:
        rank = heappop(heap)
        places = sorted(index.pop(rank, ()))
        for k, p in enumerate(places):
            q = stop[p]
            if not alive[p] or edge[q] or ranks.get(buf[p : (e := stop[q])]) != rank:
                continue
            stop[p] = e
            alive[q] = 0
            lower = False
            if not edge[e]:
                back[e] = p
                r = ranks.get(buf[p : stop[e]])
                if r is not None:
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(p)
                    lower = r < rank
            if not edge[p]:
                o = back[p]
                r = ranks.get(buf[o:e])
                if r is not None:
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(o)
                    lower = lower or r < rank
            if lower and k + 1 < len(places):  # a lower rank came up: it goes first
                if rank not in index:
                    heappush(heap, rank)
                index[rank].extend(places[k + 1 :])
                break
    out = []
    at = 0
    for w in words:
        end, ids, p = at + len(w), [], at
        while p < end:
            ids.append(ranks[buf[p : stop[p]]])
            p = stop[p]
        out.append(array("i", ids).tobytes())
        at = end
    return out


class ByteBpe:
    """Ranks, pattern and the lexicon of this worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.words = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))
        self.known: dict[str, bytes] = {}  # words, as the pattern cuts them
        self.lexicon: dict[str, bytes] = {}  # pieces
        self.held = 0

    def learn(self, pieces: set[str]) -> None:
        """Add the pieces that the lexicon lacks, from its words and from a replay over the words it lacks."""
        new = list(pieces.difference(self.lexicon))
        if not new:
            return
        known, find = self.known, self.words.findall
        gc.disable()  # the many small lists below hold no cycles
        try:
            split = [find(p) for p in new]
            words = list(set().union(*split).difference(known))
            ids = replay([w.encode() for w in words], self.ranks)
            known.update(zip(words, ids, strict=True))
            get = known.__getitem__
            whole = [b"".join(map(get, ws)) for ws in split]
            self.lexicon.update(zip(new, whole, strict=True))
        finally:
            gc.enable()
        self.held += sum(map(len, words)) + sum(map(len, ids)) + sum(map(len, new)) + sum(map(len, whole)) + ENTRY * (len(words) + len(new))

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that the pattern never crosses: cut before a lone space between two other characters."""
        if text[0].isspace() or text[-1].isspace() or "\0" in text or _DOUBLE.search(text):
            return self.words.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        seen = set().union(*cut)
        self.learn(seen)
        get = self.lexicon.__getitem__
        out = [b"".join(map(get, ps)) for ps in cut]
        if self.held > LEXICON:  # what the last texts needed is needed most
            self.lexicon, self.known = {p: get(p) for p in seen} if len(seen) * ENTRY < LEXICON // 2 else {}, {}
            self.held = sum(len(p) + len(x) + ENTRY for p, x in self.lexicon.items())
        return out


def model(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = ByteBpe(path, pattern)
    return _MODELS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row, by the rank file at ``path`` without special tokens.

    A null or empty text has no ids. Repeated rows give repeated results; other columns are not read.
    No shuffle: each input split is encoded where it is read.
    """
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches):
        bpe = model(path, pattern)
        for batch in batches:
            for part in steps(batch, "__text"):
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])

    return src.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded binary``, the bytes that ``ids_col`` stands for; null ids decode to no bytes."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tokens = model(path, pattern).tokens
        size = np.zeros(max(tokens) + 1, np.int64)
        size[list(tokens)] = [len(x) for x in tokens.values()]
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join([tokens.get(i, b"") for i in range(len(size))]), np.uint8)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(size[ids], out=ends[1:])
                raw = flat[np.repeat(begin[ids] - ends[:-1], size[ids]) + np.arange(ends[-1])]
                bounds = ends[np.append(0, np.cumsum(counts))].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
