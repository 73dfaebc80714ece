"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the binary digits of
n (full-length pieces first). Each piece is a training sequence of its own, so no
sequence crosses documents, and pieces of one length form a bucket that is
batched together: nothing is padded.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, steps

#: Bytes of a task's lexicon of chunks and of a worker's lexicon of words, and what an entry takes beside its
#: characters and ids.
LEXICON, WORDS, ENTRY = 80 << 20, 64 << 20, 190
#: A character that stands between words; one token, and what holds it is encoded alone.
MARK = "\x01"
#: What the pre-tokenizer makes of printable ASCII without quotes: runs of letters, single digits, runs of the rest.
_ASCII = re.compile(r"[a-z]+|[0-9]|[^a-z0-9 ]+")
#: ASCII signs that end a word of any script.
_SIGNS = ".,;:!?)]}\"-"
#: Latin letters end here; other scripts are left to the library whole.
_LATIN = "\u0250"


def _byte_letters() -> str:
    """The letter that byte-level tokenizers write for each byte: itself if it is visible, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(free)) for b in range(256))


_LETTERS = _byte_letters()
_TOKENIZERS: dict[tuple[str, bool], "WordTokenizer"] = {}


def words_in(chunk: str) -> list[str]:
    """Parts of a space-free chunk that the tokenizer treats one by one, in lower case where that is plain ASCII.

    Quotes (which may begin a contraction) and bars (of control strings) leave a chunk whole.
    """
    if "'" in chunk or "|" in chunk or not chunk.isprintable():
        return [chunk]
    if chunk.isascii():
        return _ASCII.findall(chunk.lower())
    head = chunk.rstrip(_SIGNS)
    return [head, chunk[len(head) :]] if len(head) < len(chunk) and head[-1:].isalpha() else [chunk]


class WordTokenizer:
    """A tokenizer whose pre-tokens never cross white space, with a lexicon of space-free chunks.

    New chunks are put together from their words, and only new words go to the library. A control string in a
    text, such as ``<|endoftext|>``, gives its control id, as the library's plain call does; with
    ``control_as_text`` it is text like any other.
    """

    def __init__(self, path: str, control_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = control_as_text
        self.lexicon: dict[str, bytes] = {}  # chunks
        self.words: dict[str, bytes] = {}
        self.held = self.held_words = 0
        (self.mark_id,) = self.tok.encode(MARK, add_special_tokens=False).ids

    def one_word(self, word: str) -> str | None:
        """What the model sees of a word that is one pre-token for sure, or None."""
        if word.isascii():
            return word if word.isprintable() and "'" not in word and "|" not in word else None
        if word.isalpha() and max(word) < _LATIN:
            low = word.lower()  # these letters are composed already
            if low.isalpha():
                return low.encode().decode("latin-1").translate(_LETTERS)
        return None

    def learn_words(self, words: set[str]) -> None:
        """Ids of new words: single pre-tokens by the model alone, a thousand others to a call with a mark between them."""
        if self.held_words > WORDS:
            self.words, self.held_words = {}, 0
        others, model = [], self.tok.model
        for w in words:
            if w not in self.words:
                seen = self.one_word(w)
                if seen is None:
                    others.append(w)
                else:
                    self.words[w] = ids = array("I", [t.id for t in model.tokenize(seen)]).tobytes()
                    self.held_words += len(w) + len(ids) + ENTRY
        plain = [w for w in others if MARK not in w]
        for group in [plain[i : i + 1000] for i in range(0, len(plain), 1000)] + [[w] for w in others if MARK in w]:
            (e,) = self.tok.encode_batch_fast([f" {MARK} ".join(group)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            self.held_words += sum(map(len, group)) + 4 * len(ids) + ENTRY * len(group)
            if len(group) == 1:
                self.words[group[0]] = ids.tobytes()
                continue
            cuts = np.flatnonzero(ids == self.mark_id)
            begin, end = np.append(0, cuts + 1), np.append(cuts, len(ids))
            raw = ids.tobytes()
            self.words.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, begin.tolist(), end.tolist(), strict=True))

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        parts = [words_in(c) for c in new]
        self.learn_words(set().union(*parts))
        get = self.words.__getitem__
        ids = [b"".join(map(get, p)) for p in parts]
        self.lexicon.update(zip(new, ids, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, ids)) + ENTRY * len(new)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        seen = set().union(*cut)
        self.learn(seen.difference(self.lexicon))
        get = self.lexicon.__getitem__
        out = [b"".join(map(get, cs)) for cs in cut]
        if self.held > LEXICON:  # what the last texts needed is needed most
            self.lexicon = {c: get(c) for c in seen} if len(seen) * ENTRY < LEXICON // 2 else {}
            self.held = sum(len(c) + len(x) + ENTRY for c, x in self.lexicon.items())
        return out

    def forget(self) -> None:
        """Empty the lexicon of chunks: its worker lives on. That of words stays, within its bound."""
        self.lexicon, self.held = {}, 0
        give_back()


def tokenizer(path: str, control_as_text: bool = False) -> WordTokenizer:
    if (path, control_as_text) not in _TOKENIZERS:
        _TOKENIZERS[path, control_as_text] = WordTokenizer(path, control_as_text)
    return _TOKENIZERS[path, control_as_text]


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: as many of ``longest`` as fit, then falling powers of two."""
    out = [(s, longest) for s in range(0, n - n % longest, longest)]
    at, rest = n - n % longest, n % longest
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", control_as_text: bool = False) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids binary, doc_tokens, bucket, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit token ids; ``end_id`` closes each document, so a null or
    empty text is one piece of one token. ``longest`` must be a power of two. ``bucket`` is the piece's
    length; ``sequence_id`` is unique; ``offset`` is 0, as a sequence is one piece. Repeated rows are
    packed again. No shuffle: pieces are made where a split is read, and ids are numbered by partition.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens")], T.StructField("ids", T.BinaryType())])
    close = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tok = tokenizer(tokenizer_path, control_as_text)
        for batch in batches:
            for part in steps(batch, "__text"):
                row, start, length, total, ids = [], [], [], [], []
                for i, x in enumerate(tok.encode(part.column(1).to_pylist())):
                    x += close
                    for s, k in binary_pieces(len(x) // 4, longest):
                        row.append(i)
                        start.append(s)
                        length.append(k)
                        total.append(len(x) // 4)
                        ids.append(x[4 * s : 4 * (s + k)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, total)], pa.array(ids, pa.binary())], names=[id_col, "start", "length", "doc_tokens", "ids"])
        tok.forget()

    return src.mapInArrow(run, schema).select("*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed pieces with one folder per bucket, so that a trainer draws batches of equal length."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
