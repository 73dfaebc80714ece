"""Licence scans: Aho-Corasick over the words of a text, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

#: The phrases of the base rule with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases, as words, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
#: Words that say that a licence is granted, and the identifier tag.
GRANTS = ("licensed under", "released under", "distributed under", "under the terms of")
TAG = "spdx license identifier"

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+:-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Licences that ask for little more than a notice.
PERMISSIVE = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit unlicense zlib".split())
_MACHINE: list[ahocorasick.Automaton] = []


def machine() -> ahocorasick.Automaton:
    """The automaton of all phrases, each between single spaces; one per worker."""
    if not _MACHINE:
        a = ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES, **dict.fromkeys(GRANTS), TAG: None}:
            a.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
        a.make_automaton()
        _MACHINE.append(a)
    return _MACHINE[0]


def parse_expression(text: str) -> tuple[list[str], str | None]:
    """Shunting-yard: the longest leading part of ``text`` that is a whole and/or/with expression.

    Returns its postfix tokens and None, or no tokens and the reason. Stops at the first thing that cannot
    continue the expression, such as a comment's end. ``with`` stands between one licence and one exception.
    """
    out: list[str] = []
    stack: list[str] = []
    open_brackets, at = 0, 0
    want_operand, plain, exception = True, False, False
    whole: tuple[int, list[str]] | None = None
    while m := _TOKEN.match(text, at):
        token, low = m[1], m[1].lower()
        if token == "(":
            if not want_operand or exception:
                break
            stack.append(token)
            open_brackets += 1
        elif token == ")":
            if want_operand or not open_brackets:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            open_brackets -= 1
            plain = False
        elif low in _BINDS:
            if want_operand or low == "with" and not plain:
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            want_operand, exception = True, low == "with"
        else:
            if not want_operand:
                break
            out.append(token)
            plain, want_operand, exception = not exception, False, False
        at = m.end()
        if not want_operand and not open_brackets:
            whole = len(out), stack[::-1]  # three operators at most: each binds tighter than the one below
    return (out[: whole[0]] + whole[1], None) if whole else ([], "no whole expression")


def licences_of(postfix: list[str]) -> set[str]:
    """All licences that an expression names, in lower case; an exception goes with the licence before it."""
    names: list[str] = []
    for token in postfix:
        if token == "with":
            names[-2:] = [f"{names[-2]}-with-{names[-1]}"]
        elif token not in _BINDS:
            names.append(token.lower())
    return set(names)


def evaluate(postfix: list[str], accepted: frozenset[str]) -> bool:
    """Whether an expression can be met with accepted licences alone: one side of an or, both of an and."""
    stack: list = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(token.lower())
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{a}-with-{b}")
        else:
            a, b = [x if isinstance(x, bool) else x in accepted for x in (a, b)]
            stack.append(a or b if token == "or" else a and b)
    return bool(stack) and (stack[-1] if isinstance(stack[-1], bool) else stack[-1] in accepted)


def scan_text(text: str, accepted: frozenset[str] = PERMISSIVE) -> tuple[int, list[tuple[str, str, int, bool]], list[str], float, bool | None]:
    """Number of words; hits (phrase, label, word position, is base); labels; score; whether ``accepted`` licences
    meet all identifier expressions (None without any)."""
    parts = text.encode("utf-8", "replace").translate(_WORDS).split()
    joined = f" {b' '.join(parts).decode('latin-1')} "
    hits, grants, tagged = [], [], False
    seen = spaces = 0
    for end, (phrase, n) in machine().iter(joined):  # ends never fall
        spaces += joined.count(" ", seen, end + 1)
        seen = end + 1
        word = spaces - 1 - n
        if phrase == TAG:
            tagged = True
        elif phrase in GRANTS:
            bisect.insort(grants, word)
        else:
            hits.append((phrase, BASE.get(phrase) or NOTICES[phrase], word, phrase in BASE))
    labels = {h[1] for h in hits}
    score = 0.0
    if hits:  # the last grant before a hit is the nearest
        granted = any(k and h[2] - grants[k - 1] <= 8 for h in hits for k in [bisect.bisect_left(grants, h[2])])
        score = 0.9 if granted else 0.6
    met = None
    if tagged:
        for m in _EXPRESSION.finditer(text):
            postfix, _ = parse_expression(m[1])
            if postfix:
                labels |= licences_of(postfix)
                met = met is not False and evaluate(postfix, accepted)
                score = 1.0
    return len(parts), sorted(hits, key=lambda h: (h[2], h[0])), sorted(labels), score, met


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", accepted: frozenset[str] = PERMISSIVE) -> DataFrame:
    """``id_col, n_words, hits, labels, score, met`` of every whole text.

    ``hits``: phrase, label, position in words and whether it is of the base rule, by position. ``labels``:
    distinct and sorted, those of identifier expressions included. ``met``: whether the ``accepted`` licences meet
    all identifier expressions; null without any. A null or empty text has no words, no
    labels and score 0; repeated rows are scanned alike. No shuffle.
    """
    src = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    hit = T.StructType([T.StructField("phrase", T.StringType()), T.StructField("label", T.StringType()), T.StructField("word", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([src.schema.fields[0], T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit)), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType()), T.StructField("met", T.BooleanType())])
    kind = pa.list_(pa.struct([("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        names = ("phrase", "label", "word", "base")
        for batch in batches:
            for part in steps(batch, "__text"):
                got = [scan_text(t or "", accepted) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([[dict(zip(names, h, strict=True)) for h in g[1]] for g in got], kind), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.float64()), pa.array([g[4] for g in got], pa.bool_())],
                    names=schema.names,
                )

    return src.mapInArrow(run, schema)
