"""The pipeline's stages against what their operators say, and planted cases."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from .test_text_operators import brute_groups, brute_repeats


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_stages(spark, sf_dir, stages):
    docs, clean, good, single, cut, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    toxic = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    insult = re.compile(r"\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron)\b", re.I)
    kept = {r["doc_id"] for r in clean.collect()}
    plain = [r["doc_id"] for r in docs.collect() if not insult.search(r["text"]) and r["doc_id"] not in toxic]
    assert sum(i in kept for i in plain) >= 0.9 * len(plain)
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    groups = brute_groups([t for _, t in rows])
    firsts = [rows[k][0] for k, (n, root) in enumerate(groups) if root == k]
    assert sorted(r["doc_id"] for r in single.collect()) == firsts
    rows = sorted((r["doc_id"], r["text"]) for r in single.collect())
    want = {i: k.decode("utf-8", "ignore") for (i, _), (k, _) in zip(rows, brute_repeats([t for _, t in rows], 200))}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in packed.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
