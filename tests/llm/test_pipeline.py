"""The stages of the pipeline on small documents, each against a brute-force version on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from peakforge.llm.common import written
from tests.llm.test_jaccard import brute as brute_near
from tests.llm.test_mixing import brute as brute_mix


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        result = written(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((docs.toPandas(), result.toPandas()))
        docs = result
    return out


def test_all_but_the_last_keep_the_columns(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "token_output"]
    assert all(list(after.columns) == columns for _, after in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) >= 0.97 * len(before)
    assert all(any(c.isalpha() for c in t or "") for t in after["text"])


def test_near_dedup_keeps_one_of_each_group(stages):
    """Groups are those that exact five-word Jaccard similarities of 0.8 or more connect, found by comparing all pairs."""
    before, after = stages[1]
    rows = [(d, (t or "").encode().lower().decode()) for d, t in zip(before["doc_id"].tolist(), before["text"], strict=True)]
    want, kept = set(brute_near(rows)), set(after["doc_id"])
    assert len(rows) > len(want) and want <= kept and len(kept - want) <= 0.02 * (len(rows) - len(want))


def test_decontamination(stages, spark, sf_dir):
    norm = lambda s: re.sub(r"[\W_]+", " ", (s or "").lower()).strip()
    items = [norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = stages[2]
    leaks = {d for d, t in zip(before["doc_id"], before["text"], strict=True) if any(i in norm(t) for i in items)}
    assert leaks and not leaks & set(after["doc_id"])
    assert len(after) >= len(before) - len(leaks) - 2  # edited passages go as well


def test_mixing(stages):
    before, after = stages[3]
    rows = list(zip(before["doc_id"].tolist(), before["text"], before["source"], strict=True))
    words = Counter()
    for d, t in zip(after["doc_id"], after["text"], strict=True):
        words[d] += len(t.split())
    assert dict(words) == {d: taken for d, _, _, _, taken in brute_mix(rows) if taken}


def test_token_output(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages[4]
    start, want = 0, []
    for d, t in sorted(zip(before["doc_id"].tolist(), before["text"], strict=True)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = after.sort_values("start")
    assert list(zip(got["doc_id"].tolist(), got["start"].tolist(), got["n_tokens"].tolist(), got["ids_crc32"].tolist(), strict=True)) == want
