import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from peakforge.llm import tokens

DOCS = "doc_id long, text string, lang string, part int"


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=0, max_size=400))
def test_shard_answers(ids):
    a = np.array(ids, "<u4")
    shard = tokens.WaveletShard(tokens.pack(a, [7, None], [len(ids), 0]))
    assert shard.all_ids().tolist() == ids
    assert [shard.access(i) for i in range(0, len(ids), 17)] == ids[::17]
    for t in set(ids[:5]) | {301, 5000}:
        at = [i for i, x in enumerate(ids) if x == t]
        assert shard.count(t) == len(at)
        assert shard.count(t, len(ids) // 2) == sum(i < len(ids) // 2 for i in at)
        assert [shard.find(t, k) for k in range(len(at))] == at and shard.find(t, len(at)) == -1


def test_shard_over_many_blocks():
    a = np.random.default_rng(0).integers(0, 49000, 3 * tokens.BLOCK + 77).astype("<u4")
    shard = tokens.WaveletShard(tokens.pack(a, [1], [len(a)]))
    assert (shard.all_ids() == a).all()
    for i in (0, 1, tokens.BLOCK - 1, tokens.BLOCK, 2 * tokens.BLOCK + 9, len(a) - 1):
        assert shard.access(i) == a[i]
        at = np.flatnonzero(a == a[i])
        assert [shard.find(int(a[i]), k) for k in range(len(at))] == at.tolist()


@example("T̈ H̱x aT̈")
@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB'sllé ſİ\x1c\x85  \n\t\r\x0b 12.,!<|endoftext|><|ENDOFTEXT|>́̈한日🙂Σς"), max_size=60))
def test_pieces_equal_whole_text(text):
    global ENCODER, PLAIN
    if "ENCODER" not in globals():
        import public_tokenizers
        from tokenizers import Tokenizer

        ENCODER, PLAIN = tokens.Encoder(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [x.tolist() for x in ENCODER.encode_all([text, None, text[::-1]])]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in (text, "", text[::-1])]


def test_full_tables_of_pieces():
    import public_tokenizers
    from tokenizers import Tokenizer

    small, plain = tokens.Encoder(max_pieces=6), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(12):
        text = " ".join(f"w{j % 7} x{j}" for j in range(k, k + 5))
        assert small.encode_all([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_query_against_plain_encoding(spark, plain):
    rows = [(5, "Hello  World don't", "en", 1), (None, None, None, 0), (3, "", "x", 2), (9, "a" * 20000 + " b" * 3000, "en", 3), (3, "zz", "en", 1), (3, "zz", "en", 1), (-4, "été\n\tnoël", "fr", 9)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    manifest = tokens.write_shards(df, shard_ids=50)
    got = [tuple(r) for r in tokens.read_shards(manifest).collect()]
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens.read_shards(tokens.write_shards(df.limit(0))).count() == 0
