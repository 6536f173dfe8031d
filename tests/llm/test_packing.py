import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sedimenta.llm import packing, registry
from tests.oracle import SF

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_both_ways_of_encoding_agree():
    lib, encoder = reference(), packing.ByteEncoder(PATH, RANKS)
    rng = random.Random(4)
    latin = [chr(i) for i in range(256)]
    texts = ["", " ", "\n \n", "a<|endoftext|>b <|endoftext|>", "aaaa" * 900, "it's WE'LL ''s", "日本 語 🙂 œuvre", "\x85\xa0 \x1c x"]
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeéè  \n't,.<|>0") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 90))) for _ in range(500)]
    for t in texts:
        assert encoder(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_squares_decide():
    # two open sequences of gap 4, one of gap 6; a piece of 4 closes one of gap 4
    where, offset, fill = packing.place(np.array([6, 6, 4]), 10)
    assert offset.tolist() == [0, 0, 6] and sorted(fill) == [6, 10] and where[2] in where[:2]
    where, offset, fill = packing.place(np.array([10, 1, 1]), 10)
    assert sorted(fill) == [2, 10]


def check_packed(rows, capacity):
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seen)


@pytest.mark.parametrize("shard_rows", [7, 100, 1 << 14])
def test_packing_is_gapless_and_tight(spark, shard_rows):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 900).tolist() + [100] * 5 + [3] * 300
    df = spark.createDataFrame([(i // 3, n, n) for i, n in enumerate(lengths)], "id long, length long, deal int")
    rows = packing.pack(df, capacity=100, shard_rows=shard_rows).collect()
    assert sorted((r.id, r.length, r.deal) for r in rows) == sorted((i // 3, n, n) for i, n in enumerate(lengths))
    least = -(-sum(lengths) // 100)
    assert check_packed(rows, 100) <= least * {7: 1.2, 100: 1.05}.get(shard_rows, 1.01)
    with pytest.raises(ValueError, match="pieces"):
        packing.pack(spark.createDataFrame([(1, 0)], "id long, length long"))


def test_pieces_and_odd_rows(spark):
    long_text = "word, other\n" * 9000
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "a b<|endoftext|>", 5), (3, long_text, 5), (4, "é œ 日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = packing.token_pieces(df, PATH, ranks_path=RANKS, with_ids=True)
    got = packing.pack(pieces).collect()
    lib = reference()
    whole = {}
    for r in sorted(got, key=lambda r: (r.id or 0, r.piece)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole.setdefault(r.id, []).extend(r.ids)
    assert whole == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] * (2 if i == 2 else 1) for i, t, _ in rows}
    of3 = sorted((r.piece, r.start, r.length) for r in got if r.id == 3)
    assert all(n == 2048 for _, _, n in of3[1:]) and [s for _, s, _ in of3] == [0, *np.cumsum([n for _, _, n in of3])[:-1].tolist()]
    check_packed(got, 2048)
    sequences = packing.assembled(packing.pack(pieces)).collect()
    assert sum(len(s.ids) for s in sequences) == sum(r.length for r in got) and max(len(s.ids) for s in sequences) <= 2048
    assert packing.pack(packing.token_pieces(df.limit(0), PATH)).count() == 0


def test_query_covers_all_documents(spark):
    lib = reference()
    rows = registry.queries()["op12_pack"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d in docs:
        ids = np.array([*lib.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d.doc_id, n] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    tokens = sum(n for _, n, _ in want.values())
    assert check_packed(rows, 2048) <= -(-tokens // 2048) * 1.02
