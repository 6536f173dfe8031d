import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import bpe

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a  b   c", "\n", "Hello\nworld\t\ttab\r\n", "ñandú ÇA İstanbul ΣΑΣ ß", "<s>x</s> <unk> <0x0A>", "▁x ▁▁ y",
    "日本語テスト 🙂👍🏽", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, " nbsp　wide sep", "é combining", "don't WE'LL 12345 3.14",
    "<|startoftext|>a<|endoftext|> b<|endoftext|>", "<|ENDOFTEXT|>", "x\x00y\x1cz", "\x85 next", "--- *** $$$&&&",
]


def fuzz(n, seed=1):
    rng = random.Random(seed)
    alphabet = "abcdeTHing ofand  \n\t.,'0123éßüñÇŒ日語🙂́ ▁<|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_piece_counts_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = bpe.PieceCounter(PIECES)
    for t in ODD + fuzz(1500):
        assert count(t) == len(sp.encode(t, num_threads=1)), t


def test_word_codec_equals_the_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    lib.no_truncation()
    lib.no_padding()
    codec = bpe.WordCodec(WORDS)
    for t in ODD + fuzz(1500):
        want = lib.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got == want, t
        assert codec.decode(got) == lib.decode(want, skip_special_tokens=False), t


def test_queries_on_nulls_and_clashing_columns(spark):
    rows = [(1, "The cat.", 7), (2, None, 8), (3, "", 9), (1, "The cat.", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = {(r.doc_id, r.n_tokens, r.n_bytes, r.over_limit) for r in bpe.token_counts(docs, PIECES, limit=2).collect()}
    assert got == {(1, 3, 8, True), (2, 0, 0, False), (3, 0, 0, False)}
    digests = bpe.bpe_digests(docs, WORDS).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in digests if r.doc_id != 1} == {(empty, empty, 0)}
    coded = docs.select(bpe.bpe_encode_decode(F.col("text"), WORDS).alias("c")).select("c.*")
    again = coded.select("decoded", bpe.bpe_decode(F.col("ids"), WORDS).alias("d"))
    assert again.filter(~F.col("decoded").eqNullSafe(F.col("d"))).count() == 0
    assert bpe.bpe_digests(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_merge_takes_the_lowest_rank_first(n):
    a, b, c, bc, abc = range(5)
    ranks = {b << bpe.WIDE | c: 0, a << bpe.WIDE | b: 1, a << bpe.WIDE | bc: 2}
    symbols = [a, b, c] * n
    assert bpe.merge(symbols, ranks, [bc, 9, abc]) == 2 * n and [s for s in symbols if s >= 0] == [abc] * n


def test_very_long_texts_and_ties():
    assert bpe.PieceCounter(PIECES)("ab" * 100_000) > 1000
    symbols = [0] * 7
    assert bpe.merge(symbols, {0: 0}, [1]) == 3 and symbols == [1, -1, 1, -1, 1, -1, 0]
