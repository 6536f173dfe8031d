import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import bpe, langid, linededup, mixing

ODD = ["a.b", "__id", "__hash", "__gone", "__text", "__lang", "__plan", "__e", "__u", "__rank", "__more", "__whole", "__copy", "__key", "lang", "id", "own_0", "own_3", "Score", "w`x", "bpe", "N_Lines"]
LINE = "the very same words stand in this line of the text"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [f"{LINE}\nand number {i} of the words and lines and texts here is another one" for i in range(6)] + [None, ""]
    base = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return base.select("doc_id", "text", "source", *[(F.col("doc_id") * 100 + i).alias(n) for i, n in enumerate(ODD)])


def kept(rows, gone=()):
    for r in rows:
        fields = r.asDict()
        for i, n in enumerate(ODD):
            if n.lower() not in gone:
                assert fields[n] == fields["doc_id"] * 100 + i, n
    return rows


def test_operators_keep_columns_of_any_name(odd):
    lines = kept(linededup.dedup_lines(odd).collect(), ("n_lines",))
    assert sum(len(r.removed_lines) for r in lines) >= 5 and len(lines) == 8
    how = {"size": F.length("text"), "weight": F.col("id")}
    mixed = kept(mixing.pareto_mix(odd, mixing.mix_plan(odd, **how), **how).collect())
    assert len(mixed) == 8 and sum(r["size"] * r["copies"] for r in mixed) > 0
    model = langid.learn(odd.withColumn("lang", F.when(F.col("doc_id") < 3, "x").otherwise("y")))
    assert len(kept(langid.identify(odd, model).collect(), ("score",))) == 8
    assert len(kept(bpe.token_counts(odd, public_tokenizers.path("piece_bpe_32k.model")).collect())) == 8
    assert len(kept(bpe.bpe_digests(odd, public_tokenizers.path("word_bpe_49k.json")).collect())) == 8


def test_pipeline_stages_keep_columns_of_any_name(spark, odd):
    docs = odd.withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == r["doc_id"] * 100 + i for i, n in enumerate(ODD) if n != "lang"), name
