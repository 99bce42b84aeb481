"""Nulls, empty and very long texts, repeated rows, empty tables, and other columns of the names that the operators use."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import chat, fingerprint, packing, passages, quality, secrets, simhash, toxicity, unigram
from gridloom.llm.queries import tokenizer_path
from tests.llm.test_text import words

OTHERS = ["spans", "row", "near", "fp", "h", "marks", "cls", "key", "score", "ids", "b", "rn", "y", "half", "kind", "grp", "again", "fps"]
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in OTHERS)
LONG = words(20_000, 44)
ROWS = [(None, words(80, 1)), (None, words(80, 1)), (None, None), (1, words(70, 2)), (1, words(70, 2)), (1, words(70, 3)), (2, ""), (3, LONG), (4, None), (5, " \n\t "), (6, words(80, 1))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if t is None else len(t), *(c for c in OTHERS)) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (6, 0, 1), (6, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    path, pieces = tokenizer_path("word_bpe_49k.json"), unigram.load_pieces(tokenizer_path("piece_bpe_32k.model"), ranks=True)
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
        "packing": lambda d: packing.pack_documents(d, path),
        "simhash": simhash.near_duplicates,
        "secrets": secrets.scan,
        "passages": passages.repeated,
        "fingerprint": fingerprint.digest,
        "unigram": lambda d: unigram.encode_documents(d, pieces),
    }


def test_every_row_has_its_result(spark, odd, labels):
    ids = sorted((i for i, _ in ROWS), key=str)
    for name, run in operators(spark, labels).items():
        got = run(odd).collect()
        if name == "passages":
            assert {r["doc_id"] for r in got} == set()  # id 1 is one document; null ids take no part
        elif name == "packing":
            assert sorted((r["doc_id"] for r in got if r["start"] == 0), key=str) == ids
            assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
        else:
            assert sorted((r["doc_id"] for r in got), key=str) == ids, name


def test_no_rows_give_no_rows(spark, odd, labels):
    for name, run in operators(spark, labels).items():
        assert run(odd.limit(0)).count() == 0, name
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, part long, mask string")
    assert chat.rotate(turns).count() == 0


def test_text_ids(spark, odd, labels):
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    texts = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for name, run in operators(spark, texts).items():
        if name in ("passages", "fingerprint"):
            with pytest.raises(ValueError):
                run(named)
        else:
            assert run(named).select("doc_id").distinct().count() == 7, name


def test_repeated_ids_keep_each_text(spark, odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # of the empty texts the one of id 2 stays; id 1 has two texts; id 6 has the text of rows without an id, which stay
    assert rows == sorted([ROWS[0], ROWS[1], ROWS[2], (1, words(70, 2)), (1, words(70, 3)), (2, ""), (3, LONG), (6, words(80, 1))], key=str)


def test_stages_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString(), name
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        if name != "simhash_near_dedup":
            assert got == sorted(ROWS, key=str), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        assert all(r["spans"] == "spans" and r["row"] == "row" for r in out.select("spans", "row").collect())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 6} and all(0 <= r["ids_crc32"] < 1 << 32 for r in rows)
    assert zlib.crc32(b"") == 0


def test_chat_of_odd_turns(spark):
    rows = [(None, 1, "ann", "x", "p"), (None, 1, "ann", "x", "p"), (1, None, None, None, "p"), (1, 3, "system", "s", "p"), (1, 3, "bob", words(20_000, 5), "p")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")).collect()
    assert sorted(((r["conv_id"], r["participant"]) for r in got), key=str) == sorted([(None, "ann"), (1, "bob"), (1, "bob"), (1, "unknown"), (1, "unknown")], key=str)
