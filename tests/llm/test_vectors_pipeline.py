"""Vector near-duplicates and the pipeline against brute force."""

import numpy as np

import corpus_pipeline
from gridloom.llm import embed_dedup
from gridloom.llm.common import components


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([centres, centres[:20] + 0.12 * rng.standard_normal((20, 64)), centres[:10] + 0.2 * rng.standard_normal((10, 64)), np.repeat(centres[:1], 5, 0)])
    rows = [(int(i), [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    bad = [(100, None, 0), (101, [0.0] * 64, 0), (102, [float("nan")] * 64, 0), (103, [None, *[1.0] * 63], 0), (104, [], 0), (105, [float("inf")] * 64, 0)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    y = np.array([r[1] for r in rows], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T) >= 0.95
    np.fill_diagonal(link, False)
    assert [got[i]["n_links"] for i in range(len(rows))] == link.sum(1).tolist()
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(rows))]
    assert [got[i]["component_id"] for i in range(len(rows))] == comp
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(100, 106)) and len(got) == len(rows) + 6
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_vectors_without_ids(spark):
    """Null ids link but name nothing; repeated ids and other columns of any name are no matter."""
    rng = np.random.default_rng(3)
    a, b, c = rng.standard_normal((3, 64))
    row = lambda i, v: (i, [float(x) for x in v], i, i)
    rows = [row(None, a), row(105, a + 0.01 * b), row(None, c), row(None, c), row(7, b), row(7, b), row(3, b)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls long, n long")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    want = [(None, 1, 105, False), (105, 1, 105, True), (None, 1, None, False), (None, 1, None, False), (7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True)]
    assert got == sorted(want, key=str)


def test_recall_by_length():
    """Share of pairs at a cosine of 0.95 that meet in some table, as the module's text states it."""
    rng = np.random.default_rng(8)
    for dim, least in ((1, 1.0), (2, 0.998), (16, 0.998), (64, 0.998), (128, 0.996), (256, 0.996), (768, 0.997)):
        n = 1500 if dim <= 128 else 800
        x = embed_dedup.unit_vectors(rng.standard_normal((n, dim)))
        y = rng.standard_normal((n, dim))
        if dim > 1:
            y -= (x * y).sum(1, keepdims=True) * x
        y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * embed_dedup.unit_vectors(y) * (dim > 1)
        a, b = embed_dedup.visits(x), embed_dedup.visits(y)
        met = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
        assert met.mean() >= least, (dim, met.mean())


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    one = rng.standard_normal(32)
    x = one + 0.02 * rng.standard_normal((60, 32))
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 16)
    got = embed_dedup.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {59} and {r["component_id"] for r in got} == {0}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_pipeline(spark, tmp_path):
    from tests.llm.test_text import docs, words

    texts = [words(60, i) + (" vilest scum vilest" if i % 4 == 1 else "") for i in range(200)] + [words(60, 0), "pw password=abcdefgh9 " + words(50, 900), None, ""]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "secret_scans", "packing"]
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols = d.columns
    kept = corpus_pipeline.drop_toxic(spark, d, str(tmp_path))
    assert kept.columns == cols and {r["doc_id"] for r in kept.collect()} == {i for i in range(204) if i >= 200 or i % 4 != 1}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {r["doc_id"] for r in rows}
    # 200 copies 0; of the null and the empty text one stays
    assert found == {i for i in range(200) if i % 4 != 1} | {201, 202}
