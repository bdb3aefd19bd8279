import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hitlake.llm import bpe, mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"


@pytest.fixture
def folder(spark, tmp_path):
    import random

    random.seed(1)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(f"p{k}" for k in range(70))
    rows = []
    for k in range(120):
        own = random.choices(words, k=80)
        if k % 4 == 0:
            own = [w for x in own for w in (x, "vile")]
        rows.append([k, " ".join(own), "en", f"s{k % 3}", 0, 7, "z"])
    rows[9][1] = rows[5][1]
    rows[13][1] = " ".join("changed" if i == 40 else w for i, w in enumerate(rows[5][1].split()))
    rows[21][1] += " " + passage
    rows[22][1] = passage + " " + rows[22][1]
    rows += [[200, None, None, None, None, None, None], [201, "", "en", "s0", 0, 1, ""]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/stage{k}"
        stage(spark, seen[-1], folder).write.parquet(out)
        seen.append(spark.read.parquet(out))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert dict(seen[-1].dtypes) == dict(docs.dtypes)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert {k for k in range(120) if k % 4} | {200, 201} == ids[1] - {k for k in range(0, 120, 4)}
    assert not any(k % 4 == 0 and k < 120 for k in ids[1])
    assert ids[1] - ids[2] == {9, 13, 201}
    assert ids[3] == ids[2]
    text = {r.doc_id: r for r in seen[3].collect()}
    assert "p0" in text[21].text.split() and "p0" not in text[22].text.split() and text[22].n_chars == len(text[22].text)
    assert text[5].text == {r.doc_id: r.text for r in docs.collect()}[5]
    sizes = {r.source: r.n for r in seen[4].groupBy("source").agg(F.sum(mixing.size(F.col("text"))).alias("n")).collect()}
    assert sizes["s0"] > sizes["s2"]
    path = P.path(corpus_pipeline.VOCABULARY)
    want = {r.doc_id: (bytes(r.ids)) for r in bpe.encode(seen[4], path, P.PATTERN).collect()}
    got = seen[5].collect()
    assert all(bytes(r.ids) == want[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in got) and len(got) == seen[4].count()


def test_stages_stand_odd_rows_and_nothing(spark, edge, empty, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, columns with clashing names; then no rows at all."""
    plain = ["doc_id", "text", "lang", "source", "n_chars", "label", "h", "vector"]
    for name, df in (("edge", edge), ("empty", empty)):
        df.select(plain).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(k, 1, int(name == "empty")) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/edge").collect()
    assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7} and all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert {None, 1, 4, 5, 7} <= {r.doc_id for r in rows} and not {2, 3, 6} & {r.doc_id for r in rows}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_every_operator_has_a_query():
    names = sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES)
    assert names == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing sources", "byte-level BPE"]


@pytest.mark.parametrize("name", ["op7_substring_dedup", "op8_mix_sources", "op9_embedding_near_dedup"])
def test_query_agrees_with_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, folder).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
