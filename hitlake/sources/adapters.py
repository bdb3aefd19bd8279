"""The provided tables in the shapes of hits, stamps and labels. Nothing here is known to an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same as SQL, for a WITH clause.
HITS_SQL = """raw as (select *, json_extract(props, '$.k')::int as k from events),
hits as (select event_id as id, event_id as "row", event_type as file, user_id::varchar as obsid, (k % 64)::int as beam, 700.0::double + value * 5.0::double as frequency,
  'src_' || user_id::varchar as "sourceName", k::int as "index", (k - k % 60)::int as "startChannel", (60 + k % 61)::int as "numChannels", user_id % 24 as ra, -(user_id % 90) as dec,
  (k % 9 - 4)::int as "driftSteps", (k % 9 - 4) * 0.01::double as "driftRate", value + 6.0::double as snr, (14 + k % 46)::int as "numTimesteps", floor(700.0::double + value * 5.0::double)::int as "coarseChannel",
  value * 1e15::double as power, case when k % 5 = 0 then 0.0::double else value * 1e15::double / (1 + k % 17) end as "incoherentPower"
  from raw)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, value, user = F.col("k"), F.col("value"), F.col("user_id")
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    steps, power = k % 9 - 4, value * F.lit(1e15)
    return raw.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("row"), F.col("event_type").alias("file"), user.cast("string").alias("obsid"), (k % 64).alias("beam"), (700.0 + value * 5.0).alias("frequency"),
        F.concat(F.lit("src_"), user.cast("string")).alias("sourceName"), k.alias("index"), (k - k % 60).alias("startChannel"), (60 + k % 61).alias("numChannels"), (user % 24).alias("ra"), (-(user % 90)).alias("dec"),
        steps.alias("driftSteps"), (steps * F.lit(0.01)).alias("driftRate"), (value + 6.0).alias("snr"), (14 + k % 46).alias("numTimesteps"), F.floor(700.0 + value * 5.0).cast("int").alias("coarseChannel"),
        power.alias("power"), F.when(k % 5 == 0, F.lit(0.0)).otherwise(power / (1 + k % 17)).alias("incoherentPower"), F.unix_timestamp("ts").cast("double").alias("tstart"),
    )


#: A spectrum of 64 channels for each vector; as 8 rows of 8 it is also a cutout.
SPECTRA_SQL = "spectra as (select vec_id as id, label, embedding::double[] as v from embeddings)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def cubes(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """(id, img): time steps of channels."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda t: F.slice("v", t * side + 1, side))
    return spectra(spark, sf_dir).select("id", "label", rows.alias("img"))


#: Clusters that are given: labels of the vectors on the hits of the same number.
GIVEN_SQL = HITS_SQL + """,
given as (select h.*, e.label::int as cluster, (e.vec_id % 7)::int as family from hits h join embeddings e on e.vec_id = h.id)"""


def given_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("cluster"), (F.col("vec_id") % 7).cast("int").alias("family"))
    return hits(spark, sf_dir).join(e, "id")


SCORES_SQL = "scored as (select d.doc_id as id, l.toxic::int as y, d.n_chars::double as s, d.source as grp from labels l join documents d on d.doc_id = l.doc_id)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"), F.col("n_chars").cast("double").alias("s"), F.col("source").alias("grp"))
