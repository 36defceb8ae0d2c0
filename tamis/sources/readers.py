"""Readers: registry, provenance texts, passages, vectors, thresholds, labels, prompts, profiler runs, fetched files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "sujet", "regime", "titre", "editeur", "annee", "langue", "portee", "licence")],
        T.StructField("licence_confirmee_dans_le_pdf", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("url_pdf", "fichier")],
        T.StructField("octets_attendus", T.LongType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("caveats", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.StringType()) for n in ("utilite_conseil", "extraction")],
        T.StructField("pages_utiles", T.IntegerType()),
        T.StructField("car_utiles", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("page_notice", "doi", "licence_citation", "exclusion", "exclusion_motif")],
        T.StructField("index_pages_utiles", T.ArrayType(T.IntegerType())),
    ]
)
CHUNK = "i bigint, doc string, titre string, editeur string, annee string, langue string, licence string, regime string, page int, citation_verbatim_autorisee string, sujet string, portee string, utilite_conseil string, off array<bigint>, car int, structure string, texte string"
LABEL = "id string, langue string, niveau_attendu string, mode string, requete string, ancres array<string>, bons array<bigint>, provenance array<struct<i: bigint, doc: string, page: int, regime: string, editeur: string, annee: string, langue: string, citation_verbatim_autorisee: string>>, pieges array<struct<i: bigint, doc: string, page: int, apercu: string>>"
RUN = "throughput struct<tokens_per_second_generation: double, first_token_latency_ms: double, prompt_tokens: int, generated_tokens: int>, memory struct<peak_rss_mb: double, steady_state_rss_mb: double, peak_vms_mb: double>, accuracy array<struct<benchmark: string, dataset_version: string, language: string, samples: int, score: double, metric: string>>, cpu_thermal struct<cpu_percent_p99: double, core_temp_c_peak: double, throttled: boolean>"


def registry(spark: SparkSession, path: str, key: str = "sources") -> DataFrame:
    """The source registry from YAML (a list, or a mapping with the list under `key`) or JSON lines. Years and other scalars
    become strings where the schema says so. The file is a registry of hand-kept entries and is read on the driver."""
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(REGISTRY).json(path)
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f)
    rows = rows.get(key, []) if isinstance(rows, dict) else rows or []
    text = {f.name for f in REGISTRY.fields if isinstance(f.dataType, T.StringType)}
    return spark.createDataFrame([tuple(str(r[f.name]) if f.name in text and r.get(f.name) is not None else r.get(f.name) for f in REGISTRY.fields) for r in rows], REGISTRY)


def provenance_texts(spark: SparkSession, path: str) -> DataFrame:
    """`fichier`, `text`: each file whole, line ends as they are, so that offsets are exact."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("fichier"), F.decode("content", "UTF-8").alias("text"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Passages from JSON lines, `off` as a struct."""
    df = spark.read.schema(CHUNK).json(path)
    return df.withColumn("off", F.when(F.col("off").isNotNull(), F.struct(F.get("off", F.lit(0)).alias("a"), F.get("off", F.lit(1)).alias("b"))))


def vectors(spark: SparkSession, path: str, rows_per_part: int = 65_536) -> DataFrame:
    """`i`, `embedding` from a .npy matrix, read by the executors in row ranges through a memory map; float16 becomes float."""
    import numpy as np

    head = np.load(path, mmap_mode="r")
    n, name = int(head.shape[0]), path
    parts = spark.range(0, max(1, -(-n // rows_per_part)), numPartitions=max(1, -(-n // rows_per_part)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = np.load(name, mmap_mode="r")
            for p in b.column(0).to_pylist():
                x = np.asarray(m[p * rows_per_part : (p + 1) * rows_per_part], np.float32)
                off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int64) + p * rows_per_part), pa.ListArray.from_arrays(off, pa.array(x.ravel()))], ["i", "embedding"])

    return parts.mapInArrow(run, "i bigint, embedding array<float>")


def postings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(`terme`, `i`, `tf`), (`i`, `dl`) and the statistics of one JSON document of postings."""
    raw = spark.read.schema("k1 double, b double, n_chunks bigint, avgdl double, doclen array<int>, postings map<string, array<array<bigint>>>").json(path, multiLine=True)
    p = raw.select(F.explode("postings").alias("terme", "l")).select("terme", F.explode("l").alias("x")).select("terme", F.col("x")[0].alias("i"), F.col("x")[1].cast("int").alias("tf"))
    d = raw.select(F.posexplode("doclen").alias("i", "dl")).select(F.col("i").cast("bigint").alias("i"), "dl")
    return p, d, raw.select("k1", "b", "n_chunks", "avgdl").first().asDict()


def thresholds(path: str) -> dict:
    """The threshold document, after its guards: the first gate has no scalar threshold, the second compares by >= and names
    its statistic, a fallback and a threshold."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    gate = doc.get("porte_niveau_2_contre_3", {})
    first = json.dumps(doc.get("porte_niveau_1_contre_2", {}), ensure_ascii=False)
    if "AUCUN seuil scalaire" not in first:
        raise ValueError("the first gate must say that it has no scalar threshold")
    if ">=" not in str(gate.get("sens", "")):
        raise ValueError("the second gate must compare by >=")
    missing = [k for k in ("statistique", "repli_si_absente", "seuil") if gate.get(k) is None]
    if missing:
        raise ValueError(f"the second gate lacks {missing}")
    return gate


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions from JSON lines; blank lines are skipped."""
    return spark.read.schema(LABEL).json(path).where("id is not null")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """`prompt_id`, `prompt` of the metadata; a prompt without text is an error."""
    rows = spark.read.schema("test_prompts array<struct<prompt_id: string, prompt: string>>").json(path, multiLine=True).select(F.explode("test_prompts").alias("p")).select("p.*")
    return rows.withColumn("prompt", F.coalesce("prompt", F.raise_error(F.lit("a test prompt has no key `prompt`")).cast("string")))


def profiler_runs(spark: SparkSession, path: str) -> DataFrame:
    """Profiler results, one per file; unreadable files give no row."""
    df = spark.read.schema(RUN + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return df.withColumn("fichier", F.input_file_name()).where("_corrupt_record is null").drop("_corrupt_record")


def fetched(spark: SparkSession, path: str, registry_df: DataFrame, regime: str = "tout") -> DataFrame:
    """`fichier`, `octets_attendus`, `octets`, `etat` (ok, absent, taille) of the registry's files against those under `path`."""
    want = registry_df.where((F.lit(regime) == "tout") | (F.col("regime") == regime)).select("fichier", "octets_attendus").where("fichier is not null").distinct()
    have = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("fichier"), F.col("length").alias("octets")) if os.path.isdir(path) and os.listdir(path) else spark.createDataFrame([], "fichier string, octets bigint")
    state = F.when(F.col("octets").isNull(), "absent").when(F.col("octets") != F.col("octets_attendus"), "taille").otherwise("ok")
    return want.join(have, "fichier", "left").withColumn("etat", state)
