"""The chain of all programs, with a mapper that makes positions up."""

import os

from pyspark.sql import functions as F

from readloom import catalog, views
from readloom.params import DedupParams, PeakParams, TrimParams
from readloom.plans import workflow


def mapper(reads):
    pos = F.pmod(F.xxhash64("seq"), F.lit(3000))
    return reads.select(F.col("read_no").alias("rec_no"), F.col("id").alias("qname"), F.lit("chr1").alias("chrom"), pos.alias("pos0"), (F.pmod(F.xxhash64("id"), F.lit(2)) * 16).cast("int").alias("flag"), F.length("seq").alias("seq_len"), F.lit(None).cast("int").alias("xm"))


def test_workflow(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    args = (spark, views.reads(spark, sf), views.chroms(spark), mapper, out, TrimParams(trim_left=4, trim_tag=True, quality=20, quality_min_length=5), DedupParams(), PeakParams(fragment_length=60, deviation=40))
    first = workflow.run(*args, catalog.barcodes(spark), catalog.adapters(spark))
    n = {k: v.count() for k, v in first.items()}
    assert n["reads"] == n["mapped"] >= n["deduplicated"] > 0 and first["mapped"].where("qname like '%:TL:%'").count() > 0
    stamp = os.path.getmtime(f"{out}/mapped/_SUCCESS")
    again = workflow.run(*args, catalog.barcodes(spark), catalog.adapters(spark))
    assert {k: v.count() for k, v in again.items()} == n and os.path.getmtime(f"{out}/mapped/_SUCCESS") == stamp
    assert {"statistics", "duplication", "peaks", "runinfo"} <= set(os.listdir(f"{out}/reports"))
    assert workflow.run_info(spark, TrimParams(), PeakParams()).where("option = 'min_overlap'").first()["value"] == "4"
