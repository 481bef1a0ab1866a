from pyspark.sql import functions as F

from quillstone.sources import datasets, synthetic


def test_datasets_keep_all_rules_and_dont_depend_on_partitions(spark):
    made = synthetic.facts(spark, 120, seed=7)
    corpus, manifest = synthetic.corpus(made), synthetic.manifest(made, 7)
    assert datasets.violations(corpus.persist(), manifest.persist()).collect() == []
    cases = datasets.cases_of(manifest)
    assert cases.count() == 720 and {r.kind for r in cases.select("kind").distinct().collect()} == set(datasets.KINDS)
    again = synthetic.facts(spark, 120, seed=7).repartition(7)
    assert sorted(made.collect()) == sorted(again.collect())
    assert made.exceptAll(synthetic.facts(spark, 300, seed=7)).count() == 0  # the same rows in a larger set
    other = synthetic.facts(spark, 120, seed=8)
    assert made.join(other, "n").where(made["amount"] == other["amount"]).count() < 10
    split = cases.groupBy(F.col("document_ids")[0]).agg(F.count_distinct("split").alias("n"))
    assert split.where("n > 1").count() == 0


def test_draws_are_even(spark):
    counts = spark.range(8000).select(synthetic.draw(1, F.col("id"), "x", 8).alias("v")).groupBy("v").count().collect()
    assert len(counts) == 8 and all(800 < r["count"] < 1200 for r in counts)
