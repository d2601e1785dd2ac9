"""The share of each grade that op7 keeps, on ratings it did not learn from, at sf0.1."""

from pyspark.sql import functions as F

from rolecall.llm import quality_classifier

DATA = "/root/testdata/sf0.1"


def test_kept_share_of_each_grade_and_of_long_toxic_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    grades = quality_classifier.quality_grades(spark.read.parquet(f"{DATA}/labels.parquet")).cache()
    held_out = grades.where("doc_id % 3 = 0")
    model = quality_classifier.train(docs, grades.where("doc_id % 3 <> 0"), n_grades=3)
    some = docs.join(held_out, "doc_id")
    kinds = some.select("doc_id", "grade", F.size(F.array_distinct(F.split(F.trim("text"), r"\s+"))).alias("kinds"))
    got = quality_classifier.classify(some, model, tail_from=2).join(kinds, "doc_id").toPandas()
    toxic, low, good = (got[got.grade == g] for g in (0, 1, 2))
    assert min(len(toxic), len(low), len(good)) > 100
    assert good.kept.mean() > 0.98
    assert low.kept.mean() < 0.3
    # 17 of 147 were kept, 3 of the 36 with 400 words or more of their own
    assert toxic[toxic.kinds < 400].kept.mean() < 0.2
    assert toxic[toxic.kinds >= 400].kept.mean() < 0.2
