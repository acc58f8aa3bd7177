"""What op7's classifier learns from: all distinct labelled texts, and all typical words."""

from pyspark.sql import functions as F

from stackroom.llm import mixing

SF = "/root/testdata/sf0.1"


def test_labelled_texts_that_open_alike_all_count(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mixing.labelled_sample(docs, labels, mixing.domain_of(labels), "doc_id", "text", 20_000)
    want = docs.join(labels.select("doc_id", mixing.domain_of(labels).alias("domain")), "doc_id").where("text IS NOT NULL AND domain IS NOT NULL")
    by_domain = lambda df: {r["domain"]: r["n"] for r in df.groupBy("domain").agg(F.count_distinct("text").alias("n")).collect()}
    assert by_domain(got) == by_domain(want) and got.count() == got.distinct().count()


def test_words_below_the_sixteenth_mark_their_domain(spark):
    slurs = [f"slur{i:02}" for i in range(30)]
    rows = [(i, f"plain words of every text {i}", 0) for i in range(300)]
    rows += [(300 + i, f"plain words of every text {i} {slurs[i % 30]}", 1) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int")
    model = mixing.fit_domains(docs, labels, min_ratio=1.5)
    assert set(slurs) <= set(model.words)
    odds = mixing.add_posteriors(docs, model).where("doc_id >= 300").select("posteriors").collect()
    assert min(r["posteriors"][2] for r in odds) > 0.5
