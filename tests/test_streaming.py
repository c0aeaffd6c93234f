from wordloom.plans import catalog
from wordloom.streaming import scan


def test_counts_of_arriving_files(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    folder = str(tmp_path / "rows")
    rows.filter("vec_id % 2 = 0").select("vec_id", "embedding", "label").write.parquet(folder)
    query = scan.watch(spark, folder, "seen", str(tmp_path / "state"))
    query.processAllAvailable()
    first = spark.table("seen").groupBy().sum("n").first()[0]
    rows.filter("vec_id % 2 = 1").select("vec_id", "embedding", "label").write.mode("append").parquet(folder)
    query.processAllAvailable()
    got = {r.tensor: (r.n_words, r.bits) for r in scan.entropy(spark.table("seen")).collect()}
    query.stop()
    assert 0 < first < sum(n for n, _ in got.values())
    want = {r.tensor: r.bits for r in catalog.queries()["field_entropy"](spark, data).filter("field = 'exponent'").collect()}
    assert {t: round(b, 5) for t, (_, b) in got.items()} == {t: round(b, 5) for t, b in want.items()}
