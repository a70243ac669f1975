"""Dataset queries on small tables that the given ones don't cover."""

from pyspark.sql import functions as F

from cmdlake.operators import datasets
from cmdlake.plans import dataset_queries


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_decontaminated_by_key(spark, tmp_path):
    texts = ["A passage of the benchmark.", "  a Passage\tof the\n\nbenchmark. ", "another text", "a passage of thebenchmark.", None]
    sf = write(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"), benchmark=([(1, "A  passage of the benchmark.")], "item_id long, text string"))
    left = {r.doc_id for r in dataset_queries.joi1_decontaminated(spark, sf).collect()}
    assert {2, 3} <= left and not left & {0, 1}


def test_set_sides_of_whole_tables(spark, tmp_path):
    documents = [(i, t) for i, t in enumerate(["a b", "c", "shared", " SHARED ", "in\nboth", "a  b"])]
    sf = write(spark, tmp_path, documents=(documents, "doc_id long, text string"), benchmark=([(1, "Shared"), (2, "in both"), (3, "other")], "item_id long, text string"))
    sides = [r.side for r in dataset_queries.set2_whole_tables(spark, sf).collect()]
    assert sorted(sides) == ["both", "both", "left", "left"]


def test_all_nations(spark):
    sf = "/root/testdata/sf0.001"
    pairs = dataset_queries.dst6_all_nations(spark, sf).select("p_partkey", "n_nationkey").distinct().count()
    assert pairs == spark.read.parquet(f"{sf}/part.parquet").count() * spark.read.parquet(f"{sf}/nation.parquet").count()


def test_split_audit(spark):
    rows = [("train", "a", "x"), ("train", "a", "y"), ("train", "b", "x"), ("test", "a", "x"), ("test", "b", "x"), ("test", "c", "x")]
    df = spark.createDataFrame(rows, "split string, key string, label string")
    got = {(r.left_split, r.right_split): (r.shared, r.conflicting) for r in datasets.split_audit(df, F.col("key"), "label", "split").collect()}
    assert got == {("test", "test"): (3, 0), ("train", "train"): (2, 1), ("test", "train"): (2, 1)}
