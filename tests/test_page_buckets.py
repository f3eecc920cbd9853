"""Pages are stored in as many buckets as shuffles have partitions."""

from corpusloom.sources.stored import save_pages


def test_buckets_follow_the_partitions(spark):
    pages = spark.range(300).selectExpr("id % 30 as id", "cast(id div 30 as int) as page", "'x' as text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (3, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            stored = save_pages(pages, "id")
            assert stored.count() == 300 and len(stored.inputFiles()) == n
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
