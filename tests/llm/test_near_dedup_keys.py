import numpy as np
from pyspark.sql import functions as F

from loamgraph.llm.near_dedup import Index, _keys, _left_out


def test_keys_of_one_partition_are_made_in_many_tasks(spark):
    index = Index()
    words = F.array(*(F.xxhash64("id", F.lit(c)) for c in range(index.chunks)))
    nodes = spark.range(4000).coalesce(1).select(F.col("id").alias("set_id"), words.alias("signature"))
    made = _keys(nodes, 4000, index).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.collect_set("set_id").alias("ids")).collect()
    assert sum(r["rows"] for r in made) == 4000 * index.chunks * len(_left_out(index))
    assert sorted(np.concatenate([r["ids"] for r in made]).tolist()) == list(range(4000))
    assert len(made) > 1 and max(r["rows"] for r in made) < 0.5 * sum(r["rows"] for r in made)
