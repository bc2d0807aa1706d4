"""Folders of many small images are read by few tasks."""

import numpy as np

from datakiln.sources import images


def test_many_small_images_are_read_by_few_tasks(spark, tmp_path):
    data = images.png_bytes(np.zeros((8, 8, 3), np.uint8))
    for i in range(600):
        (tmp_path / f"{i}.png").write_bytes(data)
    rows = images.read_images(spark, f"file://{tmp_path}")
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism  # Spark would make 19
    assert rows.select("origin").distinct().count() == 600
