"""The filter of wanted lines reaches the driver packed."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from pagemill.llm import lines


@pytest.mark.parametrize("count", [0, 1, 3_000, 200_000])
def test_filter_holds_all_ids_and_comes_in_pieces(spark, monkeypatch, tmp_path, count):
    spark.range(count).select(F.xxhash64("id").alias("id")).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    given = np.array([r.id for r in ids.collect()], np.int64)
    fetched, rows_of = [], DataFrame.toLocalIterator

    def counted(self, *rest, **named):
        for row in rows_of(self, *rest, **named):
            fetched.append(row)
            yield row

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, lambda self, name=name: pytest.fail(f"{name} brings a row for each word"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", counted)
    words = lines.id_filter(ids).value
    mask = 32 * len(words) - 1
    expected = np.zeros(len(words), np.uint32)
    np.bitwise_or.at(expected, (given & mask) >> 5, np.uint32(1) << (given & 31).astype(np.uint32))
    assert (words == expected).all() and len(fetched) <= -(-len(words) // lines.PIECE)
