"""What jobs leave on disk."""

import os

import pytest
from pyspark.sql import functions as F

from weftwork.llm.jaccard_join import jaccard_report, one_of_each
from weftwork.llm.minhash import minhash_report
from weftwork.storage import fresh_path, passing, saved, shared_folder, written


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.length()))


def _folders(spark):
    at = shared_folder(spark).removeprefix("file:") + "/weftwork"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_saved_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = saved(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "test")
    assert rows.count() == 10 and {r["count"] for r in rows.collect()} == {100}
    assert _shuffle_files(spark) <= before + 4  # those of the count above


def test_passing_keeps_what_has_a_path_from_before(spark):
    before, path = _folders(spark), fresh_path(spark, "test-kept")
    with passing(spark):
        first = saved(spark.range(5), "test-gone")
        with passing(spark):
            saved(first, "test-gone")
        kept = written(first, path)
    assert kept.count() == 5
    assert _folders(spark) - before == {os.path.basename(path)}


def test_one_of_each_leaves_what_it_kept(spark):
    texts = [f"{'a b c d e f g h i j k l'} {i // 3} x y z {i // 3}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = _folders(spark)
    out = one_of_each(docs)
    assert [x.rsplit("-", 1)[0] for x in _folders(spark) - before] == ["kept"]
    assert sorted(r.doc_id for r in out.collect()) == [r for r in range(0, 30, 3)]


@pytest.mark.parametrize("report", [jaccard_report, minhash_report])
def test_reports_leave_only_themselves(spark, report):
    texts = [f"a b c d e f g h i j k l {i // 3} x y z {i // 3}" for i in range(30)]
    before = _folders(spark)
    out = report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [x.rsplit("-", 1)[0] for x in _folders(spark) - before] == ["report"]
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i - i % 3 for i in range(30)}
