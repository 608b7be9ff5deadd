"""What the steps hold and move follows their input: each would grow faster, or in one place, otherwise."""

import re

from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions import vectors as V
from quillspar.matrix import SparseMatrix
from quillspar.operators import elementwise as E
from quillspar.operators import products as P
from quillspar.plans import learner, shortlist
from quillspar.sources import formats
from quillspar.sources.scratch import Scratch, tasks


def matrix(spark, entries, n_rows, n_cols):
    return SparseMatrix.of(spark.createDataFrame(entries, "i long, j long, v double"), n_rows, n_cols)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_that_are_alike_share_rows(spark):
    """200 labels of two kinds: two rows of candidates a point, and the least labels of the better kind first."""
    xx = matrix(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0)], 2, 2)
    yy = matrix(spark, [(y, f, 1.0) for y in range(200) for f in ((0, 1) if y % 2 else (1,))], 200, 2)
    weights = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "xf long, yf long, w double")
    with Scratch(spark) as scratch:
        groups, members = shortlist.alike(yy, weights, 3, scratch)
        assert sorted(shortlist.reach(xx, groups, weights).select("x", "c", "n", "s").collect()) == [(0, 0, 100, 2.0), (0, 1, 100, 3.0), (1, 0, 100, 1.0), (1, 1, 100, 1.0)]
        assert members.count() == 6
        for found in (shortlist.shortlist(xx, yy, weights, 3, 10, scratch), shortlist.exact_shortlist(xx, yy, weights, 3, scratch)):
            assert sorted(found.df.collect()) == [(0, 1, 3.0), (0, 3, 3.0), (0, 5, 3.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]


def test_dense_blocks_of_many_features(spark):
    """A trillion features: only the blocks with entries are dense."""
    m = matrix(spark, [(0, 3, 2.0), (0, 10**12 - 1, 3.0), (5, 17, 4.0)], 6, 10**12)
    blocks = E.dense_blocks(m)
    assert blocks.agg(F.max(F.size("values"))).first()[0] == 16
    dots = blocks.groupBy("i").agg(F.sum(V.dot(F.col("values"), F.col("entries"))))
    assert sorted(dots.collect()) == [(0, 13.0), (5, 16.0)]


def test_products_are_dealt_by_entity_in_runs(spark):
    """Nothing is dealt by (i, j), and features far apart stay apart."""
    a = matrix(spark, [(0, 0, 1.0), (0, 5000, 2.0), (1, 5000, 3.0)], 2, 5001)
    b = matrix(spark, [(0, 0, 1.0), (0, 1, 10.0), (1, 1, 2.0)], 2, 2)
    out = P.product(a, b).df
    assert sorted(out.collect()) == [(0, 0, 1.0), (0, 5000, 32.0), (1, 5000, 6.0)]
    assert not re.search(r"hashpartitioning\(i#\d+L, j#", plan(out))
    assert sorted(P.product(a, b, norm_share=0.5).df.collect()) == [(0, 5000, 32.0), (1, 5000, 6.0)]


def test_tasks_follow_the_tables(spark):
    """Fifty times the table, more tasks; a table of unknown size has the session's number."""
    with Scratch(spark) as scratch:
        small, large = (scratch.stored(spark.range(n).select(F.rand(1).alias("i"), F.rand(2).alias("v"))) for n in (10_000, 500_000))
        assert tasks(small) == spark.sparkContext.defaultParallelism < tasks(large)
        at = lambda name: F.floor(F.col("v") * 100).cast("long").alias(name)
        names = lambda text: small.select(at("id"), F.lit(text).alias("name")).distinct()
        m = SparseMatrix(large.select(at("i"), at("j"), "v"), 100, 100)
        assert re.search(rf"hashpartitioning\(i#\d+L, {tasks(large, small)}\), REPARTITION_BY_NUM", plan(formats.report(m, names("a"), names("b"))))
        assert tasks(m.df, spark.createDataFrame([(1,)], "a long").rdd.toDF()) == 4


def test_a_binary_file_is_not_taken_for_a_small_table(spark, tmp_path):
    """What is read is not broadcast whole, as the list of places in the file would be."""
    m = matrix(spark, [(0, 0, 1.0), (2, 1, 2.0)], 3, 2)
    formats.write_binary(m, f"{tmp_path}/m.bin")
    back = formats.read_binary(spark, f"{tmp_path}/m.bin")
    assert sorted(back.df.collect()) == [(0, 0, 1.0), (2, 1, 2.0)]
    assert "BroadcastHashJoin" not in plan(back.df.alias("p").join(back.df.alias("q"), "i"))


def test_terms_are_counted_in_their_row(spark):
    """No shuffle of terms where ids are unique; rows of an id are added up where not."""
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    counts = T.term_counts(docs, T.tokens(F.col("text")))
    assert sorted(counts.collect()) == [(1, "a", 2), (1, "b", 1)]
    assert "Exchange" not in plan(counts)
    again = docs.union(spark.createDataFrame([(1, "b"), (None, "c c"), (None, "c")], docs.schema))
    assert sorted(T.term_counts(again, T.tokens(F.col("text"))).collect(), key=repr) == [(1, "a", 2), (1, "b", 2), (None, "c", 3)]


def test_instances_that_are_alike_are_one(spark):
    """Weights add up; what has no features counts too."""
    features = spark.createDataFrame([(x, 0, f, 0, 3.0 + f) for x in range(50) for f in range(2)], "x long, y long, xf long, yf long, v double")
    rows = spark.createDataFrame([(x, 0, 1 if x < 20 else -1, 2.0) for x in range(60)], "x long, y long, label int, c double")
    with Scratch(spark) as scratch:
        entries, kinds = learner.alike(features, rows, True, scratch)
        assert sorted(kinds.collect()) == [(0, 0, 1, 40.0), (20, 0, -1, 60.0), (50, 0, -1, 20.0)]
        assert sorted(entries.where("x = 0").select("xf", "v").collect()) == [(0, 0.6), (1, 0.8)]
