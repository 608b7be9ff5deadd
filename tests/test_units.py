"""Hand-made matrices, the halving scan, learners, formats and the stemmer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspar.functions import text as T
from quillspar.functions.stem import stem
from quillspar.matrix import SparseMatrix
from quillspar.operators import elementwise as E
from quillspar.operators import products as P
from quillspar.operators import setops as O
from quillspar.plans import learner, metrics, mining, scoring, shortlist
from quillspar.plans.params import Params
from quillspar.sources import formats


def matrix(spark, entries, n_rows, n_cols):
    return SparseMatrix(spark.createDataFrame(entries or [], "i long, j long, v double"), n_rows, n_cols)


def cells(m):
    return {(r.i, r.j): r.v for r in m.df.collect()}


def test_shapes_survive_empty_rows(spark):
    m = matrix(spark, [(0, 1, 2.0), (2, 3, 4.0)], 3, 4)
    assert cells(E.append_bias(m, 1.0)) == {(0, 1): 2.0, (2, 3): 4.0, (0, 4): 1.0, (1, 4): 1.0, (2, 4): 1.0}
    with pytest.raises(ValueError):
        O.add(m, matrix(spark, [], 3, 5))


def test_products(spark):
    a = matrix(spark, [(0, 0, 1.0), (1, 0, -1.0), (2, 0, 2.0), (3, 0, -3.0), (4, 0, -1.0)], 5, 1)
    b = matrix(spark, [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0)], 2, 5)
    assert cells(P.product(a, b)) == {(0, 0): 2.0, (1, 0): -4.0}
    assert cells(P.product(a, b, "max")) == {(0, 0): 2.0, (1, 0): 0.0}
    assert cells(P.product(a, b, "mean"))[1, 0] == -2.0


def test_product_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.integers(-3, 4, (6, 5)).astype(float), rng.integers(-3, 4, (7, 6)).astype(float)
    as_matrix = lambda z: matrix(spark, [(int(i), int(j), float(z[i, j])) for i, j in np.argwhere(z)], *z.shape)
    got = np.zeros((7, 5))
    for (i, j), v in cells(P.product(as_matrix(x), as_matrix(y))).items():
        got[i, j] = v
    assert (got == y @ x).all()


def test_larger_and_max_norm(spark):
    a, b = matrix(spark, [(0, 0, -1.0)], 1, 3), matrix(spark, [(0, 1, -2.0), (0, 2, 3.0)], 1, 3)
    assert cells(O.larger(a, b)) == {(0, 0): -1.0, (0, 2): 3.0}
    assert sorted(cells(E.normalise(matrix(spark, [(0, 0, -4.0), (0, 1, -2.0)], 1, 2), "max")).values()) == [1.0, 2.0]


def test_names_and_score(spark):
    names = spark.createDataFrame([("t_red_x",), ("plain",), ("__label__1__a",)], "name string")
    assert [r[0] for r in names.select(mining.after_prefix(F.col("name"))).collect()] == ["red_x", "plain", "_label__1__a"]
    row = spark.createDataFrame([(2, 4, 3, 2, 1)], "co long, f1 long, f2 long, a1 long, a2 long")
    assert abs(row.select(P.association(0.5)).first()[0] - 2 / 3.5) < 1e-12
    levels = spark.createDataFrame([(1.0,), (0.5,), (0.49,), (2.0**-19,), (9e-7,)], "m double")
    assert [r[0] for r in levels.select(shortlist.level(F.col("m"))).collect()] == [0, 1, 2, 19, None]
    p = spark.createDataFrame([(1.0,), (0.0,), (2.0,)], "p double")
    assert [r[0] for r in p.select(scoring.link(F.col("p"), 0)).collect()] == pytest.approx([1, np.exp(-1), 1])


def test_shortlist_is_the_halving_scan(spark):
    rng = np.random.default_rng(4)
    p = {yf: float(v) for yf, v in enumerate(rng.random(12))}
    yy = [(y, int(f), float(v)) for y in range(60) for f, v in zip(rng.choice(12, 3, replace=False), rng.random(3))]
    k, factor = 5, 2
    found, limit = set(), 1.0
    for _ in range(20):
        if len(found) >= factor * k:
            break
        found |= {y for y, f, v in yy if p[f] >= limit and p[f] * v >= limit}
        limit /= 2
    s = {y: sum(p[f] * v for yy_, f, v in yy if yy_ == y) for y in found}
    want = sorted(found, key=lambda y: (-s[y], y))[:k]
    xx = matrix(spark, [(0, 0, 1.0)], 1, 1)
    weights = spark.createDataFrame([(0, f, v) for f, v in p.items()], "xf long, yf long, w double")
    got = shortlist.shortlist(xx, matrix(spark, yy, 60, 12), weights, k, factor).df.collect()
    assert {r.j for r in got} == set(want)


@pytest.mark.parametrize("kind,penalty", [(0, "l2"), (1, "l2"), (1, "l1")])
def test_learner_reaches_the_optimum(spark, kind, penalty):
    rng = np.random.default_rng(kind)
    x = rng.standard_normal((40, 4))
    y = np.sign(x[:, 0] - 0.5 * x[:, 1] + 0.3)
    features = spark.createDataFrame([(i, 0, j, 0, float(x[i, j])) for i in range(40) for j in range(4)], "x long, y long, xf long, yf long, v double")
    rows = spark.createDataFrame([(i, 0, int(y[i]), 0.5 if penalty == "l1" else 1.0) for i in range(40)], "x long, y long, label int, c double")
    model = learner.fit(features, rows, kind, rounds=60, normalise=False, tolerance=1e-6, penalty=penalty)
    w = [r.w for r in model.orderBy(F.col("xf").asc_nulls_last()).collect()]
    w, z = np.array(w), np.column_stack([x, np.ones(40)])
    m = z @ w
    slope = -2 * y * np.maximum(0, 1 - y * m) if kind == 0 else -y / (1 + np.exp(y * m))
    g = z.T @ slope * (0.5 if penalty == "l1" else 1)
    if penalty == "l2":
        assert np.linalg.norm(w + g) < 1e-3
    else:
        assert (w == 0).any() and (w != 0).any()
        assert all(abs(g[k] + np.sign(w[k])) < 1e-3 if w[k] else abs(g[k]) <= 1 + 1e-3 for k in range(5))
    assert max(r.residual for r in learner.residuals(features, rows, model, kind, False, penalty).collect()) < 1e-3


def test_metrics_by_hand(spark):
    scores = matrix(spark, [(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.7)], 2, 4)
    truth = matrix(spark, [(0, 1, 1.0), (0, 3, 1.0)], 2, 4)
    got = {(r.metric, r.k): r.value for r in metrics.ranking_metrics(scores, truth, None, 2).collect()}
    d = 1 / np.log2(3)
    assert got["P", 1] == 0 and got["P", 2] == 50 and got["nDCG", 2] == pytest.approx(100 * d / (1 + d))


def test_formats(spark, tmp_path):
    m = matrix(spark, [(0, 2, 0.5), (0, 3, 0.4), (2, 5, 0.25)], 3, 6)
    assert [r.value for r in formats.text_rows(m, 2).orderBy("i").collect()] == ["2:0.50 3:0.40", "", "5:0.25"]
    (tmp_path / "m.txt").write_text("3 6\n2:0.5 3:0.4\n\n5:0.25\n")
    assert cells(formats.read_matrix(spark, str(tmp_path / "m.txt"))) == cells(m)
    (tmp_path / "short.txt").write_text("3 6\n2:0.5\n")
    with pytest.raises(ValueError):
        formats.read_text(spark, str(tmp_path / "short.txt"))
    for name in ("m.bin", "m.pybin"):
        formats.write_binary(m, str(tmp_path / name), planar=name == "m.pybin")
        back = formats.read_matrix(spark, str(tmp_path / name))
        assert (back.n_rows, back.n_cols) == (3, 6) and cells(back) == pytest.approx(cells(m))
    formats.write_parquet(m, str(tmp_path / "m.parquet"))
    assert cells(formats.read_matrix(spark, str(tmp_path / "m.parquet"))) == cells(m)
    (tmp_path / "k.txt").write_text("a\t0:1 3:2\nb\n")
    keyed, keys = formats.read_keyed(spark, str(tmp_path / "k.txt"), 2)
    assert cells(keyed) == {(0, 0): 1.0} and [r.key for r in keys.orderBy("i").collect()] == ["a", "b"]


def test_parameters():
    p = Params.parse(["-bs_count", "40", "-bs_count", "120", "-bilinear_normalize", "0"])
    assert p.bs_count == 120 and p.bilinear_normalize is False and '"bs_count": 120' in p.dump()
    with pytest.raises(ValueError):
        Params(bilinear_classifier_kind=2)


def test_stemmer():
    want = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "hoping": "hope", "generously": "generous", "national": "nation", "relational": "relat", "happiness": "happi", "skies": "sky", "dying": "die", "agreed": "agre", "consistency": "consist", "knightly": "knight", "cry": "cri", "say": "say", "by": "by", "gas": "gas", "communication": "communic"}
    assert {w: stem(w) for w in want} == want


def test_bigrams(spark):
    df = spark.createDataFrame([("a b c",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(T.bigrams(T.tokens(F.col("t")))).collect()] == [["a b", "b c"], [], []]


def tables(spark, tmp_path):
    """A small world: points with three features, labels with two, names that match."""
    rng = np.random.default_rng(5)
    xx = [(i, int(j), 1.0) for i in range(40) for j in rng.choice(6, 3, replace=False)]
    yy = [(y, int(f), 1.0) for y in range(8) for f in rng.choice(6, 2, replace=False)]
    of = {y: {f for a, f, _ in yy if a == y} for y in range(8)}
    xy = [(i, y, 1.0) for i in range(40) for y in range(7) if len(of[y] & {j for a, j, _ in xx if a == i}) == 2]
    names = [(k, f"word{k}") for k in range(6)]
    formats.write_matrix(matrix(spark, xx, 40, 6), f"{tmp_path}/xx.txt")
    formats.write_matrix(matrix(spark, yy, 8, 6), f"{tmp_path}/yy.bin")
    formats.write_matrix(matrix(spark, xy, 40, 8), f"{tmp_path}/xy.parquet")
    formats.write_names(spark.createDataFrame(names, "id long, name string"), f"{tmp_path}/wf")
    formats.write_names(spark.createDataFrame([(k, f"t_{n}") for k, n in names], "id long, name string"), f"{tmp_path}/wl")
    return ["-trn_X_Xf", f"{tmp_path}/xx.txt", "-tst_X_Xf", f"{tmp_path}/xx.txt", "-Y_Yf", f"{tmp_path}/yy.bin", "-trn_X_Y", f"{tmp_path}/xy.parquet", "-tst_X_Y", f"{tmp_path}/xy.parquet", "-Xf", f"{tmp_path}/wf", "-Yf", f"{tmp_path}/wl", "-bs_count", "6", "-shortyK", "8", "-res_dir", f"{tmp_path}/res", "-model_dir", f"{tmp_path}/res/model"], xx, yy, xy


def test_command_line_end_to_end(spark, tmp_path):
    """Stages one by one give what all at once give; true labels come first; the stream ranks as the batch does."""
    from quillspar.plans import pipeline
    from quillspar.streaming.score import score_stream

    args, xx, yy, xy = tables(spark, tmp_path)
    for stage in ("xhtp_approx", "xhtp_fine_tune", "predict"):
        pipeline.main([*args, "-type", stage])
    read = lambda name: spark.read.parquet(f"{tmp_path}/res/{name}.parquet")
    scores = {(r.x, r.y): r.score for r in read("scores").collect()}
    assert read("model/recall").first().recall == 100 and len(scores) == 40 * 8
    metrics_ = {(r.metric, r.k): r.value for r in read("metrics").collect()}
    assert set(metrics_) == {(m, k) for m in ("P", "nDCG", "PSP", "PSnDCG") for k in range(1, 6)} and metrics_["nDCG", 5] > 80
    pairs = {(x, y) for x, y, _ in xy}
    assert np.mean([scores[p] for p in pairs]) > np.mean([s for p, s in scores.items() if p not in pairs]) + 0.1
    model = read("model/model")
    t = {(r.xf, r.yf): r.w for r in model.collect()}
    unit = lambda m, k: {j: v / np.sqrt(sum(b * b for a, _, b in m if a == k)) for a, j, v in m if a == k}
    for x, y in list(scores)[:20]:  # scores by hand
        margin = sum(v * w * t.get((j, f), 0.0) for j, v in unit(xx, x).items() for f, w in unit(yy, y).items()) + t[None, None]
        match = sum(v * w for j, v in unit(xx, x).items() for f, w in unit(yy, y).items() if j == f)
        assert scores[x, y] == pytest.approx(0.9 * np.exp(-max(0, 1 - margin) ** 2) + 0.1 * match)
    p = Params.parse(args)
    maps = mining.Maps(*(read(f"model/{n}") for n in ("by_point", "by_label", "matches")))
    matrix(spark, xx, 40, 6).df.repartition(1).write.parquet(f"{tmp_path}/stream")
    entries = spark.readStream.schema("i long, j long, v double").parquet(f"{tmp_path}/stream")
    score_stream(entries, 6, matrix(spark, yy, 8, 6), maps, model, p, f"{tmp_path}/scored", f"{tmp_path}/checkpoint").awaitTermination()
    assert {(r.x, r.y): r.score for r in spark.read.parquet(f"{tmp_path}/scored").collect()} == pytest.approx(scores)
    pipeline.main([*args[:-4], "-res_dir", f"{tmp_path}/all", "-model_dir", f"{tmp_path}/all/model"])
    assert {(r.x, r.y): r.score for r in spark.read.parquet(f"{tmp_path}/all/scores.parquet").collect()} == pytest.approx(scores)


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        folder = tmp_path / "lines"
        folder.mkdir()
        want = []
        for f in range(3):
            lines = [f"{f} {k} " + "9 " * (k % 13) for k in range(200 + f)] if f != 1 else []
            (folder / f"part-{f}.txt").write_text("".join(x + "\n" for x in lines))
            want += lines
        got = formats.numbered_lines(spark, str(folder)).orderBy("n").collect()
        assert [(r.n, r.value) for r in got] == list(enumerate(want))
        values = formats.read_values(spark, str(folder)).orderBy("id").collect()
        assert [tuple(r) for r in values] == list(enumerate(float(t) for x in want for t in x.split()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_binary_files_in_runs(spark, tmp_path, monkeypatch):
    """Runs of a few entries, rows without any at both ends and in between, cut files."""
    rng = np.random.default_rng(7)
    entries = [(int(i), int(j), float(rng.integers(1, 9))) for i in rng.choice(np.arange(3, 60), 25, replace=False) for j in sorted(rng.choice(50, int(rng.integers(1, 9)), replace=False))]
    m = matrix(spark, entries, 70, 50)
    monkeypatch.setattr(formats, "_STEP", 16)
    for planar in (False, True):
        for prefix in (False, True):
            path = f"{tmp_path}/m{planar}{prefix}.bin"
            formats.write_binary(m, path, planar, prefix)
            back = formats.read_binary(spark, path, planar, prefix)
            assert (back.n_rows, back.n_cols) == (70, 50) and cells(back) == cells(m)
    whole = (tmp_path / "mFalseTrue.bin").read_bytes()
    (tmp_path / "cut.bin").write_bytes(whole[:-4])
    with pytest.raises(ValueError):
        formats.read_binary(spark, f"{tmp_path}/cut.bin")


def test_settings_from_a_file(tmp_path):
    (tmp_path / "settings").write_text("bs_count 7\nscore_alpha 0.5\n")
    p = Params.parse(["-bs_count", "3", f"@{tmp_path}/settings", "-F", "2"])
    assert (p.bs_count, p.score_alpha, p.F) == (7, 0.5, 2)


def test_bigrams_of_stems(spark):
    docs = spark.createDataFrame([(1, "Running ponies hop"), (2, ""), (3, "The national gas")], "id long, t string")
    got = {r.id: (r.words, r.b) for r in T.stemmed_words(docs, T.tokens(F.col("t"), ("the",))).select("id", "words", T.bigrams(F.col("words")).alias("b")).collect()}
    assert got == {1: (["run", "poni", "hop"], ["run poni", "poni hop"]), 2: ([], []), 3: (["nation", "gas"], ["nation gas"])}
