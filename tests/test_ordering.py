import random

from pyspark.sql import functions as F

from tidewatch.operators import ordering as O


def frame(spark, n=500, seed=3):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 5000), n)
    rows = [(i, "hot" if rng.random() < .6 else rng.choice("abc"), rng.choice([0, 1])) for i in ids]
    return rows, spark.createDataFrame(rows, "id bigint, k string, v int")


def test_position_matches_sorting(spark):
    rows, df = frame(spark)
    for keys in ([], ["k"]):
        for width in (7, 100, 1 << 20):
            got = {r.id: r.pos for r in O.with_position(df, ["id"], O.id_bucket("id", width), keys).collect()}
            for key in {r[1] for r in rows} if keys else {None}:
                ids = sorted(r[0] for r in rows if key is None or r[1] == key)
                assert all(got[i] == p for p, i in enumerate(ids, 1))
    down = O.with_position(df, [F.desc("id")], O.id_bucket("id", 64, descending=True)).collect()
    expect = {i: p for p, i in enumerate(sorted((r[0] for r in rows), reverse=True), 1)}
    assert {r.id: r.pos for r in down} == expect


def test_position_of_sparse_ids(spark, monkeypatch):
    """Ids far apart: as many slices as rows, summed up span by span."""
    rng = random.Random(9)
    ids = sorted(rng.randrange(-2**62, 2**62) for _ in range(400)) + [2**62 + i for i in range(5)]
    df = spark.createDataFrame([(i, rng.choice("ab")) for i in ids], "id bigint, k string")
    for span in (O.SPAN_SLICES, 1 << 41):
        monkeypatch.setattr(O, "SPAN_SLICES", span)
        got = {r.id: (r.pos, r.n) for r in O.with_position(df, ["id"], O.id_bucket(), total="n").collect()}
        assert got == {i: (p, len(ids)) for p, i in enumerate(ids, 1)}
        keyed = O.with_position(df, [F.desc("id")], O.id_bucket(descending=True), ["k"], first=7).collect()
        for key in "ab":
            top = sorted((r.id for r in df.where(F.col("k") == key).collect()), reverse=True)[:7]
            assert {r.id: r.pos for r in keyed if r.k == key} == {i: p for p, i in enumerate(top, 1)}


def test_rolling_mean_across_blocks(spark):
    rows, df = frame(spark)
    for keys in ([], ["k"]):
        got = {r.id: r.rolling for r in O.rolling_mean(df, F.col("v"), keys=keys, width=13).collect()}
        assert len(got) == len(rows)
        for key in {r[1] for r in rows} if keys else {None}:
            part = sorted(r for r in rows if key is None or r[1] == key)
            for i, r in enumerate(part):
                seen = [x[2] for x in part[max(0, i - 11):i + 1]]
                expect = sum(seen) / len(seen) if len(seen) >= 3 else None
                assert got[r[0]] == expect or abs(got[r[0]] - expect) < 1e-12


def test_ewma_across_blocks(spark):
    rows, df = frame(spark)
    for keys in ([], ["k"]):
        for alpha in (0.5, 0.2):
            got = {r.id: r.ewma for r in O.ewma(df, F.col("v"), alpha, keys, width=50, block=3).collect()}
            assert len(got) == len(rows)
            for key in {r[1] for r in rows} if keys else {None}:
                s = None
                for i, _, v in sorted(r for r in rows if key is None or r[1] == key):
                    s = v if s is None else alpha * v + (1 - alpha) * s
                    assert abs(got[i] - s) < 1e-12


def test_keep_first_and_duplicates(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "b", "y"), (2, "a", "z"), (9, "b", "w")], "id int, t string, o string")
    assert sorted(map(tuple, O.keep_first(df, "t", "id").collect())) == [(1, "b", "y"), (2, "a", "z")]
    assert tuple(O.duplicate_count(df, "t").first()) == (4, 2, 2)
    assert tuple(O.duplicate_count(df.where("id > 99"), "t").first()) == (0, 0, 0)


def test_latest_prunes_before_the_shuffle(spark):
    rows, df = frame(spark)
    got = O.latest(df, 5, ["k"])
    for key in {r[1] for r in rows}:
        assert sorted(r.id for r in got.where(F.col("k") == key).collect()) == sorted(
            r[0] for r in rows if r[1] == key)[-5:]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_split_sample_shuffle(spark):
    rows, df = frame(spark)
    split = O.stratified_split(df, "id", 25, 42, "k")
    counts = {(r.k, r.split): r["count"] for r in split.groupBy("k", "split").count().collect()}
    for key in {r[1] for r in rows}:
        n = sum(r[1] == key for r in rows)
        assert counts[(key, "test")] == -(-n * 25 // 100)
        assert counts[(key, "test")] + counts.get((key, "train"), 0) == n
    sample = O.sample_capped(df, 20, "id", 42, ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in sample} == {
        k: min(20, sum(r[1] == k for r in rows)) for k in {r[1] for r in rows}}
    shuffled = O.seeded_shuffle(df, "id", 42).orderBy("pos").collect()
    assert [r.pos for r in shuffled] == list(range(1, len(rows) + 1))
    assert [r.id for r in shuffled] != sorted(r.id for r in shuffled)
