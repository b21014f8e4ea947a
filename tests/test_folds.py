"""Ordered helpers and greedy folds against brute-force Python on random data."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lookout.functions import ordered as O
from lookout.operators import folds as FO


def _data(seed, n=400, keys=3, span=5000):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(keys)}"
        rows.append((k, i, rnd.randrange(span), rnd.randrange(100)))
    return rows


def _df(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, t long, v long")


def test_prefix_sums_and_lag(spark):
    rows = _data(1)
    df = _df(spark, rows)
    got = O.prefix_sums(df, ["key"], ["t", "id"], {"s": F.col("v")}).toPandas()
    lag = O.lag_values(df, ["key"], ["t", "id"], ["v"]).toPandas().set_index("id")
    pdf = pd.DataFrame(rows, columns=["key", "id", "t", "v"]).sort_values(["key", "t", "id"])
    pdf["s"] = pdf.groupby("key")["v"].cumsum()
    pdf["prev"] = pdf.groupby("key")["v"].shift(1)
    exp = pdf.set_index("id")
    got = got.set_index("id")
    for i in exp.index:
        assert got.loc[i, "s"] == exp.loc[i, "s"]
        pv = lag.loc[i, "prev_v"]
        assert (pd.isna(pv) and pd.isna(exp.loc[i, "prev"])) or pv == exp.loc[i, "prev"]


def test_rows_frame_and_range_count(spark):
    rows = _data(2)
    df = _df(spark, rows)
    fr = O.rows_frame(df, ["key"], ["t", "id"], 7, F.col("v"), "last").toPandas().set_index("id")
    rc = O.count_in_range(df, ["key"], "t", "id", 300, "c").toPandas().set_index("id")
    pdf = pd.DataFrame(rows, columns=["key", "id", "t", "v"]).sort_values(["key", "t", "id"])
    for _, g in pdf.groupby("key"):
        vals, ts, ids = g["v"].tolist(), g["t"].tolist(), g["id"].tolist()
        for j, i in enumerate(ids):
            assert list(fr.loc[i, "last"]) == vals[max(0, j - 6): j + 1]
            exp = sum(1 for q in range(j + 1) if ts[q] > ts[j] - 300)
            assert rc.loc[i, "c"] == exp


def _brute_periods(ts, period):
    out, start = [], None
    for t in ts:
        if start is None or t >= start + period:
            start = t
            out.append(True)
        else:
            out.append(False)
    return out


def _brute_rate(ts, budget, window):
    allowed, out = [], []
    for t in ts:
        live = [a for a in allowed if a > t - window]
        ok = len(live) < budget
        if ok:
            allowed.append(t)
        out.append(ok)
    return out


def test_period_and_rate_folds(spark):
    for seed in (3, 4):
        rows = _data(seed, n=500, span=3000)
        df = _df(spark, rows)
        per = FO.period_starts(df, ["key"], "t", "id", 60).toPandas().set_index("id")
        rate = FO.rate_limit(df, ["key"], "t", "id", 5, 100).toPandas().set_index("id")
        pdf = pd.DataFrame(rows, columns=["key", "id", "t", "v"]).sort_values(["key", "t", "id"])
        for _, g in pdf.groupby("key"):
            ids = g["id"].tolist()
            assert [bool(per.loc[i, "opens"]) for i in ids] == _brute_periods(g["t"].tolist(), 60)
            assert [bool(rate.loc[i, "allowed"]) for i in ids] == _brute_rate(g["t"].tolist(), 5, 100)


def test_rate_limit_never_exceeds_budget(spark):
    rows = _data(5, n=600, span=1000)
    df = _df(spark, rows)
    rate = FO.rate_limit(df, ["key"], "t", "id", 3, 50).toPandas()
    ok = pd.DataFrame(rows, columns=["key", "id", "t", "v"]).merge(rate, on=["key", "id"])
    ok = ok[ok["allowed"]]
    for _, g in ok.groupby("key"):
        ts = sorted(g["t"])
        for t in ts:
            assert sum(1 for x in ts if t - 50 < x <= t) <= 3


def test_block_state(spark):
    rows = [("1.1.1.1", 1, 0, "block_ip", 100), ("1.1.1.1", 2, 50, "block_ip", 150),
            ("1.1.1.1", 3, 120, "block_ip", 220), ("1.1.1.1", 4, 130, "unblock_ip", 0),
            ("1.1.1.1", 5, 140, "unblock_ip", 0)]
    df = spark.createDataFrame(rows, "target string, id long, t long, action string, until long")
    got = {r["id"]: r["outcome"] for r in
           FO.block_state(df, ["target"], "t", "id", "action", "until", 100).collect()}
    assert got == {1: "blocked", 2: "already_blocked", 3: "blocked", 4: "unblocked", 5: "not_blocked"}


def test_top_k_per_group(spark):
    rows = _data(6)
    df = _df(spark, rows)
    got = O.top_k_per_group(df, ["key"], [F.col("t").desc(), F.col("id").desc()], 5,
                            F.floor(F.col("t") / 500)).toPandas()
    pdf = pd.DataFrame(rows, columns=["key", "id", "t", "v"])
    for k, g in pdf.groupby("key"):
        exp = g.sort_values(["t", "id"], ascending=False)["id"].head(5).tolist()
        assert got[got["key"] == k].sort_values("rank")["id"].tolist() == exp


def test_parallel_periods_dense_hot_key(spark):
    """A key with continuous traffic (no gap to split at) across many buckets."""
    from lookout.functions.periods import period_starts
    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(2500):
        t += rnd.choice([1, 2, 3, 5])
        rows.append(("hot" if i % 5 else "cold", i, t))
    df = spark.createDataFrame(rows, "key string, id long, t long")
    for period in (7, 40):
        got = {r["id"]: bool(r["opens"]) for r in period_starts(df, ["key"], "t", "id", period,
                                                                levels=(4,)).collect()}
        pdf = pd.DataFrame(rows, columns=["key", "id", "t"]).sort_values(["key", "t", "id"])
        for _, g in pdf.groupby("key"):
            assert [got[i] for i in g["id"]] == _brute_periods(g["t"].tolist(), period)


def test_block_state_random_against_brute_force(spark):
    def brute(rows):
        cur, out = None, []
        for t, a, u in rows:
            blocked = cur is not None and t < cur
            if a == "block_ip":
                if blocked:
                    out.append("already_blocked")
                else:
                    cur = u
                    out.append("blocked")
            else:
                out.append("unblocked" if blocked else "not_blocked")
                cur = None
        return out
    rnd = random.Random(21)
    rows = []
    for i in range(1500):
        k = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(3)}"
        t = rnd.randrange(20000)
        rows.append((k, i, t, "block_ip" if rnd.random() < 0.7 else "unblock_ip",
                     t + rnd.choice([50, 300, 1000])))
    df = spark.createDataFrame(rows, "target string, id long, t long, action string, until long")
    got = {r["id"]: r["outcome"] for r in
           FO.block_state(df, ["target"], "t", "id", "action", "until", 1000).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "id", "t", "a", "u"]).sort_values(["k", "t", "id"])
    for _, g in pdf.groupby("k"):
        assert [got[i] for i in g["id"]] == brute(list(zip(g["t"], g["a"], g["u"])))


def test_folds_carry_state_across_arrow_batches(spark):
    """Tiny Arrow batches: every key and bucket spans many batches."""
    from lookout.functions.periods import period_starts
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rnd = random.Random(5)
        rows, t = [], 0
        for i in range(1500):
            t += rnd.choice([1, 2, 3])
            rows.append(("hot" if i % 4 else "k1", i, t,
                         "block_ip" if rnd.random() < 0.9 else "unblock_ip", t + rnd.choice([10, 40, 90])))
        df = spark.createDataFrame(rows, "key string, id long, t long, action string, until long")
        pdf = pd.DataFrame(rows, columns=["key", "id", "t", "a", "u"]).sort_values(["key", "t", "id"])
        per = {r["id"]: bool(r["opens"]) for r in period_starts(df, ["key"], "t", "id", 25, levels=(4, 2, 3)).collect()}
        rate = {r["id"]: bool(r["allowed"]) for r in FO.rate_limit(df, ["key"], "t", "id", 3, 20).collect()}
        blk = {r["id"]: r["outcome"] for r in
               FO.block_state(df, ["key"], "t", "id", "action", "until", 90).collect()}
        for _, g in pdf.groupby("key"):
            ids, ts = g["id"].tolist(), g["t"].tolist()
            assert [per[i] for i in ids] == _brute_periods(ts, 25)
            assert [rate[i] for i in ids] == _brute_rate(ts, 3, 20)
            cur, exp = None, []
            for x, a, u in zip(ts, g["a"], g["u"]):
                blocked = cur is not None and x < cur
                if a == "block_ip":
                    exp.append("already_blocked" if blocked else "blocked")
                    if not blocked:
                        cur = u
                else:
                    exp.append("unblocked" if blocked else "not_blocked")
                    cur = None
            assert [blk[i] for i in ids] == exp
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def _traffic(rng, n):
    """Times of one key: dense, bursty or sparse stretches after each other, with ties."""
    t, out = 0, []
    while len(out) < n:
        step = rng.choice([(0, 1), (0, 0, 1, 2), (3, 9), (1,), (40, 7, 1)])
        for _ in range(rng.randint(1, 60)):
            t += rng.choice(step)
            out.append(t)
    return out[:n]


def test_rate_tables_give_the_exit_for_every_entry():
    """Bucket by bucket: the exit read off a bucket's table, or known whatever
    the entry, is the plain fold's."""
    import numpy as np
    from lookout.functions import rates as RT
    rng, tables, known = random.Random(2), 0, 0
    for _ in range(400):
        budget, window, factor = rng.randint(1, 5), rng.randint(3, 40), rng.randint(2, 6)
        times = np.array(_traffic(rng, rng.randint(1, 400)), np.int64)
        hist, got = [], []
        for b in np.unique(times // (window * factor)).tolist():
            t, start = times[times // (window * factor) == b], b * window * factor
            allowed, after = RT.allowed_rows(t, hist, budget, window)
            got += allowed.tolist()
            exit_ = RT.known_exit(t, start, budget, window)
            if exit_ is None:
                entries, table = RT.exit_table(t, start, budget, window)
                leaves = [-1] * (budget - len(hist)) + [x + window for x in hist]
                rows = [table[int(np.searchsorted(entries, x))] for x in leaves]
                ends = [max(int(r[k * budget + j]) for j, r in enumerate(rows)) for k in range(2 * budget)]
                exit_ = (hist + sorted(v for v in ends if v != RT.NEVER))[-budget:]
                assert exit_ == after
                tables += 1
            known += 1
            # only times that may still be inside the window matter
            assert [x for x in exit_ if x > t[-1] - window] == [x for x in after if x > t[-1] - window]
            hist = exit_
        assert got == _brute_rate(times.tolist(), budget, window)
    assert tables > 300 and known > tables + 100


def test_rate_limit_of_keys_without_a_gap(spark):
    """Ties, null keys, string ids and buckets over many Arrow batches."""
    from lookout.functions.rates import rate_limit
    rng, rows = random.Random(6), []
    for key, n in (("hot", 3000), (None, 700), ("k2", 300), ("k3", 2)):
        rows += [(key, f"{key}-{i:05d}", t) for i, t in enumerate(_traffic(rng, n))]
    df = spark.createDataFrame(rows, "key string, id string, t long").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["id"]: r["allowed"] for r in rate_limit(df, ["key"], "t", "id", 3, 25, factor=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows)
    for key in ("hot", None, "k2", "k3"):
        mine = [r for r in rows if r[0] == key]
        assert [got[r[1]] for r in mine] == _brute_rate([r[2] for r in mine], 3, 25)


def test_rate_limit_spreads_a_target_that_never_pauses(spark):
    """A request each second for 30 days: no cut, a phase that never converges. The
    result is the plain fold's, in buckets that no task has many of."""
    import numpy as np
    from lookout.functions import rates as RT
    n = 30 * 86_400
    df = spark.range(n).select(F.lit("target").alias("key"), "id", (F.col("id") * 1_000_000).alias("t"))
    out = RT.rate_limit(df, ["key"], "t", "id", 5, 60_000_000)
    expected = RT.allowed_rows(np.arange(n) * 1_000_000, [], 5, 60_000_000)[0]
    allowed = np.zeros(n, bool)
    allowed[[r["id"] for r in out.filter("allowed").select("id").collect()]] = True
    assert out.count() == n and (allowed == expected).all()
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 4 and max(per_task) < 2 * n / len(per_task)


def test_period_tree_of_any_shape(spark):
    """Dense, bursty and sparse keys, one of them null, over trees of several depths."""
    from lookout.functions.periods import period_starts
    rng, rows = random.Random(12), []
    for key, n in (("hot", 2500), (None, 600), ("k2", 200), ("k3", 1)):
        rows += [(key, f"{key}-{i:05d}", 3 * t if key == "k2" else t - 500) for i, t in enumerate(_traffic(rng, n))]
    df = spark.createDataFrame(rows, "key string, id string, t long").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for period, levels in ((20, (1, 2, 2, 2)), (7, (2, 4, 4)), (33, (64, 64)), (5, (3,))):
            got = {r["id"]: (r["opens"], r["period_start"])
                   for r in period_starts(df, ["key"], "t", "id", period, levels).collect()}
            assert len(got) == len(rows)
            for key in ("hot", None, "k2", "k3"):
                mine, start = [r for r in rows if r[0] == key], None
                for (_, i, t), opens in zip(mine, _brute_periods([r[2] for r in mine], period)):
                    start = t if opens else start
                    assert got[i] == (opens, start)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_long_periods_of_a_busy_host_spread(spark):
    """30 days of 24 h periods, a third of the rows on one host: no task of the fold
    has more than three times the median."""
    from lookout.functions.periods import period_starts
    day = 86_400
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "busy").otherwise(F.concat(F.lit("h"), F.col("id") % 97)).alias("host"),
        "id", (F.col("id") * 30 * day / 300_000).cast("long").alias("t"))
    out = period_starts(df, ["host"], "t", "id", day, levels=(2, 4, 4, 4))
    times = [i * 30 * day // 300_000 for i in range(0, 300_000, 3)]
    starts = [r[0] for r in out.filter("host = 'busy' AND opens").orderBy("period_start").select("period_start").collect()]
    assert starts == [t for t, opens in zip(times, _brute_periods(times, day)) if opens]
    tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 3 * tasks[len(tasks) // 2]


def test_range_count_with_a_width_per_key_and_idle_gaps(spark):
    rng, rows, n = random.Random(4), [], 0
    widths = {"a": 7, "b": 60, "c": 0, None: 25, "d": 400}
    for key, w in widths.items():
        for t in _traffic(rng, 500):
            n += 1
            rows.append((key, w, n, t - 90))
    df = spark.createDataFrame(rows, "key string, w long, id long, t long").repartition(5)
    got = {r["id"]: r["c"] for r in O.count_in_range(df, ["key"], "t", "id", F.col("w"), "c", idle=15).collect()}
    for key, w in widths.items():
        times, last = [], None
        for _, _, i, t in [r for r in rows if r[0] == key]:
            if last is not None and t - last >= 15:
                times = []
            last = t
            times = [x for x in times if x > t - w] + [t]
            assert got[i] == (len(times) if w > 0 else None)


def test_ordered_scans_carry_over_partition_edges(spark):
    """Keys over many partitions, partitions shorter than the frame and keys that
    fit into one, null keys and values; one partition per task and key edge."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(9)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None, "zz"]), i, rng.randrange(90),
             None if i % 11 == 0 else rng.randrange(-5, 50)) for i in range(300)]
    df = _df(spark, rows).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # nothing coalesced
    try:
        for parts in (1, 7, 60, 150):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            sums = O.prefix_sums(df, ["key"], ["t", "id"], {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)}, keep_parts=True)
            got = {r["id"]: r for r in O.lag_values(sums, ["key"], ["t", "id"], ["v", "s", "t"]).collect()}
            frames = {r["id"]: r["last"] for r in O.rows_frame(
                df, ["key"], ["t", "id"], 12, F.coalesce("v", F.lit(0)), "last").collect()}
            assert len(got) == len(frames) == len(rows)
            for key in {r[0] for r in rows}:
                mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
                values = [r[3] or 0 for r in mine]
                for j, (_, i, t, v) in enumerate(mine):
                    r = got[i]
                    assert (r["s"], r["n"]) == (sum(values[:j + 1]), j + 1)
                    before = (mine[j - 1][3], sum(values[:j]), mine[j - 1][2]) if j else (None, None, None)
                    assert (r["prev_v"], r["prev_s"], r["prev_t"]) == before
                    assert frames[i] == values[max(0, j - 11):j + 1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ordered_parts_are_even_whatever_the_keys(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"),
                                    "id", (F.col("id") * 7 % 60_000).alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many partitions as configured
    try:
        sizes = [r["count"] for r in O.ordered_parts(df, ["key"], ["t", "id"]).groupBy(O.PART).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_exact_quantile(spark):
    import numpy as np
    rng = random.Random(1)
    values = [round(rng.gauss(0, 1), 2) for _ in range(800)] + [0.5] * 900
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.05, 0.333, 0.5, 1.0):
        assert abs(O.exact_quantile(df, "v", share) - np.quantile(values, share)) < 1e-12
    assert O.exact_quantile(df.limit(0), "v", 0.5) is None
