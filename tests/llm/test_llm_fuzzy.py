"""Operators 3, 6, 10 and the pipeline against brute force, and on awkward rows."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from helpers_llm import awkward, key, prose, table
from pyspark.sql import functions as F

import corpus_pipeline
from lookout.llm import decontaminate, mixing, neardup, quality, sharding, toxicity
from lookout.llm.components import components
from lookout.llm.tables import Tables


def edited(text, rng, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = rng.choice(["zzz", "yyyy", words[k] + "q"])
    return " ".join(words)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# ---- operator 3

def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcd")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        most, d = rng.randint(0, 8), distance(a, b)
        assert neardup.aligned_distance(a, b, most) == (d if d <= most else None)


def test_sketches_keep_order_and_occurrences():
    words = prose(1, 60).split()
    assert (neardup.sketch(" ".join(words)) == neardup.sketch("\n".join(words).upper())).all()
    halves = neardup.sketch(" ".join(words[30:] + words[:30]))
    assert 0 < (neardup.sketch(" ".join(words)) == halves).mean() < 0.9
    assert neardup.sketch("  ") is None and neardup.sketch(None) is None and len(neardup.sketch("one two")) == 32
    once, twice = neardup.sketch("a b c d e"), neardup.sketch("a b c d e a b c d e")
    assert (once != twice).any()


def groups_of(rows):
    """Brute force: components of texts at least 0.8 alike, with their 5-word
    shingles at least 0.8 in common; and whether two may be linked at all."""
    texts = sorted({r[1] or "" for r in rows})
    words = {t: neardup.words_of(t) for t in texts}
    shingles = {t: collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else None for t, w in words.items()}
    must, may = [], []
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if shingles[a] and shingles[b]:
                if neardup.similar(a, b):
                    may.append((a, b))
                    j = (shingles[a] & shingles[b]).total() / (shingles[a] | shingles[b]).total()
                    if j >= 0.8:
                        must.append((a, b))
    return texts, must, may


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    passage = prose(77, 45)
    rows = []
    for i in range(25):
        base = prose(i, rng.randint(60, 160))
        rows.append(base)
        rows += [edited(base, rng, rng.choice([0.0, 0.01, 0.02, 0.05, 0.3])) for _ in range(rng.randint(0, 4))]
    rows += [passage + " " + prose(200 + k, 70) for k in range(30)]  # a passage isn't a copy
    rows += ["short text", "short text", "short texts", "", " "]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(rows)]
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts, must, may = groups_of(rows)
    label = {}
    by_text = {i: t for i, t, *_ in rows}
    for r in got:
        assert label.setdefault(by_text[r.doc_id], r.class_id) == r.class_id
    assert all(label[a] == label[b] for a, b in must) and len(must) > 10
    whole = components_of(texts, may)
    assert all(whole[a] == whole[b] for a in texts for b in texts if label[a] == label[b])
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_sketches_block_by_block(monkeypatch):
    words = prose(31, 700).split()
    texts = [" ".join(words[:k]) for k in (1, 4, 5, 6, 63, 64, 65, 700)] + [" ".join(words[:9] * 40)]
    whole = [neardup.sketch(t) for t in texts]
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(neardup, "_BLOCK", block)
        assert all((neardup.sketch(t) == w).all() for t, w in zip(texts, whole))


def test_ranking_a_very_long_text_needs_little_memory():
    hashed = neardup.word_hashes(" ".join(f"word{i * 7919 % 99991}" for i in range(2_000_000)))  # about 20 MB of text
    tracemalloc.start()
    assert len(neardup._sketch(hashed, neardup.Settings())) == neardup.Settings().sketches
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * hashed.nbytes  # with all ranks at once: 32 sketches of that size


def test_length_classes_part_no_similar_lengths(spark):
    s = neardup.Settings()
    rows = spark.range(1, 3000).select(F.col("id").alias("n")).select("n", neardup._length_class(s).alias("c")).collect()
    of = {r.n: r.c for r in rows}
    for n in of:
        least = next(m for m in range(max(1, int(0.7 * n)), n + 1) if n - m <= int((1 - s.similarity) * n + 1e-9))
        assert of[n] - of[least] <= 1


def test_texts_are_fetched_once_by_a_join_that_holds_at_any_size(spark, monkeypatch):
    """Few digests are not broadcast: the shuffle of the texts is one, and also removes copies."""
    base = prose(71, 120)
    rows = [(i, edited(base, random.Random(i), 0.02 * i), "en", "s", 0) for i in range(6)] + [(9, base, "en", "s", 0)]
    put, fetched = Tables.put, []

    def noted(self, name, df):
        if name == "texts":
            fetched.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, name, df)
    monkeypatch.setattr(Tables, "put", noted)
    got = neardup.classes(table(spark, rows)).collect()
    assert len(got) == 7 and max(r["class_size"] for r in got) > 2
    assert len(fetched) == 1
    assert "SortMergeJoin" in fetched[0] and "BroadcastHashJoin" not in fetched[0]


def test_texts_that_share_a_passage_are_told_apart_by_their_words(spark, monkeypatch):
    """A text of the standing buckets is one row, and pairs that the counts of their words tell
    apart don't fetch their texts."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(140)), "en", "s", 0) for i in range(60)]
    rows.append((60, rows[7][1] + " and more", "en", "s", 0))
    verified, standing, tried = [], [], []
    verify, put = neardup._verified, Tables.put

    def verifying(edges, texts, s):
        verified.append(edges.count())
        return verify(edges, texts, s)

    def putting(self, name, df):
        out = put(self, name, df)
        if name == "members":
            standing.append((out.count(), out.select("node").distinct().count()))
        elif name.startswith("tried"):
            tried.append(out.count())
        return out
    monkeypatch.setattr(neardup, "_verified", verifying)
    monkeypatch.setattr(Tables, "put", putting)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(table(spark, rows)).collect()}
    assert got == {i: (7, 2) if i in (7, 60) else (i, 1) for i in range(61)}
    assert standing[0][0] > 20 and all(a == b for a, b in standing)
    assert sum(tried[1:]) > 50 and sum(verified[1:]) < 10


def test_all_pairs_of_large_buckets_are_tried_at_once(spark, monkeypatch):
    """Of many unlike texts that share most of their words each pair is tried once, in two rounds."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(250))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60 if i < 4 else 66 + i % 30)), "en", "s", 0) for i in range(200)]
    rows.append((200, rows[7][1] + " and more", "en", "s", 0))
    tried, put = [], Tables.put

    def putting(self, name, df):
        out = put(self, name, df)
        if name.startswith("tried"):
            tried.append((name, [(bytes(r.a), bytes(r.b)) for r in out.collect()]))
        return out
    monkeypatch.setattr(Tables, "put", putting)
    monkeypatch.setattr(neardup, "_TASK_TEXTS", 16)
    got = {r.doc_id: r.class_id for r in neardup.classes(table(spark, rows)).collect()}
    roots = components_of(range(201), [(i, j) for i in range(201) for j in range(i) if neardup.similar(rows[i][1], rows[j][1])])
    least = {}
    for i in range(201):
        least.setdefault(roots[i], i)
    assert got == {i: least[roots[i]] for i in range(201)} and len(set(got.values())) == 197
    assert [name for name, _ in tried] == ["tried", "tried0", "tried1"]
    pairs = [p for _, ps in tried for p in ps]
    assert len(pairs) == len(set(pairs))


def test_many_edits_are_counted_by_bit_vectors():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        d, most = distance(a, b), rng.randrange(70)
        assert neardup._bit_distance(a, b, most) == (d if d <= most else None)
        assert neardup.aligned_distance(a, b, most) == (d if d <= most else None)


def test_components_of_many_edges(spark, monkeypatch):
    """More edges than one task takes are shuffled."""
    from lookout.llm import components as module
    monkeypatch.setattr(module, "_TASK_EDGES", 0)
    test_components_of_paths_stars_and_cycles(spark)


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(8)
    path = [(k, k + 1) for k in range(40)]
    cycle = [(100 + k, 100 + (k * 7 + 7) % 30) for k in range(30)]
    star = [(200, 200 + k) for k in range(1, 20)]
    tree = [(300 + k, 300 + rng.randrange(k)) for k in range(1, 60)]
    for edges in ([*path, *cycle, *star, *tree, (5, 5)], star, path, []):
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.root for r in components(frame, Tables(spark)).collect()}
        nodes = {n for a, b in edges if a != b for n in (a, b)}
        whole = components_of(nodes, [e for e in edges if e[0] != e[1]])
        least = {}
        for n in nodes:
            least[whole[n]] = min(least.get(whole[n], n), n)
        assert got == {n: least[whole[n]] for n in nodes}


def test_one_large_group(spark):
    rng = random.Random(5)
    base = prose(3, 150)
    rows = [(i, edited(base, rng, 0.03), "en", "a", 0) for i in range(400)] + [(1000 + i, base, "en", "a", 0) for i in range(300)]
    got = neardup.classes(table(spark, rows).repartition(4)).collect()
    assert collections.Counter(r.class_id for r in got).most_common(1)[0][1] >= 695


def test_copies_that_only_their_original_is_like(spark):
    rng = random.Random(21)
    original = prose(70, 400, words=4000).split()
    rows = [(0, " ".join(original), "en", "a", 0)]
    for i in range(1, 61):
        at = rng.randrange(401)
        rows.append((i, " ".join([*original[:at], *prose(7000 + i, 84).split(), *original[at:]]), "en", "a", 0))
    # others share a third of the original with them, but aren't like any
    rows += [(100 + i, " ".join([*prose(8000 + i, 250).split(), *original[:150]]), "en", "a", 0) for i in range(30)]
    assert all(neardup.similar(rows[0][1], r[1]) for r in rows[1:61])
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(table(spark, rows)).collect()}
    assert got == {i: (0, 61) for i in range(61)} | {i: (i, 1) for i in range(100, 130)}


def test_near_duplicates_awkward(spark):
    docs = table(spark, awkward())
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 15
    classes = collections.defaultdict(list)
    for r in got:
        classes[r.class_id, r.class_size].append(r)
    # the equal texts, null and empty ones, and those without words; repeated rows both say kept
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[1].class_size == 3
    assert by_id[4].class_id == by_id[5].class_id == 4
    assert by_id[7].class_size == 1 or by_id[8].class_id == 7
    wide = table(spark, awkward(), extra=True)
    assert sorted(map(key, neardup.classes(wide).collect())) == sorted(map(key, neardup.classes(docs).collect()))
    assert neardup.classes(table(spark, [])).count() == 0
    out = neardup.deduplicated(wide)
    assert out.columns == wide.columns
    kept = out.collect()
    assert len(kept) == len({(r.k1, r.k2) for r in got if r.kept})
    assert len({r.text or "" for r in kept}) == len(kept)


# ---- operator 6

def toxic_rows(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(5000 + i, rng.randint(15, 120)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vequ", "lowei"]) + rng.choice(["sse", "mo", "eur", "ja"]))
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(1, 500)
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i, r in got.items() if r.held_out) == held
    right = [got[i].predicted == labels[i][2] for i in held]
    assert np.mean(right) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    # labels of held-out rows don't matter
    other = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, other).collect()} == {i: r.score for i, r in got.items()}


def test_toxicity_awkward(spark):
    marks = spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(None, 1, 1), (3, None, None)],
                                  "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, awkward()), marks).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    wide = toxicity.toxicity(table(spark, awkward(), extra=True), marks).collect()
    assert sorted(map(key, wide)) == sorted(map(key, got))
    assert toxicity.toxicity(table(spark, []), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(table(spark, awkward()), marks.limit(0)).collect()} == {0}


# ---- operator 10

def test_alignment_against_brute_force():
    rng = random.Random(2)
    s = decontaminate.Settings()
    for _ in range(300):
        a = np.array([rng.randrange(4) for _ in range(rng.randint(1, 10))])
        b = np.array([rng.randrange(4) for _ in range(rng.randint(1, 14))])
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (s.match if a[i - 1] == b[j - 1] else s.mismatch), h[i - 1, j] + s.gap, h[i, j - 1] + s.gap)
        assert decontaminate.align(a, b, s)[0] == h.max()


def leaks():
    rng = random.Random(7)
    items = [(k, prose(300 + k, rng.randint(14, 40))) for k in range(20)]
    docs, planted = [], set()
    for i in range(80):
        text = prose(600 + i, rng.randint(30, 200)).split()
        if i % 4 == 0:
            k = rng.randrange(20)
            text[10:10] = edited(items[k][1], rng, rng.choice([0, 0.1, 0.2])).split()
            planted.add((i, k))
        docs.append((i, " ".join(text), "en", "a", 0))
    return docs, items, planted


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, planted = leaks()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_words=100)):
        got = decontaminate.contaminated(table(spark, docs), bench, settings).collect()
        assert {(r.doc_id, r.item_id) for r in got} == planted
        for r in got:
            words = decontaminate.tokens(docs[r.doc_id][1])[r.first_word:r.last_word + 1]
            assert len(set(words) & set(decontaminate.tokens(items[r.item_id][1]))) >= 0.4 * len(set(words))
    kept = decontaminate.clean_documents(table(spark, docs, extra=True), bench)
    assert kept.columns == table(spark, [], extra=True).columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {i for i, _ in planted}


def test_leaks_in_a_hot_group_of_equal_edited_copies(spark):
    words = prose(77, 40, words=4000).split()
    copy = [w if k % 4 != 3 else f"zz{k}" for k, w in enumerate(words)]
    docs = [(i, prose(2000 + i, 40) + " " + " ".join(copy) + " " + prose(3000 + i, 40), "en", "a", 0) for i in range(60)]
    # every other trigram of the item stands somewhere by chance
    docs += [(100 + k, " ".join([prose(4000 + k, 30), *words[k:k + 3], prose(5000 + k, 30)]), "en", "a", 0) for k in range(38)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, prose(78, 30))], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in range(60)}
    assert {r.doc_id for r in decontaminate.clean_documents(table(spark, docs), bench).collect()} == set(range(100, 138))


def test_leaks_awkward(spark):
    item = awkward()[0][1][:200]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one"), (None, awkward()[3][1])],
                                  "item_id long, text string")
    got = decontaminate.contaminated(table(spark, awkward()), bench).collect()
    assert {r.doc_id for r in got if r.item_id == 1} == {1, 2, 11}
    assert sum(r.doc_id == 2 and r.item_id == 1 for r in got) == 4  # two rows, two items
    assert decontaminate.contaminated(table(spark, awkward()), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0
    assert decontaminate.clean_documents(table(spark, awkward()), bench.limit(0)).count() == 15


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, prose(900 + k, 30)) for k in range(5)]
    rows = []
    for i in range(60):
        text = prose(i, rng.randint(60, 200))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows.append((100, edited(rows[3][1], rng, 0.01), "en", "s1", 1))       # a near copy
    rows.append((101, prose(50, 40) + " " + items[2][1], "en", "s1", 1))   # a leak
    rows.append((102, "same words again " * 60, "en", "s1", 1))            # junk
    rows.append((103, None, None, None, None))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out/{k}")
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            ids -= {102, 103}
        elif k == 1:
            ids -= {100}
        elif k == 2:
            ids -= {101}
        elif k == 3:
            taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(before).collect()}
            assert collections.Counter(r.doc_id for r in docs.collect()) == collections.Counter({i: n for i, n in taken.items() if n})
            ids = {i for i, n in taken.items() if n}
        else:
            assert docs.count() == before.count()
            assert sorted(map(key, docs.collect())) == sorted(map(key, sharding.sharded(before).collect()))
        assert {r.doc_id for r in docs.collect()} == ids, name
    assert quality.measure(rows[0][1])[6]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("name", ["op7_mix_sources", "op9_byte_shards"])
def test_queries_with_sql_agree_with_it(spark, name):
    import duckdb
    from lookout.llm import queries
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(key, got.collect())) == sorted(key([r[k] for k in order]) for r in want.fetchall())
