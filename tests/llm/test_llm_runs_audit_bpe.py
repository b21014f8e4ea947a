"""Operators 11 to 13 against brute force, a public tokenizer library and on awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers_llm import awkward, key, prose, table
from pyspark.sql import functions as F

from lookout.llm import audit, bpe, periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same_with_extra_columns(spark, fn):
    """The rows of ``fn`` on the awkward table; other columns, whatever their
    names, change nothing, and an empty table gives no rows of the same columns."""
    plain = fn(table(spark, awkward()))
    rows = plain.collect()
    wide = fn(table(spark, awkward(), extra=True))
    assert wide.columns == plain.columns
    assert sorted(map(key, wide.collect())) == sorted(map(key, rows))
    none = fn(table(spark, []))
    assert none.columns == plain.columns and none.count() == 0
    return rows


# ---- operator 11

def brute_runs(words, least):
    """Every maximal stretch for every period; the smallest period of a stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def repetitive(rng):
    """Word lists of the kinds that periods are hard in."""
    kind, n = rng.randrange(5), rng.randint(0, 90)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:  # Fibonacci words: as many runs as can be
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[rng.randint(0, 4):n]
    if kind == 2:
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        return [3, 4] + unit * rng.randint(2, 5) + [5, 3]
    if kind == 3:
        out = []
        while len(out) < n:
            out += [rng.randrange(2) for _ in range(rng.randint(1, 6))] * rng.randint(1, 5)
        return out
    inner = ([0] * rng.randint(1, 6) + [1] * rng.randint(0, 2)) * rng.randint(1, 4) + [0] * rng.randint(0, 3)
    return inner * rng.randint(1, 4)


def test_runs_against_brute_force():
    rng, found = random.Random(11), 0
    for _ in range(2500):
        words, least = repetitive(rng), rng.choice((1, 2, 5, 12))
        got = periodic.find_runs(periodic.word_numbers(words), least)
        assert [tuple(r) for r in got.tolist()] == brute_runs(words, least)
        found += len(got)
    assert found > 10_000


def test_dictionary_numbers_equal_factors_equally():
    rng = random.Random(2)
    words = [rng.randrange(2) for _ in range(300)]
    for k, name in enumerate(periodic.basic_factors(np.array(words))):
        factors = [tuple(words[i:i + 2**k]) for i in range(len(words) - 2**k + 1)]
        count = collections.Counter(factors)
        for i, f in enumerate(factors):
            assert (name[i] >= 0) == (count[f] > 1)
        assert len({(f, int(n)) for f, n in zip(factors, name) if n >= 0}) == sum(c > 1 for c in count.values())


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    runs.sort(key=lambda r: (r[0], r[2]))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{s},{length},{q}\n" for s, length, q in runs),
            " ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], *sha)


def run_rows():
    rng, rows = random.Random(5), []
    for i in range(160):
        words = [rng.choice("ab") if i % 3 else prose(i * 1000 + k, 1) for k in range(rng.randint(0, 120))]
        if i % 4 == 0:
            unit = prose(i, rng.randint(1, 9))
            words.insert(len(words) // 2, " \n".join([unit] * rng.randint(2, 20)))
        rows.append((i, "\t ".join(words), "en", "s", 0))
    return rows


def test_run_digest_against_brute_force(spark):
    rows = run_rows()
    got = {r.doc_id: tuple(r) for r in periodic.digest(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert got[i] == brute_digest(i, text)
    assert sum(v[1] > 0 for v in got.values()) > 60


def test_runs_and_collapsed_texts(spark):
    text = "start " + "one two three " * 6 + "end"
    rows = {r.doc_id: r for r in periodic.runs_of(table(spark, [(3, text, "en", "s", 0), (4, "a b", "en", "s", 0)])).collect()}
    assert [tuple(r) for r in rows[3].runs] == [(1, 18, 3)] and rows[3].collapsed == "start one two three end"
    assert rows[4].runs == [] and rows[4].collapsed == "a b"


def test_runs_awkward(spark):
    rows = same_with_extra_columns(spark, periodic.digest)
    long = {i for i, t, *_ in awkward() if t and len(t) > 9000}  # too long for the brute force
    assert collections.Counter(tuple(r) for r in rows if r.doc_id not in long) == collections.Counter(
        brute_digest(i, t) for i, t, *_ in awkward() if i not in long)
    assert len(rows) == len(awkward())
    same_with_extra_columns(spark, periodic.runs_of)


def test_runs_of_very_long_texts():
    """20 MB: all one run, no run, and one run amid words that don't repeat."""
    rng = np.random.default_rng(1)
    n = 3_000_000
    assert periodic.find_runs(np.arange(n) % 1000).tolist() == [[0, n, 1000]]
    assert periodic.find_runs(np.arange(n)).tolist() == []
    ids = np.arange(n)
    ids[1_000_000:1_900_000] = np.tile(rng.permutation(n)[:300_000], 3)
    assert [r for r in periodic.find_runs(periodic.word_numbers(ids.tolist())).tolist() if r[1] > 1000] == [
        [1_000_000, 900_000, 300_000]]


# ---- operator 12

def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = collections.defaultdict(list)
    for i, text, lang, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                  "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                  "D": re.search(r"[#$%&*|]", text) is not None, "E": i is not None and i > least[text]}
        parts[lang or ""].append((i, {k for k, v in failed.items() if v}))
    out, shapley = [], collections.Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for _, failed in docs:
                first = next((x for x in order if x in failed), None)
                if first:
                    shapley[part, first] += 1
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                left = [(i, f) for i, f in docs if not f & set(order[:step - 1])]
                gone = [i for i, f in left if x in f]
                out.append((part, "".join(order), step, len(left) - len(gone), len(gone),
                            sum(x in f for _, f in docs) - len(gone), sum(f == {x} for _, f in docs),
                            sum(i in good for i in gone), sum(i in toxic for i in gone), shapley[part, x]))
    return sorted(out)


def audit_rows():
    rng, rows = random.Random(8), []
    head = "The same long heading stands before many texts and differs late " * 6
    for i in range(240):
        kind = i % 8
        text = (prose(i, rng.randint(150, 260)) if kind < 3 else
                head + prose(i % 40, 210, 300) if kind < 5 else
                "one text that a third of the rows hold" if kind < 7 else
                rng.choice([None, "", prose(i, 220) + " #1", prose(i, 210).upper(), "a b " * 150]))
        rows.append((rng.randrange(150) if kind == 6 else i, text, rng.choice(["en", "de", None, ""]), "s", 0))
    return rows


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("range_bytes, local_chars", [(1, 200), (700, 4000), (audit.RANGE_BYTES, audit.LOCAL_CHARS)])
def test_audit_against_brute_force(spark, range_bytes, local_chars):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 240, 2)] + [(4, None, None), (None, 1, 1), (999, 1, 1)]
    failed = audit.failed_filters(table(spark, rows).repartition(5), range_bytes, local_chars)
    got = audit.report(failed, spark.createDataFrame(labels, LABELS)).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_ranges_part_texts_that_begin_alike(spark):
    head = "x" * 5000
    rows = [(i, head + prose(i, 30), "en", "s", 0) for i in range(400)] + [(i, head, "en", "s", 0) for i in range(400, 500)]
    cuts = audit.range_cuts(table(spark, rows), 100_000)
    held = collections.Counter(sum(c <= t for c in cuts) for t in {t for _, t, *_ in rows})
    assert len(held) >= 15 and max(held.values()) <= 60


def test_trie_holds_each_text_once():
    rng, trie, least = random.Random(3), audit.Trie(), {}
    for i in range(4000):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) * rng.choice((1, 1, 9))
        number = rng.randrange(1000)
        least[text] = min(number, least.get(text, number))
        trie.add(text, number, "", "")
    assert {t: node.least for t, node in trie.texts()} == least
    stack = [trie.root]
    while stack:  # compressed: an inner node without a text has two children at least
        node = stack.pop()
        stack += node.children.values()
        assert node is trie.root or node.rows or len(node.children) > 1


def test_audit_awkward(spark):
    labels = spark.createDataFrame([(2, 1, 1), (None, 1, 1), (8, None, None)], LABELS)
    rows = same_with_extra_columns(spark, lambda docs: audit.audited(docs, labels))
    assert sorted(tuple(r) for r in rows) == brute_audit(awkward(), [(2, 1, 1)])
    none = audit.audited(table(spark, awkward()), labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


# ---- operator 13

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as file:
        return bpe.vocabulary(file.read(), public_tokenizers.PATTERN)


def test_bpe_against_the_public_library(public, vocabulary):
    rng = random.Random(13)
    alphabets = ["ab", "abcdefghij", "etaoin shrdlu", "éüñ漢字 \U0001f600x", "-=_", "aaab", "the in on er re", "0123456789",
                 " \n\t x\u0085\x1c'sS", "".join(map(chr, range(0x20, 0x250)))]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in alphabets for _ in range(120)]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert ids.tolist() == public.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_bpe_of_tokens_in_a_row(public, vocabulary):
    """Strings of whole tokens meet pairs whose merge makes a pair of lower rank."""
    rng, tokens = random.Random(1), list(vocabulary.rank)
    for _ in range(1500):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(2, 9)))
        if piece not in vocabulary.rank:
            expected = list(public._core_bpe.encode_single_piece(piece))
            assert vocabulary.merged([piece])[0].tolist() == expected
            assert vocabulary._long(piece).tolist() == expected


def test_bpe_of_long_pieces(public, vocabulary):
    rng = random.Random(4)
    for text in ("x" * 100_001, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "ab" * 3000 + "é" * 5000, "-" * 777):
        ids = vocabulary.encode([text])[0]
        assert ids.tolist() == public.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def test_pair_table():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 900, (4000, 2)), axis=0)
    table_ = bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    held = {tuple(k): i for i, k in enumerate(keys.tolist())}
    ask = rng.integers(-1, 900, (20_000, 2))
    assert table_(ask[:, 0], ask[:, 1]).tolist() == [held.get(tuple(k), int(bpe.NONE)) for k in ask.tolist()]


def test_bpe_awkward(spark, public):
    def digest(docs):
        return bpe.digest(docs, RANKS, public_tokenizers.PATTERN)

    rows = same_with_extra_columns(spark, digest)
    expected = []
    for i, text, *_ in awkward():
        ids = public.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, rows)) == collections.Counter(expected)


def test_bpe_round_trip_of_tables(spark, public):
    ids = bpe.encoded(table(spark, awkward()), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(ids, RANKS, public_tokenizers.PATTERN).collect() if r.doc_id}
    assert got == {i: (t or "").encode() for i, t, *_ in awkward() if i}


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary(base64.b64encode(b"a") + b" 0", "a")
