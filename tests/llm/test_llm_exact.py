"""Operators 1, 2, 4, 5, 7, 8, 9 against brute force, and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers_llm import awkward, key, prose, table

from lookout.llm import licenses, linededup, mixing, pii, quality, sharding, substrings
from lookout.llm.suffixes import common_prefixes, suffix_array
from lookout.llm.tagger import Tagger

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def both(spark, fn, columns=None):
    """The result on the awkward rows, which extra columns must not change; and
    that an empty table gives no rows of the same columns."""
    plain = fn(table(spark, awkward()))
    rows = sorted(map(key, plain.collect()))
    wide = fn(table(spark, awkward(), extra=True))
    if wide.columns == plain.columns:
        assert sorted(map(key, wide.collect())) == rows
    none = fn(table(spark, []))
    assert none.columns == plain.columns and none.count() == 0
    return plain.collect()


# ---- operator 1

def test_licences(spark):
    text = licenses.TEMPLATES["MIT"]
    rows = [(1, "Some words.\n" + text + "\nand more", "en", "a", 1), (2, text.replace("Software", "Program", 2), "en", "a", 1),
            (3, prose(5, 100), "en", "a", 1), (4, "Licensed under the Apache Licence, version 2.0", "en", "a", 1)]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got[1].license == "MIT" and got[1].dice == 1.0
    assert got[2].license == "MIT" and 0.8 <= got[2].dice < 1
    assert got[3].license is None and got[3].dice == 0 and got[3].n_units == 0
    assert got[4].licenses == ["Apache-2.0 line"]


def test_licence_size_bounds_lose_nothing():
    rng = random.Random(4)
    library = licenses.Library(licenses.TEMPLATES, 0.8)
    for _ in range(300):
        name, text = rng.choice(list(licenses.TEMPLATES.items()))
        words = [w for w in licenses.normalised(text) if rng.random() > 0.08]
        words = words[: rng.randint(1, len(words))] + ["x"] * rng.randint(0, 3)
        scores = {n: licenses.dice(licenses.bigrams(words), licenses.bigrams(licenses.normalised(t)))
                  for n, t in licenses.TEMPLATES.items()}
        best = min(((-s, n) for n, s in scores.items() if s >= 0.8), default=None)
        got = library.best(words)
        assert (got is None) == (best is None) and (got is None or got == (-best[0], best[1]))


def test_licences_of_several_paragraphs_within_other_text():
    library = licenses.Library(licenses.TEMPLATES, 0.8)
    parts = {"MIT": ("The above copyright", "THE SOFTWARE IS"),
             "BSD-2-Clause": ("1. Redist", "2. Redist", "THIS SOFTWARE"),
             "Zlib": ("Permission", "1. The", "2. Altered", "3. This"),
             "Apache-2.0 notice": ("You may obtain", "http:", "Unless", "See the"),
             "GPL-3.0 notice": ("This program is distributed", "You should")}
    for name, starts in parts.items():
        notice = licenses.TEMPLATES[name]
        for start in starts:
            notice = notice.replace(start, "\n\n" + start)
        for mark in ("", " * ", "# "):
            lines = "\n".join((mark + line).rstrip() for line in notice.split("\n"))
            text = prose(5, 900) + "\n" + lines + "\n" + prose(6, 900)
            best, score, _, found = library.scan(text)
            assert name in found and (best == name or score >= 0.99), (name, mark, best, found)
    assert library.scan(prose(7, 50) + " released under the MIT License. " + prose(8, 50))[3] == ["MIT line"]
    assert library.scan(prose(9, 3000)) == (None, 0.0, 0, [])
    # a notice that stands as one paragraph still counts once
    assert library.scan(prose(5, 90) + "\n\n" + licenses.TEMPLATES["MIT"] + "\n\n" + prose(6, 90))[2] == 1


def test_licences_awkward(spark):
    rows = both(spark, licenses.scan_licenses)
    assert len(rows) == 15 and all(r.license is None for r in rows)


# ---- operator 2

def test_line_chunks_move_only_near_an_insertion():
    lines = [prose(k, 6) for k in range(200)]
    before = {c for _, _, c in linededup.chunks("\n".join(lines))}
    after = {c for _, _, c in linededup.chunks("\n".join(lines[:77] + ["new line"] + lines[77:]))}
    assert "\n".join(c for _, _, c in linededup.chunks("\n".join(lines))) == "\n".join(lines)
    assert len(before - after) <= 3


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = [prose(k, 5) for k in range(60)]
    rows = []
    for i in range(120):
        lines = []
        while len(lines) < 25:
            at = rng.randrange(50)
            lines += pool[at:at + rng.randint(1, 10)]
        rows.append((i, "\n".join(lines), "en", "a", 0))
    seen, expected = set(), {}
    for i, text, *_ in rows:
        kept = []
        for _, n, chunk in linededup.chunks(text):
            if n >= 2 and chunk.strip():
                if chunk in seen:
                    continue
                seen.add(chunk)
            kept.append(chunk)
        expected[i] = "\n".join(kept)
    got = {r.doc_id: r for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert {i: r.kept_text for i, r in got.items()} == expected
    assert sum(r.n_removed_chunks for r in got.values()) > 100
    assert all(r.n_removed_lines >= 2 * r.n_removed_chunks for r in got.values())


def test_line_dedup_awkward(spark):
    two = "first line\nsecond line\n" * 30
    rows = awkward() + [(20, two, "en", "a", 1), (20, two, "en", "a", 1), (21, two, "en", "a", 1)]
    assert len(both(spark, linededup.digest)) == 15
    got = [(r.doc_id, r.kept_text, r.n_removed_chunks) for r in linededup.line_dedup(table(spark, rows)).collect()]
    assert len(got) == 18
    twins = [g for g in got if g[0] == 20]
    assert twins[0] == twins[1]  # rows equal in id and text count as one
    assert all(t == (k or "") for i, t, n in got for j, k, *_ in rows if i == j and i is not None and i not in (2, 20, 21) and n == 0)


# ---- operator 4

def brute_substrings(rows, n):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = collections.Counter(b[j:j + n] for _, b in data for j in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if counts[b[j:j + n]] > 1:
                gone[j:j + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(key, out))


def copied_texts(seed, n=40):
    rng = random.Random(seed)
    pieces = [prose(100 + k, rng.randint(5, 60)) for k in range(12)] + ["ab" * 400, "é" * 150]
    return [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))), "en", "a", 0) for i in range(n)]


@pytest.mark.parametrize("settings", [
    substrings.Settings(window=100, grams=(16, 50, 80, 100)),
    substrings.Settings(window=100, grams=(16, 50, 80, 100), crowd=1, shard_bytes=3000),
    substrings.Settings(window=100, grams=(100,)),
])
def test_substrings_against_brute_force(spark, settings):
    rows = copied_texts(1) + awkward()[:11]
    got = substrings.digest(table(spark, rows), settings).collect()
    assert sorted(map(key, got)) == brute_substrings(rows, 100)


def test_substrings_awkward(spark):
    rows = both(spark, substrings.digest)
    assert sorted(map(key, rows)) == brute_substrings(awkward(), 400)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(400):
        symbols = rng.choice([1, 2, 4, 30])
        t = [rng.randint(1, symbols) for _ in range(rng.randint(0, 50))] * rng.choice([1, 1, 3]) + [0]
        t = np.array(t, np.uint16)
        sa = suffix_array(t, symbols + 1)
        raw = t.tolist()
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        before, shared = common_prefixes(t, sa, 12)
        for i, j in enumerate(before.tolist()):
            if j >= 0:
                n = 0
                while n < 12 and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                    n += 1
                assert shared[i] == n


# ---- operator 5

def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeat = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k:k + 3])] > 1:
            repeat |= {k, k + 1, k + 2}
    lines = text.split("\n")
    dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat),
            n < 50 or 100 * len(repeat) > 50 * n)


def test_quality_base(spark):
    rng = random.Random(2)
    rows = awkward() + [(100 + k, "\n".join(" ".join(rng.choice(["ab", "c|", "d", "é#", "f g"]) for _ in range(rng.randint(0, 8)))
                                            for _ in range(rng.randint(0, 25))), "en", "a", 0) for k in range(60)]
    got = quality.measured(table(spark, rows)).collect()
    assert sorted(key((r[0], brute_quality(r[1]))) for r in rows) == sorted(
        key((r.doc_id, tuple(r)[1:7])) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def brute_shares(text, grams):
    words = WORD.findall(text)
    out = []
    for n in grams:
        seen, inside = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k:k + n])
            if gram in seen:
                inside |= set(range(k, k + n))
            seen.add(gram)
        out.append(sum(len(words[k]) for k in inside) / max(1, sum(map(len, words))))
    return out


def test_quality_shares_and_verdict():
    rng = random.Random(6)
    for _ in range(60):
        words = prose(rng.randrange(10**6), 120).split()
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(100)
            words += words[a:a + rng.randint(3, 20)]
        text = " ".join(words)
        shares = quality.measure(text)[8]
        assert shares == pytest.approx(brute_shares(text, (5, 6, 7, 8, 9, 10)))
    clean = prose(7, 300)
    assert quality.measure(clean)[6]
    assert not quality.measure(" ".join([clean[:400]] * 2))[6]
    assert not quality.measure(" | ".join(prose(8, 200).split()))[6]


def test_quality_awkward(spark):
    rows = both(spark, quality.measured)
    assert len(rows) == 15
    kept = quality.kept_documents(table(spark, awkward(), extra=True))
    assert kept.columns == table(spark, [], extra=True).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


# ---- operator 7

def brute_mix(rows, seed=mixing.SEED):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        rest = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * total[s] if s in full else left * weight[s] / rest for s in sources}
        above = {s for s in sources if s not in full and target[s] >= 3 * total[s]}
        if not above:
            break
        full |= above
    order = sorted(range(len(rows)), key=lambda k: (
        hashlib.md5(f"{seed}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:16], size[k]))
    return size, total, target, order


def test_mixing_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.choice([1, 5, 30, 200])), "en", rng.choice(["b", "a", "é", "Z", None]), 0) for i in range(150)]
    rows += [(1000 + i, prose(i, 4), "en", "tiny", 0) for i in range(3)] + [(2000, "", "en", "zero", 0)]
    size, total, target, order = brute_mix(rows)
    expected, used = {}, collections.Counter()
    for k in order:
        s = rows[k][3]
        budget = int(target[s] + 1e-9)
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        expected[rows[k][0]] = whole * size[k] + max(0, min(size[k], rest - used[s]))
        used[s] += size[k]
    got = mixing.mix(table(spark, rows)).collect()
    assert {r.doc_id: r.taken for r in got} == expected
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source]
        assert r.taken <= 3 * r.size
    assert len({r.source for r in got}) == 7
    again = mixing.mix(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mixing_awkward(spark):
    rows = both(spark, mixing.mixed)
    assert len(rows) == 15
    docs = table(spark, awkward(), extra=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = collections.Counter((r.doc_id, r.text) for r in out.collect())
    per_row = collections.Counter()
    for r in mixing.mix(docs).collect():
        per_row[r.doc_id] += -(-r.taken // r.size) if r.size else 0
    assert {i: n for i, n in per_row.items() if n} == collections.Counter(
        {i: sum(n for (j, _), n in texts.items() if i == j) for i, _ in texts})
    assert mixing.mixed(table(spark, [(1, None, None, None, None)])).first().target == 0


# ---- operator 8

def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    others = {1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), 2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
              3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}

    def luhn(d):
        return sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0

    def brute(x):
        out = [(m.start(), 0, m.end()) for m in email.finditer(x)]
        for k, p in others.items():
            for m in p.finditer(x):
                d = [int(c) for c in m.group() if c in "0123456789"]
                if {1: lambda: all(int(v) <= 255 for v in m.group().split(".")),
                        2: lambda: 12 <= len(d) <= 19 and luhn(d), 3: lambda: 9 <= len(d) <= 15}[k]():
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    for _ in range(5000):
        x = "".join(rng.choice("a1.@ +-(2") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(x) == brute(x)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_tagger_gradients():
    tagger = Tagger(7, 5, 3, 4)
    for k in tagger.p:
        tagger.p[k] = tagger.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 7, (3, 6)), rng.integers(0, 5, (3, 6))
    grads = tagger.loss(x, y)[1]
    for k, value in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        kept, losses = value[at], []
        for step in (1e-3, -1e-3):
            value[at] = kept + step
            losses.append(tagger.loss(x, y)[0])
        value[at] = kept
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(float(grads[k][at]), abs=1e-3)


def personal(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(1000 + seed * n + i, rng.randint(20, 60)).split()
        for _ in range(rng.randint(0, 2)):
            found = rng.choice([f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com",
                                f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
                                ".".join(str(rng.randint(0, 255)) for _ in range(4)), "4111111111111111"])
            words.insert(rng.randrange(len(words)), found)
        out.append((i, " ".join(words), "en", "a", 0))
    return out


def test_tagger_learns_spans_and_adds_to_the_base(spark):
    settings = pii.Settings(train_texts=300, epochs=16)
    docs = table(spark, personal(1, 400))
    tagger = pii.train(docs, settings)
    held = [r[1] for r in personal(2, 150)]
    hit = total = 0
    for text, spans in zip(held, pii.tagged_spans(held, tagger, settings)):
        base = pii.base_spans(text)
        total += len(base)
        hit += len(set(base) & set(spans))
    assert total > 80 and hit / total > 0.8
    clean = [prose(k, 80) for k in range(50)]
    assert pii.tagged_spans(clean, tagger, settings) == [[]] * 50
    for row in pii.spans_of(held, tagger, settings):
        written = row[5].split(",") if row[5] else []
        assert sum(row[:4]) + row[6] == len(written)


def test_windows_of_a_long_text_agree_with_short_ones():
    # spans far into a long text are found as in a text of their own
    tagger = Tagger(pii.N_SYMBOLS, pii.N_TAGS)
    text = prose(1, 400) + " 12.34.56.78 " + prose(2, 400)
    places = [k for k, c in enumerate(text) if c in "0123456789"]
    assert pii.tagged_spans([text], tagger, pii.Settings()) is not None and places


def test_personal_data_awkward(spark):
    def run(docs):
        return pii.personal_data(docs, pii.Settings(epochs=1))
    rows = both(spark, run)
    assert len(rows) == 15
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)


# ---- operator 9

def test_shards(spark):
    rng = random.Random(8)
    rows = [(i, prose(i % 700, rng.choice([3, 40, 300])), "en", "a", 0) for i in range(2000)]
    rows += [(5000 + i, "the very same text " * 20, "en", "a", 0) for i in range(800)]  # a third of the bytes
    got = sharding.sharded(table(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    largest = max(r.size for r in got)
    target = sum(r.size for r in got) / 24
    for shard in range(24):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
        assert abs(sum(r.size for r in got if r.shard == shard) - target) <= largest + 2 * sharding.WHOLE_GROUP * target
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    homes = collections.defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    bytes_of = collections.Counter()
    for r in got:
        bytes_of[text[r.doc_id]] += r.size
    whole = [t for t, n in bytes_of.items() if n <= sharding.WHOLE_GROUP * target]
    assert len(whole) > 100 and all(len(homes[t]) == 1 for t in whole)


def test_shards_awkward(spark):
    rows = both(spark, sharding.sharded)
    assert len(rows) == 15 and {r.size for r in rows if r.doc_id in (4, 5)} == {8}
    one = sharding.sharded(table(spark, [(1, "x", "en", "a", 1)])).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
