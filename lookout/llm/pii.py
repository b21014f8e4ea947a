"""Operator 8: personal data, by patterns and by a tagger trained on their spans.

Patterns give the base spans. A character-level bidirectional LSTM with CRF
transitions, trained on windows around labelled spans, adds others: overlapping
windows are decoded, their tag probabilities are joined over the whole text, and
one path through them gives the spans.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import hash_sample, prepared
from lookout.llm.tagger import Tagger, best_path

KINDS = ("email", "ip", "card", "phone")  # in the contract's order
# The contract's patterns. Digits give nothing back and an address begins at its
# first digit, which finds the same matches without trying each digit as a start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every span of the four kinds, of the base and the tagger's, has one of these.
TRIGGER = "[0-9@]"
_TRIGGER = re.compile(TRIGGER)


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The contract's conditions on a match."""
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = _digits(found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def _emails(text: str):
    """Leftmost matches, found from their at signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if free <= start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' valid matches, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m.group())]
    return sorted(out)


@dataclass(frozen=True)
class Settings:
    """``window``: characters the tagger sees at a time, ``stride`` apart.
    ``train_texts``: bound of the training sample, the rows with a trigger
    character with the least hashes of (doc_id, text); ``train_spots``: windows from one text.
    ``accept``: least probability of the first and mean probability of all
    characters of a span."""
    window: int = 64
    stride: int = 32
    train_texts: int = 1000
    train_spots: int = 3
    epochs: int = 16
    batch: int = 48
    rate: float = 0.03
    accept: float = 0.9
    seed: int = 8


def _symbols(text: str) -> np.ndarray:
    """Character classes: 0 for padding, printable ASCII one by one, then other
    letters, blanks and the rest."""
    out = np.empty(len(text), np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = (codes >= 32) & (codes < 127)
    out[ascii_] = codes[ascii_] - 31
    out[~ascii_] = 98
    out[(codes >= 0xC0) & (codes < 0x2000)] = 96
    out[(codes == 10) | (codes == 9) | (codes == 13)] = 97
    return out


N_SYMBOLS, N_TAGS = 99, 1 + 2 * len(KINDS)


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside; 1 + 2k at the start of a span of kind k, 2 + 2k inside."""
    out = np.zeros(n, np.int64)
    for a, k, b in spans:
        out[max(a, 0):b] = 2 + 2 * k
        if a >= 0:
            out[a] = 1 + 2 * k
    return out


def _variant(kind: int, found: str, rng: random.Random) -> str:
    """Another way to write a span, which the patterns may miss."""
    if kind == 3:
        d = "".join(c for c in found if c.isdigit())
        area, mid, last = d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{d[:-10] or '1'}-{area}-{mid}-{last}",
                           f"00{d[:-10] or '1'} {area} {mid} {last}", f"{area}.{mid}.{last}"]) if len(d) >= 10 else found
    if kind == 0:
        left, _, right = found.partition("@")
        return rng.choice([f"{left} @ {right}", f"{left}@{right}", f"{left}@ {right}"])
    if kind == 2:
        d = "".join(c for c in found if c.isdigit())
        return rng.choice([d, " ".join(d[i:i + 4] for i in range(0, len(d), 4)),
                           ".".join(d[i:i + 4] for i in range(0, len(d), 4)), "-".join(d[i:i + 4] for i in range(0, len(d), 4))])
    return found


def examples(text: str, s: Settings) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(context, spans) around places of a text with trigger characters: labelled
    by the patterns, some spans written another way."""
    rng = random.Random(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    spans = base_spans(text)
    out = []
    for a, k, b in rng.sample(spans, min(len(spans), s.train_spots)):
        if any(c < b and a < d and (c, j, d) != (a, k, b) for c, j, d in spans):
            continue  # a place of two kinds teaches nothing
        for found in {text[a:b], _variant(k, text[a:b], rng)}:
            left = rng.randint(0, max(0, s.window - len(found) // 2))
            before = text[max(0, a - left):a]
            near = [(c - a + len(before), j, d - a + len(before)) for c, j, d in spans if a - len(before) < d <= a]
            if any(c < 0 for c, _, _ in near):
                continue
            context = (before + found + text[b:b + s.window])[:s.window]
            later = [(c - b + len(before) + len(found), j, d - b + len(before) + len(found))
                     for c, j, d in spans if c >= b]
            near += [(len(before), k, len(before) + len(found)), *later]
            out.append((context, [(c, j, min(d, len(context))) for c, j, d in near if c < len(context)]))
    places = [m.start() for m in _TRIGGER.finditer(text)]
    for at in rng.sample(places, min(len(places), s.train_spots)) if places else []:
        start = max(0, at - rng.randint(0, s.window - 1))
        near = [(a - start, k, min(b - start, s.window)) for a, k, b in spans if a < start + s.window and b > start]
        out.append((text[start:start + s.window], near))
    return out


def training_windows(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of the bounded training sample."""
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[(c, [x for span in spans for x in span]) for c, spans in examples(t, s)]
                          for t in texts], dtype=object)

    drawn = hash_sample(docs.select("doc_id", "text").filter(F.col("text").rlike(TRIGGER)), s.train_texts,
                        "doc_id", "text").checkpoint()
    rows = drawn.select(F.pandas_udf(cut, "array<struct<context: string, spans: array<int>>>")("text").alias("w")).collect()
    symbols, tags = [], []
    for r in rows:
        for context, flat in r.w:
            x, y = np.zeros(s.window, np.int64), np.zeros(s.window, np.int64)
            x[:len(context)] = _symbols(context)
            y[:len(context)] = _tags(len(context), list(zip(flat[::3], flat[1::3], flat[2::3])))
            symbols.append(x)
            tags.append(y)
    return (np.array(symbols).reshape(-1, s.window), np.array(tags).reshape(-1, s.window))


def train(docs: DataFrame, s: Settings = Settings()) -> Tagger:
    """A tagger trained on the sample; untrained taggers of an empty sample find nothing."""
    symbols, tags = training_windows(docs, s)
    tagger = Tagger(N_SYMBOLS, N_TAGS, seed=s.seed)
    if len(symbols):
        tagger.train(symbols, tags, s.epochs, s.batch, s.rate, s.seed)
    else:
        tagger.p["c"][0] = 100
    return tagger


_FORBIDDEN = np.zeros((N_TAGS, N_TAGS), np.float32)
_FORBIDDEN_FIRST = np.zeros(N_TAGS, np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e4  # inside a span only after its start or inside
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
    _FORBIDDEN_FIRST[2 + 2 * _k] = -1e4

_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9])+"),
    "phone": re.compile(r"\+?\(?[0-9]+(?:[ ().-]+[0-9]+){2,}"),
}


def plausible(kind: str, found: str) -> bool:
    """What a span of the tagger must look like, besides the contract's conditions."""
    return bool(_SHAPES[kind].fullmatch(found)) and valid(kind, found)


def tagged_spans(texts: list[str], tagger: Tagger, s: Settings) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans (start, kind, end) of each text.

    Windows begin every ``stride`` characters over the whole text; one without a
    trigger character holds no span and isn't tagged. Windows of all texts are
    tagged in batches; a character's tag probabilities are the mean of those of
    its windows, weighted by the distance to the window's edge; over each stretch
    of windows the best path follows the allowed transitions."""
    windows, owner, starts = [], [], []
    for n, text in enumerate(texts):
        places = np.array([m.start() for m in _TRIGGER.finditer(text)])
        if not len(places):
            continue
        first = np.maximum(0, (places - s.window) // s.stride + 1)
        todo = np.unique(np.concatenate([np.arange(a, p // s.stride + 1) for a, p in zip(first, places)])) * s.stride
        for a in todo.tolist():
            x = np.zeros(s.window, np.int64)
            part = _symbols(text[a:a + s.window])
            x[:len(part)] = part
            windows.append(x)
            owner.append(n)
            starts.append(a)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not windows:
        return out
    chance = np.concatenate([tagger.posteriors(np.array(windows[i:i + 512])) for i in range(0, len(windows), 512)])
    weight = np.minimum(np.arange(1, s.window + 1), np.arange(s.window, 0, -1)).astype(np.float32)[:, None]
    k = 0
    while k < len(windows):  # a stretch: windows of one text that overlap
        last = k
        while last + 1 < len(windows) and owner[last + 1] == owner[k] and starts[last + 1] < starts[last] + s.window:
            last += 1
        text, begin = texts[owner[k]], starts[k]
        n = min(len(text), starts[last] + s.window) - begin
        mean, total = np.zeros((n + s.window, N_TAGS), np.float32), np.full((n + s.window, 1), 1e-9, np.float32)
        for w in range(k, last + 1):
            at = starts[w] - begin
            mean[at:at + s.window] += chance[w] * weight
            total[at:at + s.window] += weight
        mean = (mean / total)[:n]
        path = best_path(np.log(mean + 1e-6), _FORBIDDEN, _FORBIDDEN_FIRST)
        sure = mean[np.arange(n), path]
        for a in np.flatnonzero(path % 2 == 1).tolist():
            kind, b = (int(path[a]) - 1) // 2, a + 1
            while b < n and path[b] == path[a] + 1:
                b += 1
            if sure[a] >= s.accept and sure[a:b].mean() >= s.accept and plausible(KINDS[kind], text[begin + a:begin + b]):
                out[owner[k]].append((begin + a, kind, begin + b))
        k = last + 1
    return out


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans_of(texts: list[str], tagger: Tagger, s: Settings) -> list[tuple]:
    """``FIELDS`` for each text. Base spans stay; a span of the tagger is added
    where it overlaps no base span."""
    rows = []
    for text, tagged in zip(texts, tagged_spans(texts, tagger, s)):
        base = base_spans(text)
        added = [(a, k, b) for a, k, b in tagged if all(b <= c or d <= a for c, _, d in base)]
        counts = [sum(k == j for _, k, _ in base) for j in range(len(KINDS))]
        rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(),
                     _written(sorted(base + added)), len(added)))
    return rows


def personal_data(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, FIELDS...): one row for each input row; places count code points,
    ends exclusive. Null texts count as empty; repeated rows get equal results; an
    empty table gives no rows. Other columns aren't read."""
    prepared(docs)
    broadcast = docs.sparkSession.sparkContext.broadcast(train(docs, s))

    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(spans_of(["" if t is None else t for t in texts], broadcast.value, s),
                            columns=[f.split()[0] for f in FIELDS.split(", ")])

    # a text without trigger characters has no spans; it isn't sent to Python
    text = F.when(F.col("text").rlike(TRIGGER), F.col("text"))
    return docs.select("doc_id", F.pandas_udf(find, FIELDS)(text).alias("p")).select("doc_id", "p.*")
