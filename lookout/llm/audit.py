"""Operator 12: how the filters of a corpus interact, in every order of them.

Four filters look at a text alone, the fifth at equal texts anywhere. For the
fifth, texts are range-partitioned by prefixes whose lengths adapt to the data,
and each range goes whole into a compressed trie whose terminals hold the least
id of a text. Tasks first put what they read into tries of their own, so that
of a group of copies only one goes on. A document is then the set of filters it
fails; counts of the few different sets give every order's report.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import global_prefix, prepared
from lookout.session import task_parallelism

LETTERS = "ABCDE"                    # fixed by the contract, as are the limits below
ORDERS = ["".join(p) for p in permutations(LETTERS)]
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
RANGE_BYTES = 32 << 20               # distinct text in a range, about; its trie fits a worker
LOCAL_CHARS = 16 << 20               # text in a task's own trie before it is emptied
FIRST_PREFIX = 16                    # characters; overfull prefixes grow by GROWTH
GROWTH = 4


def text_failures(text: str) -> str:
    """The letters of the filters A to D that ``text`` fails. Words are those of its
    UTF-8 form: bytes are split at the six ASCII blanks."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    marks = len(raw) - len(raw.translate(None, MARKS))
    return "".join(letter for letter, fails in zip(LETTERS, (
        n < 200, 100 * len(set(words)) < 50 * n, 100 * upper > 3 * len(text), marks > 0)) if fails)


class Node:
    """A node of the trie: the characters on the edge to it, its children by their
    first character and, at the end of a text, that text's least id, the letters
    it fails and its rows counted by (id, part)."""

    __slots__ = ("label", "children", "least", "fails", "rows")

    def __init__(self, label: str):
        self.label, self.children = label, {}
        self.least = self.fails = self.rows = None


def _shared(label: str, text: str, at: int) -> int:
    """Characters that ``label`` and ``text`` from ``at`` share, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Whole texts, each stored once; shared beginnings are stored once too."""

    def __init__(self):
        self.root, self.chars = Node(""), 0

    def terminal(self, text: str) -> Node:
        """The node at which ``text`` ends, new if need be."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.chars += len(child.label)
            elif not text.startswith(child.label, at):
                cut = _shared(child.label, text, at)
                upper = node.children[text[at]] = Node(child.label[:cut])
                upper.children[child.label[cut]] = child
                child.label = child.label[cut:]
                child = upper
            node, at = child, at + len(child.label)
        return node

    def add(self, text: str, number: int | None, part: str, fails: str | None, n: int = 1) -> None:
        """Counts ``n`` rows of ``text``. ``fails`` None: worked out when the text is new."""
        node = self.terminal(text)
        if node.rows is None:
            node.rows, node.fails = {}, text_failures(text) if fails is None else fails
        if number is not None and (node.least is None or number < node.least):
            node.least = number
        node.rows[number, part] = node.rows.get((number, part), 0) + n
        self.chars += 8  # a row's place

    def texts(self) -> Iterator[tuple[str, Node]]:
        """Every text with its terminal."""
        stack = [("", self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node.label
            if node.rows is not None:
                yield text, node
            stack += [(text, child) for child in node.children.values()]


def range_cuts(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[str]:
    """Prefixes, in order, between which lie about equal amounts of different text
    (each text counted once): at most ``range_bytes``, or a shuffle partition's share
    if that is less. Prefixes of ``FIRST_PREFIX`` characters are summed up over all
    documents; those that hold more than two ranges are taken apart by longer
    ones, until none does. Cuts and overfull prefixes come to the driver: about
    one for each range."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    cuts: set[str] = set()
    size, target = FIRST_PREFIX, None
    while True:
        groups = (texts.groupBy(F.substring("text", 1, size).alias("prefix"), F.xxhash64("text").alias("h"))
                  .agg(F.max(F.octet_length("text").cast("long")).alias("bytes"))
                  .groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).checkpoint())
        if target is None:
            total = groups.agg(F.sum("bytes")).first()[0] or 0
            target = max(1, min(range_bytes, total // task_parallelism(spark)))
        ranked = global_prefix(groups, ["prefix"], ["bytes"])
        over = F.floor((F.col("p_bytes") + F.col("bytes")) / target) > F.floor(F.col("p_bytes") / target)
        cuts |= {r[0] for r in ranked.filter(over).select("prefix").collect()}
        heavy = [r[0] for r in groups.filter((F.col("bytes") > 2 * target) & (F.col("n") > 1))
                 .select("prefix").collect()]
        if not heavy:
            return sorted(cuts)
        cuts |= set(heavy)
        inside = spark.createDataFrame([(p,) for p in heavy], "prefix string")
        # at most total / (2 * target) prefixes, so fewer than half as many as there are ranges
        texts = (texts.join(F.broadcast(inside), F.substring("text", 1, size) == F.col("prefix"), "left_semi"))
        size *= GROWTH


_DEALT = "range int, text string, doc_id long, part string, fails string, n long"
_DECIDED = "doc_id long, part string, fails string, n long"
_DEALT_ARROW = pa.schema([("range", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()),
                          ("part", pa.string()), ("fails", pa.string()), ("n", pa.int64())])
_DECIDED_ARROW = pa.schema(list(_DEALT_ARROW)[2:])


def _batches(rows: Iterable[tuple], schema: pa.Schema, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``rows`` as record batches of about ``chars`` characters of text, or 10,000 rows."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[1] or "") if len(schema) == 6 else 0
        if len(block) >= 10_000 or held >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block, held = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def _settled(node: Node) -> Iterator[tuple]:
    """The rows of a terminal that need no other copy: (id, part, fails, n). An id
    above the least fails E, a null one never does."""
    for (number, part), n in node.rows.items():
        if number is None:
            yield number, part, node.fails, n
        elif number > node.least:
            yield number, part, node.fails + "E", n


def _dealt(batches: Iterator[pa.RecordBatch], cuts: list[str], local_chars: int) -> Iterator[tuple]:
    """Through the task's own tries: settled rows, dealt evenly without their text,
    and for each different text the row of its least id, with the text, to the
    range that it lies in."""
    trie = Trie()

    def emptied():
        for text, node in trie.texts():
            for number, part, fails, n in _settled(node):
                yield (number or 0) % (len(cuts) + 1), None, number, part, fails, n
            if node.least is not None:
                at = bisect.bisect_right(cuts, text)
                for (number, part), n in node.rows.items():
                    if number == node.least:
                        yield at, text, number, part, node.fails, n

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for number, text, lang in zip(*columns):
            trie.add(text or "", number, lang or "", None)
            if trie.chars > local_chars:
                yield from emptied()
                trie = Trie()
    yield from emptied()


def _ranges_done(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One range: its texts into a trie; settled rows pass by."""
    trie = Trie()
    for batch in batches:
        for _, text, number, part, fails, n in zip(*[c.to_pylist() for c in batch.columns]):
            if text is None:
                yield number, part, fails, n
            else:
                trie.add(text, number, part, fails, n)
    for _, node in trie.texts():
        for (number, part), n in node.rows.items():
            if number == node.least:
                yield number, part, node.fails, n
        yield from _settled(node)


def failed_filters(docs: DataFrame, range_bytes: int = RANGE_BYTES, local_chars: int = LOCAL_CHARS) -> DataFrame:
    """(doc_id, part, fails, n): the ``n`` equal rows of a document fail the filters
    whose letters are in ``fails``. ``part`` is lang, null as the empty string; a
    null text is an empty one; of copies all but those with the least id fail E,
    wherever they stand; a null doc_id is neither above nor below another, so it
    never fails E nor makes others fail. Whole texts are compared; a range's
    different texts are one task's memory, about ``range_bytes`` of them, or one
    very long text. An empty table gives no rows; other columns aren't read."""
    prepared(docs)
    cuts = range_cuts(docs, range_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    dealt = rows.mapInArrow(lambda it: _batches(_dealt(it, cuts, local_chars), _DEALT_ARROW), _DEALT)
    return (dealt.repartitionById(len(cuts) + 1, "range")
            .mapInArrow(lambda it: _batches(_ranges_done(it), _DECIDED_ARROW), _DECIDED))


def report(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of the contract from ``failed_filters`` rows: one row for each
    part, order of the filters and step. ``labels`` (doc_id, quality, toxic) may
    be as large as the documents; several labels of one id count as their greatest."""
    good = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
            .agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
                 F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("bad")))
    sets = (failed.groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n"))
            .join(good, F.col("doc_id") == F.col("id"), "left")
            .groupBy("part", "fails")
            .agg(F.sum("n").alias("n"), F.sum(F.expr("n * coalesce(good, 0)")).alias("good"),
                 F.sum(F.expr("n * coalesce(bad, 0)")).alias("bad")))
    steps = (sets.withColumn("filter_order", F.explode(F.lit(ORDERS)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
             .withColumn("own", F.expr("instr(fails, substring(filter_order, step, 1)) > 0"))
             # letters of earlier steps struck out of the failed ones
             .withColumn("left", F.expr("translate(fails, substring(filter_order, 1, step - 1), '')"))
             .withColumn("before", F.expr("length(`left`) < length(fails)")))

    def total(what: str, where: str, name: str):
        return F.sum(F.expr(f"CASE WHEN {where} THEN {what} ELSE 0L END")).alias(name)

    return (steps.groupBy("part", "filter_order", "step").agg(
        total("n", "NOT before AND NOT own", "kept"),
        total("n", "own AND NOT before", "removed"),
        total("n", "own AND before", "redundant"),
        total("n", "own AND length(fails) = 1", "unique_fails"),
        total("good", "own AND NOT before", "good_lost"),
        total("bad", "own AND NOT before", "toxic_lost"),
        # of all orders, those in which this filter is the first of the failed ones
        total(f"n * ({len(ORDERS)} div length(fails))", "own", "shapley")))


def audited(docs: DataFrame, labels: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): ``report`` over all documents."""
    return report(failed_filters(docs, range_bytes), labels)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
least AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
docs AS (
  SELECT words.doc_id, part,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(words.text, '[A-Z]')) > 3 * length(words.text) AS c,
         regexp_matches(words.text, '[#$%&*|]') AS d,
         coalesce(words.doc_id > first_id, false) AS e,
         coalesce((SELECT max(quality) FROM labels WHERE labels.doc_id = words.doc_id) = 1, false) AS good,
         coalesce((SELECT max(toxic) FROM labels WHERE labels.doc_id = words.doc_id) = 1, false) AS bad
  FROM words JOIN least USING (text)),
fails AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: [a, b, c, d, e][ascii(f) - 64]) AS f,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM docs GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
  FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x,
         string_split(substr(filter_order, 1, step - 1), '') AS prior
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
marked AS (
  SELECT *, list_contains(f, x) AS own, list_has_any(f, prior) AS before FROM fails, steps),
counted AS (
  SELECT part, filter_order, step::INTEGER AS step, x,
         coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (own AND len(f) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT before), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counted
"""
