"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyloom.llm import common
from tallyloom.llm.common import ALNUM_BYTES

WINDOW = 13
#: Words of test items in one automaton, which then takes about 60 MB, and automata that one scan of the documents holds;
#: more items make more automata, and more than these make a further scan.
BLOCK_WORDS, BLOCKS_A_SCAN = 100_000, 8


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return (text or b"").translate(ALNUM_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences.

    ``step[s]`` leads on by word number, ``link[s]`` to the longest suffix in another state, ``length[s]`` is the longest
    sequence of the state. ``vocabulary`` numbers the words of the items, and ``pairs`` holds their neighbours. A state has one
    sequence of each length that it covers, so it ends at most one window; ``report`` holds its length and items.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=list)
    shortest: int = 0
    pairs: np.ndarray | None = None
    report: dict[int, tuple[int, tuple[int, ...]]] = field(default_factory=dict)

    def _extend(self, last: int, word: int) -> int:
        """The state after ``last`` and ``word``; states split where another item leaves a shared path."""
        known = self.step[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            new = self._state(self.length[last] + 1)
            at = last
            while at >= 0 and word not in self.step[at]:
                self.step[at][word] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
                return new
            known = self.step[at][word]
            if self.length[known] == self.length[at] + 1:
                self.link[new] = known
                return new
            self.link[new] = self._split(at, word, known)
            return new
        return self._split(last, word, known)

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """The part of ``old`` that ends shortly after ``at`` becomes a state of its own."""
        copy = self._state(self.length[at] + 1)
        self.step[copy] = dict(self.step[old])
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while at >= 0 and self.step[at].get(word) == old:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def build(self, items: Iterable[tuple[str, list[bytes]]]) -> Automaton:
        """Adds the items and works out which windows end in each state."""
        sequences = []
        for name, words in items:
            if words:
                self.names.append(name)
                sequences.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        found: dict[int, tuple[int, set[int]]] = {}
        for item, sequence in enumerate(sequences):
            state, reach = 0, 0
            for at, word in enumerate(sequence):
                state, reach = self.step[state][word], min(reach + 1, self.window)
                while self.length[self.link[state]] >= reach:
                    state = self.link[state]
                if reach == self.window or at + 1 == len(sequence):
                    found.setdefault(state, (reach, set()))[1].add(item)
        self.report = {state: (reach, tuple(owners)) for state, (reach, owners) in found.items()}
        size = max(len(self.vocabulary), 1)
        self.pairs = np.unique(np.array([a * size + b for s in sequences for a, b in zip(s, s[1:])], np.int64))
        self.shortest = min((min(len(s), self.window) for s in sequences), default=0)
        return self

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The spans (first word, word after the last) that windows cover, and the items that own the windows.

        Only runs whose neighbouring words stand next to each other in some item are walked.
        """
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        n = len(words)
        if not self.shortest or n < self.shortest:
            return spans, owners
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        if self.shortest == 1:
            starts, stops = _runs(ids >= 0)
        else:
            key = ids[:-1] * max(len(self.vocabulary), 1) + ids[1:]
            known = (ids[:-1] >= 0) & (ids[1:] >= 0)
            known[known] = _member(key[known], self.pairs)
            starts, stops = _runs(known)
            stops = stops + 1
        wide = stops - starts >= self.shortest
        for start, stop in zip(starts[wide].tolist(), stops[wide].tolist()):
            self._walk(ids[start:stop].tolist(), start, spans, owners)
        return _joined(spans), owners

    def _walk(self, ids: list[int], offset: int, spans: list[tuple[int, int]], owners: set[int]) -> None:
        """Longest matching length word by word; a window ends in the state or in one of its suffixes."""
        state, matched = 0, 0
        step, link, length, report = self.step, self.link, self.length, self.report
        for at, word in enumerate(ids):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state, matched = step[state][word], matched + 1
            if matched < self.shortest:
                continue
            look = state
            while length[look] >= self.shortest:
                found = report.get(look)
                if found and found[0] <= matched:
                    spans.append((offset + at + 1 - found[0], offset + at + 1))
                    owners.update(found[1])
                look = link[look]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def pieces(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """The words of an item, in pieces of at most ``most`` that overlap by one word less than a window, so that each
    window stands whole in a piece; an item within the bound is one piece."""
    size = max(most, window)
    if len(words) <= size:
        return [words]
    return [words[a:a + size] for a in range(0, len(words) - window + 1, size - window + 1)]


def _cut_items(window: int, most: int):
    """Pieces of items (item, words, n), and how many words the task has put out before each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            rows = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                for words in pieces(words_of(text), window, most):
                    if words:
                        rows.append((name, b" ".join(words), len(words), done))
                        done += len(words)
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "words", "n", "before"])
    return run


def _build(window: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        items = ((name, words.split(b" ")) for name, words in zip(rows["item"].to_pylist(), rows["words"].to_pylist()))
        built = pickle.dumps(vars(Automaton(window).build(items)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([built], pa.binary())})
    return run


def _built(benchmark: DataFrame, window: int, item: str, text: str, block_words: int) -> DataFrame:
    """(block, automaton) in the shared folder, a folder for each block; tasks cut the items and build the automata.

    Pieces are laid end to end in the order of the tasks that cut them, and a block takes those that begin among its
    ``block_words`` words, so it holds less than twice as many whatever the lengths of items and the partitions are.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    parts = common.staged(
        rows.mapInArrow(_cut_items(window, block_words), "item string, words binary, n long, before long")
        .withColumn("task", F.spark_partition_id()), "items")
    # One row for each task that cut items.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("task").agg(F.sum("n").alias("total")).select(
        "task", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    placed = parts.join(offsets, "task").select(
        F.floor((F.col("offset") + F.col("before")) / block_words).alias("block"), "item", "words")
    path = f"{common.shared_folder(spark)}/tallyloom-llm/automata-{uuid.uuid4().hex}"
    placed.groupBy("block").applyInArrow(_build(window), "block long, automaton binary").write.partitionBy("block").parquet(path)
    common.discard(parts)
    return common.removable(spark.read.schema("automaton binary, block long").parquet(path), path)


def _pickled(built: DataFrame) -> Iterator[bytes]:
    """The fields of the automata as they were written, one automaton at a time."""
    for row in built.select("block").distinct().orderBy("block").collect():
        yield bytes(built.where(F.col("block") == row.block).first().automaton)


def automata(benchmark: DataFrame, window: int = WINDOW, *, item: str = "item_id", text: str = "text",
             block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """The automata of a benchmark, one for every ``block_words`` words of items. An item of more words goes into several,
    under the same name."""
    built = _built(benchmark, window, item, text, block_words)
    yield from (Automaton(**pickle.loads(one)) for one in _pickled(built))
    common.discard(built)


_SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("after", IntegerType())]))
_FOUND = [StructField("n_words", LongType()), StructField("__spans", _SPANS), StructField("__items", ArrayType(StringType()))]


def _scan(shared: list[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Automaton(**pickle.loads(one.value)) for one in shared]
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                words = words_of(text)
                covered, names = [], []
                for automaton in blocks:
                    found, owners = automaton.hits(words)
                    covered += found
                    names += [automaton.names[i] for i in owners]
                counts.append(len(words))
                spans.append([{"first": a, "after": b} for a, b in _joined(covered)])
                items.append(names)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
            columns = [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n_words", "__spans", "__items"])
    return run


def _scanned(docs: DataFrame, shared: list[Broadcast], text: str, carry: list[str]) -> DataFrame:
    ready = docs.select(*[f"`{c}`" for c in carry], F.col(f"`{text}`").cast("binary").alias("__bytes"))
    return ready.mapInArrow(_scan(shared), StructType([*ready.schema.fields[:-1], *_FOUND]))


def _union(spans: Column) -> Column:
    """Spans of several automata, joined where they touch."""
    start = F.array().cast(_SPANS)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["after"], span["after"]).alias("after"))
        return F.when((F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["after"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(spans), start, add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_coverage: int = 20,
                       text: str = "text", carry: list[str] | None = None, block_words: int = BLOCK_WORDS,
                       blocks_a_scan: int = BLOCKS_A_SCAN) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items``, ``spans`` and ``contaminated``.

    A window is ``window`` consecutive words of an item, or a whole item that is shorter. A word inside an occurrence of any
    window is hit; ``spans`` are the runs of hit words (first word, word after the last), ``items`` the sorted ids of
    the items with occurring windows. A document is contaminated if one in ``max_coverage`` of its words or more is hit.

    Automata of ``block_words`` words of items are built in tasks and broadcast one by one; a scan of the documents holds up to
    ``blocks_a_scan`` of them. What further scans find is written and their broadcasts are removed.

    ``carry``: the input columns to keep (all by default). Null texts have no words and are never contaminated; items with a null
    text match nothing, a null item id is named "null", items of one id count once; an empty benchmark hits nothing. Repeated rows
    are all returned; an empty table gives no rows. Input columns named like an output column are replaced.
    """
    outputs = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    known = common.without(docs, *[c for c in outputs if c != text.lower()])
    carry = [c for c in known.columns if carry is None or c in carry]
    context = docs.sparkSession.sparkContext
    built = _built(benchmark, window, "item_id", "text", block_words)
    scans = batched(map(context.broadcast, _pickled(built)), blocks_a_scan)
    first, second = list(next(scans, ())), next(scans, None)
    if second is None:
        found = _scanned(known, first, text, carry)
    else:
        table = common.numbered(known, "contamination")
        base = _scanned(table, first, text, [*carry, "__rid"])
        more = None
        while second is not None:
            part = _scanned(table, list(second), text, ["__rid"]).where("size(__items) > 0").select("__rid", "__spans", "__items")
            part = common.staged(part, "contamination-scan")
            for one in second:
                one.destroy()
            more = part if more is None else more.union(part)
            second = next(scans, None)
        more = more.groupBy("__rid").agg(
            F.flatten(F.collect_list("__spans")).alias("__s"), F.flatten(F.collect_list("__items")).alias("__i"))
        found = base.join(more, "__rid", "left").drop("__rid").withColumns({
            "__spans": F.when(F.col("__s").isNull(), F.col("__spans")).otherwise(_union(F.concat("__spans", "__s"))),
            "__items": F.when(F.col("__i").isNull(), F.col("__items")).otherwise(F.concat("__items", "__i")),
        }).drop("__s", "__i")
    common.discard(built)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    return found.select(
        *[f"`{c}`" for c in carry], "n_words", hit.alias("n_hit"),
        F.array_sort(F.array_distinct("__items")).alias("items"), F.col("__spans").alias("spans"),
    ).withColumns({
        "n_items": F.size("items").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (max_coverage * F.col("n_hit") >= F.col("n_words")),
    })


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the given runs of words and what stands between their words."""
    plain = text.translate(ALNUM_BYTES)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for first, after in spans:
        out.append(text[done:places[first][0]])
        done = places[after - 1][1]
    return b"".join([*out, text[done:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        out = [cut(t.encode(), [(x["first"], x["after"]) for x in s]).decode() if s else t for t, s in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], names=batch.schema.names[:-1])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", min_span: int = WINDOW, **limits) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``.

    Spans of at least ``min_span`` words that they still share with the benchmark are cut out of the text, and ``n_chars``
    follows. See :func:`find_contamination` for the limits and for nulls, repeated rows and empty tables. Further
    columns keep their values, whatever their names.
    """
    known, names = common.hidden(docs, text)
    found = find_contamination(known, benchmark, text=text, **limits).where(~F.col("contaminated"))
    long = F.filter("spans", lambda x: x["after"] - x["first"] >= min_span)
    ready = found.select(*[f"`{c}`" for c in names.values() if c != text], f"`{text}`", long.alias("__spans"))
    out = ready.mapInArrow(_cut, StructType(ready.schema.fields[:-1]))
    if "n_chars" in docs.columns:
        out = out.withColumn(names["n_chars"], F.length(f"`{text}`").cast(docs.schema["n_chars"].dataType))
    return common.shown(out, names)
