"""Personal data: base patterns, and unseen identifiers found through the contexts of known ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tallyloom.llm import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_TRIM = ".,;:!?\"'()[]{}<>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address ends at its only ``@`` on the left, so each ``@`` is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, sorted, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))


def _plain(token: str) -> str:
    return token.strip(_TRIM).lower()


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and (text[start] in _TRIM or text[start].isspace()):
        start += 1
    while end > start and (text[end - 1] in _TRIM or text[end - 1].isspace()):
        end -= 1
    return start, end


def _unmatched(text: str, start: int, end: int, min_digits: int) -> list[tuple[int, int]]:
    """Between ``start`` and ``end``: tokens with an ``@``, and neighbouring tokens with digits as one, from ``min_digits`` on."""
    groups, joins = [], False
    for m in _TOKEN.finditer(text, start, end):
        if "@" in m[0]:
            groups.append((m.start(), m.end()))
            joins = False
        elif any("0" <= c <= "9" for c in m[0]):
            groups.append((groups.pop()[0] if joins else m.start(), m.end()))
            joins = True
        else:
            joins = False
    found = [_trimmed(text, a, b) for a, b in groups]
    return [(a, b) for a, b in found
            if sum("0" <= c <= "9" for c in text[a:b]) >= min_digits or ("@" in text[a:b] and b - a > 1)]


def _parts(text: str, start: int, end: int, spans: list[tuple[int, int, int]], min_digits: int) -> list[Span]:
    """(kind or -1, start, end) of a run of marked tokens: its base spans, and what lies outside them and is shaped like an
    identifier. Text outside that is not goes with the base span beside it; overlapping base spans count as the first."""
    known: list[list[int]] = []
    for a, b, k in spans:
        if known and a < known[-1][1]:
            known[-1][1] = max(known[-1][1], min(b, end))
        else:
            known.append([max(a, start), min(b, end), k])
    out: list[Span] = []
    done = start
    for a, b, k in [*known, (end, end, -1)]:
        between = _unmatched(text, done, a, min_digits)
        if between:
            until, begin = between[0][0], between[-1][1]
        elif k < 0:
            until = begin = end
        else:
            blank = max(text.rfind(" ", done, a), text.rfind("\n", done, a))
            until = begin = blank + 1 if blank >= 0 else a if out else start
        if out:
            out[-1] = (out[-1][0], *_trimmed(text, out[-1][1], until))
        out += [(-1, *x) for x in between]
        if k >= 0:
            out.append((k, begin if between or out else start, b))
            done = b
    return [(k, *_trimmed(text, a, b)) for k, a, b in out]


def instances(text: str, spans: list[Span], min_digits: int) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, hash of the token, hashes of its patterns) of everything shaped like an identifier.

    Neighbouring tokens with digits count as one; base spans and what lies between them count each for itself, see
    :func:`_parts`. Patterns are lexical: the word before with the token's shape, the two words before, and the words on both
    sides. A neighbour in the same run stands for itself by its kind, or by its shape if it has none.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    marked = [any("0" <= c <= "9" for c in text[a:b]) or "@" in text[a:b] for a, b in tokens]
    hash64 = lambda *x: xxhash.xxh64_intdigest("\0".join(x)) - 2**63
    out, i, at = [], 0, 0
    by_place = sorted((a, b, k) for k, a, b in spans)
    while i < len(tokens):
        if not marked[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(tokens) and marked[j + 1]:
            j += 1
        start, end = _trimmed(text, tokens[i][0], tokens[j][1])
        while at < len(by_place) and by_place[at][1] <= start:
            at += 1
        here, k = [], at
        while k < len(by_place) and by_place[k][0] < end:
            if by_place[k][1] > start:
                here.append(by_place[k])
            k += 1
        parts = _parts(text, start, end, here, min_digits)
        names = [f"\1{KINDS[kind]}" if kind >= 0 else f"\1{_shape(text[a:b])}" for kind, a, b in parts]
        left = [_plain(text[a:b]) for a, b in tokens[max(0, i - 2):i]]
        words = [*[""] * (2 - len(left)), *left, *names, _plain(text[slice(*tokens[j + 1])]) if j + 1 < len(tokens) else ""]
        for place, (kind, a, b) in enumerate(parts):
            two, one, right = words[place], words[place + 1], words[place + 3]
            token = text[a:b]
            patterns = [hash64("shape", one, _shape(token)), hash64("two", two, one), hash64("sides", one, right)]
            out.append((a, b, kind, hash64(token.lower()), patterns))
        i = j + 1
    return out


_SPAN_TYPE = ArrayType(StructType([StructField(n, IntegerType()) for n in ("kind", "start", "end")]))
_FOUND_TYPE = ArrayType(StructType([
    *[StructField(n, IntegerType()) for n in ("start", "end", "kind")], StructField("token", LongType()),
    StructField("patterns", ArrayType(LongType()))]))


def _scan(min_digits: int):
    span = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")]))
    found = pa.list_(pa.struct([
        *[(n, pa.int32()) for n in ("start", "end", "kind")], ("token", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
    any_mark = re.compile("[0-9@]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seen = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text is None or not any_mark.search(text):
                    spans.append([])
                    seen.append([])
                    continue
                own = base_spans(text)
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                seen.append([
                    dict(zip(("start", "end", "kind", "token", "patterns"), x)) for x in instances(text, own, min_digits)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(spans, span), pa.array(seen, found)],
                names=[*batch.schema.names[:-1], "__base", "__found"])
    return run


#: Rounds end when the trust of all tokens together rises by no more than this.
SETTLED = 1e-6


def bootstrap(found: DataFrame, *, min_confidence: float = 0.9, min_support: int = 8) -> DataFrame:
    """(token, kind) of identifiers that only their contexts give away.

    ``found``: token, kind (-1: none), pattern; a row for each occurrence and pattern. Tokens and patterns form a graph. Known tokens have
    trust 1 for their kind. A pattern's confidence for a kind is the trust among its distinct tokens over their number plus one; it
    counts from ``min_confidence`` and ``min_support`` distinct trusted tokens on. An unknown token's trust is the chance
    that not all of its counting patterns err. Every round scores all patterns and then all tokens, as joins and sums. Trust only
    rises from round to round; rounds end when it no longer does.
    """
    edges = common.staged(found.groupBy("pattern", "token").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.min("kind").alias("least"))
    sizes = common.staged(sizes, "pii-patterns")
    # A pattern whose tokens are all known finds nothing; only the others need scores.
    useful = edges.join(sizes.where((F.col("least") < 0) & (F.col("n") > min_support)).select("pattern", "n"), "pattern")
    useful = common.staged(useful, "pii-useful")
    known = useful.where("kind >= 0").select("token", "kind", F.lit(1.0).alias("trust")).distinct()
    unknown = useful.where("kind < 0").select("token", "pattern")
    trust, learned, total = known, None, 0.0
    while True:
        scored = (
            useful.select("token", "pattern", "n").join(trust, "token")
            .groupBy("pattern", "kind").agg(
                (F.sum("trust") / (F.max("n") + 1)).alias("c"), F.count("*").alias("support"))
            .where((F.col("c") >= min_confidence) & (F.col("support") >= min_support))
        )
        latest = common.staged(
            unknown.join(scored, "pattern").groupBy("token", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("trust")), "pii-learned")
        if learned is not None:
            common.discard(learned)
        learned, before = latest, total
        total = learned.agg(F.sum("trust")).first()[0] or 0.0
        if total <= before + SETTLED:
            break
        trust = known.union(learned.select("token", "kind", "trust"))
    best = learned.groupBy("token").agg(F.max(F.struct("trust", (-F.col("kind")).alias("k"))).alias("b"))
    return best.where(F.col("b.trust") >= min_confidence).select("token", (-F.col("b.k")).alias("kind"))


def find(docs: DataFrame, *, text: str = "text", min_digits: int = 4, min_confidence: float = 0.9, min_support: int = 8,
         carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end), kind as a place in ``KINDS``, sorted.

    ``base`` holds the base patterns, ``spans`` also what the contexts of the whole corpus add. Each text is read
    once; of an occurrence of something like an identifier (``min_digits`` digits, or an ``@``) three hashed patterns go on.

    ``carry``: the input columns to keep (all by default). Null and empty texts have no spans; copies of a text or of a token count
    once among a pattern's tokens; repeated rows are all returned; an empty table gives no rows. Input columns named like
    an output column are replaced.
    """
    known = common.without(docs, *[c for c in ("base", "spans") if c != text])
    kept = [c for c in known.columns if carry is None or c in carry]
    ready = known.withColumns({"__rid": F.monotonically_increasing_id(), "__text": F.col(f"`{text}`")}).select(
        *[f"`{c}`" for c in kept], "__rid", "__text")
    schema = StructType([*ready.schema.fields[:-1], StructField("__base", _SPAN_TYPE), StructField("__found", _FOUND_TYPE)])
    table = common.staged(ready.mapInArrow(_scan(min_digits), schema), "pii")
    seen = table.select("__rid", F.explode("__found").alias("x")).select("__rid", "x.*")
    learned = bootstrap(
        seen.select("token", "kind", F.explode("patterns").alias("pattern")),
        min_confidence=min_confidence, min_support=min_support)
    added = (
        seen.where("kind < 0").select("__rid", "token", "start", "end").join(learned, "token")
        .groupBy("__rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("__added"))
    )
    merged = F.when(F.col("__added").isNull(), F.col("__base")).otherwise(F.sort_array(F.concat("__base", "__added")))
    return table.join(added, "__rid", "left").select(
        *[f"`{c}`" for c in kept], F.col("__base").alias("base"), merged.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
