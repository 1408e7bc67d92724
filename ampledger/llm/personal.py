"""Personal data: fixed forms, and identifiers that their surroundings give away.

Seeds are what the fixed forms of e-mail addresses, IP addresses, card and telephone numbers
match. Words around them are patterns. Other mentions that could be identifiers stand in
patterns too; Spark scores the graph of patterns and values in rounds: a pattern is as good as
the share of its values that are believed, a value as good as its accepted patterns together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces, scratch
from ampledger.operators.grouped import attach
from ampledger.session import row_bound, stored

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

#: A pattern is accepted for a kind from so many believed values and this share of all its values
#: (one more counts against it); a value is an identifier from this belief; rounds at most.
SUPPORT, ACCEPT, BELIEVE, ROUNDS = 3, 0.6, 0.8, 6
#: Characters before and after a mention in which its neighbouring words are looked for.
LEFT, RIGHT = 64, 32

_CLUE = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: without this, long runs cost a square.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Mentions of no fixed form.
_HOST = re.compile(r"@[A-Za-z0-9-]+")
_DIGITS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![A-Za-z0-9])")
_COLONS = re.compile(r"(?<![A-Za-z0-9:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![A-Za-z0-9:])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NO_DIGIT = str.maketrans("123456789", "000000000")

SPAN = "struct<kind:int,start:int,stop:int>"
MENTION = "struct<start:int,stop:int,value:string,seeds:array<int>,kinds:array<int>,patterns:array<string>>"
SCHEMA = f"doc_id long, row_key binary, base array<{SPAN}>, mentions array<{MENTION}>, unknown boolean"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _addresses(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of an address around every ``@`` from left to right, none inside another."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = domain.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed forms, by kind and start, in code points."""
    found = [(EMAIL, *span) for span in _addresses(text, _DOMAIN)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


def other_mentions(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """``(start, end, kinds it could be)`` of identifier-like mentions outside ``taken``:
    addresses without a dotted domain, groups of digits, groups of hexadecimal numbers."""
    parts, at = [], 0
    for start, stop in sorted(taken):
        if stop > at:
            parts.append(text[at : max(start, at)] + "\n" * (stop - max(start, at)))
            at = stop
    text = "".join(parts) + text[at:]
    found = [(start, stop, [EMAIL]) for start, stop in _addresses(text, _HOST)]
    for m in _DIGITS.finditer(text):
        size = len(_NOT_DIGIT.sub("", m.group()))
        kinds = [IP] if m.group().count(".") == 3 and _IP.fullmatch(m.group()) else []
        kinds += [CARD] if 12 <= size <= 19 else []
        kinds += [PHONE] if 7 <= size <= 15 else []
        if kinds:
            found.append((m.start(), m.end(), kinds))
    found += [(m.start(), m.end(), [IP]) for m in _COLONS.finditer(text) if m.end() - m.start() > 6]
    kept, done = [], 0
    for start, stop, kinds in sorted(found):
        if start >= done:
            kept.append((start, stop, kinds))
            done = stop
    return kept


def patterns(text: str, start: int, stop: int) -> list[str]:
    """Lexical patterns of a mention: two words before it, the words on both sides, the word
    before it. Lower case, digits read as 0. Without a word before there is no pattern."""
    before = text[max(0, start - LEFT) : start].lower().translate(_NO_DIGIT).split()[-2:]
    after = text[stop : stop + RIGHT].lower().translate(_NO_DIGIT).split()[:1]
    out = []
    if before:
        out.append(f"{before[-1]} _")
        if after:
            out.append(f"{before[-1]} _ {after[0]}")
        if len(before) == 2:
            out.append(f"{before[0]} {before[1]} _")
    return out


def _value(text: str) -> str:
    """What is the same for two spellings: digits alone, or the text in lower case."""
    plain = text.lower()
    return plain if "@" in plain or ":" in plain else _NOT_DIGIT.sub("", plain)


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` the spans of fixed forms, and all mentions with their values and
    patterns; ``unknown`` if some mention has no fixed form. ``row_key`` is a digest of id and
    text: rows that share it are equal."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            rows = {"row_key": [], "base": [], "mentions": [], "unknown": []}
            for key, text in zip(ids, batch.column("text").to_pylist()):
                base, others = [], []
                if _CLUE.search(text):
                    base = base_spans(text)
                    others = other_mentions(text, [(a, b) for _, a, b in base])
                seeds: dict[tuple[int, int], list[int]] = {}
                for kind, a, b in base:
                    seeds.setdefault((a, b), []).append(kind)
                every = [(a, b, kinds, []) for (a, b), kinds in seeds.items()] + [(a, b, [], kinds) for a, b, kinds in others]
                rows["row_key"].append(xxhash.xxh3_128_digest(f"{key}\n{text}".encode()) if others else None)
                rows["base"].append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
                rows["mentions"].append(
                    [
                        {"start": a, "stop": b, "value": _value(text[a:b]), "seeds": s, "kinds": k, "patterns": patterns(text, a, b)}
                        for a, b, s, k in every
                    ]
                )
                rows["unknown"].append(bool(others))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(rows["row_key"], pa.binary()),
                    pa.array(rows["base"], pa.list_(_SPAN)),
                    pa.array(rows["mentions"], pa.list_(_MENTION)),
                    pa.array(rows["unknown"], pa.bool_()),
                ],
                names=["doc_id", "row_key", "base", "mentions", "unknown"],
            )

    return documents_of(docs, id_col, text_col).mapInArrow(find, SCHEMA)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_MENTION = pa.struct(
    [
        ("start", pa.int32()),
        ("stop", pa.int32()),
        ("value", pa.string()),
        ("seeds", pa.list_(pa.int32())),
        ("kinds", pa.list_(pa.int32())),
        ("patterns", pa.list_(pa.string())),
    ]
)


def bootstrap(found: DataFrame) -> DataFrame:
    """``value, kind, belief`` of values without a fixed form, scored with their patterns.

    ``found`` holds one row per mention: ``value, seeds, kinds, patterns``. In each round a
    pattern of total values T whose values are believed to be of a kind by B in sum has the
    score B / (T + 1), and is accepted if B and the score are large enough; the belief in a
    value is 1 minus the product of (1 - score) over its accepted patterns. Seeds are believed
    by 1. Rounds end when nothing new is accepted.
    """
    cells = found.select("value", "seeds", "kinds", F.explode("patterns").alias("pattern"))
    both = F.concat(
        F.transform("seeds", lambda k: F.struct(k.alias("kind"), F.lit(True).alias("seed"))),
        F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.lit(False).alias("seed"))),
    )
    # Equal cells are one: nothing but the distinct values of a pattern counts.
    cells = cells.select("pattern", "value", F.explode(both).alias("_k")).select("pattern", "value", "_k.kind", "_k.seed")
    cells = cells.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed"))
    cells = scratch(cells, "pattern-cells")
    totals = cells.groupBy("pattern", "value").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = cells.groupBy("pattern", "kind").agg(F.count_if("seed").alias("seeds"))
    table = stored(seeds.join(totals, "pattern"))
    unknown = cells.where(~F.col("seed")).select("pattern", "value", "kind")

    beliefs, accepted = None, 0
    for _ in range(ROUNDS):
        scored = table.withColumn("believed", F.col("seeds").cast("double"))
        if beliefs is not None:
            more = attach(unknown, beliefs, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("more"))
            scored = table.join(more, ["pattern", "kind"], "left").withColumn(
                "believed", F.col("seeds") + F.coalesce("more", F.lit(0.0))
            )
        scored = scored.withColumn("score", F.col("believed") / (F.col("total") + 1))
        good = stored(scored.where((F.col("believed") >= SUPPORT) & (F.col("score") >= ACCEPT)).select("pattern", "kind", "score"))
        if row_bound(good) == accepted:
            break
        accepted = row_bound(good)
        linked = attach(unknown, good, ["pattern", "kind"], "inner")
        beliefs = stored(linked.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("belief")))
    # A value that a fixed form matches elsewhere is known.
    known = cells.where("seed").select("value", "kind").distinct().withColumn("belief", F.lit(1.0))
    known = known.join(unknown.select("value", "kind").distinct(), ["value", "kind"], "left_semi")
    if beliefs is None:
        return known
    return beliefs.unionByName(known).groupBy("value", "kind").agg(F.max("belief").alias("belief"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, spans ``base`` of fixed forms and spans ``found`` by their surroundings.

    Spans are ``kind`` (number in ``KINDS``), ``start``, ``stop`` (exclusive) in code points of
    the whole text, by kind and start. Found ones never overlap fixed forms.

    One row per row of ``docs``; a null, empty or blank text has no spans. Rows with null or
    repeated ids stay apart; equal rows get equal spans, and copies of a text count once for
    its patterns, since only distinct values do. Other columns are not read. An empty table
    gives an empty result.
    """
    rows = scratch(mentions(docs, id_col, text_col), "mentions")
    each = rows.select("row_key", F.explode("mentions").alias("m")).select("row_key", "m.*")
    beliefs = bootstrap(each).where(F.col("belief") >= BELIEVE)
    # A mention that may be of several kinds is of the one believed most.
    candidates = each.select("row_key", "start", "stop", "value", F.explode("kinds").alias("kind"))
    hits = attach(candidates, beliefs, ["value", "kind"], "inner")
    best = hits.groupBy("row_key", "start", "stop").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
    lists = best.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("found"))
    none = F.lit(None).cast(f"array<{SPAN}>")
    plain = rows.where(~F.col("unknown")).select("doc_id", "base", none.alias("found"))
    joined = attach(rows.where("unknown").select("doc_id", "base", "row_key"), lists, ["row_key"])
    out = plain.unionByName(joined.select("doc_id", "base", "found"))
    return out.withColumn("found", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))


def summary(spans: DataFrame) -> DataFrame:
    """Counts of the fixed forms by kind, a digest of their spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(column: Column | str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(number).alias(f"n_{name}") for number, name in enumerate(KINDS)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text(F.sort_array(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
