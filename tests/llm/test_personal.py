"""Personal data: fixed forms against plain patterns, bootstrapping against plain loops."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ampledger.llm import personal, queries

#: The forms as the contract states them.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [
        (n, m.start(), m.end())
        for n, (kind, form) in enumerate(FORMS.items())
        for m in re.finditer(form, text)
        if holds(kind, m.group())
    ]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+%_ 0123456789()\néx:", max_size=60))
@example("a@b.c@d.e @x.y.z a@b..c.d a@b.c. 1.2.3.4.5.6.7.8 01.002.0003.256")
@example("4111 1111 1111 1111, 4111-1111-1111-1112 +12 +123 +1 (743) 555-3824 ++49.30.1234567-")
def test_fixed_forms(text):
    assert personal.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "1:" * 200_000):
        personal.other_mentions(text, [span[1:] for span in personal.base_spans(text)])
    assert time.time() - began < 30


def loops(docs):
    """Spans found by their surroundings, with plain loops over the graph."""
    mentions = []
    for d, text in enumerate(docs):
        base = personal.base_spans(text)
        by_span = defaultdict(list)
        for kind, a, b in base:
            by_span[a, b].append(kind)
        for (a, b), kinds in by_span.items():
            mentions.append((d, a, b, personal._value(text[a:b]), set(kinds), set(), personal.patterns(text, a, b)))
        for a, b, kinds in personal.other_mentions(text, [s[1:] for s in base]):
            mentions.append((d, a, b, personal._value(text[a:b]), set(), set(kinds), personal.patterns(text, a, b)))
    seeds, unknown, values = defaultdict(set), defaultdict(set), defaultdict(set)
    for _, _, _, value, s, k, patterns in mentions:
        for p in patterns:
            values[p].add(value)
            for kind in s:
                seeds[p, kind].add(value)
            for kind in k:
                unknown[p, kind].add(value)
    everywhere = {(v, kind) for (_, kind), found in seeds.items() for v in found}
    belief = {}
    for _ in range(personal.ROUNDS):
        scores = {}
        for p, kind in set(seeds) | set(unknown):
            fresh = unknown[p, kind] - seeds[p, kind]
            total = len(seeds[p, kind]) + sum(belief.get((v, kind), 0) for v in fresh)
            score = total / (len(values[p]) + 1)
            if total >= personal.SUPPORT and score >= personal.ACCEPT:
                scores[p, kind] = score
        odds = defaultdict(lambda: 1.0)
        for (p, kind), score in scores.items():
            for v in unknown[p, kind] - seeds[p, kind]:
                odds[v, kind] *= 1 - score
        belief = {key: 1 - odd for key, odd in odds.items()}
    out = defaultdict(list)
    for d, a, b, value, _, kinds, _ in mentions:
        best = max(((1.0 if (value, k) in everywhere else belief.get((value, k), 0), -k) for k in kinds), default=(0, 0))
        if best[0] >= personal.BELIEVE:
            out[d].append((-best[1], a, b))
    return {d: sorted(spans) for d, spans in out.items()}


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(4)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice("river stone cloud amber field quiet lemon".split())
    docs = []
    for _ in range(60):
        docs.append(f"{word()} please call me at +1 {number(3)} 555 {number(4)} {word()} {word()}")
        docs.append(f"{word()} my address is {word()}{number(2)}@{word()}.org and {word()}")
    docs += [f"{word()} please call me at 555-{number(4)} {word()}" for _ in range(4)]
    docs += [f"{word()} my address is {word()}@localhost and {word()}" for _ in range(3)]
    docs += [f"{word()} order number {number(9)} was sent on 2024-05-{number(2)}" for _ in range(20)]
    docs += ["reach reach 555-0000 now", "please call me at 555-0000 today", "reach 555-0000 or +1 743 555 3824 or 17435553824", docs[0], docs[0]]
    return docs


def test_surroundings_discover(spark, make, letters):
    got = personal.personal_data(make(letters)).where(F.size("found") > 0).collect()
    assert {r.doc_id: [tuple(s) for s in r.found] for r in got} == loops(letters)
    texts = {letters[r.doc_id][s.start : s.stop] for r in got for s in r.found}
    # Numbers where numbers were seen, addresses where addresses were; no dates and orders.
    assert {"555-0000", "17435553824"} < texts and sum("@localhost" in t for t in texts) >= 2
    assert not any(t.startswith("2024") or len(t) == 9 for t in texts)


def test_tables_that_count_as_large(spark, make, letters, staged):
    got = personal.personal_data(make(letters)).where(F.size("found") > 0).collect()
    assert {r.doc_id: [tuple(s) for s in r.found] for r in got} == loops(letters)


def test_query_against_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_personal_data"](spark, sf).collect()
    assert len(got) == len(docs)
    found = loops(list(docs.values()))
    by_place = dict(zip(docs, range(len(docs))))
    names = list(FORMS)
    for r in got:
        base = plain(docs[r.doc_id])
        line = ",".join(f"{names[k]}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        more = found.get(by_place[r.doc_id], [])
        assert r.spans == ",".join(f"{names[k]}:{a}:{b}" for k, a, b in sorted(base + more)) and r.n_found == len(more)
    assert sum(r.n_email for r in got) == 12 and sum(r.n_ip for r in got) == 32


def test_odd_rows(odd, nothing, make):
    got = personal.summary(personal.personal_data(odd)).collect()
    assert len(got) == 13 and all(r.spans == "" and r.n_found == 0 for r in got)
    assert personal.personal_data(nothing).collect() == []
    rows = [(None, "é mail é@b.c x.y@b.c, 12345678")] * 2 + [(1, "12345678 +1234 56789"), (1, "x.y@b.c " + "é " * 50_000 + "1.2.3.4")]
    got = personal.summary(personal.personal_data(make(rows, clash=True))).collect()
    assert sorted(r.spans for r in got) == ["email:0:7,ip:100008:100015", "email:13:20", "email:13:20", "phone:9:20"]
