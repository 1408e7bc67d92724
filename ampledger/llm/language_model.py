"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

A token is predicted in two steps: first its dish, one of the commonest words or a hash bucket
of all other words, then the word inside the bucket. Both steps depend on the word before,
and every word that ever stood before another has a restaurant of its own:

* In the first step the restaurants of contexts share as parents the classes of word endings,
  whose parent is the whole table. Tokens are dealt by the hash of their context.
* Inside a bucket there is a restaurant for every context, below those of endings, below the
  bucket's root, which draws from equally likely words, one of them standing for all unseen
  ones. Tokens are dealt by the hash of their word.

The logarithms of the two steps add up, so each is summed by text where it is sampled, and the
probabilities of all words still sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of, pieces, remainder_of_id, scratch
from ampledger.llm.words import VISIBLE, hash_spans, mix, word_spans

#: Words that are dishes of the first step, and as contexts so frequent that their restaurants
#: are kept as one broadcast table of at most COMMON * (COMMON + 1 + ENDINGS + 1) cells.
COMMON = 400
#: Classes of word endings (hashes of the last two bytes).
ENDINGS = 1024
#: Training tokens of one bucket, about.
BUCKET_TOKENS = 500_000
#: Buckets that one task samples one after the other, and tasks at least. Their sums are added
#: up before they leave the task, in parts of some number of texts.
BUCKETS_OF_TASK = 32
RARE_TASKS = 16
GATHERED_KEYS = 1_000_000
#: Bytes of text that a task gathers before it deals tokens to buckets.
DEAL_BYTES = 8 << 20
END_HASH = np.uint64(0x5851F42D4C957F2D)
BURN_IN, SAMPLES = 3, 3
#: Customers of a cell that are seated one by one; more are seated in growing blocks.
SINGLE = 64
#: Weight of the coarser estimate in the first step.
FIRST_STEP = 20.0
STRENGTH = (1.0, 1.0, 1.0)
#: The same in the step to a bucket, where few contexts have many customers.
BUCKET_STRENGTH = 0.1
#: Distinct keys that a task counts before it merges or hands them on.
TALLIED = 1_000_000


@dataclass
class Tokens:
    """Tokens of some texts in order, each text closed by an end."""

    text: np.ndarray  # number of the text
    word: np.ndarray  # hash
    previous: np.ndarray  # hash of the word before, 0 at the start of a text
    ending: np.ndarray  # class of the ending of the word before, ENDINGS at the start


def ending_of(last: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(last.astype(np.uint64) * np.uint64(256) + second.astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)


def tokens_of(texts: pa.Array) -> Tokens:
    data, starts, ends, before = word_spans(texts, VISIBLE)
    hashes = hash_spans(data, starts, ends)
    second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0)
    endings = ending_of(data[ends - 1], second)
    n = np.diff(before)
    text = np.repeat(np.arange(len(n)), n + 1)
    last = np.cumsum(n + 1) - 1
    word = np.empty(len(text), np.uint64)
    is_end = np.zeros(len(text), bool)
    is_end[last] = True
    word[is_end] = END_HASH
    word[~is_end] = hashes
    ends_of_words = np.full(len(text), ENDINGS)
    ends_of_words[~is_end] = endings
    previous = np.zeros(len(text), np.uint64)
    previous[1:] = word[:-1]
    ending = np.full(len(text), ENDINGS)
    ending[1:] = ends_of_words[:-1]
    first = last - n
    previous[first] = 0
    ending[first] = ENDINGS
    return Tokens(text, word, previous, ending)


@dataclass
class Common:
    """Hashes of the common words, ascending, and the class of each one's ending."""

    words: np.ndarray
    endings: np.ndarray

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the common words, -1 for others."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, -1) if len(self.words) else np.full(len(hashes), -1)

    def context(self, tokens: Tokens) -> np.ndarray:
        """Code of the context of each token: a common word, or else an ending class."""
        own = self.number(tokens.previous)
        return np.where(own >= 0, own, len(self.words) + tokens.ending)

    @property
    def codes(self) -> int:
        return len(self.words) + ENDINGS + 1

    @property
    def parent(self) -> np.ndarray:
        """Ending class of every context code."""
        return np.concatenate([self.endings, np.arange(ENDINGS + 1)])


def _discount(counts: np.ndarray) -> float:
    """Estimated from how many counts are one and two."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95))


def seat(
    customers: np.ndarray, place: np.ndarray, tables: np.ndarray, total: np.ndarray, parent: np.ndarray,
    discount: float, strength: float, rng: np.random.Generator,
) -> np.ndarray:
    """New numbers of tables for all cells, a dish in a restaurant, given everything else.

    The customers of a cell get up and are seated again one after the other: the next one
    opens a table in proportion to ``(strength + discount * tables of the restaurant) *
    parent probability`` and else joins one of the cell's tables. From ``SINGLE`` customers
    on, blocks of an eighth of those seated draw their new tables at once.
    """
    order = np.argsort(-customers, kind="stable")
    c, p = customers[order], parent[order]
    others = (total[place] - tables)[order].astype(float)
    t = np.minimum(c, 1).astype(float)
    k, top = 1, int(c[0]) if len(c) else 0
    while k < top:
        active = int(np.searchsorted(-c, -k, "left"))  # cells with more than k customers
        now = t[:active]
        fresh = (strength + discount * (others[:active] + now)) * p[:active]
        chance = fresh / (fresh + k - discount * now)
        if k < SINGLE:
            t[:active] += rng.random(active) < chance
            k += 1
        else:
            step = max(1, k // 8)
            t[:active] += rng.binomial(np.minimum(step, c[:active] - k), chance)
            k += step
    out = np.empty(len(c), np.int64)
    out[order] = t.astype(np.int64)
    return out


class Group:
    """The restaurants of one group: counts of training tokens by room, ending and word.

    A room is the restaurant of one context; -1 are tokens that sit at their ending at once.
    """

    def __init__(
        self, room: np.ndarray, ending: np.ndarray, word: np.ndarray, count: np.ndarray, rooms: int, words: int, known: int, seed: int
    ):
        self.rooms, self.words, self.known = rooms, words, known
        self.rng = np.random.default_rng([seed, 8])
        own = room >= 0
        # Leaves: cells of rooms. Middle: cells of ending classes. Root: words.
        self.c2, self.r2, self.w2 = count[own], room[own], word[own]
        self.key1, cell = np.unique(ending * words + word, return_inverse=True)
        self.up2 = cell[own]  # middle cell of each leaf cell
        self.direct1 = np.bincount(cell[~own], weights=count[~own], minlength=len(self.key1)).astype(np.int64)
        self.r1, self.w1 = np.divmod(self.key1, words) if words else (self.key1, self.key1)
        self.key2 = self.r2 * words + self.w2
        by_key = np.argsort(self.key2)
        self.key2, self.c2, self.r2, self.w2, self.up2 = (x[by_key] for x in (self.key2, self.c2, self.r2, self.w2, self.up2))
        self.t2 = np.minimum(self.c2, 1)
        self._count_up()
        self.t1 = np.minimum(self.c1, 1)
        self._count_root()
        self.t0 = np.minimum(self.c0, 1)
        total1 = self.direct1 + np.bincount(self.up2, weights=self.c2, minlength=len(self.key1)).astype(np.int64)
        self.d = (
            _discount(np.bincount(self.w1, weights=total1, minlength=words)),
            _discount(total1),
            _discount(self.c2),
        )

    def _count_up(self) -> None:
        tables = np.bincount(self.up2, weights=self.t2, minlength=len(self.key1)).astype(np.int64)
        self.c1 = self.direct1 + tables

    def _count_root(self) -> None:
        self.c0 = np.bincount(self.w1, weights=self.t1, minlength=self.words).astype(np.int64)

    def _root(self) -> np.ndarray:
        """Probability of every word, unseen ones each as the one unseen word."""
        d, s = self.d[0], STRENGTH[0]
        return (self.c0 - d * self.t0 + (s + d * self.t0.sum()) / (self.known + 1)) / (s + self.c0.sum())

    def _level(self, c, t, r, rooms, d, s):
        """For every restaurant of a level: weight of its parent and size."""
        seated = np.bincount(r, weights=c, minlength=rooms)
        tables = np.bincount(r, weights=t, minlength=rooms)
        return (s + d * tables) / (s + seated), s + seated

    def sweep(self) -> None:
        """Seat all levels anew, from the leaves to the root."""
        rooms = ENDINGS + 1
        root = self._root()
        back1, size1 = self._level(self.c1, self.t1, self.r1, rooms, self.d[1], STRENGTH[1])
        middle = (self.c1 - self.d[1] * self.t1) / size1[self.r1] + back1[self.r1] * root[self.w1]
        total2 = np.bincount(self.r2, weights=self.t2, minlength=self.rooms)
        self.t2 = seat(self.c2, self.r2, self.t2, total2, middle[self.up2], self.d[2], STRENGTH[2], self.rng)
        self._count_up()
        total1 = np.bincount(self.r1, weights=np.minimum(self.t1, self.c1), minlength=rooms)
        self.t1 = seat(self.c1, self.r1, np.minimum(self.t1, self.c1), total1, root[self.w1], self.d[1], STRENGTH[1], self.rng)
        self._count_root()
        total0 = np.array([np.minimum(self.t0, self.c0).sum()])
        flat = np.full(self.words, 1 / (self.known + 1))
        self.t0 = seat(
            self.c0, np.zeros(self.words, int), np.minimum(self.t0, self.c0), total0, flat, self.d[0], STRENGTH[0], self.rng
        )

    def predict(self, room: np.ndarray, ending: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probabilities of cells under the present seating."""
        root = self._root()[word]
        back, size = self._level(self.c1, self.t1, self.r1, ENDINGS + 1, self.d[1], STRENGTH[1])
        p = back[ending] * root + self._found(self.key1, self.c1 - self.d[1] * self.t1, ending * self.words + word) / size[ending]
        own = room >= 0
        back, size = self._level(self.c2, self.t2, self.r2, self.rooms, self.d[2], STRENGTH[2])
        kept = self._found(self.key2, self.c2 - self.d[2] * self.t2, room[own] * self.words + word[own])
        p[own] = back[room[own]] * p[own] + kept / size[room[own]]
        return p

    @staticmethod
    def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def averaged(self, room: np.ndarray, ending: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Predictive probabilities averaged over the seatings after the burn-in."""
        total = np.zeros(len(word))
        for i in range(BURN_IN + SAMPLES):
            self.sweep()
            if i >= BURN_IN:
                total += self.predict(room, ending, word)
        return total / SAMPLES


def context_rooms(room: np.ndarray, count: np.ndarray, parent: np.ndarray, rooms: int, seed: int) -> np.ndarray:
    """Averaged probabilities of cells, a dish in a room, below fixed parent probabilities;
    cells without training tokens have a count of 0."""
    rng = np.random.default_rng([seed, 9])
    used = count > 0
    c, r, p = count[used], room[used], parent[used]
    d, strength = _discount(c), STRENGTH[2]
    t = np.minimum(c, 1)
    size = strength + np.bincount(r, weights=c, minlength=rooms)
    total = np.zeros(len(count))
    for i in range(BURN_IN + SAMPLES):
        t = seat(c, r, t, np.bincount(r, weights=t, minlength=rooms), p, d, strength, rng)
        if i >= BURN_IN:
            back = (strength + d * np.bincount(r, weights=t, minlength=rooms)) / size
            now = back[room] * parent
            now[used] += (c - d * t) / size[r]
            total += now
    return total / SAMPLES


class Tally:
    """How often each key stood, merged whenever many are held; a key has one value."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        found, at, counts = np.unique(keys, return_index=True, return_counts=True)
        self.held.append((found, counts, np.zeros(len(found), np.int64) if values is None else values[at]))
        self.size += len(found)
        if self.size > TALLIED:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts, values = (np.concatenate(x) for x in zip(*self.held))
        keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        self.held, self.size = [(keys, counts, values[first])], len(keys)
        return self.held[0]


def _common_words(rows: DataFrame) -> tuple[Common, int]:
    """The commonest words of training texts and the number of training tokens.

    Every word is counted; the most frequent are taken, ties by hash. The end of a text is
    always among them.
    """

    def run(batches):
        tally = Tally()

        def counted() -> pa.RecordBatch:
            word, count, ending = tally.merged()
            tally.__init__()
            # All tokens stand in a row without a word.
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(word.view(np.int64), 0), mask=np.arange(len(word) + 1) == len(word)),
                    pa.array(np.append(ending, 0).astype(np.int32)),
                    pa.array(np.append(count, count.sum())),
                ],
                names=["word", "ending", "count"],
            )

        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").filter(batch.column("train"))
            if len(texts):
                tokens = tokens_of(texts)
                # The ending of a word stands with the token that follows it.
                tally.add(tokens.word, np.where(tokens.word == END_HASH, ENDINGS, np.append(tokens.ending[1:], ENDINGS)))
                if tally.size > TALLIED // 2 and len(tally.held) == 1:
                    yield counted()
        yield counted()

    seen = rows.select("text", "train").mapInArrow(run, "word long, ending int, count long")
    by_word = seen.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("count").alias("count"))
    end = int(END_HASH.view(np.int64))
    order = (F.col("word").isNotNull(), F.col("word") != end, F.desc("count"), "word")
    total, *chosen = by_word.orderBy(*order).limit(COMMON + 1).collect()
    pairs = sorted((int(np.int64(r.word).view(np.uint64)), r.ending) for r in chosen)
    common = Common(np.array([w for w, _ in pairs], np.uint64), np.array([e for _, e in pairs], np.int64))
    return common, total["count"]


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Shares:
    """The step from a context to a bucket of rare words: what is not known inside a bucket.

    A context's probability of a bucket is its discounted count there and, for the mass of
    the discounts, the probability of its ending; an ending backs off to the bucket's share
    of all rare tokens. Over all buckets the probabilities sum to one.
    """

    buckets: int
    overall: np.ndarray  # rare training tokens by bucket
    total: np.ndarray  # rare training tokens by context
    types: tuple[np.ndarray, np.ndarray]  # buckets seen, by ending and by context
    discount: tuple[float, float]

    @property
    def plain(self) -> np.ndarray:
        """Share of every bucket whatever the context."""
        return (self.overall + 1) / (self.overall.sum() + self.buckets)

    def of_bucket(self, found: np.ndarray, common: Common) -> np.ndarray:
        """Probability of a bucket by context code, from its training tokens by context."""
        parent, h = common.parent, len(common.words)
        p0 = (found.sum() + 1) / (self.total.sum() + self.buckets)
        p1 = self._level(np.bincount(parent, found, ENDINGS + 1), np.bincount(parent, self.total, ENDINGS + 1), 0, p0)
        out = p1[parent]
        out[:h] = self._level(found, self.total, 1, out)[:h]
        return out

    def _level(self, found: np.ndarray, total: np.ndarray, level: int, p):
        d, s = self.discount[level], BUCKET_STRENGTH
        return (found - d * (found > 0) + (s + d * self.types[level]) * p) / (total + s)


def _context_counts(rows: DataFrame, common: Common, buckets: int) -> tuple[np.ndarray, Shares]:
    """Training tokens by context (rows) and common word, rare words in the last column, and
    how rare words are dealt to buckets by context."""
    h = len(common.words)
    width = h + buckets

    def run(batches):
        tally = Tally()
        for batch in pieces(batches, "text", 2 << 20):
            texts = batch.column("text").filter(batch.column("train"))
            if len(texts):
                tokens = tokens_of(texts)
                number = common.number(tokens.word)
                group = np.where(number >= 0, number, h + _bucket_of(tokens.word, buckets))
                tally.add(common.context(tokens) * width + group)
        keys, counts, _ = tally.merged()
        c, w = np.divmod(keys, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(counts)],
            names=["context", "word", "count"],
        )

    found = rows.select("text", "train").mapInArrow(run, "context int, word int, count long")
    summed = scratch(found.groupBy("context", "word").agg(F.sum("count").alias("n")), "context-counts")
    counts = np.zeros((common.codes, h + 1), np.int64)
    # Bounded by contexts times common words.
    for r in summed.groupBy("context", F.least("word", F.lit(h)).alias("word")).agg(F.sum("n").alias("n")).collect():
        counts[r.context, r.word] = r.n
    parent = F.element_at(F.lit(common.parent.tolist()), F.col("context") + 1)
    by_bucket = summed.where(F.col("word") >= h)
    overall = np.zeros(buckets)
    for r in by_bucket.groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        overall[r.word - h] = r.n
    types, discount = [], []
    for size, rows_of in (
        (ENDINGS + 1, by_bucket.groupBy(parent.alias("context"), "word").agg(F.sum("n").alias("n"))),
        (common.codes, by_bucket),
    ):
        kinds = [F.count("*"), *(F.count_if(F.col("n") == k) for k in (1, 2))]
        seen = rows_of.groupBy("context").agg(*(k.alias(c) for k, c in zip(kinds, ("kinds", "one", "two")))).collect()
        at = np.zeros(size)
        for r in seen:  # a row per context
            at[r.context] = r.kinds
        one, two = sum(r.one for r in seen), sum(r.two for r in seen)
        types.append(at)
        discount.append(float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95)))
    return counts, Shares(buckets, overall, counts[:, -1], tuple(types), tuple(discount))


#: Columns of dealt tokens; a bucket is dealt twice, by words and, ``buckets`` further, by contexts.
DEALT = ["bucket", "keys", "owners", "sizes", "texts", "others", "marks"]
COMMON_MARK, TRAIN_MARK = np.uint16(1 << 14), np.uint16(1 << 15)


def _deal(rows: DataFrame, common: Common, buckets: int) -> DataFrame:
    """Tokens of all texts, packed by bucket: the distinct owners (rare words, or else rare
    contexts) with their numbers, and for each token, in the order of owners, its text, the
    other side and a mark.

    Dealt by word, the other side is the number of a common context or 32 bits of the hash of
    another one, which its ending class in the mark completes to 42. Dealt by context, it is
    the dish, and the mark has the ending of the context. The top bit marks training.
    """
    h = len(common.words)
    kinds = [pa.int32(), *[pa.binary()] * (len(DEALT) - 1)]

    def run(batches):
        held: list[tuple] = []
        size = texts = 0

        def packed(key, number, owner, text, other, mark):
            order = np.argsort(owner, kind="stable")
            owner, text, other, mark = owner[order], text[order], other[order], mark[order]
            bucket = _bucket_of(owner, buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(edges[1:] > edges[:-1]):
                part = slice(edges[b], edges[b + 1])
                used, local = np.unique(text[part], return_inverse=True)
                owners, n = np.unique(owner[part], return_counts=True)
                local = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                yield (number + b, *[x.tobytes() for x in (key[used], owners, n.astype(np.uint32), local, other[part], mark[part])])

        def dealt():
            key = np.concatenate([x[0] for x in held])
            out = []
            for side in (0, 1):
                parts = [np.concatenate(x) for x in zip(*[x[1][side] for x in held])]
                out += packed(key, side * buckets, *parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(DEALT), kinds)], names=DEALT
            )

        for batch in pieces(batches, "text", 2 << 20):
            tokens = tokens_of(batch.column("text"))
            train = np.asarray(batch.column("train").to_pylist(), bool)[tokens.text]
            number, before = common.number(tokens.word), common.number(tokens.previous)
            text = (tokens.text + texts).astype(np.uint32)
            mark = tokens.ending.astype(np.uint16) | np.where(train, TRAIN_MARK, np.uint16(0))
            by_word = number < 0
            other = np.where(before >= 0, before.astype(np.uint32), tokens.previous.astype(np.uint32))
            marks = mark | np.where(before >= 0, COMMON_MARK, np.uint16(0))
            by_context = (before < 0) & (tokens.previous != 0)
            dish = np.where(by_word, h + _bucket_of(tokens.word, buckets), number).astype(np.uint32)
            sides = [
                [x[chosen] for x in (owner, text, side, m)]
                for chosen, owner, side, m in (
                    (by_word, tokens.word, other, marks),
                    (by_context, tokens.previous, dish, mark),
                )
            ]
            held.append((batch.column("key").to_numpy(), sides))
            texts += len(batch)
            size += batch.column("text").nbytes
            if size >= DEAL_BYTES:
                yield dealt()
                held, size, texts = [], 0, 0
        if held:
            yield dealt()

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in DEALT[1:])
    return rows.select("key", "text", "train").mapInArrow(run, schema)


@dataclass
class Part:
    """All tokens of one bucket, dealt by word or by context."""

    keys: np.ndarray  # of texts
    owners: np.ndarray
    owner: np.ndarray  # number of the owner by token
    text: np.ndarray
    other: np.ndarray
    mark: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple]) -> Part:
        owners, number = np.unique(np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts]), return_inverse=True)
        owner = np.repeat(number, np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts]))
        keys = [np.frombuffer(p[0], np.int64) for p in parts]
        texts, start = [], 0
        for key, p in zip(keys, parts):
            width = len(p[3]) // (len(p[5]) // 2)
            texts.append(np.frombuffer(p[3], f"u{width}").astype(np.int64) + start)
            start += len(key)
        other = np.concatenate([np.frombuffer(p[4], np.uint32) for p in parts])
        mark = np.concatenate([np.frombuffer(p[5], np.uint16) for p in parts])
        return cls(np.concatenate(keys), owners, owner, np.concatenate(texts), other, mark)

    @property
    def train(self) -> np.ndarray:
        return self.mark >= TRAIN_MARK

    @property
    def ending(self) -> np.ndarray:
        return (self.mark & np.uint16(0x3FFF)).astype(np.int64)

    def sums(self, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of texts and sums of the weights of their tokens. Rows that repeat an id and
        a text have one key and the same tokens: each has the mean."""
        by_text = [np.bincount(self.text, weights=w, minlength=len(self.keys)) for w in weights]
        keys, sums, rows = _by_key(self.keys, by_text)
        return keys, [x / rows for x in sums]


def _score_words(parts: list[tuple], common: Common, seed: int, shares: Shares) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Sample the restaurants of one bucket. Keys of texts, their sums of log probability, base
    and known words, and the number of words in the bucket's training tokens."""
    part = Part.of(parts)
    train, words = part.train, len(part.owners)
    seen = np.bincount(part.owner[train], minlength=words)
    # Rooms: common words keep their numbers, other contexts follow; the start of a text has none.
    h = len(common.words)
    name = (part.mark & ~TRAIN_MARK).astype(np.int64) << 32 | part.other
    names, room = np.unique(name, return_inverse=True)
    is_common = names >> 32 & int(COMMON_MARK) > 0
    start = ~is_common & (names >> 32 == ENDINGS)
    cells, cell = np.unique(room * words + part.owner, return_inverse=True)
    count = np.bincount(cell[train], minlength=len(cells))
    of_name, cell_word = np.divmod(cells, words)
    cell_room = np.where(start[of_name], -1, of_name)
    cell_ending = (names >> 32 & 0x3FFF)[of_name]
    used = count > 0
    group = Group(
        cell_room[used], cell_ending[used], cell_word[used], count[used], len(names), words, int((seen > 0).sum()), seed
    )
    logs = np.log10(group.averaged(cell_room, cell_ending, cell_word))
    # The step to the bucket, from contexts that are not dealt by themselves.
    code = np.where(is_common, names & 0xFFFFFFFF, h + (names >> 32 & 0x3FFF))
    share = shares.of_bucket(np.bincount(code[room[train]], minlength=common.codes), common)
    here = (is_common | start)[of_name]
    logs[here] += np.log10(share)[code[of_name[here]]]
    keys, sums = part.sums(logs[cell], np.log10(seen + 0.1)[part.owner], (seen > 0)[part.owner])
    return keys, sums, int((seen > 0).sum())


@dataclass
class Dishes:
    """Probabilities of dishes by ending class, the parents of the restaurants of contexts."""

    common: np.ndarray  # by ending class and common word
    rare: np.ndarray  # by ending class
    share: np.ndarray  # by bucket

    def of(self, ending: np.ndarray, dish: np.ndarray) -> np.ndarray:
        h = self.common.shape[1]
        out = self.rare[ending] * self.share[np.maximum(dish - h, 0)]
        inside = dish < h
        out[inside] = self.common[ending[inside], dish[inside]]
        return out


def _score_contexts(parts: list[tuple], seed: int, dishes: Dishes) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The first step of the contexts of one bucket, in the form of ``_score_words``."""
    part = Part.of(parts)
    ending = np.zeros(len(part.owners), np.int64)
    ending[part.owner] = part.ending
    width = dishes.common.shape[1] + len(dishes.share)
    cells, cell = np.unique(part.owner * width + part.other.astype(np.int64), return_inverse=True)
    count = np.bincount(cell[part.train], minlength=len(cells))
    room, dish = np.divmod(cells, width)
    p = context_rooms(room, count, dishes.of(ending[room], dish), len(part.owners), seed)
    none = np.zeros(len(cell))
    return *part.sums(np.log10(p)[cell], none, none), 0


def _by_key(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, sums of the values, and how often a key stood."""
    distinct, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, [np.bincount(at, weights=v, minlength=len(distinct)) for v in values], times


SUMS = "key long, s double, base double, known long, vocabulary long"


def _rare(dealt: DataFrame, tables: Tables, shares: Shares) -> DataFrame:
    common, buckets = tables.common, shares.buckets
    shared = dealt.sparkSession.sparkContext.broadcast(tables.dishes(shares))  # bounded by COMMON, ENDINGS and buckets

    def run(batches):
        now, parts = None, []
        keys, sums, vocabulary = np.zeros(0, np.int64), [np.zeros(0)] * 3, 0

        def close() -> None:
            nonlocal keys, sums, vocabulary, parts
            if now < buckets:
                found, more, words = _score_words(parts, common, now, shares)
            else:
                found, more, words = _score_contexts(parts, now, shared.value)
            both = [np.concatenate(x) for x in zip(sums, more)]
            keys, sums, _ = _by_key(np.concatenate([keys, found]), both)
            vocabulary, parts = vocabulary + words, []

        def gathered() -> pa.RecordBatch:
            """All sums so far, and the words in a row that adds nothing to any text."""
            nonlocal keys, sums, vocabulary
            s, base, known = (np.append(x, 0.0) for x in sums)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(keys, 0)),
                    pa.array(s),
                    pa.array(base),
                    pa.array(np.rint(known).astype(np.int64)),
                    pa.array(np.append(np.zeros(len(keys), np.int64), vocabulary)),
                ],
                names=["key", "s", "base", "known", "vocabulary"],
            )
            keys, sums, vocabulary = np.zeros(0, np.int64), [np.zeros(0)] * 3, 0
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in DEALT]
            for bucket, *part in zip(*columns):
                if bucket != now and parts:
                    close()
                    if len(keys) > GATHERED_KEYS:
                        yield gathered()
                now = bucket
                parts.append(part)
            del columns
        if parts:
            close()
        yield gathered()

    tasks = max(RARE_TASKS, -(-2 * buckets // BUCKETS_OF_TASK))
    by_task = dealt.repartitionById(tasks, F.col("bucket") % tasks)
    return by_task.sortWithinPartitions("bucket").mapInArrow(run, SUMS)


@dataclass
class Tables:
    """What every task needs of the group of common words and of the first step."""

    common: Common
    log_word: np.ndarray  # by context and common word, first step included
    log_rare: np.ndarray  # by context
    log_base: np.ndarray  # by common word
    known: np.ndarray

    def dishes(self, shares: Shares) -> Dishes:
        h = len(self.common.words)
        return Dishes(10 ** self.log_word[h:], 10 ** self.log_rare[h:], shares.plain)


def _tables(common: Common, counts: np.ndarray) -> Tables:
    """From the counts of contexts (rows) and common words, the last column rare words."""
    h = len(common.words)
    own, total = counts[:, :h].sum(axis=1), counts.sum(axis=1)
    parent = common.parent
    own1 = np.bincount(parent, weights=own, minlength=ENDINGS + 1)
    total1 = np.bincount(parent, weights=total, minlength=ENDINGS + 1)
    p0 = (own.sum() + 1) / (total.sum() + 2)
    p1 = (own1 + FIRST_STEP * p0) / (total1 + FIRST_STEP)
    first = p1[parent].copy()
    first[:h] = (own[:h] + FIRST_STEP * first[:h]) / (total[:h] + FIRST_STEP)
    context, word = np.nonzero(counts[:, :h])
    seen = counts[:, :h].sum(axis=0)
    room = np.append(np.arange(h), np.full(ENDINGS + 1, -1))
    group = Group(room[context], parent[context], word, counts[context, word], h, h, int((seen > 0).sum()), -1 & 0xFFFF)
    c, w = (x.ravel() for x in np.mgrid[: common.codes, :h])
    inside = group.averaged(room[c], parent[c], w).reshape(common.codes, h)
    return Tables(common, np.log10(inside * first[:, None]), np.log10(1 - first), np.log10(seen + 0.1), seen > 0)


def _common_part(rows: DataFrame, tables: Tables) -> DataFrame:
    """By document: number of tokens and the part of the sums that needs no bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)  # bounded by COMMON and ENDINGS

    def run(batches):
        known = shared.value
        for batch in pieces(batches, "text", 2 << 20):
            tokens = tokens_of(batch.column("text"))
            context, number = known.common.context(tokens), known.common.number(tokens.word)
            common = number >= 0
            s = known.log_rare[context]
            s[common] = known.log_word[context[common], number[common]]
            # The dishes of other contexts are dealt by context.
            s[(known.common.number(tokens.previous) < 0) & (tokens.previous != 0)] = 0
            base = np.where(common, known.log_base[number], 0.0)
            counts = np.where(common, known.known[number], False)
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.bincount(tokens.text, minlength=n)),
                    pa.array(np.bincount(tokens.text, weights=s, minlength=n)),
                    pa.array(np.bincount(tokens.text, weights=base, minlength=n)),
                    pa.array(np.bincount(tokens.text, weights=counts, minlength=n).astype(np.int64)),
                ],
                names=["key", "doc_id", "held_out", "n_tokens", "s", "base", "known"],
            )

    return rows.select("key", "doc_id", "held_out", "text").mapInArrow(
        run, "key long, doc_id long, held_out boolean, n_tokens long, s double, base double, known long"
    )


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Trained on the rows whose crc32 of the id modulo ``modulus`` is not 0, all rows are
    scored. ``score`` is the log10 probability of the whole text and its end,
    ``base_score`` that of single words with 0.1 added to each count. Null and empty texts
    are an end alone. Rows that repeat an id and a text get the same scores; a null id hashes
    as empty text and is kept. Without training rows all words are unseen. An empty table
    gives no rows, other columns are ignored.
    """
    rows = documents_of(df, id_col, text_col).withColumns(
        {
            "held_out": remainder_of_id("doc_id", modulus) == 0,
            "train": remainder_of_id("doc_id", modulus) != 0,
            "key": F.xxhash64("doc_id", "text"),
        }
    )
    common, tokens = _common_words(rows)
    if not len(common.words):
        common = Common(np.array([END_HASH]), np.array([ENDINGS]))
    buckets = max(1, -(-tokens // (2 * BUCKET_TOKENS)))  # about half of the tokens are rare
    counts, shares = _context_counts(rows, common, buckets)
    tables = _tables(common, counts)
    rare = _rare(_deal(rows, common, buckets), tables, shares)
    sums = [F.sum(c).alias(f"_{c}") for c in ("s", "base", "known", "vocabulary")]
    by_key = scratch(rare.groupBy("key").agg(*sums), "rare-sums")
    vocabulary = int(tables.known.sum()) + (by_key.agg(F.sum("_vocabulary").alias("v")).first().v or 0)
    whole = _common_part(rows, tables)
    joined = whole.join(by_key, "key", "left")
    denominator = float(np.log10(tokens + 0.1 * (vocabulary + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("s") + F.coalesce("_s", F.lit(0.0))).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
