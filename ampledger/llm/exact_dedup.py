"""Exact duplicates by Patricia tries over length-and-hash partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.llm.common import documents_of

#: Bytes of text that the tries of one task hold before closed subtrees are written out.
TRIE_BYTES = 32 << 20


class Trie:
    """A compressed radix trie over byte strings; ``insert`` gives each string its number.

    A node is ``[label, children by first byte, number or -1]``. Labels are slices of the
    inserted strings, so a chain without branches is a single node.
    """

    __slots__ = ("root", "size")

    def __init__(self):
        self.root = [b"", {}, -1]
        self.size = 0

    def insert(self, key: bytes, number: int) -> int:
        """The number stored for ``key``; a new key is stored with ``number``."""
        node, at, end = self.root, 0, len(key)
        while True:
            if at == end:
                if node[2] < 0:
                    node[2] = number
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, number]
                self.size += end - at
                return number
            label = child[0]
            if not key.startswith(label, at):
                shared = self._shared(label, key, at)
                upper = [label[:shared], {label[shared]: child}, -1]
                child[0] = label[shared:]
                node[1][key[at]] = upper
                child = upper
            at += len(child[0])
            node = child

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix of ``label`` and ``key[at:]`` by halving."""
        low, high = 1, min(len(label), len(key) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if label[:middle] == key[at : at + middle]:
                low = middle
            else:
                high = middle - 1
        return low


def _owners(batches: Iterable[pa.RecordBatch], schema: pa.Schema, largest: bool, ordered: bool) -> Iterator[pa.RecordBatch]:
    """Insert rows into one trie per (length, hash) and give one row for each string.

    Rows of the result keep the columns of the owner's row, with ``n`` summed. When
    more than ``TRIE_BYTES`` are held, subtrees are written out and freed: all of them if
    rows come in any order (the next step merges the parts), all but the last one if they
    come ordered by (length, hash), since no later row can reach a closed subtree.
    """
    tries: dict[tuple[int, int], Trie] = {}
    where: list[tuple[pa.RecordBatch, int]] = []  # of owners
    owner: list[int | None] = []
    count: list[int] = []
    held, last = 0, None
    target = schema.names

    def flush() -> Iterator[pa.RecordBatch]:
        by_batch: dict[int, tuple[pa.RecordBatch, list[int], list[int]]] = {}
        for (batch, i), n in zip(where, count):
            entry = by_batch.setdefault(id(batch), (batch, [], []))
            entry[1].append(i)
            entry[2].append(n)
        for batch, rows, totals in by_batch.values():
            part = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(totals, pa.int64()) if c == "n" else part.column(c) for c in target]
            yield pa.RecordBatch.from_arrays(columns, names=target)

    def clear() -> None:
        nonlocal held
        tries.clear()
        where.clear()
        owner.clear()
        count.clear()
        held = 0

    for batch in batches:
        lengths, hashes = batch.column("_len").to_pylist(), batch.column("_hash").to_pylist()
        ids, counts = batch.column("_id").to_pylist(), batch.column("n").to_pylist()
        texts = batch.column("_text")
        for i, key in enumerate(zip(lengths, hashes)):
            if held > TRIE_BYTES and (not ordered or key != last):
                yield from flush()
                clear()
            last = key
            text = texts[i].as_py().encode() if pa.types.is_string(texts.type) else texts[i].as_py()
            trie = tries.get(key)
            if trie is None:
                trie = tries[key] = Trie()
            number = trie.insert(text, len(owner))
            if number == len(owner):
                owner.append(ids[i])
                count.append(counts[i])
                where.append((batch, i))
                held += len(text)
                continue
            count[number] += counts[i]
            old, new = owner[number], ids[i]
            if new is not None and (old is None or (new > old if largest else new < old)):
                owner[number] = new
                where[number] = (batch, i)
    yield from flush()


def text_owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per distinct text: the row that owns it, and the number of rows with it.

    Result: ``owner`` (struct with all columns of the owning row), ``owner_id``,
    ``owner_text``, ``group_size``, ``text_sha256``. The owner is the row with the smallest
    (or largest) id; a null id gives way to any other. Of rows that repeat the same id and
    text, one is the owner.

    Each task first folds its own rows, so a text that fills a third of the table reaches
    the shuffle once per task. Rows are then dealt by length and content hash, and full
    byte strings decide within the partition's tries. A null text is the empty text.
    An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.octet_length(text).cast("long").alias("_len"),
        F.xxhash64(text).alias("_hash"),
        F.col(id_col).cast("long").alias("_id"),
        text.alias("_text"),
        F.lit(1).cast("long").alias("n"),
        F.struct(*[F.col(c) for c in df.columns if c != text_col]).alias("_rest"),
    )
    schema, names, largest = rows.schema, rows.columns, keep == "largest"

    def fold(ordered: bool):
        def run(batches):
            yield from _owners(batches, pa.schema([(c, pa.null()) for c in names]), largest, ordered)

        return run

    folded = rows.mapInArrow(fold(False), schema)
    dealt = folded.repartition("_len", "_hash").sortWithinPartitions("_len", "_hash")
    owners = dealt.mapInArrow(fold(True), schema)
    fields = [
        F.col(f"_rest.`{c}`").alias(c) if c != text_col else F.col("_text").alias(c) for c in df.columns
    ]
    return owners.select(
        F.struct(*fields).alias("owner"),
        F.col("_id").alias("owner_id"),
        F.col("_text").alias("owner_text"),
        F.col("n").alias("group_size"),
        F.sha2("_text", 256).alias("text_sha256"),
    )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``df``.

    ``keep_id`` is the id of the row that stays for the row's text. Rows that repeat an id
    and a text are the same document and are marked alike. Null ids are kept as rows and
    own a text only if no other id has it. Null texts are empty texts.
    """
    owners = text_owners(df.select(id_col, text_col), id_col, text_col, keep).select(
        "text_sha256", F.col("owner_id").alias("keep_id"), "group_size"
    )
    rows = documents_of(df, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(owners, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
