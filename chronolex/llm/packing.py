"""Cost-balanced packing of token sequences.

A document's cost is estimated as linear plus quadratic attention cost. In each group of documents (part of one input
partition, bounded in tokens) the number of sequences is what the tokens need; documents go, in descending order, to the
sequence of lowest cost that still has room for all of it. A document that no sequence has room for is cut over the sequences
with room, the lowest cost first, so a group pads less than one sequence. Documents longer than a sequence first fill
whole sequences of their own.

No row is shuffled: a task packs what it reads, and a sequence's id holds the partition's number, so a lost task repeats the
same ids. Defined results: a null or empty text is its end token alone; repeated rows are packed each; no rows give no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolex.llm.common import id_type, prepare, texts
from chronolex.llm.tokens import FOLDER, word_bpe

LENGTH, END, GROUP_TOKENS = 4096, 2, 1 << 21
#: Weights of the cost: of a token, and of a pair of tokens of one document.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths, and the number of sequences."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    n = 0
    for d, size in enumerate(lengths):
        whole = size // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, n, 0))
            n += 1
        if left := size - whole * capacity:
            rest.append((-left, d, whole * capacity))
    total = -sum(r[0] for r in rest)
    first, n = n, n + -(-total // capacity)
    used = [0] * (n - first)
    heap = [(0.0, s) for s in range(n - first)]
    rest.sort()

    def put(d: int, start: int, size: int, c: float, s: int) -> None:
        pieces.append((d, start, size, first + s, used[s]))
        used[s] += size
        if used[s] < capacity:
            heapq.heappush(heap, (c + cost(size), s))

    for left, d, start in rest:
        size, passed = -left, []
        while heap and capacity - used[heap[0][1]] < size:
            passed.append(heapq.heappop(heap))
        if heap:
            c, s = heapq.heappop(heap)
            for x in passed:
                heapq.heappush(heap, x)
            put(d, start, size, c, s)
            continue
        for k, (c, s) in enumerate(passed):  # in order of cost
            part = min(size, capacity - used[s])
            put(d, start, part, c, s)
            start, size = start + part, size - part
            if not size:
                for x in passed[k + 1 :]:
                    heapq.heappush(heap, x)
                break
    return pieces, n


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list], list[bytes]]], id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row for each piece. encoder, called once in each task, gives a function from texts to little-endian 32-bit ids."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"doc_id {id_type(docs, id_col)}, {PIECES}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids: list = []
        docs_ids: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs_ids, tokens, at
            sizes = [len(x) // 4 for x in docs_ids]
            pieces, n = assign(sizes, capacity)
            out = [(ids[d], s, k, zlib.crc32(docs_ids[d][4 * s : 4 * (s + k)]), sizes[d], at + q, o) for d, s, k, q, o in pieces]
            ids, docs_ids, tokens, at = [], [], 0, at + n
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                for i, x in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    docs_ids.append(x + last)
                    tokens += len(x) // 4 + 1
                    if tokens >= group_tokens:
                        yield flush()
        if ids:
            yield flush()

    prepare(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def pack_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, capacity: int = LENGTH) -> DataFrame:
    """Pack with the public word vocabulary."""
    return pack(docs, lambda: word_bpe(folder).encode, id_col, text_col, capacity)
