"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary is a sentencepiece BPE model with byte fallback. A text is a run of symbols: its characters, or
the UTF-8 bytes of a character that the vocabulary lacks. The adjacent pair of the lowest rank is popped from a
heap and merged, again and again; the count is the initial symbols less the merges. No identifiers are emitted.

No piece holds a word mark after another character, so text splits exactly before each run of word marks, and
line feeds, which no piece holds, split it too. Equal segments have equal counts, and each worker remembers a
bounded number of them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MARK = "▁"
#: Segments that a worker remembers before it forgets all of them.
REMEMBERED = 700_000


class PieceCounter(dict):
    """Maps a segment to its number of tokens; unknown segments are merged on demand."""

    def __init__(self, model_file: str):
        super().__init__()
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        order = sorted(
            (i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))),
            key=lambda i: (-sp.get_score(i), i),
        )
        self.rank = {sp.id_to_piece(i): r for r, i in enumerate(order)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a piece of this model crosses words or lines; segments wouldn't be independent")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+")

    def __missing__(self, segment: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[segment] = self.merged(segment)
        return n

    def merged(self, segment: str) -> int:
        rank = self.rank
        total = sum(1 if c in rank else len(c.encode()) for c in segment)
        part: list[str] = list(segment)
        n = len(part)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            r = rank.get(part[k] + part[k + 1])
            if r is not None:
                heap.append((r, k, part[k], part[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k] if part[k] == left else n
            if j >= n or part[j] != right:
                continue
            part[k], part[j] = left + right, ""
            total -= 1
            nxt = after[k] = after[j]
            if nxt < n:
                before[nxt] = k
                r = rank.get(part[k] + part[nxt])
                if r is not None:
                    heapq.heappush(heap, (r, k, part[k], part[nxt]))
            prv = before[k]
            if prv >= 0:
                r = rank.get(part[prv] + part[k])
                if r is not None:
                    heapq.heappush(heap, (r, prv, part[prv], part[k]))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.cut.findall(marked))) + marked.count("\n")


_counters: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def token_counts(df: DataFrame, model_file: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text.

    Null and empty texts have 0 tokens. Equal texts have equal counts, and every row is kept, repeated ones too.
    A column named as `out` is replaced; all others pass through unchanged. An empty table gives an empty table.
    model_file must be readable by that path on every executor.
    """

    from .common import modest_batches, release

    modest_batches(df)

    def count(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(model_file)
        for col in cols:
            yield pa.array((0 if t is None else c.count(t) for t in (x.as_py() for x in col)), pa.int64())
        # A worker lives on after its task; what it remembers would take room from other stages.
        c.clear()
        release()

    return df.withColumn(out, F.arrow_udf(count, LongType())(F.col(text).cast("string")))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )
