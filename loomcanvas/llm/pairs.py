"""Problem 5: broken prompt and response pairs.

Responses are sorted by text and neighbours' common prefixes show shortened versions; length-limit spikes, the trie and
the endings of problem 2 show cuts; then the rules for empty answers, refusals, copies and languages apply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcanvas.llm import truncation
from loomcanvas.plans.frames import cut

#: An unfinished answer of at least this many bytes that another answer continues with a further word is a shortened
#: version; shorter ones may be whole answers ("Yes") that others begin with too.
LEAST_SHARED = 20
#: Texts in a range, at most about.
RANGE_ROWS = 500_000
GOES_ON = regex.compile(r"[\p{L}\p{M}]*[\s,;:]*[\p{L}\p{N}]")


class Neighbours:
    """Texts in sorted order, each compared with those before it that it begins with (a stack of the still unanswered ones)."""

    def __init__(self) -> None:
        self.stack: list[str] = []

    def next(self, text: str, is_open: bool) -> list[str]:
        """The open texts that ``text`` continues; they are answered then."""
        while self.stack and not text.startswith(self.stack[-1]):
            self.stack.pop()
        found = [x for x in self.stack if GOES_ON.match(text, len(x))]
        if found:
            self.stack = [x for x in self.stack if x not in found]
        if is_open and len(text.encode("utf-8", "surrogatepass")) >= LEAST_SHARED:
            self.stack.append(text)
        return found


def shortened(found: DataFrame) -> DataFrame:
    """``core`` of the unfinished texts that another text continues: range-sorted, each compared with its neighbours.

    In sorted order all texts that begin with a text follow it, so one pass with a stack finds every continuation, however
    many texts stand between. A text that is still unanswered at the end of its range is handed on to the following ranges whose
    first text begins with it, which a second pass goes through. Equal texts are one row.
    """
    spark = found.sparkSession
    texts = found.where("kind IN ('open', 'ended')").groupBy("core").agg(F.max(F.col("kind") == "open").alias("is_open"))
    # Left to the session (and its runtime coalescing) unless there are more texts than that suits.
    wanted = -(-found.count() // RANGE_ROWS)
    ranged = texts.repartitionByRange(wanted, "core") if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else texts.repartitionByRange("core")
    ranges = cut(ranged.sortWithinPartitions("core").select("core", "is_open", F.spark_partition_id().alias("_p")))
    firsts = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in ranges.groupBy("_p").agg(F.min("core")).collect()))  # a row per range

    def run(batches: Iterator[pa.RecordBatch], hand_on: bool) -> Iterator[pa.RecordBatch]:
        order, at = Neighbours(), None
        out: list[tuple[str, int | None]] = []

        def leave() -> None:
            later = [(p, first) for p, first in firsts.value if p > at] if hand_on and order.stack else []
            for x in order.stack:
                for p, first in later:
                    if not first.startswith(x):
                        break
                    out.append((x, p))

        for batch in batches:
            for text, is_open, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != at:
                    if at is not None:
                        leave()
                    order, at = Neighbours(), p
                out += [(x, None) for x in order.next(text, is_open)]
        if at is not None:
            leave()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.int32())], names=["core", "_p"])

    schema = "core string, _p int"
    marks = cut(ranges.mapInArrow(lambda b: run(b, True), schema))
    told = marks.where("_p IS NULL").select("core")
    carried = marks.where("_p IS NOT NULL")
    if not carried.isEmpty():
        again = ranges.join(F.broadcast(carried.select("_p").distinct()), "_p", "left_semi")  # a row per range at most
        both = again.select("core", F.lit(False).alias("is_open"), "_p").unionByName(carried.select("core", F.lit(True).alias("is_open"), "_p"))
        told = told.union(both.repartition("_p").sortWithinPartitions("_p", "core", "is_open").mapInArrow(lambda b: run(b, False), schema).select("core"))
    return told.distinct().withColumn("is_shortened", F.lit(True))


def defects(answers: DataFrame, documents: DataFrame, keys: list[str], words: dict[int, list[float]], models: dict[str, tuple[bytes, str]] | None = None) -> DataFrame:
    """``keys, defect_type`` of each defective answer; ``answers`` has ``keys``, source, prompt and answer.

    Garbled texts are restored first if ``models`` are given. At most one type each, in this order: empty, refusal, copy,
    truncated, other_language. A null prompt has no copies and no language. An answer in action code is no defect.
    """
    found = cut(truncation.endings(answers, [*keys, "source"], "answer", "prompt", words, models))
    foreign = F.when(F.col("foreign"), F.lit("other_language"))
    whole = found.where("kind <> 'open'").select(*keys, F.when(F.col("kind").isin("empty", "refusal", "copy"), F.col("kind")).when(F.col("kind") == "ended", foreign).alias("defect_type"))
    open_rows = truncation.judge(found, documents, "source").join(shortened(found), "core", "left")
    cut_rows = open_rows.select(*keys, F.when(F.col("is_cut") | F.coalesce("is_shortened", F.lit(False)), F.lit("truncated")).otherwise(foreign).alias("defect_type"))
    return whole.unionByName(cut_rows).where("defect_type IS NOT NULL")
