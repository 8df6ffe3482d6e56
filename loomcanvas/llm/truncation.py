"""Problem 2: text and action lists that were cut by a limit or in transfer.

A text without a sentence end is judged by (1) length evidence: it stands at a length where its source's unfinished
texts pile up and that almost none of its texts exceeds; (2) the vocabulary trie: its last token is no known word but a
proper prefix of known words; (3) its last word, in the context since the sentence began, practically never ends a unit
of the corpus. Trie nodes (by the hash of their path) and contexts are counted over the whole corpus, but only those
leave a task that some unfinished text asks about: a bitmap says which.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomcanvas.llm import encoding, lexing
from loomcanvas.llm.answers import Ending, Languages, is_copy, is_refusal
from loomcanvas.llm.runs import canonical_action
from loomcanvas.plans.frames import cut, latest, small, spread

#: Bits of the bitmap of wanted keys: BITS_A_TEXT for each unfinished text, within bounds (32 MB at most). A fuller bitmap lets more keys
#: through to the shuffle, never fewer.
BITS_A_TEXT, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: A context must have been seen this often to speak, and end units in less than this share to tell a cut.
LEAST_SEEN, MOST_ENDS = 3, 0.08
#: A length limit: this share of a source's unfinished texts (and this many) stand at it, at most this share of all its texts goes beyond.
SPIKE_SHARE, SPIKE_COUNT, BEYOND_SHARE, LEAST_LIMIT = 0.12, 6, 0.04, 16
#: A source whose share of histories with a stop mark is below this never writes one.
WRITES_STOP = 0.01
#: Counts that a task gathers before it passes them on.
MOST_COUNTS = 1_000_000
#: Nats by which a language must lead the next one, for the prompt and for the answer.
SURE = 3.0
#: Sources up to this number are joined by broadcast.
MOST_SOURCES = 100_000
#: Texts that are judged together.
BATCH = 10_000


def endings(df: DataFrame, keep: list[str], text: str, prompt: str | None = None, words: dict[int, list[float]] | None = None, models: dict[str, tuple[bytes, str]] | None = None) -> DataFrame:
    """``keep`` and of the column ``text``: kind, core, chars, bytes, words, keys, foreign.

    With ``models`` (of problem 1) garbled texts and prompts are restored first. Kinds: empty (null too), code, refusal, copy
    (of the column ``prompt``), ended, open. ``keys`` are null unless the text is open; the first two are its last token as a
    word and as a trie node; there are none if it ends with an abbreviation that something has to follow. ``foreign`` (with ``words``, the model of ``Languages``): the text is in another language
    than the prompt asks for, told with SURE nats at least. Null prompts have no copies and no language.
    """
    sent = df.sparkSession.sparkContext.broadcast((words, models))  # dictionaries, alphabets and the words of five languages
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_())
    names = [*keep, "kind", "core", "chars", "bytes", "words", "keys", "foreign"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, models = sent.value
        tongues, solver = Languages(words or {}), encoding.solver(models) if models else None
        for whole in batches:
            for batch in (whole.slice(at, BATCH) for at in range(0, whole.num_rows, BATCH)):
                texts, asks = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
                if solver:
                    each = list(dict.fromkeys([*texts, *asks]))
                    plain = dict(zip(each, solver.plain(each)))
                    texts, asks = [plain[t] for t in texts], [plain[a] for a in asks]
                rows: list[list] = []
                halted: list[bool] = []
                for t, ask in zip(texts, asks):
                    e = Ending(t)
                    kind = e.kind
                    if kind in ("ended", "open"):
                        kind = "refusal" if is_refusal(t) else "copy" if is_copy(ask, t) else kind
                    halted.append(e.halted)
                    core = e.core if kind in ("ended", "open") else ""
                    rows.append([kind, core, len(core) + len(e.blanks), len(core.encode("utf-8", "surrogatepass")) + len(e.blanks.encode("utf-8")), len(core.split()), None, False])
                told = [i for i, r in enumerate(rows) if r[0] in ("ended", "open")]
                if words:
                    for i, (want, sure), (has, how) in zip(told, tongues.wanted([asks[i] for i in told]), tongues.tell([texts[i] for i in told])):
                        rows[i][6] = want is not None and has is not None and want != has and min(sure, how) >= SURE
                opened = [i for i in told if rows[i][0] == "open"]
                for i, keys in zip(opened, lexing.last_keys([rows[i][1] for i in opened])):
                    rows[i][5] = [] if halted[i] else keys
                more = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *more], names=names)

    asked = F.col(prompt) if prompt else F.lit(None).cast("string")
    picked = spread(df.select(*keep, F.col(text).alias("_text"), asked.alias("_prompt")))
    kinds = ", ".join(f"`{n}` {t}" for n, t in picked.dtypes[:-2])
    return picked.mapInArrow(run, f"{kinds}, kind string, core string, chars int, bytes int, words int, keys array<bigint>, foreign boolean")


def wanted_bitmap(open_rows: DataFrame) -> bytes:
    """A bitmap of the low bits of all keys, built by the JVM's bitmap aggregate and collected (MOST_BITS at most)."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_A_TEXT * open_rows.count()):
        size *= 2
    keys = open_rows.where("keys IS NOT NULL").select(F.explode("keys").alias("k"))
    bits = keys.select((F.pmod("k", F.lit(size)) + 1).alias("b"))  # the JVM counts bits from 1
    rows = bits.groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    out = bytearray(size // 8)
    for n, m in rows:  # buckets of 32768 bits, numbered from 1
        out[(n - 1) * 4096 : (n - 1) * 4096 + len(m)] = m
    return bytes(out)


def corpus_counts(corpus: DataFrame, bitmap: bytes) -> DataFrame:
    """``key, seen, ends`` over all texts of ``corpus`` (column ``text``) for the keys in the bitmap, as ``lexing.corpus_keys`` counts them."""
    sent = corpus.sparkSession.sparkContext.broadcast(bitmap)  # MOST_BITS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        low = np.uint64(8 * len(bits) - 1)

        def asked(keys: np.ndarray) -> np.ndarray:
            k = keys & low
            return (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            return lexing.summed(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

        def sent_on(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])], names=["key", "seen", "ends"])

        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for _, some in lexing.chunks([t for t in batch.column(0).to_pylist() if t]):
                parts.append(lexing.corpus_keys(some, asked))
            if sum(len(p[0]) for p in parts) > MOST_COUNTS:
                parts = [merged(parts)]
                if len(parts[0][0]) > MOST_COUNTS // 2:
                    yield sent_on(parts.pop())
        if parts:
            yield sent_on(merged(parts))

    counts = spread(corpus.select("text")).mapInArrow(run, "key bigint, seen bigint, ends bigint")
    return counts.groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def limits(found: DataFrame, source: str) -> DataFrame:
    """``source, measure, at``: the lengths at which a source's unfinished texts pile up."""
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("at")) for m in ("chars", "bytes", "words")]))
    each = found.where("kind IN ('ended', 'open')").select(F.col(source).alias("source"), (F.col("kind") == "open").cast("int").alias("is_open"), measures.alias("_m")).select("source", "is_open", "_m.*")
    counts = each.groupBy("source", "measure", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("is_open").alias("opened"))
    per = Window.partitionBy("source", "measure")
    above = per.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    told = counts.select("*", F.sum("n").over(per).alias("all_n"), F.sum("opened").over(per).alias("all_open"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("beyond"))
    return told.where(
        (F.col("opened") >= SPIKE_COUNT) & (F.col("opened") >= SPIKE_SHARE * F.col("all_open")) & (F.col("beyond") <= BEYOND_SHARE * F.col("all_n")) & (F.col("at") >= LEAST_LIMIT)
    ).select("source", "measure", "at")


def judge(found: DataFrame, documents: DataFrame, source: str) -> DataFrame:
    """The open rows of ``found`` (as ``endings`` gives it, materialised) with ``is_cut boolean``.

    The corpus is the column ``text`` of ``documents`` and the texts of ``found`` that are answers at all.
    """
    open_rows = found.where("kind = 'open'")
    at = small(limits(found, source).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("measure", "at"))).alias("_limits")).withColumnRenamed("source", "_source"), MOST_SOURCES)
    full = lambda x: (
        ((x["measure"] == "chars") & (F.col("chars") == x["at"]))
        | ((x["measure"] == "words") & (F.col("words") == x["at"]))
        | ((x["measure"] == "bytes") & (F.col("bytes") <= x["at"]) & (F.col("bytes") > x["at"] - 3))
    )
    corpus = documents.select("text").unionByName(found.where("kind IN ('ended', 'open')").select(F.col("core").alias("text")))
    counts = corpus_counts(corpus, wanted_bitmap(open_rows))
    # Each list of keys is asked about once, and each of its keys finds its count.
    asked = open_rows.where("keys IS NOT NULL").select("keys").distinct().select(F.xxhash64("keys").alias("_k"), F.posexplode("keys").alias("no", "key"))
    hit = asked.join(counts, "key")
    told = hit.groupBy("_k").agg(
        F.max(F.when(F.col("no") == 0, F.col("seen"))).alias("as_word"),
        F.max(F.when(F.col("no") == 1, F.col("seen"))).alias("as_node"),
        F.min(F.when((F.col("no") > 1) & (F.col("seen") >= LEAST_SEEN), F.struct("no", (F.col("ends") / F.col("seen")).alias("share")))).alias("_best"),
    ).select("_k", F.coalesce("as_word", F.lit(0)).alias("as_word"), F.coalesce("as_node", F.lit(0)).alias("as_node"), F.col("_best.share").alias("share"))
    evidence = open_rows.withColumn("_k", F.xxhash64("keys")).join(told, "_k", "left").join(at, F.col(source) == F.col("_source"), "left")
    # A token that no context speaks for is judged by the trie alone, even if it is a word too.
    mid_word = ((F.col("as_word") < 2) | F.col("share").isNull()) & (F.col("as_node") >= 2)
    at_limit = F.exists("_limits", full)
    told_cut = F.coalesce(F.size("keys") == 0, F.lit(False)) | F.coalesce(at_limit, F.lit(False)) | F.coalesce(mid_word, F.lit(False)) | F.coalesce(F.col("share") < MOST_ENDS, F.lit(False))
    return evidence.withColumn("is_cut", told_cut).select(*found.columns, "is_cut")


def cut_histories(df: DataFrame, key: str, history: Column, arrived: str, as_text: bool, counted: Column | None = None) -> DataFrame:
    """``record_key, source, has_list, is_cut`` of action lists by their last delivery; a null source is ``unknown``.

    A list is cut if it holds no stop mark although its source writes them, or if more actions were counted (``counted``)
    than it holds. Null and empty lists are no cases.
    """
    n = F.size(history)
    if as_text:
        stop = F.exists(F.slice(history, F.greatest(n, F.lit(1)), 1), lambda x: canonical_action(x) == "STOP")
    else:
        stop = F.array_contains(history, F.lit(50260))  # the stop id; pad ids may follow it
    has = history.isNotNull() & (n > 0)
    more = F.coalesce(counted > n, F.lit(False)) if counted is not None else F.lit(False)
    narrow = df.select(F.col(key).cast("string").alias("record_key"), F.coalesce("source", F.lit("unknown")).alias("source"), F.col(arrived).alias("_at"), has.alias("has_list"), F.coalesce(has & stop, F.lit(False)).alias("_stop"), (has & more).alias("_more"))
    last = cut(latest(narrow, ["record_key"], ["source", "has_list", "_stop", "_more"], ["_at", F.xxhash64("source", "has_list", "_stop", "_more")]))
    writes = last.where("has_list").groupBy("source").agg((F.avg(F.col("_stop").cast("int")) >= WRITES_STOP).alias("_writes"))
    told = last.join(small(writes, MOST_SOURCES), "source", "left")
    return told.select("record_key", "source", "has_list", (F.col("has_list") & ~F.col("_stop") & (F.coalesce("_writes", F.lit(False)) | F.col("_more"))).alias("is_cut"))
