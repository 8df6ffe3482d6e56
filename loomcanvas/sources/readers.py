"""Readers: JSON and JSON Lines with their variants, metric logs, raw array shards, text reports, listings."""

from __future__ import annotations

import ast
import io
import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcanvas.functions import text as X

# The columns of a metric log.
METRICS = T.StructType(
    [T.StructField("timestamp_unix", T.DoubleType()), T.StructField("timestamp_iso", T.StringType()), T.StructField("event", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("step", "tokens_processed")]
    + [T.StructField(n, T.DoubleType()) for n in ("train_loss", "lr", "toks_per_sec")]
    + [T.StructField("label_toks", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("dev_loss", "dev_ppl", "dev_action_acc", "infer_insert_pct", "infer_move_pct", "infer_delete_pct")]
    + [T.StructField("infer_seed", T.LongType())]
)
# The two kinds of sidecar files with prefix lengths, in the order in which they are looked for.
PREFIX_KINDS = ("prefix_len", "rest_prefix_len")
# The columns of samples with oracle actions beside the usual ones.
ORACLE_COLUMNS = ("oracle_action_ids", "oracle_action_weights")


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of ``.jsonl`` (blank lines skipped) or of a JSON file that is a list, an object with ``records`` (first) or
    ``rows``, or one record. Entries that are no objects are dropped; a byte order mark is accepted."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path).dropna("all")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    as_list = F.from_json("t", T.ArrayType(T.StringType()))
    inside = F.from_json("t", "struct<records:array<string>,rows:array<string>>")
    listed = F.when(F.col("t").rlike(r"^\s*\["), as_list).otherwise(F.coalesce(inside["records"], inside["rows"], F.array("t")))
    return whole.select(F.explode(listed).alias("one")).where(F.col("one").rlike(r"^\s*\{")).select(F.from_json("one", schema).alias("r")).select("r.*")


def metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """A metric log (CSV with header), blanks around values ignored, empty or wrong values null."""
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in METRICS])).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cast = {T.DoubleType: X.lenient_double, T.LongType: X.lenient_int}
    return raw.select(*[(cast[type(f.dataType)](F.col(f.name)) if type(f.dataType) in cast else F.trim(f.name)).alias(f.name) for f in METRICS])


def array_shards(spark: SparkSession, folder: str, prefixes: bool = False) -> DataFrame:
    """``shard_idx, sample_idx, tokens`` of flat ``rest_tokens_shardN.npy`` files with ``rest_offsets_shardN.npy`` (start, length).

    Only shards that have both files, half-written ``.tmp.`` files left out. Only paths travel: each task maps its shards'
    token files and copies one sample after the other. With ``prefixes`` also ``prefix_len`` of the sidecars, null without one.
    """
    paths = _shard_files(spark, folder).groupBy("shard_idx").agg(F.max(F.when(F.col("kind") == "rest_tokens", F.col("path"))).alias("tokens"), F.max(F.when(F.col("kind") == "rest_offsets", F.col("path"))).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for shard, tokens, offsets in zip(*(batch.column(i).to_pylist() for i in range(3))):
                flat, where = _array(tokens, np), _array(offsets, np)
                for at in range(0, len(where), 1000):
                    rows = [flat[s : s + n].astype("int32") for s, n in where[at : at + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["shard_idx", "sample_idx", "tokens"])

    whole = paths.where("tokens IS NOT NULL AND offsets IS NOT NULL")
    samples = whole.repartition("shard_idx").mapInArrow(run, "shard_idx bigint, sample_idx bigint, tokens array<int>")
    return with_prefix_lengths(samples, prefix_lengths(spark, folder)) if prefixes else samples


def _shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, shard_idx, kind`` of a folder's array files (their contents are not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_shard*.npy").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    parts = files.where(~F.contains(name, F.lit(".tmp."))).select("path", F.regexp_extract("path", r"shard(\d+)\.npy$", 1).try_cast("bigint").alias("shard_idx"), F.regexp_extract(name, r"^(.*)_shard\d+\.npy$", 1).alias("kind"))
    return parts.where("shard_idx IS NOT NULL AND kind <> ''")


def _array(uri: str, np: Any) -> Any:  # noqa: ANN401
    """An array file: mapped where the path is local to all tasks' file system, else read through its file system."""
    if uri.startswith("file:"):
        from urllib.parse import unquote, urlparse

        return np.load(unquote(urlparse(uri).path), mmap_mode="r", allow_pickle=False)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


def prefix_lengths(spark: SparkSession, folder: str, kinds: tuple[str, str] = PREFIX_KINDS) -> DataFrame:
    """``shard_idx, sample_idx, prefix_len`` of the optional sidecar arrays; of a shard's two possible files the first kind counts."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    files = _shard_files(spark, folder).where(F.col("kind").isin(*kinds)).groupBy("shard_idx").agg(F.min_by("path", rank).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes = np.asarray(_array(path, np)).astype("int32")
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sizes), pa.int64()), pa.array(range(len(sizes)), pa.int64()), pa.array(sizes)], names=["shard_idx", "sample_idx", "prefix_len"])

    return files.mapInArrow(run, "shard_idx bigint, sample_idx bigint, prefix_len int")


def with_prefix_lengths(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """``samples`` with ``prefix_len``: a left outer join, null where there is no sidecar or it ends before the sample."""
    keys = ["shard_idx", "sample_idx"]
    return samples.drop("prefix_len").join(sizes.select(*keys, "prefix_len"), keys, "left")


def numpy_samples(spark: SparkSession, folder: str, need: list[str]) -> DataFrame:
    """Samples of ``.npz`` bucket shards: ``path, sample_no`` and each array of ``need`` as array<double> (one sample a row, flattened).

    Files with ``.tmp.`` in their name and files that cannot be read are left out; a readable file without a needed array is an
    error that names it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(folder).select("path")
    names = ["path", "sample_no", *need]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        import numpy as np
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                try:
                    with system.open_input_file(path) as f:
                        arrays = dict(np.load(io.BytesIO(f.read()), allow_pickle=False))
                except (OSError, ValueError, EOFError, zipfile.BadZipFile):
                    continue
                if lacking := [n for n in need if n not in arrays]:
                    raise KeyError(f"{uri} lacks {', '.join(lacking)}")
                n = min((len(arrays[k]) for k in need), default=0)
                columns = [pa.array([np.ravel(arrays[k][i]).astype("float64") for i in range(n)], pa.list_(pa.float64())) for k in need]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(range(n), pa.int32()), *columns], names=names)

    kept = files.where(~F.contains(F.element_at(F.split("path", "/"), -1), F.lit(".tmp.")))
    return kept.mapInArrow(run, "path string, sample_no int" + "".join(f", `{n}` array<double>" for n in need))


def discover_buckets(spark: SparkSession, folder: str, least: int, most: int) -> DataFrame:
    """``bucket, len_start, len_end`` of the bucket folders that overlap [least, most] and hold both index files; none at all is an error."""
    from loomcanvas.operators.buckets import overlapping, parse_bucket

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder).select(F.split("path", "/").alias("_p"))
    per = files.select(F.element_at("_p", -2).alias("bucket"), F.element_at("_p", -1).alias("_n")).groupBy("bucket").agg(F.count_if(F.col("_n").rlike("shard")).alias("_s"), F.count_if(F.col("_n").rlike("sample")).alias("_i"))
    found = overlapping(per.where("_s > 0 AND _i > 0").select("bucket", parse_bucket(F.col("bucket")).alias("_b")).where("_b IS NOT NULL").select("bucket", "_b.*"), least, most)
    if found.isEmpty():
        raise FileNotFoundError(f"no bucket of [{least}, {most}] under {folder}")
    return found


def at_index(df: DataFrame, index: str, wanted: int, per_file: int) -> DataFrame:
    """Random access: the row at position ``wanted``, with the file it lies in and its place there (``file_no``, ``in_file``)."""
    return df.where(F.col(index) == wanted).withColumn("file_no", F.floor(F.col(index) / per_file).cast("bigint")).withColumn("in_file", (F.col(index) % per_file).cast("int"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``shard_idx, has_tokens, has_offsets, done`` from a folder's file names; temporary files do not count."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name")).where(~F.contains("name", F.lit(".tmp.")))
    number = F.regexp_extract(F.regexp_replace("name", r"\.[a-z]+$", ""), r"(\d+)\D*$", 1).try_cast("bigint")
    has = lambda p: F.max(F.col("name").rlike(p))
    return files.withColumn("shard_idx", number).where("shard_idx IS NOT NULL").groupBy("shard_idx").agg(has(r"tokens_shard\d+\.npy$").alias("has_tokens"), has(r"offsets_shard\d+\.npy$").alias("has_offsets"), has(r"\.done$").alias("done"))


def samples(spark: SparkSession, path: str, need: list[str], most: int | None = None) -> DataFrame:
    """Preprocessed samples as Parquet; missing required columns are an error naming them, unreadable files are skipped.

    With ``most``, the first samples in the order of their file and place there.
    """
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    if lacking := [c for c in need if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(lacking)}")
    if most is None:
        return df
    place = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return place.orderBy("_f", "_b", "_i").limit(most).drop("_f", "_b", "_i")


def read_trajectories(spark: SparkSession, kind: str, path: str, **options: Any) -> DataFrame:
    """One entrance to all layouts: ``parquet``, ``arrays`` (raw shards), ``samples`` (needs ``need``), ``oracle`` (samples that
    must have oracle actions too), ``npz``."""
    makers = {
        "parquet": lambda: spark.read.parquet(path), "arrays": lambda: array_shards(spark, path, **options), "samples": lambda: samples(spark, path, **options),
        "oracle": lambda: samples(spark, path, **{**options, "need": [*options.get("need", ()), *ORACLE_COLUMNS]}), "npz": lambda: numpy_samples(spark, path, **options),
    }
    if kind not in makers:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(makers))}")
    return makers[kind]()


def config(path: str) -> dict[str, Any]:
    """A YAML (or JSON) configuration; numbers written as text become numbers."""
    raw = Path(path).read_text(encoding="utf-8-sig")
    try:
        import yaml

        data = yaml.safe_load(raw)
    except ImportError:
        data = json.loads(raw)

    def number(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: number(v) for k, v in x.items()}
        if isinstance(x, list):
            return [number(v) for v in x]
        if isinstance(x, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x):
            return float(x) if re.search(r"[.eE]", x) else int(x)
        return x

    return number(data or {})


def state_file(path: str) -> dict[str, Any]:
    """A data set's state; an empty one on any error."""
    try:
        out = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        return out if isinstance(out, dict) else {}
    except (OSError, ValueError):
        return {}


# The headings of a decoded report, and how many lines after a response its action list may begin.
CAPITAL, SMALL = "PROMPT:", "prompt:"
TABLE_HEADS = ("RESPONSE_TEXT:", "STEPS:", "ACTIONS (token_id -> token_string)")
LIST_HEADS = ("response_text:", "RESPONSE_TEXT:", "steps:", "edit_history_tokens_decoded:")
REACH = 500


class Sections:
    """A block's lines by heading: each heading's own rest of line, and the lines up to the next one."""

    def __init__(self, block: list[str], heads: tuple[str, ...]):
        places = [(n, h) for n, line in enumerate(block) if (h := next((x for x in heads if x in line and line.strip().startswith(x)), None))]
        self.top = block[1 : places[0][0] if places else len(block)]
        self.parts: dict[str, tuple[int, str, list[str]]] = {}
        for (n, head), (end, _) in zip(places, [*places[1:], (len(block), "")]):
            self.parts.setdefault(head, (n, block[n].strip()[len(head) :].strip(), block[n + 1 : end]))

    def line(self, head: str) -> int:
        return self.parts[head][0]

    def text(self, head: str) -> str:
        """The section's text: what stands on the heading's line (a literal), else the lines below it up to a blank one or all."""
        _, inline, below = self.parts[head]
        return literal(inline) if inline else "\n".join(below).rstrip()

    def rows(self, head: str) -> list[str]:
        """The section's lines up to the first blank one."""
        lines = [x.strip() for x in self.parts[head][2]]
        return lines[: lines.index("")] if "" in lines else lines


def literal(text: str) -> str:
    """A quoted text's value, any other text as it is."""
    quoted = re.fullmatch(r"""(?s)(['"])(.*)\1""", text.strip())
    if not quoted:
        return text.strip()
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        value = quoted[2]
    return value if isinstance(value, str) else text.strip()


def table_block(block: list[str]) -> tuple[str, str, list[str]] | None:
    """A block with capital headings and a table ``id -> token``; moves are written ``[MOVE -1]``, whatever stands after MOVE."""
    s = Sections(block, TABLE_HEADS)
    if not {TABLE_HEADS[0], TABLE_HEADS[2]} <= s.parts.keys():
        return None
    tokens = [re.sub(r"\[MOVE_(?=[+-])", "[MOVE ", row.partition("->")[2].strip()) for row in s.rows(TABLE_HEADS[2]) if "->" in row]
    return "\n".join(s.top).strip(), s.text(TABLE_HEADS[0]), tokens


def list_block(block: list[str]) -> tuple[str, str, list[str]] | None:
    """A block with a prompt (quoted on its line, or on the lines below), a response and a list of actions."""
    s = Sections(block, LIST_HEADS)
    response = next((h for h in LIST_HEADS[:2] if h in s.parts), None)
    listed = next((h for h in reversed(LIST_HEADS[2:]) if h in s.parts), None)
    if not response or not listed or s.line(listed) - s.line(response) > REACH:
        return None
    inline = block[0].strip()[len(SMALL) :].strip()
    actions = s.rows(listed)
    if not any(word in a for a in actions for word in ("MOVE", "DELETE", "END_OF_RESPONSE")) and not any(a[:1] in ("'", '"') for a in actions if a):
        return None
    text = s.text(response)
    return (literal(inline) if inline else "\n".join(s.top).strip()), text, actions


def parse_report(text: str) -> list[tuple[str, str, list[str]]]:
    """(prompt, response, actions) of each block of a decoded report that has an action list.

    A block begins at a prompt heading and ends before the next; its kind is told by that heading's spelling. Blocks
    without a prompt or without actions are left out, and so are those with small headings that have no response.
    """
    lines = text.splitlines()
    starts = [n for n, x in enumerate(lines) if x.strip() == CAPITAL or x.strip().startswith(SMALL)]
    out = []
    for start, end in zip(starts, [*starts[1:], len(lines)]):
        block = lines[start:end]
        capital = block[0].strip() == CAPITAL
        found = (table_block if capital else list_block)(block)
        if found and found[0] and found[2] and (capital or found[1]):
            out.append(found)
    return out


def reports(spark: SparkSession, path: str) -> DataFrame:
    """``path, example_no, prompt, response, actions`` of all report files under ``path`` (a file is one task's row)."""
    from loomcanvas.plans.frames import ship

    ship(spark)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, x in enumerate(parse_report(t or ""))]
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "example_no", "prompt", "response", "actions"])

    return files.mapInArrow(run, "path string, example_no int, prompt string, response string, actions array<string>")
