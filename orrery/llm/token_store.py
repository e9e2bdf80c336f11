"""A token store: ids of every document in files, compressed one by one with a shared dictionary.

A store is a folder with two Parquet datasets, written by Spark's own committed writer so that any
file system will do and a lost executor leaves no half-written file:

    dictionary/  one row: sha256, body        the zstandard dictionary, trained on serialised ids
    blocks/      shard, block, dict_sha256, payload, index

A payload is the concatenation of zstandard frames, one for each document, of little-endian unsigned
16-bit ids (32-bit where the vocabulary needs them). The index has, for each document, doc_id, offset
and length of its frame, n_tokens, and start: the ids before it in its shard. Shards and blocks are
in ascending order of doc_id, so one document is read by its block and one short frame.

Defined results: a null text counts as empty, and every document gets the end id; a null doc_id comes
first, and equal doc_ids follow one another in the order of their texts' hashes; an empty table gives
an empty store that reads back as no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, partitions, prepare

#: Bytes of frames after which a block is written.
BLOCK_BYTES = 1 << 20
#: The dictionary is fitted on so many documents, those first in a hashed order, and on at most so many
#: characters of each.
TRAIN_DOCS, TRAIN_CHARS, DICT_BYTES = 1000, 20_000, 32_768
LEVEL = 3
MOST_CACHED = 1_000_000
#: Letters below are letters to every library, in either case.
LATIN = "\u0100"
#: What a vocabulary file has to say for words between blanks to be encoded by themselves: text is composed, white
#: space becomes blanks, case goes; a pre-token never crosses a blank; and a word's last token shows its end. Fixed values.
NORMALISERS = ("NFC", "Replace", "Lowercase")
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK, BETWEEN, AT_ONCE = "\x01", " \x01 ", 256

INDEX = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "offset", "length", "n_tokens", "start")]))
INDEX_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "offset", "length", "n_tokens", "start")]))
BLOCKS = "shard int, block int, dict_sha256 string, payload binary, `index` array<struct<doc_id: bigint, offset: bigint, length: bigint, n_tokens: bigint, start: bigint>>"


def splits_at_blanks(layout: dict) -> bool:
    """Whether a vocabulary file is of the one layout whose words may be encoded one by one."""
    model, steps = layout["model"], (layout.get("normalizer") or {}).get("normalizers") or []
    splits = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and tuple(s["type"] for s in steps) == NORMALISERS and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": PRE_TOKENS} and splits[0].get("behavior") == "Removed" and bool(splits[0].get("invert"))
        and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex") and not layout.get("post_processor") and not layout.get("truncation") and not layout.get("padding")
        and all(not t["normalized"] for t in layout["added_tokens"])
    )


class Words:
    """The tokenizers library over words between blanks, each distinct word encoded once.

    That is right where the vocabulary's pre-tokeniser never lets a token cross white space, drops case,
    and tells words' ends, as its file says; with any other vocabulary, texts are encoded whole. So are texts that
    hold the string of a special token, which the library takes for that token.
    """

    def __init__(self, path: str, kind: str) -> None:
        # Tasks are parallel already, and threads of the library's own would each hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.kind = np.dtype(kind)
        self.marks = {m: np.array(self.own.encode(m, add_special_tokens=False).ids, self.kind).tobytes() for m in ".,;:!?)"}
        self.mark = (self.own.encode(MARK, add_special_tokens=False).ids or [-1])[0]
        layout = json.loads(Path(path).read_text())
        self.by_word, suffix = splits_at_blanks(layout), layout["model"].get("end_of_word_suffix") or "</w>"
        self.added = tuple(t["content"] for t in layout["added_tokens"])
        self.ends = np.array([(self.own.id_to_token(i) or "").endswith(suffix) for i in range(self.own.get_vocab_size())])
        # Two generations: what was used since the last change is kept at the next one.
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def whole(self, texts: list[str], end: int) -> list[bytes]:
        coded = self.own.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array([*c.ids, end], self.kind).tobytes() for c in coded]

    def learn(self, new: list[str]) -> None:
        """Adds words to the known ones. A mark behind a letter is a token of its own, and case is
        dropped: a word's ids are those of its stem in lower case, and the mark's."""
        known, marks = self.known, self.marks
        stems, rest = [], {}
        for w in new:
            if w[-1] in marks and w[-2:-1] < LATIN and w[-2:-1].isalpha():
                stem, mark = w[:-1], marks[w[-1]]
            else:
                stem, mark = w, b""
            if stem[0] <= "Z" and stem.isascii():
                stem = stem.lower()
            if stem not in known:
                rest[stem] = None
            if stem is not w:
                stems.append((w, stem, mark))
        # A word of plain letters is one pre-token, which ends with the first token that ends a word.
        letters, other = [], []
        for w in rest:
            (letters if w.isalpha() and (w.isascii() or max(w) < LATIN) else other).append(w)
        self.add(letters, " ", lambda ids: np.flatnonzero(self.ends[ids]) + 1, 0)
        # Others have a control character of its own between them.
        self.add([w for w in other if MARK not in w], BETWEEN, lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for w in other:
            if MARK in w:
                known[w] = np.array(self.own.encode(w, add_special_tokens=False).ids, self.kind).tobytes()
        for w, stem, mark in stems:
            known[w] = known[stem] + mark

    def add(self, new: list[str], between: str, ends: Callable[[np.ndarray], np.ndarray], gap: int) -> None:
        """Encodes words, many in one text; ends: where each word's ids end, `gap` ids before the next's."""
        parts = [new[at : at + AT_ONCE] for at in range(0, len(new), AT_ONCE)]
        size = self.kind.itemsize
        for part, coded in zip(parts, self.own.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, self.kind)
            raw, at = ids.tobytes(), ends(ids) * size
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *(at[:-1] + gap * size).tolist()], at.tolist())), strict=True))

    def serialised(self, texts: list[str], end: int) -> list[bytes]:
        """Each text's ids and the end id, as little-endian bytes."""
        if not self.by_word:
            return self.whole(texts, end)
        if odd := [i for i, t in enumerate(texts) if any(a in t for a in self.added)]:
            at, plain = set(odd), iter(self.serialised([t for t in texts if not any(a in t for a in self.added)], end))
            whole = iter(self.whole([texts[i] for i in odd], end))
            return [next(whole if i in at else plain) for i in range(len(texts))]
        known, before, final = self.known, self.before, np.array([end], self.kind).tobytes()
        rows, holes, new = [], [], {}
        for text in texts:
            words_of = text.replace("\n", " ").split(" ")
            row = list(map(known.get, words_of))
            if gaps := row.count(None):
                at, i = [], -1
                for _ in range(gaps):
                    at.append(i := row.index(None, i + 1))
                own = [words_of[i] for i in at]
                new.update(dict.fromkeys(own))
                holes.append((row, at, own))
            rows.append(row)
        unknown = []
        for w in new:
            if (x := before.get(w)) is None:
                unknown.append(w)
            else:
                known[w] = x
        self.learn(unknown)
        for row, at, own in holes:
            for i, w in zip(at, own, strict=True):
                row[i] = known[w]
        for w in unknown:
            if len(w) > 64:
                known.pop(w, None)
        if len(known) > MOST_CACHED:
            self.before, self.known = known, {"": b""}
        return [b"".join(row) + final for row in rows]


def words(path: str, kind: str) -> Words:
    return only(("words", path, kind), lambda: Words(path, kind))


@lru_cache(2)
def vocabulary_kind(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, kind: str) -> bytes:
    """A zstandard dictionary; what the sample's ids are where zstandard finds too little to train on,
    and no bytes only where no text has a character."""
    import zstandard

    with_text = docs.select("doc_id", "text").filter(F.length("text") > 0)
    texts: set[str] = set()
    # Ids are picked by their hashes alone, without a look at texts, and once more if none of them has any.
    for ids in (docs, with_text):
        picked = ids.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(TRAIN_DOCS)
        found = with_text.select(F.xxhash64("doc_id").alias("h"), "text").join(F.broadcast(picked), "h")
        found = found.groupBy("h", F.xxhash64("text").alias("t")).agg(F.first(F.substring("text", 1, TRAIN_CHARS)).alias("text"))
        texts = {r["text"] for r in found.orderBy("h", "t").limit(TRAIN_DOCS).collect()}
        if texts:
            break
    samples = Words(tokenizer, kind).serialised(sorted(texts), end)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def shard_of(docs: DataFrame, shards: int) -> Column:
    """Which range of doc_id a row is in. The bounds are quantiles of doc_id, so that texts aren't read
    for them; they are searched in two steps, of their root's number each."""
    bounds = sorted({int(x) for x in docs.filter("doc_id IS NOT NULL").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.25 / shards)})
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    numbers = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")
    table = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    group = below(numbers([g[-1] for g in groups]))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(group * width + F.coalesce(below(F.get(table, group)), F.lit(0)))


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> str:
    """Writes docs' ids to a new store at path; returns the dictionary's sha256."""
    import zstandard

    spark = docs.sparkSession
    prepare(spark)
    kind = vocabulary_kind(tokenizer)
    body = train_dictionary(docs, tokenizer, end, kind)
    digest = hashlib.sha256(body).hexdigest()
    spark.createDataFrame([(digest, bytearray(body))], "sha256 string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = None, 0, 0
        own = words(tokenizer, kind)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(body) if body else None)
        payload, index = bytearray(), []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([digest]), pa.array([bytes(payload)], pa.binary()), pa.array([index], INDEX_ARROW)], names=["shard", "block", "dict_sha256", "payload", "index"])

        for batch in source:
            texts = own.serialised([t or "" for t in batch["text"].to_pylist()], end)
            for doc, of, ids in zip(batch["doc_id"].to_pylist(), batch["shard"].to_pylist(), texts, strict=True):
                if of != shard:
                    if index:
                        yield made()
                    shard, block, start, payload, index = of, 0, 0, bytearray(), []
                frame, n = press.compress(ids), len(ids) // own.kind.itemsize
                index.append({"doc_id": doc, "offset": len(payload), "length": len(frame), "n_tokens": n, "start": start})
                payload += frame
                start += n
                if len(payload) >= BLOCK_BYTES:
                    yield made()
                    payload, index, block = bytearray(), [], block + 1
        if index:
            yield made()

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = text.select("doc_id", "text", shard_of(text, 4 * partitions(spark)).alias("shard"))
    sorted_in = shards.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    sorted_in.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    return digest


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str]:
    """The blocks, the dictionary's bytes and its sha256; ValueError if they don't belong together."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    body = bytes(row["body"])
    if hashlib.sha256(body).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary at {path} is damaged")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), body, row["sha256"]


def read(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and
    with `wide` ids (array<int>), from the files alone."""
    import zstandard

    prepare(spark)
    blocks, body, digest = open_store(spark, path)
    last = F.element_at("index", -1)
    sizes = blocks.select("shard", (last["start"] + last["n_tokens"]).alias("upto"))
    bases, total = {}, 0
    # A row for each shard, of which there are four times the writer's shuffle partitions at most.
    for r in sorted(sizes.groupBy("shard").agg(F.max("upto").alias("n")).collect(), key=lambda r: r["shard"]):
        bases[r["shard"]] = total
        total += r["n"]
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4

    def opened(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
        for batch in source:
            for r in batch.to_pylist():
                if r["dict_sha256"] != digest:
                    raise ValueError("a block was written with another dictionary")
                rows, arrays, whole = [], [], memoryview(r["payload"])
                for x in r["index"]:
                    raw = unpress.decompress(whole[x["offset"] : x["offset"] + x["length"]])
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * x["n_tokens"] else "<u4").astype("<u4")
                    rows.append((x["doc_id"], bases[r["shard"]] + x["start"], len(ids), zlib.crc32(ids.tobytes())))
                    if wide:
                        arrays.append(ids.astype(np.int32))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(arrays, pa.list_(pa.int32()))] if wide else [])], names=[*names, *(["ids"] if wide else [])])

    return blocks.mapInArrow(opened, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * wide)


def read_one(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id: only their frames are decompressed."""
    import zstandard

    blocks, body, _ = open_store(spark, path)
    found = blocks.select("payload", F.explode("index").alias("x")).filter(F.col("x.doc_id") == doc_id)
    frames = found.select(F.expr("substring(payload, cast(x.offset + 1 as int), cast(x.length as int))").alias("frame"), "x.n_tokens").collect()
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    return [np.frombuffer(raw := unpress.decompress(bytes(r["frame"])), "<u2" if len(raw) == 2 * r["n_tokens"] else "<u4").tolist() for r in frames]
