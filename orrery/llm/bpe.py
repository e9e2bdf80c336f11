"""Byte-level BPE encoding and decoding.

A text is cut into overlapping chunks, each chunk is pre-tokenised on its own, and neighbours are
stitched at the first pre-token boundary that both have inside their overlap: from a common boundary
on the two agree, since the pattern never looks back. Chunks of huge texts are rows of their own and read
in parallel. The pieces are then merged one by one, with repeated pieces looked up. Decoding concatenates the tokens' raw bytes.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows and null
ids are rows like others; extra columns are kept by `encode`, and those named like its own outputs
are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, durable, only, partitions, prepare, record

STEP, OVERLAP = 1 << 13, 256
#: Characters before a chunk's end whose boundaries may depend on what follows: the longest
#: alternative of the pattern with a fixed length has three characters.
GUARD = 4
MOST_CACHED = 250_000
#: Characters from which on a text's chunks are rows of their own, and of such a chunk.
HUGE, PART = 1 << 16, 1 << 15


class Encoder:
    """Ranks, a pattern, and what repeated pieces encode to."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).finditer
        self.merged = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, tuple[list[int], str]] = {}

    def ends(self, text: str, first: int, last: int) -> list[int]:
        """Where the pre-tokens of text[first:last] end, each read on its own from `first` on."""
        return [m.end() + first for m in self.split(text[first:last])]

    def boundaries(self, text: str, step: int = STEP, overlap: int = OVERLAP) -> list[int]:
        """Where the text's pre-tokens end, from chunks of step + overlap characters."""
        n = len(text)
        if n <= step + overlap:
            return self.ends(text, 0, n)
        starts = range(0, max(1, n - overlap), step)
        chunks = [self.ends(text, at, min(n, at + step + overlap)) for at in starts]
        return self.stitch(text, list(starts), chunks, step + overlap)

    def stitch(self, text: str, starts: list[int], chunks: list[list[int]], width: int) -> list[int]:
        n, out, at = len(text), chunks[0], 1
        reach = min(n, starts[0] + width)
        while at < len(chunks):
            start, nxt = starts[at], chunks[at]
            sure = reach - GUARD
            mine = {p for p in out[-(width + 8) :] if start < p <= sure}
            meet = next((p for p in nxt if p in mine), None)
            if meet is None:
                # No boundary in common: one run goes across. Read on from the last sure boundary.
                while out and out[-1] > sure:
                    out.pop()
                reach = min(n, starts[at] + width)
                out += self.ends(text, out[-1] if out else 0, reach)
            else:
                while out[-1] > meet:
                    out.pop()
                out += nxt[nxt.index(meet) + 1 :]
                reach = min(n, start + width)
            at += 1
        return out

    def pieces(self, text: str) -> Iterator[str]:
        begin = 0
        for end in self.boundaries(text):
            yield text[begin:end]
            begin = end

    def piece(self, piece: str) -> tuple[list[int], str]:
        found = self.known.get(piece)
        if found is None:
            ids = self.merged(piece.encode("utf-8", "surrogatepass"))
            found = ids, ",".join(map(str, ids))
            if len(self.known) >= MOST_CACHED:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.piece(p)[0]]

    def encode_written(self, text: str) -> tuple[list[int], str]:
        """The ids, and their decimals joined by commas."""
        known, ids, words = self.known.get, [], []
        for p in self.pieces(text):
            own, word = known(p) or self.piece(p)
            ids += own
            words.append(word)
        return ids, ",".join(words)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def encoder(ranks_path: str, pattern: str) -> Encoder:
    return only(("bpe", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))


def per_text(docs: DataFrame, ranks_path: str, pattern: str, outputs: dict[str, str], of: Callable[[Encoder, str], tuple]) -> DataFrame:
    """docs with the named columns that `of` gives for the encoder and a text."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in outputs]
    sent = docs.select(*kept, *(["text"] if "text" not in kept else []))
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in source:
            found = [of(own, t or "") for t in batch["text"].to_pylist()]
            if found:
                columns = [pa.array(c, types[k]) for c, k in zip(zip(*found, strict=True), outputs.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], names=[*kept, *outputs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept] + [f"`{k}` {v}" for k, v in outputs.items()]
    return sent.mapInArrow(run, ", ".join(fields))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs with ids (array<int>) and n_tokens."""

    def of(own: Encoder, text: str) -> tuple:
        ids = own.encode(text)
        return ids, len(ids)

    return per_text(docs, ranks_path, pattern, {"ids": "array<int>", "n_tokens": "long"}, of)


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """rows with `decoded` (binary): the raw bytes of their `ids`; null ids give no bytes."""
    prepare(rows.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "decoded"]
    kept = [c for c in rows.columns if c != "decoded"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in source:
            out = pa.array([own.decode(i or []) for i in batch["ids"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), out], names=[*kept, "decoded"])

    return rows.select(*kept).mapInArrow(run, ", ".join([*fields, "`decoded` binary"]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, huge: int = HUGE, step: int = PART, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256: encodes
    and decodes every text, without writing the ids out. Texts of more than `huge` characters are
    dealt out as chunks of `step`, others go through in one pass."""

    def of(own: Encoder, text: str) -> tuple:
        ids, written = own.encode_written(text)
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    rows, long = docs.select("doc_id", "text"), F.coalesce(F.length("text"), F.lit(0)) > huge
    out = per_text(rows.filter(~long), ranks_path, pattern, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, of).select(*names)
    rows = rows.filter(long)
    return out if rows.isEmpty() else out.unionByName(by_chunks(rows, ranks_path, pattern, step, overlap))


ROW = "row long, doc_id long, no int, start long, chunk string"


def cut(step: int, overlap: int):
    """Overlapping chunks of texts, numbered; row tells texts apart, also where they share an id."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in source:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                row += 1
                starts = range(0, max(1, len(text) - overlap), step)
                for first in range(0, len(starts), 64):
                    part = starts[first : first + 64]
                    columns = [[row] * len(part), [doc] * len(part), range(first, first + len(part)), part, [text[at : at + step + overlap] for at in part]]
                    yield record(["row", "doc_id", "no", "start", "chunk"], columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()])

    return run


def by_chunks(docs: DataFrame, ranks_path: str, pattern: str, step: int, overlap: int) -> DataFrame:
    """As round_trip, with the chunks of a text in rows of their own: chunks are read in parallel, and
    neighbours meet at the first boundary that both have in their overlap. Only those boundaries are
    gathered by text, and in the end the encoded chunks, which stream in order through two digests. A
    text in which neighbours have no boundary in common is put together again and read at once."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut(step, overlap), ROW)
    rows = durable(rows.repartition(n, "row", "no"))

    def edges(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, heads, tails = encoder(ranks_path, pattern), [], []
        for at, chunk in zip(batch["start"].to_pylist(), batch["chunk"].to_pylist(), strict=True):
            ends = [p + at for p in own.ends(chunk, 0, len(chunk))]
            heads.append([p for p in ends if p <= at + overlap])
            tails.append([p for p in ends if at + step < p <= at + len(chunk) - GUARD])
        return pa.RecordBatch.from_arrays([batch["row"], batch["no"], pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["row", "no", "heads", "tails"])

    found = rows.mapInArrow(batches(edges), "row long, no int, heads array<long>, tails array<long>")
    order = Window.partitionBy("row").orderBy("no")
    meets = found.withColumn("next", F.lead("heads").over(order)).select("row", "no", F.col("next").isNotNull().alias("more"), F.array_min(F.array_intersect("tails", "next")).alias("upto"))
    meets = durable(meets.withColumn("since", F.coalesce(F.lag("upto").over(order), F.lit(0).cast("long"))))
    apart = meets.filter("more AND upto IS NULL").select("row").distinct()

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, written, raw = encoder(ranks_path, pattern), [], [], []
        for at, chunk, since, upto in zip(*(batch[c].to_pylist() for c in ("start", "chunk", "since", "upto")), strict=True):
            begin, ids, words = since, [], []
            for end in (p + at for p in own.ends(chunk, 0, len(chunk))):
                if end > begin and (upto is None or end <= upto):
                    piece, word = own.piece(chunk[begin - at : end - at])
                    ids += piece
                    words.append(word)
                    begin = end
            counts.append(len(ids))
            written.append(",".join(words))
            raw.append(own.decode(ids))
        return pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["no"], pa.array(counts, pa.int64()), pa.array(written, pa.string()), pa.array(raw, pa.binary())], names=["row", "doc_id", "no", "n", "written", "raw"])

    def digests(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc, count, ids, raw = None, None, 0, hashlib.sha256(), hashlib.sha256()
        made = lambda: record(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [[doc], [count], [ids.hexdigest()], [raw.hexdigest()]], [pa.int64(), pa.int64(), pa.string(), pa.string()])
        for batch in source:
            for r in batch.to_pylist():
                if r["row"] != now:
                    if now is not None:
                        yield made()
                    now, doc, count, ids, raw = r["row"], r["doc_id"], 0, hashlib.sha256(), hashlib.sha256()
                if r["written"]:
                    ids.update(("," * bool(count) + r["written"]).encode())
                count += r["n"]
                raw.update(r["raw"])
        if now is not None:
            yield made()

    def at_once(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of sorted chunks, whole again."""
        now, doc, parts = None, None, []
        made = lambda: record(["doc_id", "text"], [[doc], ["".join(parts)]], [pa.int64(), pa.string()])
        for batch in source:
            for r in batch.to_pylist():
                if r["row"] != now:
                    if now is not None:
                        yield made()
                    now, doc, parts = r["row"], r["doc_id"], []
                parts.append(r["chunk"] if r["last"] else r["chunk"][:step])
        if now is not None:
            yield made()

    ordered = lambda df: df.repartition(n, "row").sortWithinPartitions("row", "no")
    sound = rows.join(meets, ["row", "no"]).join(apart, "row", "left_anti")
    pieces = sound.mapInArrow(batches(coded), "row long, doc_id long, no int, n long, written string, raw binary")
    result = ordered(pieces).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    whole = ordered(rows.join(meets.select("row", "no", (~F.col("more")).alias("last")), ["row", "no"]).join(apart, "row", "left_semi")).mapInArrow(at_once, "doc_id long, text string")
    return result.unionByName(round_trip(whole, ranks_path, pattern, huge=1 << 62)) if not apart.isEmpty() else result
