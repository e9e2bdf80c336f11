"""Language identification by cross-parsing.

For each language a suffix automaton holds the substrings of a labelled sample. A text is parsed
greedily into the longest phrases that occur in the sample; with c phrases over n symbols and a
sample of N symbols, c * log2(N) / n estimates the bits a symbol costs in that language, and the
language with the fewest wins.

Every letter of the samples has a symbol of its own. Automata are transition tables, dense for the
commonest letters of a language and sorted for its others, and many stretches of text walk them in step, one numpy call
for a symbol of all of them. Every text is read whole, in stretches of STRETCH symbols, at whose ends a phrase ends too.

The sample is bounded: for each language, the first SAMPLE_DOCS labelled texts in a hashed order that
have at most SAMPLE_CHARS characters, until SAMPLE_SYMBOLS are reached. Where a language has none so
short, the first SAMPLE_CHARS characters of its longer texts, from their first letter on. At most LANGUAGES are
learned, and ALL_SYMBOLS bounds all samples together, and with them what the driver and each Python worker hold.

Defined results: a null text or one without a letter is `und` with score 0; so is any text when
nothing could be learned. Rows with a null lang aren't learned from. Repeated rows and null ids are
rows like others. Extra columns are kept by `identify`; lang_pred and score replace columns so named.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, only, prepare

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS = 64, 20_000, 1 << 16
#: Languages that are learned, those with the most labelled rows, and symbols of all of them together: up to 32 have
#: SAMPLE_SYMBOLS each, more share. An automaton takes about 160 bytes a symbol, in whatever alphabet.
LANGUAGES, ALL_SYMBOLS = 512, 1 << 21
#: Symbols of a language with a column of their own in its dense table, the commonest of its sample.
LETTERS = 61
STRETCH = 512
BLANK, OTHER = 0, 1
UNDETERMINED = "und"

Samples = tuple[tuple[str, str], ...]


def samples(docs: DataFrame, learn: Column) -> Samples:
    """(lang, text) of the bounded sample, in the order of lang."""
    prepare(docs.sparkSession)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"\p{L}")).withColumn("long", F.length("text") > SAMPLE_CHARS)
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id")]
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    most = quota(len(counts))
    named = docs.sparkSession.createDataFrame([(r["lang"],) for r in counts], "lang string")
    # Ids first, so that the sort carries no texts; then the texts of the few that reach the bound.
    ids = rows.select("lang", "doc_id", "long", order[0].alias("h"), F.least(F.length("text"), F.lit(SAMPLE_CHARS)).alias("size")).join(F.broadcast(named), "lang")
    own = Window.partitionBy("lang").orderBy("long", "h", "doc_id")
    ids = ids.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= SAMPLE_DOCS)
    ids = ids.withColumn("before", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = ids.filter(F.col("before") < most).collect()
    short = {r["lang"] for r in first if not r["long"]}
    picked = {(r["lang"], r["h"]): r["n"] for r in first if not r["long"] or r["lang"] not in short}
    hashes = docs.sparkSession.createDataFrame([(h,) for h in {h for _, h in picked}], "h long")
    found = rows.select("lang", F.when(F.col("long"), F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, SAMPLE_CHARS)).otherwise(F.col("text")).alias("text"), order[0].alias("h")).join(F.broadcast(hashes), "h").dropDuplicates(["lang", "h"]).collect()
    found.sort(key=lambda r: (r["lang"], picked.get((r["lang"], r["h"]), math.inf)))
    out: dict[str, str] = {}
    for r in found:
        if (r["lang"], r["h"]) in picked and len(out.get(r["lang"], "")) < most:
            out[r["lang"]] = f"{out.get(r['lang'], '')} {r['text']}"[: most + SAMPLE_CHARS]
    return tuple(sorted(out.items()))


def quota(languages: int) -> int:
    """Symbols of each language's sample."""
    return min(SAMPLE_SYMBOLS, ALL_SYMBOLS // max(1, languages))


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Of the automaton of all substrings, by state: 1 is the start, 0 isn't used."""
    after, link, length = [{}, {}], [0, 0], [0, 0]
    last = 1
    for c in symbols:
        state = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in after[p]:
            after[p][c] = state
            p = link[p]
        if p:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[state] = twin
                while p and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
        last = state
    return after


def triples(after: list[dict[int, int]]) -> np.ndarray:
    """(state, symbol, next state), a column each."""
    return np.array([(i, c, to) for i, own in enumerate(after) for c, to in own.items()], np.int64).reshape(-1, 3).T


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of all substrings: row 1 is the start, 0 means none."""
    after = transitions(symbols)
    table = np.zeros((len(after), width), np.int32)
    state, c, to = triples(after)
    table[state, c] = to
    return table


class Automaton:
    """Transitions of one sample. A state is its number times the width of the dense table; column 0
    of that table is for symbols that the sample doesn't have."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        found, counts = np.unique(symbols, return_counts=True)
        found = found[np.lexsort((found, -counts))]
        self.column = np.zeros(n_symbols, np.int32)
        self.column[found] = np.arange(1, len(found) + 1)
        self.width, self.every = min(len(found), LETTERS + 2) + 1, len(found) + 1
        after = transitions(self.column[symbols].tolist())
        state, c, to = triples(after)
        to *= self.width
        dense = c < self.width
        self.table = np.zeros(len(after) * self.width, np.int32)
        self.table[state[dense] * self.width + c[dense]] = to[dense]
        self.start = np.full(self.every, self.width, np.int32)
        self.start[c[state == 1]] = to[state == 1]
        keys = state[~dense] * self.every + c[~dense]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[~dense][order].astype(np.int32)

    def step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended."""
        c = self.column.take(symbols)
        if len(self.keys):
            far = np.flatnonzero(c >= self.width)
            near = state + c
            near[far] = 0
            to = self.table.take(near)
            wanted = state[far].astype(np.int64) // self.width * self.every + c[far]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            to[far] = np.where(self.keys[at] == wanted, self.to[at], 0)
        else:
            to = self.table.take(state + c)
        none = to == 0
        return np.where(none, self.start.take(c), to), none


class Parser:
    def __init__(self, learned: Samples) -> None:
        self.langs = [lang for lang, _ in learned]
        letters = sorted({c for _, text in learned for c in text.lower() if c.isalpha()})
        self.symbol = np.zeros(0x110000, np.uint16 if len(letters) + 2 < 1 << 16 else np.int32)
        self.symbol[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = OTHER
        for k, c in enumerate(letters):
            self.symbol[ord(c)] = k + 2
        self.automata, self.cost = [], []
        for _, text in learned:
            own = self.read(text)[: quota(len(learned))]
            self.automata.append(Automaton(own, len(letters) + 2))
            self.cost.append(math.log2(len(own) + 2))

    def read(self, text: str) -> np.ndarray:
        """Symbols of a text: letters, with a single blank for what stands between words."""
        own = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        own = own[(own != BLANK) | np.concatenate(([False], own[:-1] != BLANK))] if len(own) else own
        return own

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol of each text in each language, and its number of letters."""
        read = [self.read(t) for t in texts]
        letters = np.array([int(np.count_nonzero(r)) for r in read], np.int64)
        lanes = [(i, r[at : at + STRETCH]) for i, r in enumerate(read) for at in range(0, len(r), STRETCH)]
        # A phrase ends where a stretch does: each stretch opens one of its own.
        phrases = np.zeros((len(texts), len(self.langs)))
        if lanes:
            lanes.sort(key=lambda x: -len(x[1]))
            sizes = np.array([len(r) for _, r in lanes])
            steps = np.zeros((sizes[0], len(lanes)), self.symbol.dtype)
            for k, (_, r) in enumerate(lanes):
                steps[: len(r), k] = r
            open_at = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            owner = np.array([i for i, _ in lanes])
            for j, automaton in enumerate(self.automata):
                state, missed = np.full(len(lanes), automaton.width, np.int32), np.zeros(len(lanes), np.int32)
                for step, n in zip(steps, open_at, strict=True):
                    state[:n], none = automaton.step(state[:n], step[:n])
                    missed[:n] += none
                np.add.at(phrases[:, j], owner, missed + 1)
        n = np.maximum(1, np.array([len(r) for r in read]))[:, None]
        return phrases * np.array(self.cost) / n, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        bits, letters = self.bits(texts)
        out = []
        for own, n in zip(bits, letters.tolist(), strict=True):
            if not n:
                out.append((UNDETERMINED, 0.0))
                continue
            best = int(own.argmin())
            others = np.delete(own, best)
            out.append((self.langs[best], float(1 - own[best] / others.min()) if len(others) and others.min() > 0 else 1.0))
        return out


def parser(learned: Samples) -> Parser:
    return only(("language", learned), lambda: Parser(learned))


def identify(docs: DataFrame, learned: Samples) -> DataFrame:
    """docs with lang_pred and score: by how much the best language undercuts the second, 0 to 1."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(learned)
        for batch in source:
            if batch.num_rows:
                langs, scores = zip(*own.predict([t or "" for t in batch["text"].to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(key: Column) -> Column:
    return bucket_of(key, 4) == 2
