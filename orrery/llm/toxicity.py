"""A toxicity classifier with a counterfactual regulariser.

A logistic model over the distinct words of a text. In labelled texts that mention a group, the
identity term is swapped for others of its kind, and the squared change of the score is part of the
loss, so that the mention itself can't carry the decision and neutral mentions aren't flagged. Terms are given by language
and kind, and words of the sample that stand in the same places as terms of a kind, under both labels, join it.

The model is fitted on a bounded sample: at most FIT_ROWS labelled rows of each class, first in a
hashed order. Texts are scored whole.

Defined results: a null or empty text gets the score of a text without known words; labels that are
null, or whose document has no row, aren't learned from; a document labelled more than once is toxic
if any label says so; without labels of both classes every score is their share of toxic ones, or 0.
Repeated rows and null ids are rows like others. Extra columns are kept by `score`; score and
predicted replace columns so named.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bucket_of, prepare, record

FIT_ROWS = 4000
#: A word is a feature if so many sampled texts have it.
LEAST_TEXTS = 4
#: and its share of toxic texts is so many standard deviations from that of all.
LEAST_Z = 3.0
SWAPS, SWAP_PENALTY, RIDGE = 3, 1.0, 2e-4
TOKEN = re.compile(r"[^\W\d_]+")
#: Identity terms by language and kind; a term is swapped for others of its kind. Fixed values.
BY_LANGUAGE = {
    "en": (
        ("women", "men", "girls", "boys", "nonbinary", "transgender"),
        ("woman", "man", "girl", "boy"),
        ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
        ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab"),
        ("americans", "mexicans", "chinese", "indians", "germans", "russians", "turks", "poles"),
        ("immigrants", "refugees", "natives", "foreigners", "citizens", "migrants"),
        ("disabled", "deaf", "blind", "autistic", "elderly", "young", "old"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
        ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
        ("einwanderer", "flüchtlinge", "einheimische", "ausländer", "migranten"),
        ("amerikaner", "türken", "russen", "polen", "chinesen", "inder", "araber"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
        ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
        ("immigrés", "réfugiés", "étrangers", "citoyens", "migrants"),
        ("américains", "turcs", "russes", "polonais", "chinois", "indiens", "arabes"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
        ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
        ("inmigrantes", "refugiados", "extranjeros", "ciudadanos", "migrantes"),
        ("americanos", "turcos", "rusos", "polacos", "chinos", "indios", "árabes"),
    ),
}
Terms = Sequence[Sequence[str]]
IDENTITY: Terms = tuple(kind for kinds in BY_LANGUAGE.values() for kind in kinds)
#: A word joins a kind if it stands where terms of that kind do, between the same two words, at so many different places
#: and under both labels. Places that are looked at, at most, and words that join a kind.
LEAST_PLACES, PLACES, MOST_JOINING = 3, 5000, 32


def tokens(text: str | None) -> set[str]:
    """Distinct words, in lower case."""
    return set(TOKEN.findall(" ".join(set((text or "").lower().split()))))


def swapped(own: set[str], seed: str, terms: Terms = IDENTITY) -> list[set[str]]:
    """Counterfactuals of a text: its identity terms swapped, SWAPS times; none if it has none."""
    mentioned = [(t, kind) for kind in terms for t in kind if t in own]
    if not mentioned:
        return []
    pick = random.Random(seed)
    return [(own - {t for t, _ in mentioned}) | {pick.choice([x for x in kind if x != t]) for t, kind in mentioned} for _ in range(SWAPS)]


class Rows:
    """Sets of feature numbers as one flat array."""

    def __init__(self, sets: Sequence[Sequence[int]]) -> None:
        self.n = len(sets)
        self.owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.index = np.array([i for s in sets for i in s], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.index], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, r[self.owner], width)


def fit(texts: Sequence[tuple[str, set[str], int]], terms: Terms = IDENTITY, rounds: int = 300, rate: float = 0.1) -> dict:
    """{bias, weights, swapped} from (seed, tokens, label); swapped: how many texts mention a group, and had their terms
    swapped. Classes weigh alike; Adam over all rows at once."""
    labels = np.array([y for *_, y in texts], float)
    if not len(labels) or labels.min() == labels.max():
        return {"bias": 40.0 * (float(labels.mean()) * 2 - 1) if len(labels) else -40.0, "weights": {}, "swapped": 0}
    counts = Counter(w for _, own, _ in texts for w in own)
    toxic = Counter(w for _, own, y in texts for w in own if y)
    toxic_share = labels.mean()
    names = sorted({w for w, n in counts.items() if n >= LEAST_TEXTS and abs(toxic[w] - n * toxic_share) >= LEAST_Z * (n * toxic_share * (1 - toxic_share)) ** 0.5} | {t for kind in terms for t in kind})
    number = {w: i for i, w in enumerate(names)}
    sets = lambda many: [sorted(number[w] for w in own if w in number) for own in many]
    changed = [(own, swapped(own, seed, terms)) for seed, own, _ in texts]
    pairs = [(own, other) for own, others in changed for other in others]
    rows, left, right = Rows(sets([own for _, own, _ in texts])), Rows(sets([a for a, _ in pairs])), Rows(sets([b for _, b in pairs]))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    width = len(names)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(rows.dot(w) + b, -40, 40)))
        r = share * (p - labels)
        slope = rows.back(r, width) + RIDGE * w
        if pairs:
            gap = (left.dot(w) - right.dot(w)) * (2 * SWAP_PENALTY / len(pairs))
            slope += left.back(gap, width) - right.back(gap, width)
        slope = np.append(slope, r.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {"bias": float(b), "weights": {x: float(y) for x, y in zip(names, w, strict=True) if abs(y) > 1e-4}, "swapped": sum(bool(others) for _, others in changed)}


def sampled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, toxic, text: the bounded, deterministic sample of labelled rows; learn: a condition on doc_id."""
    prepare(docs.sparkSession)
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        ids = own if ids is None else ids.unionByName(own)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(ids), "doc_id")
    # An id that many rows share counts with its different texts, and within the same bound.
    found = found.groupBy("doc_id", "toxic", "t").agg(F.first("text").alias("text"))
    rows = None
    for label in (0, 1):
        own = found.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(FIT_ROWS)
        rows = own if rows is None else rows.unionByName(own)
    return rows.select("doc_id", "toxic", "text")


def places(text: str | None) -> Iterator[tuple[str, str]]:
    """(word, place): each word between two others, and these."""
    words = TOKEN.findall((text or "").lower())
    return ((b, f"{a} {c}") for a, b, c in zip(words, words[1:], words[2:], strict=False))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, terms: Terms = IDENTITY) -> tuple[list[tuple[str, set[str], int]], Terms]:
    """(seed, tokens, label) of the sample, and the terms with the words of the sample that stand where they do."""
    rows = sampled(docs, labels, learn)
    kind_of = {t: i for i, kind in enumerate(terms) for t in kind}

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        held = [sorted({f"{kind_of[w]} {at}" for w, at in places(t) if w in kind_of}) for t in texts]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"].cast(pa.int32()), pa.array([" ".join(sorted(tokens(t))) for t in texts], pa.string()), pa.array([h[:PLACES] for h in held], pa.list_(pa.string()))], names=["doc_id", "toxic", "words", "places"])

    found = rows.mapInArrow(batches(read), "doc_id long, toxic int, words string, places array<string>").collect()
    counts = Counter(p for r in found for p in r["places"])
    known = {p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PLACES]}
    # One object for each different word, and no row longer than it is needed: the driver holds thousands of texts' words.
    texts = []
    while found:
        r = found.pop()
        texts.append((str(r["doc_id"]), set(map(sys.intern, r["words"].split())), r["toxic"]))
    texts.sort()
    return texts, joined(rows, terms, known) if known else terms


def joined(rows: DataFrame, terms: Terms, known: set[str]) -> Terms:
    """The terms with the words that share their places. known: places of terms, with the kind's number before each."""
    given, by_place = {t for kind in terms for t in kind}, {}
    for p in known:
        kind, at = p.split(" ", 1)
        by_place.setdefault(at, []).append(int(kind))

    def filling(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {(kind, w, at, y) for t, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True) for w, at in places(t) if at in by_place and w not in given for kind in by_place[at]}
        return record(["kind", "word", "place", "toxic"], list(zip(*sorted(out), strict=True)) or [[]] * 4, [pa.int32(), pa.string(), pa.string(), pa.int32()])

    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(batches(filling), "kind int, word string, place string, toxic int")
    found = found.groupBy("kind", "word").agg(F.countDistinct("place").alias("places"), F.countDistinct("toxic").alias("labels")).filter((F.col("places") >= LEAST_PLACES) & (F.col("labels") == 2))
    order = Window.partitionBy("kind").orderBy(F.desc("places"), "word")
    new = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_JOINING).collect()
    return tuple((*kind, *sorted(r["word"] for r in new if r["kind"] == i)) for i, kind in enumerate(terms))


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> list[tuple[str, set[str], int]]:
    """(seed, tokens, label) of the sample."""
    return learned(docs, labels, learn)[0]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0)."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    weights, bias = model["weights"], model["bias"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            z = np.array([bias + sum(weights.get(w, 0.0) for w in sorted(tokens(t) & weights.keys())) for t in batch["text"].to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def held_out(key: Column) -> Column:
    return bucket_of(key, 5) == 0
