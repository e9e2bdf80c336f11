"""Look-ups in a catalogue of (id, type, style, import, use_when, preserves)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "type", "style", "import")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("use_when", "preserves")])


def find(catalog: DataFrame, style: str | None = None, purpose: str | None = None, type: str | None = None) -> DataFrame:  # noqa: A002
    """Entries that meet all that is asked for; a purpose is one whole element of use_when."""
    asked = [(F.col("style") == style, style), (F.array_contains("use_when", purpose or ""), purpose), (F.col("type") == type, type)]
    for condition, given in asked:
        if given is not None:
            catalog = catalog.filter(condition)
    return catalog


def answers(catalog: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question (style, purpose, type, null where nothing is asked) with each entry that meets it, as `find` does.

    A catalogue is authored and small, and goes to the questions. Those with a purpose meet entries by it, the others
    by their style; what names neither is left out, since it asks for the whole catalogue."""
    own = catalog.select(*(F.col(c).alias(f"__{c}") for c in ("id", "style", "type", "import", "use_when")))
    by_purpose = questions.filter("purpose IS NOT NULL").join(F.broadcast(own.withColumn("__use", F.explode(F.array_distinct("__use_when")))), F.col("purpose") == F.col("__use")).drop("__use")
    by_style = questions.filter("purpose IS NULL AND style IS NOT NULL").join(F.broadcast(own), F.col("style") == F.col("__style"))
    both = by_purpose.filter(F.col("style").isNull() | (F.col("style") == F.col("__style"))).unionByName(by_style)
    both = both.filter(F.col("type").isNull() | (F.col("type") == F.col("__type")))
    return both.select(*questions.columns, F.col("__id").alias("id"), F.col("__import").alias("import"), F.col("__use_when").alias("use_when"))


def expand_family(families: DataFrame, prefix: str) -> DataFrame:
    """Entries of families (style, entries: array<struct<id, type, path, use_when, preserves>>), each
    with the import path below the prefix."""
    one = families.select("style", F.explode("entries").alias("e"))
    return one.select("e.id", "e.type", "style", F.concat(F.lit(prefix), F.lit("/"), F.col("e.path")).alias("import"), "e.use_when", "e.preserves")


def problems(catalog: DataFrame) -> DataFrame:
    """id and rule of entries that break the catalogue's rules."""
    twice = catalog.groupBy("id").count().filter("count > 1").select("id", F.lit("id_repeats").alias("rule"))
    kind = catalog.filter(~F.coalesce(F.col("type").isin("unit", "behaviour"), F.lit(False))).select("id", F.lit("type").alias("rule"))
    few = catalog.filter(F.coalesce(F.size("preserves"), F.lit(0)) < 2).select("id", F.lit("preserves").alias("rule"))
    return twice.unionByName(kind).unionByName(few)


def unresolved(catalog: DataFrame, kinds: DataFrame) -> DataFrame:
    """Ids without a kind of that name."""
    return catalog.select("id").join(kinds.select(F.col("kind").alias("id")), "id", "left_anti")


def listing(catalog: DataFrame, order: Sequence[Column | str], row: Column | None = None, page: int = 100) -> DataFrame:
    """style, page (from 0) and text: the entries of each style as lines of text, in order, `page` of them in a row, so
    that no row grows with the table."""
    line = row if row is not None else F.concat_ws(" | ", "id", F.array_join("use_when", ", "), F.array_join("preserves", ", "))
    place = F.row_number().over(Window.partitionBy("style").orderBy(*order)) - 1
    lines = catalog.withColumn("line", line).select("style", place.alias("place"), "line").withColumn("page", F.floor(F.col("place") / page).cast("int"))
    entries = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("style", "page").agg(F.array_join(F.transform(entries, lambda e: e["line"]), "\n").alias("text"))


def kept_by_laws() -> dict[str, list[str]]:
    """What each law keeps, by kind: its roles, its channels, and what these follow."""
    from ..laws import catalogue as laws
    from ..laws import flash, impact, panels  # noqa: F401
    from ..laws.terms import ARGUMENTS

    found: dict[str, tuple[set[str], set[str], set[str]]] = {}
    for name, channels in laws.LAWS.items():
        kind, _, role = name.partition("/")
        roles, kept, follows = found.setdefault(kind, (set(), set(), set()))
        own = channels()
        roles |= {role} - {""}
        kept |= set(own)
        # Terms without SQL are springs and curves of the frame.
        follows |= {"frame"} | {x for t in own.values() if t.sql for x in ("fps", "duration", *ARGUMENTS) if re.search(rf"\b{x}\b", t.sql)}
    return {k: [f"role {r}" for r in sorted(roles)] + [f"channel {c}" for c in sorted(kept)] + [f"follows {x}" for x in sorted(follows)] for k, (roles, kept, follows) in found.items()}


def kept_by_units() -> dict[str, list[str]]:
    """What each kind of unit keeps: its base, and in builders' scenes its parts, its laws, and what it is a part of."""
    from ..sources.builders import builders

    out = {kind: [f"is a {base}"] for base, _, own in (x.partition(": ") for x in lines("kinds.txt")) for kind in own.split(", ")}
    for made in builders().values():
        kinds = {"self": made.kind} | {p["role"]: p["kind"] for p in made.parts}
        for part in made.parts:
            out.setdefault(made.kind, []).append(f"part {part['role']}")
            out.setdefault(part["kind"], []).append(f"part of {kinds[part['parent'] or 'self']}")
        for role, law in made.laws:
            out.setdefault(kinds[role], []).append(f"moved by {law.partition('/')[0]}")
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


def entries(spark: SparkSession, prefix: str = "") -> DataFrame:
    """The catalogue of units and behaviours, with `place`, its order; imports are below the prefix."""
    rows, of_laws, of_units = [], kept_by_laws(), kept_by_units()
    for line in lines("catalogue.txt"):
        name, kind, use = (x.strip() for x in line.split("|"))
        type_, style, own = name.split(".", 2)
        keep = [f"style {style}", *(of_laws if type_ == "behaviour" else of_units).get(f"{style}.{own}", [])]
        rows.append((len(rows), name, type_, style, "/".join(x for x in (prefix, f"{type_}s", style, kind) if x), use.split("; "), keep))
    return spark.createDataFrame(rows, T.StructType([T.StructField("place", T.IntegerType()), *SCHEMA.fields]))


def is_unit(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"\Aunit\.[a-z0-9.-]+\z"), F.lit(False))


def is_behaviour(kind: Column) -> Column:
    return F.coalesce(kind.rlike(r"\Abehaviour\.[a-z0-9.-]+\z"), F.lit(False))


def prompt(catalog: DataFrame, instructions: str, placeholder: str = "{catalog}") -> DataFrame:
    """One row, text: instructions with the catalogue in place of the placeholder, an entry a line, in order.
    A catalogue is authored, so that its listing fits a row."""
    line = F.concat_ws(" | ", "id", "import", "style", F.concat(F.lit("use: "), F.array_join("use_when", "; ")), F.concat(F.lit("preserves: "), F.array_join("preserves", "; ")))
    whole = catalog.agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("all"))
    return whole.select(F.replace(F.lit(instructions), F.lit(placeholder), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("text"))


def lines(name: str) -> list[str]:
    return [x for x in Path(__file__).with_name(name).read_text().splitlines() if x and not x.startswith("#")]


def kinds(spark: SparkSession) -> DataFrame:
    """kind and base of every unit, and of every law (base `behaviour`)."""
    from ..laws import catalogue as laws
    from ..laws import flash, impact, panels  # noqa: F401

    rows = [(f"unit.{kind}", f"unit.{base}" if base != "unit" else base) for base, _, own in (x.partition(": ") for x in lines("kinds.txt")) for kind in own.split(", ")]
    rows += [(f"behaviour.{k}", "behaviour") for k in sorted({name.partition("/")[0] for name in laws.LAWS})]
    return spark.createDataFrame(rows, "kind string, base string")


def is_a(kinds: DataFrame, base: str) -> DataFrame:
    """kind of all that derives from a base, whatever stands between; the depth of bases is authored."""
    found, level = None, kinds.filter(F.col("base") == base).select("kind")
    while not level.isEmpty():
        found = level if found is None else found.unionByName(level)
        level = kinds.join(level.withColumnRenamed("kind", "base"), "base").select("kind")
    return kinds.select("kind").limit(0) if found is None else found


def of_laws(spark: SparkSession) -> DataFrame:
    """The laws of this library as a catalogue: one entry for each, with its roles as what it is for."""
    rows = []
    for k, keep in sorted(kept_by_laws().items()):
        rows.append((f"behaviour.{k}", "behaviour", k.split(".")[0], f"orrery.laws/{k}", [x.removeprefix("role ") for x in keep if x.startswith("role ")], keep))
    return spark.createDataFrame(rows, SCHEMA)
