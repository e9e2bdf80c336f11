from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.laws import extensions


def sway(c):
    return {"x": np.sin(c["frame"] / c["fps"]), "label": np.where(c["frame"] % 2 == 0, "even", "odd")}


def test_a_law_of_ones_own_in_sql(spark):
    name = extensions.register(spark, "mine.sway", sway, {"x": "double", "label": "string"})
    places = spark.range(3000).select("id", F.col("id").cast("double").alias("frame"), F.lit(30.0).alias("fps")).repartition(5)
    places.createOrReplaceTempView("places")
    got = {r["id"]: (r["x"], r["label"]) for r in spark.sql(f"SELECT * FROM {name}(TABLE(SELECT id, frame, fps FROM places))").collect()}
    assert len(got) == 3000 and all(x == pytest.approx(math.sin(i / 30)) and s == ("odd" if i % 2 else "even") for i, (x, s) in got.items())
    assert sorted(map(tuple, extensions.channels(spark, "mine.sway", places).collect())) == sorted((i, *v) for i, v in got.items())
    assert extensions.channels(spark, "mine.sway", places.limit(0)).count() == 0


def test_what_cannot_be_registered(spark):
    with pytest.raises(ValueError, match="no law mine.other"):
        extensions.channels(spark, "mine.other", spark.range(1))
    for kind, gives, match in (("Mine", {"x": "double"}, "no kind"), ("micro-flash.pulse/6", {"x": "double"}, "law of the library"), ("mine.x", {}, "gives channels"), ("mine.x", {"id": "long"}, "gives channels")):
        with pytest.raises(ValueError, match=match):
            extensions.register(spark, kind, sway, gives)
    extensions.register(spark, "mine.short", lambda c: {"x": c["frame"][:1]}, {"x": "double"})
    with pytest.raises(Exception, match="a value for each row"):
        extensions.channels(spark, "mine.short", spark.range(50).select("id", F.lit(1.0).alias("frame"))).collect()
