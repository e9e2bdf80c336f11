from __future__ import annotations

import os

import pytest

from orrery.catalogue_of_queries import QUERIES
from orrery.plans.inspect import plan

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"
#: Queries whose whole result is one pass over a scan.
NARROW = ["catalog_find", "ms_to_frame", "beat_bucket", "easings", "noises", "mulberry", "exposure_max", "shake_sum", "typing_prefix", "word_reveal", "font_fit", "timecode", "id_validation", "spring_curve", "bezier_ease", "style_transform", "laws_neon_heart_pop"]


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_shuffle_nothing_and_stay_in_the_jvm(spark, name):
    own = plan(QUERIES[name](spark, SF))
    assert own.shuffles == 0 and not own.python and not own.quadratic


@pytest.mark.parametrize("name", ["mount_phase", "shot_local_time", "cue_presence", "as_of_lookup", "rank_pages", "tree_depth", "determinism_drift", "revision_outcome"])
def test_joins_have_keys(spark, name):
    own = plan(QUERIES[name](spark, SF))
    assert not own.quadratic and not own.python


def test_filters_and_columns_reach_the_scan(spark):
    own = plan(QUERIES["catalog_find"](spark, SF))
    assert "EqualTo(lang,en)" in own.pushed and "EqualTo(source,src7)" in own.pushed
    assert own.columns_read == [{"doc_id", "text", "lang", "source"}]
    assert plan(QUERIES["ms_to_frame"](spark, SF)).columns_read == [{"event_id", "value"}]


def test_outcome_takes_one_shuffle(spark):
    assert plan(QUERIES["revision_outcome"](spark, SF)).shuffles == 1
