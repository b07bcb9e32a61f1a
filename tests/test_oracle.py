"""Registered queries against their SQL twins on the smallest data; CUEMILL_ALL=1 runs every one."""

import os

import oracle
import pytest

from cuemill.catalog import load

SF = "/root/testdata/sf0.001"
QUICK = (
    "clean_text slugify extract_entities length_report display_width split_sentences hook_type content_skeleton parse_counts format_counts age_days explode_words "
    "retained_segments remap_words rhythm pause_edits rhythm_pieces speech_regions smooth_activity match_onset nearest_quiet audit_cut_plan audit_reveals card_layout "
    "top_comments liked_or_fallback parse_comments parse_search match_runs structure_timeline html_gate extract_images emphasis_blocks forbidden_keys qa_cards verify_quotes "
    "range_coverage latest_stage pause_sessions speech_regions_stream sniff_images refine_boundaries benchmark_quotes"
).split()
NAMES = [n for n, q in load().items() if q.sql is not None] if os.environ.get("CUEMILL_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert oracle.compare(spark, con, load()[name], SF) is None


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 150
    assert e.entry(spark).columns[:2] == ["media_id", "unit_id"]
