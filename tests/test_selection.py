"""Catalogue look-ups and freshness."""

from datetime import datetime

from riffle import dims
from riffle.functions import times
from riffle.operators import selection
from riffle.plans import fixed_values as fixed


def test_section_names_and_lookup(spark):
    names = {r.section_name for r in selection.section_names(dims.sections(spark)).collect()}
    assert len(names) == 27 and "Kelly's Whitewater Park" in names
    record = selection.section_lookup(dims.sections(spark), "Kelly's Whitewater Park").collect()
    assert [r.section_id for r in record] == [27]
    assert selection.section_lookup(dims.sections(spark), "Nowhere").count() == 0


def test_links_and_videos(spark):
    rows = selection.section_links(dims.sections(spark)).collect()
    by_kind = {kind: sum(r.kind == kind for r in rows) for kind in ("link", "video")}
    assert by_kind == {kind: sum(len(s[i] or ()) for s in fixed.SECTIONS) for kind, i in (("link", 13), ("video", 14))}
    assert {r.section_id for r in rows} == {s[0] for s in fixed.SECTIONS if s[13] or s[14]}


def test_freshness_counts_seconds(spark):
    times_of_run = [datetime(2026, 4, 1, 10), datetime(2026, 4, 1, 9, 59, 59), datetime(2026, 4, 1, 12), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times_of_run)], "i int, t timestamp_ntz")
    fresh = selection.is_fresh(df.t, times.ntz(datetime(2026, 4, 1, 11)), 60)
    assert [r.f for r in df.select("i", fresh.alias("f")).orderBy("i").collect()] == [True, False, True, None]
