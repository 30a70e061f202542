"""Folders of files with different headers, and lines that do not parse."""

from __future__ import annotations

import gzip

import pytest

from measurelake.model import ColumnMap
from measurelake.sources import readers

COLUMNS = ColumnMap()
EARLY = "State Name,County Name,Date Local,Arithmetic Mean,AQI,Local Site Name"
LATE = 'AQI,"Arithmetic Mean",Date Local,State Name,Unknown'


@pytest.fixture()
def folder(tmp_path):
    def write(**files):
        for name, lines in files.items():
            at = tmp_path / "in" / name.replace("__", "/")
            at.parent.mkdir(parents=True, exist_ok=True)
            content = "".join(line + "\n" for line in lines).encode()
            if name.endswith("gz"):
                at = at.with_suffix(".csv.gz")
                at.write_bytes(gzip.compress(content))
            else:
                at.with_suffix(".csv").write_bytes(content)
        return str(tmp_path / "in")

    return write


def test_layouts_are_united_by_name(spark, folder):
    path = folder(
        a=[EARLY, "Ohio,Lake,2024-01-02,1.5,7,Site", 'Ohio,Lake,2024-01-03,,,"a, ""b"""'],
        b=["﻿" + LATE, "9,2.5,2024-02-01,Texas,x"], sub__c=[LATE, "8,3.5,2024-02-02,Utah,y"],
        d_gz=[EARLY, "Iowa,Polk,2024-03-01,4.5,1,"], empty=[])
    layouts = readers.csv_layouts(spark, path)
    assert sorted(map(len, layouts.values())) == [2, 2]
    df = readers.read_csv_folder(spark, path, COLUMNS)
    rows = {(r.state_name, str(r.date_local)): r for r in df.collect()}
    assert len(rows) == 5 and df.columns[:3] == ["state_name", "county_name", "date_local"]
    assert rows["Texas", "2024-02-01"].pm25_raw == 2.5 and rows["Texas", "2024-02-01"].site_name is None
    assert rows["Ohio", "2024-01-03"].site_name == 'a, "b"' and rows["Ohio", "2024-01-03"].aqi_raw is None
    assert rows["Iowa", "2024-03-01"].aqi_raw == 1 and "Unknown" not in df.columns


def test_only_the_columns_asked_for_are_read(spark, folder):
    path = folder(a=[EARLY, "Ohio,Lake,2024-01-02,1.5,7,Site"], b=[LATE, "9,2.5,2024-02-01,Texas,x"])
    df = readers.read_csv_folder(spark, path, COLUMNS).where("state_name = 'Texas'").select("pm25_raw")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "County Name" not in text and [r.pm25_raw for r in df.collect()] == [2.5]


def test_files_that_are_none_of_ours(spark, folder):
    path = folder(a=["x,y", "1,2"])
    with pytest.raises(ValueError, match="no known column"):
        readers.read_csv_folder(spark, path, COLUMNS)


def test_a_folder_without_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        readers.read_csv_folder(spark, folder(a=[]), COLUMNS)


def test_bad_lines_neither_abort_nor_vanish(spark, folder):
    good = "Ohio,Lake,2024-01-02,1.5,7,Site"
    bad = ["Ohio,Lake,someday,1.5,7,Site", "Ohio,Lake,2024-01-02,x,y,Site", good + ",more", "Ohio,Lake"]
    path = folder(a=[EARLY, good, *bad, good], b=[LATE, "9,2.5,2024-02-01,Texas,x", "9.5,2.5,2024-02-01,Texas,x"])
    table, rejects = readers.read_csv_checked(spark, path, COLUMNS)
    assert table.count() == 3 and table.select("pm25_raw").count() == 3
    assert sorted(r.pm25_raw for r in table.collect()) == [1.5, 1.5, 2.5]
    found = {r.line: r for r in rejects.collect()}
    assert set(found) == {*bad, "9.5,2.5,2024-02-01,Texas,x"}
    assert [found[b].reason for b in bad] == ["type: Date Local", "type: Arithmetic Mean, AQI", "cells", "cells"]
    assert found["9.5,2.5,2024-02-01,Texas,x"].reason == "type: AQI"
    assert found[bad[0]].file.endswith("a.csv")
    assert set(table.columns) == {"state_name", "county_name", "date_local", "site_name", "pm25_raw", "aqi_raw"}


def test_a_sound_file_rejects_nothing(spark, folder):
    path = folder(a=[EARLY, "Ohio,Lake,2024-01-02,1.5,7,", ",,,,,"])
    table, rejects = readers.read_csv_checked(spark, path, COLUMNS)
    assert table.count() == 2 and rejects.count() == 0
