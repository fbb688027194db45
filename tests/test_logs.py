"""CSV logs of many files."""

from datetime import datetime

import pytest

from conftest import as_set
from fleetspc.schemas import RAW
from fleetspc.sources.logs import headers, read_csv_logs

HEADER = ",".join(RAW.fieldNames())


def row(machine, rpm="7", ts="2024-01-01 10:00:00"):
    return f"{ts},{machine},Pump,normal,1.5,0,2,none,1,2,3,4,{rpm},6"


def files(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_names_decide(spark, tmp_path):
    other = "rpm,machine_id, timestamp ,note\n"
    path = files(
        tmp_path, a=f"{HEADER}\n{row(1)}\n{row(2, '')}\n", b="﻿" + other + '8,3,2024-01-02 00:00:00,"a, b"\n', c=other + "9, 4 ,2024-01-02 00:00:00,\n",
        d=f"{HEADER}\n", e="", _hidden="x\n1\n",
    )
    log, rejected = read_csv_logs(spark, path)
    assert log.schema == RAW and rejected.count() == 0 and len(headers(spark, path)) == 2
    assert as_set(log, "machine_id", "rpm", "machine_type") == [(1, 7.0, "Pump"), (2, None, "Pump"), (3, 8.0, None), (4, 9.0, None)]
    assert log.where("machine_id = 3").first().timestamp == datetime(2024, 1, 2)


def test_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    path = files(
        tmp_path, a=f"{HEADER}\n{row(1)}\n2024-01-01,9\n{row(2)},77\n{row(3, 'fast')}\n{row('one')}\n{row(4, 'NaN')}\n{row(5, ts='soon')}\n",
    )
    log, rejected = read_csv_logs(spark, path)
    assert as_set(log, "machine_id", "rpm") == [(1, 7.0), (4, None)]
    found = as_set(rejected, "reason", "line")
    assert found == sorted([
        ("torn", "2024-01-01,9"), ("torn", f"{row(2)},77"), ("rpm", row(3, "fast")), ("machine_id", row("one")), ("timestamp", row(5, ts="soon")),
    ])
    assert {r.file.rpartition("/")[2] for r in rejected.collect()} == {"a.csv"}


def test_headers_that_cannot_be(spark, tmp_path):
    with pytest.raises(KeyError):
        read_csv_logs(spark, files(tmp_path, a="machine_id,rpm\n1,2\n"))
    with pytest.raises(ValueError, match="twice"):
        read_csv_logs(spark, files(tmp_path, a="timestamp,machine_id,rpm,rpm\n2024-01-01,1,2,3\n"))
    with pytest.raises(FileNotFoundError):
        read_csv_logs(spark, str(tmp_path / "nothing"))
    empty = tmp_path / "empty"
    empty.mkdir()
    log, rejected = read_csv_logs(spark, files(empty, a=""))
    assert log.count() == rejected.count() == 0 and log.schema == RAW
