"""Staged ingest: what is published, what is set apart, and what keeps a target as it was."""

import os

import pytest

from panelrisk.sources import ingest
from panelrisk.sources.spec import Field, TableSpec

SPEC = TableSpec("t", (Field("loan_id", "text"), Field("period", "month"), Field("upb", "double")), ("loan_id", "period"))


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def table(spark, path):
    return sorted((r["loan_id"], r["vintage"], r["quarter"], str(r["upb"])) for r in ingest.read_ingested(spark, path, SPEC).collect())


def test_good_quarters_are_published_and_bad_rows_set_apart(spark, tmp_path):
    raw, target, bad = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "bad")
    write(raw, "perf_1999Q1.txt", ["A|199901|10.5", "A|199902|", "B|199901|x", " |199901|1"])
    write(raw, "perf_1999Q2.txt", ["C|199904|1", "broken", "C|199913|2", "D|199904|3|extra"])
    done = ingest.staged_ingest(spark, f"{raw}/*", SPEC, target, bad, ingest.Limits(bad_share=0.8)).collect()
    assert {(r["vintage"], r["quarter"]): (r["rows"], r["bad_rows"]) for r in done} == {(1999, 1): (3, 1), (1999, 2): (1, 3)}
    assert table(spark, target) == [("A", 1999, 1, "10.5"), ("A", 1999, 1, "None"), ("B", 1999, 1, "None"), ("C", 1999, 2, "1.0")]
    apart = spark.read.parquet(bad).collect()
    assert sorted(r["reason"] for r in apart) == ["key", "key", "width", "width"] and {"broken", "D|199904|3|extra"} <= {r["line"] for r in apart}
    assert sorted(os.listdir(tmp_path)) == ["bad", "out", "raw"]  # no staging folder is left


def test_failure_leaves_the_target_as_it_was(spark, tmp_path):
    raw, target, bad = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "bad")
    write(raw, "perf_2000Q3.txt", ["A|200007|1", "B|200007|2"])
    ingest.staged_ingest(spark, f"{raw}/*", SPEC, target, bad)
    before = [(r["loan_id"], r["upb"]) for r in ingest.read_ingested(spark, target, SPEC).orderBy("loan_id").collect()]
    assert before == [("A", 1.0), ("B", 2.0)] and not os.path.exists(bad)
    cases = {
        "1 bad rows of 2": ["C|200010|1", "short"], "1 keys occur more than once": ["A|200010|1", "A|200010|2"], "no good rows": ["short"],
    }
    for what, lines in cases.items():
        write(raw, "perf_2000Q4.txt", lines)
        with pytest.raises(ingest.IngestError, match=what):
            ingest.staged_ingest(spark, f"{raw}/*", SPEC, target, bad)
        assert [(r["loan_id"], r["upb"]) for r in ingest.read_ingested(spark, target, SPEC).orderBy("loan_id").collect()] == before
        assert sorted(os.listdir(tmp_path)) == ["out", "raw"]
    # a key that a row of another quarter has is found too
    write(raw, "perf_2000Q4.txt", ["A|200007|9"])
    with pytest.raises(ingest.IngestError, match="1 keys"):
        ingest.staged_ingest(spark, f"{raw}/*", SPEC, target, bad)
    # and good files replace the whole target
    write(raw, "perf_2000Q4.txt", ["E|200010|9"])
    ingest.staged_ingest(spark, f"{raw}/*", SPEC, target, bad)
    assert {r["loan_id"] for r in ingest.read_ingested(spark, target, SPEC).collect()} == {"A", "B", "E"}


def test_files_without_a_period_in_their_name(spark, tmp_path):
    write(str(tmp_path / "raw"), "perf.txt", ["A|200007|1"])
    with pytest.raises(ingest.IngestError, match="bad rows"):
        ingest.staged_ingest(spark, f"{tmp_path}/raw/*", SPEC, str(tmp_path / "out"), str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "out")
