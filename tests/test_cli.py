"""The command line from files to files."""

import json

import pytest

from paretide.__main__ import main, parser
from paretide.sources import files


@pytest.fixture
def counts(tmp_path):
    rows = [("toy", i, b, n) for i, row in enumerate(((7, 3, 1, 1), (1, 1, 7, 3), (3, 1, 1, 7))) for b, n in zip("ACGT", row, strict=True)]
    (tmp_path / "counts.csv").write_text("matrix_id,pos,base,count\n" + "".join(f"{a},{b},{c},{d}\n" for a, b, c, d in rows))
    (tmp_path / "targets").mkdir()
    (tmp_path / "targets" / "one.fa").write_text(">one\nacg\ntag\n")
    (tmp_path / "targets" / "two.txt").write_text("*ATGTAA\n")
    return tmp_path


def test_designs_are_written_for_each_target_and_sampler(spark, counts):
    (counts / "usage.txt").write_text("".join(f"{a}{b}{c} {0.01 + 0.005 * i}\n" for i, (a, b, c) in enumerate((x, y, z) for x in "ACGU" for y in "ACGU" for z in "ACGU")))
    main(["design", "--counts", str(counts / "counts.csv"), "--motif", "toy", "--targets", str(counts / "targets"), "--usage", str(counts / "usage.txt"), "--budgets", "0,2", "--alphas", "1.0", "--max-ties", "1", "--out", str(counts / "out")], spark)
    for target, n in (("one", 6), ("two", 6)):
        for sampler in ("k_0", "k_2__alpha_1.0"):
            folder = counts / "out" / target / "toy" / sampler
            texts = [p.read_text().strip() for p in folder.glob("*_sequence.txt")]
            found = json.loads(next((folder / "results_metadata").glob("part-*.json")).read_text())
            assert texts and all(len(t) == n for t in texts)
            assert sorted(texts) == sorted(r["sequence"] for r in found["results"])
            assert found["metadata"]["n_solutions"] == len(texts)
    assert all(t.startswith("ATG") for t in [p.read_text() for p in (counts / "out" / "two" / "toy" / "k_0").glob("*_sequence.txt")])


def test_hits_and_traces_are_written(spark, counts):
    main(["scan", "--counts", str(counts / "counts.csv"), "--motif", "toy", "--targets", str(counts / "targets"), "--p-value", "0.25", "--out", str(counts / "hits")], spark)
    found = files.hits(spark, str(counts / "hits")).collect()
    assert found and {r["motif_id"] for r in found} == {"toy"} and all(r["p_value"] <= 0.25 for r in found)
    main(["reduce", "--counts", str(counts / "counts.csv"), "--motif", "toy", "--out", str(counts / "trace")], spark)
    assert files.trace(spark, str(counts / "trace")).count() == 48
    with pytest.raises(SystemExit):
        parser().parse_args(["design"])
