"""The command line on a small file."""

from quadrille.__main__ import main


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "few.nt"
    path.write_text('<urn:a> <urn:p> <urn:b> .\n<urn:b> <urn:p> <urn:c> .\n')
    queries = ["INSERT DATA { <urn:c> <urn:p> <urn:d> }", "SELECT ?s WHERE { ?s <urn:p> ?o } ORDER BY ?s"]
    assert main(["--file", str(path), "--query", queries[0], "--query", queries[1]], spark) == 0
    assert capsys.readouterr().out.splitlines()[-4:] == ["s", "urn:a", "urn:b", "urn:c"]
    assert main(["--file", str(path), "--query", queries[1], "--output", str(tmp_path / "out")], spark) == 0
    assert [r.s for r in spark.read.parquet(str(tmp_path / "out")).orderBy("s").collect()] == ["urn:a", "urn:b"]
