from tidewright.operators import analysis
from tidewright.sources.scripts import read_scripts, stream_scripts
from tidewright.streaming.analysis import write_diagnostics


def write(folder, **scripts):
    for name, sql in scripts.items():
        (folder / f"{name}.sql").write_text(sql)
    return str(folder)


def test_folder_of_scripts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep", b="SELECT 1;\nSELECT 2")
    folder = write(tmp_path, a="DELETE FROM T")
    (tmp_path / "notes.txt").write_text("DELETE FROM T")
    found = {r.script_id.rsplit("/", 1)[1]: r.sql for r in read_scripts(spark, folder).collect()}
    assert found == {"a.sql": "DELETE FROM T", "b.sql": "SELECT 1;\nSELECT 2"}


def test_stream_gives_the_diagnostics_of_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder, out, at = write(tmp_path / "in", a="DELETE FROM T", b="SELECT * FROM T"), str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        write_diagnostics(stream_scripts(spark, folder, files_per_batch=1), out, at).awaitTermination()
        return sorted((r.script_id.rsplit("/", 1)[1], r.code) for r in spark.read.parquet(out).collect())

    assert run() == [("a.sql", "DML002"), ("b.sql", "SEL001")]
    write(tmp_path / "in", c="PRINT @x")
    assert run() == [("a.sql", "DML002"), ("b.sql", "SEL001"), ("c.sql", "VAR001")]  # earlier files are not read again
    whole = analysis.diagnostics(analysis.nodes(read_scripts(spark, folder)))
    assert sorted((r.script_id.rsplit("/", 1)[1], r.code) for r in whole.collect()) == run()
