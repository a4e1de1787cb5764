import pathlib
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).parent.parent
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="no test tables")


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 2, 3, 5):
        assert f"p{n}_found" in entry.queries()


def test_nothing_outside_imports_the_llm_package():
    for path in [*ROOT.glob("sluice/**/*.py"), ROOT / "bench.py"]:
        if "sluice/llm/" not in path.as_posix():
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_works_without_the_llm_package():
    code = "import sys; sys.modules['sluice.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(n.startswith(('p4', 'p6', 'p7', 'p8')) for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p1_rules", "t_normalizePath", "t_cmdLine", "op_ipMatch", "op_sqli_patterns", "var_ARGS", "eng_chain", "eng_skip_after", "eng_score", "eng_late_phases", "stream_verdicts", "stream_phases", "op_ipMatch_many", "op_pm_many", "t_jsDecode_stored", "t_htmlEntityDecode_stored", "var_ARGS_POST", "op_detection_fingerprints", "eng_cli", "eng_push", "eng_manual", "src_rules_remote", "p2_found", "p5_found"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in pathlib.Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want))


@needs_data
def test_assembly_streams_all_rows(spark, monkeypatch):
    import duckdb

    from sluice.plans import rule_queries

    seen, cut, put = {}, rule_queries.assemble.to_parts, rule_queries.assemble.assemble
    monkeypatch.setattr(rule_queries.assemble, "to_parts", lambda tx: seen.update(rows=tx.count()) or cut(tx))
    monkeypatch.setattr(rule_queries.assemble, "assemble", lambda parts: seen.update(streaming=parts.isStreaming) or put(parts))
    got = entry.queries()["stream_assemble"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW http_transactions AS SELECT * FROM '{SMALL}/http_transactions.parquet'")
    cols = ", ".join(got.columns)
    want = con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()['stream_assemble']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert seen == {"rows": con.execute("SELECT count(*) FROM http_transactions").fetchone()[0], "streaming": True}
