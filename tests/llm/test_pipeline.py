import sys

import corpus_pipeline
import pytest

from chatloom.llm import decontaminate, quality_rules
from chatloom.llm.queries import ORACLE, REGISTRY
from tests.llm.conftest import ODD
from tests.llm.test_near_copies import groups_by_hand
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_registry_has_each_operator_once():
    assert sorted(int(name[2:].split("_")[0]) for name in REGISTRY) == list(range(1, 14))
    assert set(ORACLE) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    assert compare(REGISTRY[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None


def test_stages_follow_from_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    quality, lines, near, clean, last = (stage for _, stage in corpus_pipeline.STAGES)
    out = quality(spark, docs, SMALL)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    first = out.collect()
    assert {r.doc_id for r in first} == kept and all(r == rows[r.doc_id] for r in first)
    out = lines(spark, out, SMALL)
    second = out.collect()
    assert {r.doc_id for r in second} == kept and all(r.n_chars == len(r.text) for r in second) and out.dtypes == docs.dtypes
    out = near(spark, out, SMALL)
    third = out.collect()
    cut = [(r.doc_id, " ".join(r.text.encode().lower().decode("utf-8").split())) for r in second]
    group = groups_by_hand(cut)
    gone = set(group) - {r.doc_id for r in third}
    assert not gone & set(group.values()) and len(gone) >= 0.9 * (len(group) - len(set(group.values())))
    assert all(r == next(s for s in second if s.doc_id == r.doc_id) for r in third)
    out = clean(spark, out, SMALL)
    fourth = out.collect()
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()], 0.8)
    assert {r.doc_id for r in fourth} == {r.doc_id for r in third if not items.matches(r.text)} and len(fourth) < len(third)
    assert {r.doc_id for r in last(spark, out, SMALL).collect()} == {r.doc_id for r in fourth}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == {r.doc_id for r in fourth}


def test_queries_run_where_workers_have_no_copy_of_the_package(tmp_path):
    """Functions travel with their code: a worker that cannot import the package runs every query of this folder."""
    import os
    import subprocess
    from pathlib import Path

    here = str(Path(corpus_pipeline.__file__).parent)
    code = f"""
import sys
sys.path.insert(0, {here!r})
from chatloom.session import build_session
import __spark_entry__ as entry
spark = build_session("bare", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {SMALL!r}).write.format("noop").mode("overwrite").save()
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_stages_take_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns, name
            assert stage(spark, docs, SMALL).count() <= len(ODD)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_entry_does_without_the_package(tmp_path):
    import shutil
    import subprocess
    from pathlib import Path

    here = Path(corpus_pipeline.__file__).parent
    shutil.copytree(here / "chatloom", tmp_path / "chatloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and not any(x.startswith('op') or x == 'pipeline' for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


