from __future__ import annotations

import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termwarden.llm import common
from termwarden.sources.scratch import WorkFolder
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup import plain_fingerprint

DOCUMENT = SCHEMA.split(", ")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A corpus with planted toxic documents, copies and benchmark items."""
    random.seed(6)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "ne", "so") for c in ("n", "st", "ly", "ed")]
    some = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(i, some(30)) for i in range(5)]
    rows, labels, kinds = [], [], {}

    def add(text, kind, toxic=0):
        doc_id = len(rows)
        rows.append((doc_id, text, "en", f"src{doc_id % 3}", len(text or "")))
        labels.append((doc_id, 1, toxic))
        kinds[doc_id] = kind

    for _ in range(240):
        add(some(120), "clean")
    for _ in range(60):
        add(some(60) + " grimblo " + some(60), "toxic", 1)
    for i in range(30):
        add(rows[i][1], "copy")
    for i in range(30, 60):
        add(rows[i][1] + " extra", "copy")
    for i in range(10):
        add(some(50) + " " + items[i % 5][1] + " " + some(50), "leak")
    add(None, "clean")
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kinds


def near_groups(rows):
    """The rows of each component at four bits, by comparing all fingerprints."""
    marks = np.array([plain_fingerprint(text) for _, text in rows], np.uint64)
    label = np.arange(len(marks))
    while True:
        new = np.array([label[np.bitwise_count(m ^ marks) <= 4].min() for m in marks])
        if (new == label).all():
            break
        label = new
    groups = {}
    for row, at in zip(rows, label.tolist(), strict=True):
        groups.setdefault(at, []).append(row)
    return list(groups.values())


def test_stages_do_what_they_say(spark, folder, tmp_path):
    path, kinds = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        if name == "near_dedup":
            groups = near_groups([(r.doc_id, r.text) for r in docs.collect()])
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns or name == "sharding"
    clean = {d for d, kind in kinds.items() if kind == "clean"}
    assert set(seen["toxicity"]) == {d for d, kind in kinds.items() if kind != "toxic"}
    # Of each group the smallest id stays; an added word may well move more than four bits.
    assert sorted(seen["near_dedup"]) == sorted(min(d for d, _ in group) for group in groups)
    kept = set(seen["near_dedup"])
    assert clean <= kept and len([d for d in kept if kinds[d] == "copy"]) <= 3
    assert all(kinds[d] != "copy" or d >= 330 for d in kept)
    assert sorted(seen["decontamination"]) == sorted(d for d in kept if kinds[d] != "leak")
    left = set(seen["decontamination"])
    taken = {d: seen["mixing"].count(d) for d in left}
    assert max(taken.values()) <= 2 and set(seen["mixing"]) <= left
    # Half as much again as there is, within half a document of each source and the empty one.
    assert abs(len(seen["mixing"]) - 1.5 * (len(left) - 1)) <= 3
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and len(counts) == corpus_pipeline.SHARDS


def test_the_pipeline_is_its_stages(spark, folder):
    path, kinds = folder
    found = corpus_pipeline.run(spark, path)
    assert set(found.columns) == {c.split()[0] for c in DOCUMENT} | {"shard", "slot"}
    assert {kinds[r.doc_id] for r in found.select("doc_id").distinct().collect()} <= {"clean", "copy"}
    again = corpus_pipeline.run(spark, path)
    key = ["doc_id", "shard", "slot"]
    assert found.select(key).exceptAll(again.select(key)).isEmpty()


def test_extra_columns_pass_through(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40)
    extra = {"_row": 1, "_doc": 2, "score": 3, "row": 4, "_text_hash": 5, "component_id": 6, "size": 7}
    docs = docs.withColumns({name: F.lit(value) for name, value in extra.items()})
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, path)
        assert kept.columns[: len(docs.columns)] == docs.columns
        assert {tuple(r) for r in kept.select(*extra).distinct().collect()} == {tuple(extra.values())}


def test_empty_tables_pass_through(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_component_of_near_copies_keeps_a_row(spark, docs_of):
    """Ids that are missing, or that several texts have, take no other text along."""
    random.seed(8)
    some = lambda: " ".join(f"word{random.randrange(5000)}" for _ in range(120))
    # Further blanks change no shingle.
    near = some()
    alone = [some() for _ in range(3)]
    x, y = some(), some()
    rows = [(None, alone[0]), (None, alone[1]), (None, alone[1]), (7, alone[2]), (7, near), (None, near + "  ")]
    rows += [(5, x), (5, y), (9, y.upper())]
    kept = corpus_pipeline.remove_near_copies(spark, docs_of(rows), "").select("doc_id", "text").collect()
    expected = [(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, near), (5, x), (5, y)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))


def test_no_stage_shuffles_texts(spark, folder, monkeypatch):
    """With broadcasts off, no exchange of what a stage runs has a text or a whole row."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plans = []
    write = WorkFolder.write

    def seen(self, name, df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan())
        return write(self, name, df, *rest)

    monkeypatch.setattr(WorkFolder, "write", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, stage in corpus_pipeline.STAGES[1:]:
            plans.append(stage(spark, docs, path)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = 0
    for plan in plans:
        waiting = [plan]
        while waiting:
            node = waiting.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                waiting.append(node.initialPlan())
                continue
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
            if node.nodeName() == "Exchange":
                exchanges += 1
                fields = node.schema().json()
                # Texts of the benchmark are grouped by themselves.
                assert "n_chars" not in fields
                assert '"text"' not in fields or '"doc_id"' not in fields and '"_row"' not in fields
    assert exchanges > 10


def test_a_run_leaves_its_result_alone(spark, folder, tmp_path, monkeypatch):
    path, _ = folder
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    found = corpus_pipeline.run(spark, path)
    left = [p.name for work in tmp_path.iterdir() for p in work.iterdir()]
    assert left == ["sharding"] and found.count() > 300


def test_nothing_is_left_when_a_session_ends(folder, tmp_path):
    path, _ = folder
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "from termwarden.llm import queries\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', sys.argv[3]).getOrCreate()\n"
        "for name in ('op1_language_model', 'op4_simhash', 'op10_exact_dedup'):\n"
        "    assert queries.queries()[name](spark, sys.argv[2]).count() > 0\n"
        "spark.stop()\n"
    )
    root = str(Path(corpus_pipeline.__file__).parent)
    subprocess.run([sys.executable, "-c", code, root, path, str(tmp_path)], check=True, timeout=300, cwd=tmp_path)
    until = time.monotonic() + 20
    while (left := [p.name for p in tmp_path.iterdir() if p.name.startswith(("work-", "model-"))]) and time.monotonic() < until:
        time.sleep(0.5)
    assert left == []
