"""The stages against what brute force keeps, the registered queries, and the guard around the subpackage."""

import subprocess
import sys
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from packetloom.llm import queries
from tests.llm.test_alike import kept
from tests.llm.test_texts import brute_passages, brute_spans

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Rows of every stage, each stage on what the one before has stored."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.first()
    odd = [(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "12 34", "en", "s", 5), (first["doc_id"], first["text"], "en", "s", 1), (90004, first["text"], "en", "s", 1), (None, first["text"], "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(odd, DDL)).write.parquet(f"{root}/0")
    out = [spark.read.parquet(f"{root}/0")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{i + 1}")
        out.append(spark.read.parquet(f"{root}/{i + 1}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns(stored):
    assert len(pipeline.STAGES) == 5
    assert all(df.columns == pipeline.COLUMNS for df in stored[:-1])


def test_language_stage(stored):
    before, after = rows(stored[0]), rows(stored[1])
    kept = {r["doc_id"] for r in after}
    assert {90001, 90002, 90003}.isdisjoint(kept)
    texts = [r for r in before if r["text"] and any(map(str.isalpha, r["text"]))]
    assert len(after) >= 0.98 * len(texts) and {r["lang"] for r in after} <= {"en", "de", "fr", "es"}


def test_near_duplicate_stage(stored):
    before, after = rows(stored[1]), rows(stored[2])
    named = sorted((r["doc_id"], r["text"]) for r in after if r["doc_id"] is not None)
    assert named == kept([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None]) and len(named) < len(before)
    assert sum(r["doc_id"] is None for r in after) == 1


def test_decontamination_stage(spark, stored):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(stored[2]), rows(stored[3])
    want = [r["doc_id"] for r in before if not brute_passages(r["text"], items)]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in after) and len(after) < len(before)


def test_redaction_stage(stored):
    before, after = {r["doc_id"]: r for r in rows(stored[3])}, rows(stored[4])
    assert len(after) == len(before)
    for r in after:
        assert r["n_chars"] == len(r["text"]) and not any(k in ("email", "phone") for *_, k, _ in brute_spans(r["text"]))
        old = before[r["doc_id"]]["text"]
        if not brute_spans(old) and "[" not in r["text"]:
            assert r["text"] == old
    assert any("[EMAIL]" in r["text"] for r in after)


def test_packing_stage(stored):
    before, after = rows(stored[4]), rows(stored[5])
    by = defaultdict(int)
    for r in after:
        by[r["doc_id"]] += r["length"]
    assert by.keys() == {r["doc_id"] for r in before}
    assert all(by[r["doc_id"]] == r["doc_tokens"] for r in after)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else spark.createDataFrame([], out.schema)


def test_run_is_all_stages(spark):
    got = entry.queries()["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_every_operator_is_registered():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())


def test_library_works_without_the_subpackage(tmp_path):
    """A copy without llm and the pipeline still registers all else; other missing modules are errors."""
    repo = entry.__file__.rsplit("/", 1)[0]
    subprocess.run(["cp", "-r", f"{repo}/packetloom", f"{repo}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["mv", f"{tmp_path}/packetloom/llm", f"{tmp_path}/gone"], check=True)
    said = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 100, 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True", "False"]
