"""What the patterns for personal data reach beyond the numbers of the given tables."""

import pytest
from pyspark.sql import functions as F

from packetloom.llm import pii
from tests.llm.test_texts import brute_spans

PAIRED = ["call +33 1 23 45 67 89 now", "+45 12 34 56 78", "+12 34 56 78 90", "+3.2.4.7.1.2.3.4.5", "+1(2)3(4)5(6)7(8)9", "+12--34--56--78--90", "no + here 12 34", "12 34 56 78 90"]


@pytest.mark.parametrize("text", PAIRED)
def test_paired_numbers_equal_brute_force(spark, text):
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=pii.Model()).first()
    spans = brute_spans(text)
    assert row["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    assert row["n_phone"] == sum(k == "phone" for *_, k, _ in spans)


def test_paired_numbers_are_proposed_and_redacted(spark):
    frame = spark.createDataFrame([(1, "tel 12 34 56 78 90"), (2, "tel +33 1 23 45 67 89.")], "doc_id long, text string")
    found = {r["doc_id"]: [s["body"] for s in r["p"]] for r in frame.select("doc_id", pii.proposals("phone", frame["text"]).alias("p")).collect()}
    assert "12 34 56 78 90" in found[1]
    assert {r["text"] for r in pii.redact(frame, pii.Model()).collect()} == {"tel 12 34 56 78 90", "tel [PHONE]."}


def test_all_documents_are_learned_from(spark, monkeypatch):
    seen, store = [], pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, name: seen.append(store(df, name)) or seen[-1])
    pii.train(spark.range(24_000).selectExpr("id AS doc_id", "'host 10.0.0.1' AS text"))
    told = F.sum("n") if "n" in seen[0].columns else F.count("*")
    assert seen[0].agg(told).first()[0] == 24_000
