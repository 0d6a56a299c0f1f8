"""Packing and sharding against exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetloom.llm import packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(-1, None), (-2, ""), (-3, "<|endoftext|> x"), (-4, "漢字 and “quotes” – 𝒳"), (-5, "word " * 30000), (-6, "a"), (-6, "a"), (None, "no id")]


@pytest.fixture(scope="module")
def frame(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "'x' as length", "1 as shard", "doc_id % 3 = 0 as own")


def whole(pieces):
    at = 0
    for p in sorted(pieces, key=lambda r: r["offset"]):
        assert p["offset"] == at
        at += p["length"]
    return at


@pytest.mark.parametrize("limits, loss", [(packing.Limits(), None), (packing.Limits(256, 3, 100), "own")])
def test_every_id_once_and_no_padding(frame, limits, loss):
    rows = packing.pack(frame, PATH, limits, loss=loss, with_ids=True).collect()
    exact = Tokenizer.from_file(PATH)
    texts = defaultdict(list)
    for r in frame.collect():
        texts[r["doc_id"]].append([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    own = {r["doc_id"]: r["own"] for r in frame.collect()}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    assert by.keys() == texts.keys()
    for i, pieces in by.items():
        if len(texts[i]) > 1:  # copies are packed each for itself
            assert sum(p["length"] for p in pieces) == sum(map(len, texts[i]))
            continue
        ids = texts[i][0]
        pieces.sort(key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == ids and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
    for pieces in sequences.values():
        n = whole(pieces)
        assert n <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p["length"] for p in pieces if loss is None or own[p["doc_id"]]) <= limits.loss
        assert n == limits.tokens or n & (n - 1) == 0


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id string, text string"), PATH).count() == 0


def test_plain_texts_get_the_file_s_ids():
    encode, exact = packing._encoder(PATH), Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 '{chr(c)}  {chr(c)} x" for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0), 0x2028, 0x3000]]
    for text, want in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == want.ids


def test_shard_plan(frame):
    rows = sharding.shard_plan(frame).collect()
    texts = defaultdict(set)
    for r in frame.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    slots, place = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        place[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
        assert (r["size"] - 1, r["text_crc32"]) in {(len(t.encode()), zlib.crc32(t.encode())) for t in texts[r["doc_id"]]}
    assert len(rows) == frame.count() and all(len(p) == 1 for p in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_removal(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    even = {r[0]: r[1] for r in sharding.assign(keys, [1.0, 1.0, 2.0]).collect()}
    share = np.bincount(list(even.values())) / 20000
    assert np.allclose(share, [0.25, 0.25, 0.5], atol=0.02)
    less = {r[0]: r[1] for r in sharding.assign(keys, [1.0, 1.0]).collect()}
    assert all(less[k] == s for k, s in even.items() if s < 2)
    with pytest.raises(ValueError):
        sharding.assign(keys, [])


def test_shards_on_disk(spark, frame, tmp_path):
    sharding.write_shards(frame.select("doc_id", "text"), [1.0, 3.0], str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == frame.count()
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign(frame.select("doc_id"), [1.0, 3.0]).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == want


def test_slots_of_nothing(spark):
    assert sharding.shard_plan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
