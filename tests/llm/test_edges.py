"""Nulls, repeated rows, empty tables, very long texts and clashing columns, operator by operator."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larder.llm import chat, packing, quality, token_file, tokenizing, url_filter, workspace
from larder.llm.tokenizing import ChunkEncoder, default_vocabulary
from larder.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, nulls everywhere, a very long text, and columns of the operators' own names."""
    long = "Long wörds, and more. " * 40_000
    rows = [(None, "no id", None, None, None), (None, "no id", None, None, None), (1, "one", "en", "a", 3), (1, "one", "en", "a", 3), (1, "other", "en", "a", 5), (2, None, None, "b", None), (3, "", "en", None, 0), (4, long, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("ids", "n_tokens", "length", "piece", "kept", "_score", "score", "row", "salt", "size", "parts", "expected_grade"):
        docs = docs.withColumn(c, F.lit("mine"))
    return docs.repartition(3)


def plain(odd):
    t = Tokenizer.from_file(default_vocabulary())
    return sorted(((r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_file(spark, odd):
    space = Workspace(spark, "t")
    token_file.write_token_file(odd, space.path("f"), space)
    found = sorted(tuple(r) for r in token_file.read_token_file(spark, space.path("f")).select("start", "n_tokens", "ids_crc32", F.coalesce("doc_id", F.lit(-1))).collect())
    start, wanted = 0, []
    for i, ids in plain(odd):
        wanted.append((len(ids), crc(ids), -1 if i is None else i))
        start += len(ids)
    assert sorted(f[1:] for f in found) == sorted(wanted)
    assert [f[0] for f in found] == np.cumsum([0] + [f[1] for f in found[:-1]]).tolist() and [f[3] for f in found] == sorted(f[3] for f in found)


def test_packing(spark, odd):
    found = packing.pack(odd, Workspace(spark, "t"), capacity=512).collect()
    wanted = [(-1 if i is None else i, k // 512, len(ids[k : k + 512]), crc(ids[k : k + 512])) for i, ids in plain(odd) for k in range(0, len(ids), 512)]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    places = [(r["sequence_id"], r["offset"] + k) for r in found for k in range(r["length"])]
    assert len(set(places)) == len(places) and max(p for _, p in places) < 512


def test_chunks_of_one_hash_stay_apart(monkeypatch):
    """All chunks get one of three hashes; ids must not change."""
    t, given = Tokenizer.from_file(default_vocabulary()), ["one two three four", "Two one; nine", "one two"]
    wanted = [t.encode(x, add_special_tokens=False).ids for x in given]
    plain_segments = tokenizing.word_segments

    def few(*a, **k):
        for s in plain_segments(*a, **k):
            s.hashes = s.hashes % np.uint64(3)
            yield s

    own = ChunkEncoder(default_vocabulary())
    monkeypatch.setattr(tokenizing, "word_segments", few)
    for _ in range(2):
        ids, counts = own.encode([x.encode() for x in given])
        assert own.by_chunk and [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted


def test_other_vocabularies_are_asked_for_whole_texts():
    folder = os.path.dirname(default_vocabulary())
    for name in sorted(os.listdir(folder)):
        if not name.endswith(".json") or name == os.path.basename(default_vocabulary()):
            continue
        t, own = Tokenizer.from_file(f"{folder}/{name}"), ChunkEncoder(f"{folder}/{name}")
        ids, counts = own.encode([x.encode() for x in (*tokenizing.PROBES, "")])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in (*tokenizing.PROBES, "")]


def test_quality(spark, odd):
    marks = spark.createDataFrame([(0, None), (None, 0), (None, None), (1, None), (0, 1), (1, 1), (1, 0)], "quality int, toxic int")
    assert [r[0] for r in marks.select(quality.grade_of(F.col("quality"), F.col("toxic"))).collect()] == [0, None, None, None, 0, 1, 2]
    rated = spark.createDataFrame([(1, 0), (1, 0), (2, 2), (3, 2), (4, 2), (None, 0), (2, None)], "doc_id long, grade int")
    found = quality.classify(odd, rated)
    assert found.count() == 8 and sorted(found.columns) == sorted({*odd.columns, "expected_grade", "tail_probability", "kept"})
    found.write.mode("overwrite").parquet(Workspace(spark, "t").path("q"))
    assert quality.select_quality(odd, rated).columns == odd.columns
    assert quality.select_quality(odd, rated.limit(0)).count() == 8


def test_chat(spark):
    text = [(1, 0, "user", "x" * 500_000), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (None, None, None, None), (2, 0, "assistant", "<s>" * 3)]
    turns = spark.createDataFrame(text, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("mine")).withColumn("seq", F.lit("mine")).withColumn("body", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.format_chat(turns))).collect()}
    wanted = "user\n" + "x" * 500_000 + "\n" + "assistant\nsame\n" * 2
    assert got[1]["turns_sha256"] == hashlib.sha256(wanted.encode()).hexdigest() and got[1]["loss_chars"] == 8 and got[1]["n_turns"] == 3
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[2]["loss_chars"] == 9
    empty = chat.format_chat(turns.limit(0))
    assert empty.count() == 0 and chat.digests(chat.read_back(empty)).count() == 0


def test_urls(spark):
    terms = spark.createDataFrame([("Bad", None), ("soft", 2), ("mild", 1), ("soft", 1), (None, 3), ("", None)], "term string, weight int")
    strict, soft = url_filter.read_vocabulary(terms)
    assert strict == ("bad",) and soft == {"soft": 2, "mild": 1}
    hosts = "a." * 20_000 + "example.com"
    urls = {"http://x.fr/bad": "block", "http://x.fr/soft-soft": "allow", "http://x.fr/soft/mild": "block", "http://x.fr/badly": "allow", f"http://{hosts}/en/7": "allow", f"http://{hosts}/en/8": "block", None: "allow"}
    pages = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(urls)] + [(0, "http://x.fr/bad", "mine", "mine")], "page_id long, url string, host string, rule string")
    found = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge_urls(pages, strict=strict, soft=soft).collect())
    assert found == sorted([*enumerate(urls.values()), (0, "block")])
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, odd, tmp_path):
    """Each stage on awkward rows and on none, with the rows' own columns."""
    folder = "/root/testdata/sf0.001"
    for docs, least in ((odd, 1), (odd.limit(0), 0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            docs = Workspace(spark, "t").write(stage(spark, docs, folder), "s")
            assert docs.count() >= least and (i == 4 or docs.columns == columns)


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), spark.conf

    monkeypatch.setattr(workspace, "_own_folder", None)
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            workspace.shared_folder(Session())
    space = Workspace(spark, "t")
    table = space.write(spark.range(3), "x")
    assert table.count() == 3
    space.delete()
    with pytest.raises(Exception):
        spark.read.parquet(space.path("x"))


def test_quality_rejects_toxic_and_low_rows_of_random_words(spark):
    """Held-out accuracy on invented words by grade, with null marks among the ratings."""
    r = random.Random(7)
    vocabulary = {0: [f"low{i}" for i in range(30)], 1: [f"fine{i}" for i in range(90)] + [f"toxic{i}" for i in range(9)], 2: [f"fine{i}" for i in range(99)]}
    docs = spark.createDataFrame([(i, " ".join(r.choices(vocabulary[i % 3], k=60))) for i in range(900)], "doc_id long, text string")
    rated = spark.createDataFrame([(i, None if i % 10 == 9 else i % 3) for i in range(600)], "doc_id long, grade int")
    held = quality.classify(docs, rated).filter("doc_id >= 600").collect()
    assert np.mean([x["kept"] == (x["doc_id"] % 3 == 2) for x in held]) > 0.95
