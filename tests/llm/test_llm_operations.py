"""Each pipeline operation against a brute-force version on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import chat, exact_dedup, license_scan, mixing, near_dup, packing, quality, queries, token_file, topk, url_filter
from larder.llm.tokenizing import ChunkEncoder, default_vocabulary
from larder.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    """Nulls, empties, ties, repeats, odd letters, and one very long text."""
    r = random.Random(3)
    words = ["Alpha", "beta,", "gamma.", "délta", "ΣΑΣ", "it's", "12.5", "H̱", "x", "\x1codd", "<|endoftext|>", "日本"]
    out = [None, "", " \n\t", "one", "one two three", "one two  three", "ONE two three", "the same\ttext here", "the same text here", "thesametexthere"]
    out += [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(30)]
    base = [f"w{i}" for i in range(80)]
    for i in range(8):
        copy = list(base)
        for k in range(i):
            copy[k * 9] = f"v{i}{k}"
        out.append(" ".join(copy))
    return [*out, out[-1], "word " * 300_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "B"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# tokens and packing


def test_chunk_encoder_equals_library():
    t, own = Tokenizer.from_file(default_vocabulary()), ChunkEncoder(default_vocabulary())
    given = [x or "" for x in texts()]
    ids, counts = own.encode([x.encode() for x in given])
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [t.encode(x, add_special_tokens=False).ids for x in given]


def plain_ids():
    t = Tokenizer.from_file(default_vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts()]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_file_round_trip(spark, docs, empty):
    space = Workspace(spark, "t")
    token_file.write_token_file(docs, space.path("f"), space)
    found = as_rows(token_file.read_token_file(spark, space.path("f")), "doc_id", "start", "n_tokens", "ids_crc32")
    start, wanted = 0, []
    for i, ids in enumerate(plain_ids()):
        wanted.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert found == sorted(wanted, key=str)
    space = Workspace(spark, "t")
    token_file.write_token_file(empty, space.path("f"), space)
    assert token_file.read_token_file(spark, space.path("f")).count() == 0


@pytest.mark.parametrize("limit", [3, 4, 16])
def test_huffman_lengths_are_a_full_limited_code(limit):
    counts = np.array([1, 1, 2, 3, 5, 8, 0, 1000])
    lengths = token_file.code_lengths(counts, limit)
    assert lengths[6] == 0 and lengths.max() <= max(limit, 3)
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    if limit == 16:  # unlimited: as good as merging the two smallest again and again
        merged, total = sorted(counts[counts > 0].tolist()), 0
        while len(merged) > 1:
            total += merged[0] + merged[1]
            merged = sorted([merged[0] + merged[1], *merged[2:]])
        assert int((counts * lengths).sum()) == total


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(100):
        capacity = r.choice([7, 16, 31])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 40))]
        rows, bins = packing.plan(Counter(lengths), capacity)
        assert bins == len(best_fit(lengths, capacity))


def test_packing_places_every_piece(spark, docs, empty):
    found = packing.pack(docs, Workspace(spark, "t"), capacity=256).collect()
    wanted = [(i, k // 256, k, len(ids[k : k + 256]), crc(ids[k : k + 256])) for i, ids in enumerate(plain_ids()) for k in range(0, len(ids), 256)]
    assert sorted(tuple(r)[:5] for r in found) == sorted(wanted)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(bins) == len(best_fit([w[3] for w in wanted], 256))
    assert packing.pack(empty, Workspace(spark, "t")).count() == 0


def test_sequences_hold_their_pieces(spark, docs):
    few = docs.filter("doc_id < 40")
    for r in packing.sequences(few, Workspace(spark, "t"), capacity=64).collect():
        assert len(r["ids"]) == 4 * sum(p["length"] for p in r["pieces"]) <= 256


# duplicates


def test_exact_dedup(spark, docs, empty):
    doubled = docs.unionByName(docs.filter("doc_id = 5"))
    rows = [(r["doc_id"], r["text"] or "") for r in doubled.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((-len(t), i))
    wanted = []
    for content, members in groups.items():
        best = min(members)
        for k, (n, i) in enumerate(sorted(members)):
            wanted.append((i, best[1], len(members), k == 0, hashlib.sha256(content.encode()).hexdigest()))
    assert as_rows(exact_dedup.find_duplicates(doubled, Workspace(spark, "t")), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(wanted, key=str)
    kept = exact_dedup.drop_duplicates(doubled, Workspace(spark, "t"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in wanted if w[3])
    assert exact_dedup.find_duplicates(empty, Workspace(spark, "t")).count() == 0


def test_exact_dedup_of_hot_null_and_clashing(spark):
    """A text that most rows hold, null ids, repeated rows, small groups of copies, and columns of the operator's own names."""
    rows = [(i if i % 5 else None, "hot  text" if i % 3 else "hot text", "en", "s", i) for i in range(300)]
    rows += [(1000 + i, f"pair {i // 2}" + " " * (i % 2), "en", "s", i) for i in range(60)] + [(1000, "pair 0", "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumn("_sha256", F.lit("mine")).withColumn("_doc_id", F.col("n_chars")).withColumn("salt", F.lit("x")).withColumn("row", F.lit(1))
    kept = exact_dedup.drop_duplicates(docs.repartition(3), Workspace(spark, "t"))
    assert kept.columns == docs.columns
    best = min((-len(t), i is None, i) for i, t, *_ in rows[:300])
    assert sorted((r["doc_id"], r["text"], r["_sha256"]) for r in kept.collect()) == sorted([(best[2], "hot  text", "mine")] + [(1001 + 2 * i, f"pair {i} ", "mine") for i in range(30)])
    found = exact_dedup.find_duplicates(docs.repartition(3), Workspace(spark, "t")).collect()
    assert len(found) == len(rows) and Counter(r["group_size"] for r in found) == {300: 300, 2: 58, 4: 4} and sum(r["kept"] for r in found) == 31
    assert {r["keep_id"] for r in found if r["group_size"] == 300} == {best[2]}


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    to = {i: i for i in sets}

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                to[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, docs, empty, words):
    wanted = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, 80)
    found = near_dup.find_near_duplicates(docs, Workspace(spark, "t"), words=words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = near_dup.drop_near_duplicates(docs, Workspace(spark, "t"), words=words)
    assert kept.columns == docs.columns and kept.count() == sum(i == c for i, (_, c) in wanted.items())
    assert near_dup.find_near_duplicates(empty, Workspace(spark, "t")).count() == 0


def test_chain_of_texts_around_an_unlike_centre(spark):
    """Texts that drift away from the first one: links between later texts must not be lost."""
    r, rows, current = random.Random(8), [], [f"t{i}" for i in range(120)]
    for i in range(40):
        rows.append((i, " ".join(current), "en", "s", 0))
        current = [w if r.random() > 0.02 else f"n{i}-{k}" for k, w in enumerate(current)]
    docs = spark.createDataFrame(rows, DOCS)
    wanted = brute_components([(x[0], x[1]) for x in rows], 4, 80)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.find_near_duplicates(docs, Workspace(spark, "t"), words=4).collect()} == wanted


def brute_rows(texts, words, percent):
    """Smallest id of each text's component, text by text."""
    return [(n, c) for _, (n, c) in sorted(brute_components(list(enumerate(texts)), words, percent).items())]


def test_near_duplicates_of_hot_null_and_repeated_ids(spark, monkeypatch):
    """A hot group of near copies, ids that several texts share, null ids, and settling over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 8)
    r, base = random.Random(12), [f"b{i}" for i in range(60)]
    other = [f"o{i}" for i in range(60)]
    texts = [" ".join(w if r.random() > 0.01 else f"x{i}" for w in base) for i in range(70)] + [" ".join(base)] * 30
    texts += [" ".join(base[: 30 + i % 8] + other[i % 12 :]) for i in range(40)] + [" ".join(other)] * 3 + ["lone text of its own here", "", None]
    ids = [*range(100), *[7] * 20, *range(200, 200 + len(texts) - 120)]
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, texts[100])]
    groups = [c for _, c in brute_rows(texts, 4, 80)]
    smallest = {g: min(ids[i] for i in range(len(texts)) if groups[i] == g) for g in groups}
    wanted = sorted([(ids[i], smallest[g]) for i, g in enumerate(groups)] + [(None, None)] * 2, key=str)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("print", F.lit("mine")).withColumn("node", F.lit(1)).repartition(6)
    found = near_dup.find_near_duplicates(docs, Workspace(spark, "t"), words=4).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in found), key=str) == wanted
    kept = near_dup.drop_near_duplicates(docs, Workspace(spark, "t"), words=4)
    assert kept.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(ids[i], t) for i, t in enumerate(texts) if smallest[groups[i]] == ids[i]] + rows[-2:], key=str)


def test_near_duplicates_of_a_given_table(spark):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    wanted = brute_components([(r["doc_id"], r["text"]) for r in rows], 4, 80)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op9_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()} == wanted


def test_blocks_meet_each_other():
    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(60) for _ in range(40)], dtype=np.int64)) for _ in range(30)]
    left = np.arange(30) < 15
    links = near_dup._links_between(np.arange(30), sets, left, 50)
    alike = lambda a, b: 2 * len(set(a) & set(b)) >= len(set(a) | set(b))
    assert all(alike(sets[i], sets[j]) and left[i] and not left[j] for i, j in links)
    reached = {i for pair in links for i in pair}
    assert reached == {i for i in range(30) for j in range(30) if left[i] != left[j] and alike(sets[i], sets[j])}


# mixing


def test_mix_reaches_targets(spark, docs, empty):
    many = spark.createDataFrame([(i, "w " * (1 + i % 9), "en", ["a", "b", "c", None, "tiny"][0 if i % 3 == 0 else 4 if i % 97 == 0 else i % 4], 0) for i in range(2000)], DOCS)
    found = mixing.shares(many, Workspace(spark, "t")).collect()
    again = mixing.shares(many.repartition(3), Workspace(spark, "t")).collect()
    assert sorted((r["doc_id"], r["times"]) for r in found) == sorted((r["doc_id"], r["times"]) for r in again)
    source = {r["doc_id"]: r["source"] for r in many.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["times"]
        target[s] = r["target"]
        assert r["times"] <= 3
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, open_, wanted = float(sum(sizes.values())), set(order), {}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            wanted[s] = 3.0 * sizes[s]
        left -= sum(wanted[s] for s in over)
        open_ -= set(over)
    wanted |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for s in order:
        assert target[s] == pytest.approx(wanted[s]) and abs(taken[s] - target[s]) <= 20
    assert sum(taken.values()) <= sum(sizes.values())
    assert mixing.shares(empty, Workspace(spark, "t")).count() == 0 and mixing.mix(empty, Workspace(spark, "t")).count() == 0
    mixed = mixing.mix(docs.withColumn("size", F.lit("clash")), Workspace(spark, "t"))
    assert mixed.columns == [*docs.columns, "size"]


def plain_queue(rows, targets, budget):
    """How often each row is taken, one document after another: (key, doc_id, size, source) rows."""
    queue = []
    for source in {r[3] for r in rows}:
        words = sum(r[2] for r in rows if r[3] == source)
        done = 0
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: (r[0], (r[1] is not None, r[1] or 0), r[2])):
            done += r[2]
            for k in range(min(3, int(targets[source] // words) + 1) if words and targets[source] else 0):
                queue.append(((done + k * words) / targets[source], source is None, source or "", r[1] is None, r[1] or 0, done, r))
    taken, used = Counter(), 0
    for *_, r in sorted((q for q in queue if q[-1][2]), key=lambda q: q[:-1]):
        used += r[2]
        if used > budget:
            break
        taken[r] += 1
    return taken


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_mix_equals_plain_queue(spark, monkeypatch, broadcast):
    """Null and repeated ids, repeated rows, a hot source, an empty one, and columns of the operator's own names."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    r = random.Random(3)
    rows = [(i if i % 7 else None, "w " * r.randint(0, 12), "en", r.choice(["a", "a", "a", "b", "Z", None]), 0) for i in range(700)]
    rows += [(5, "same row", "en", "b", 0)] * 4 + [(5, "other text", "en", "b", 0), (9001, None, "en", "empty", 0), (9002, "x " * 50_000, "en", "long", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine")).withColumn("_key", F.lit("mine"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "source", "text"), 1)
    plain = [(k, i, len(WORD.findall(t or "")), s) for k, i, t, s in docs.select(key, "doc_id", "text", "source").collect()]
    found = mixing.shares(docs.repartition(5), Workspace(spark, "t"), payload=["source"]).collect()
    taken = plain_queue(plain, {x["source"]: x["target"] for x in found}, sum(x[2] for x in plain))
    wanted = Counter()
    for row, n in Counter(plain).items():
        for _ in range(n):
            wanted[(row[1], row[2], row[3])] += 0
        wanted[(row[1], row[2], row[3])] += taken[row]
    got = Counter()
    for x in found:
        got[(x["doc_id"], x["size"], x["source"])] += x["times"]
    assert dict(got) == dict(wanted) and len(found) == len(rows)
    mixed = mixing.mix(docs, Workspace(spark, "t"))
    assert mixed.columns == docs.columns and mixed.count() == sum(got.values())


# quality


def test_classifier_on_held_out_rows(spark, empty):
    r = random.Random(4)
    good, bad = [f"word{i}" for i in range(200)], [f"junk{i}!!" for i in range(40)]
    make = lambda i: " ".join(r.choices(bad if i % 4 == 0 else good, k=30)) + (" nasty" if i % 4 == 1 else "")
    docs = spark.createDataFrame([(i, make(i), "en", "s", 0) for i in range(1200)] + [(5000, None, "en", "s", 0)], DOCS)
    rated = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1 if i % 4 == 1 else 2) for i in range(800)] + [(7, None)], "doc_id long, grade int")
    found = quality.classify(docs, rated).collect()
    held_out = [x for x in found if 800 <= x["doc_id"] < 1200]
    assert np.mean([x["kept"] == (x["doc_id"] % 4 > 1) for x in held_out]) > 0.97
    assert all(0 <= x["expected_grade"] <= 2 and 0 <= x["tail_probability"] <= 1 for x in found)
    assert all(x["kept"] for x in quality.classify(docs, rated.filter("grade = 2")).collect())
    assert quality.classify(empty, rated).count() == 0


def test_classifier_finds_rare_toxic_words():
    """Toxic texts differ from good ones by one of twenty words, each in about 15 of 3000 fitted documents."""
    r = random.Random(11)
    usual = [f"word{i}" for i in range(400)]
    make = lambda grade: " ".join(r.choices(usual if grade else ["junk", "spam", "click"], k=60) + ([f"slur{r.randrange(20)}"] if grade == 1 else []))
    grades = np.array([0 if i % 10 == 0 else 1 if i % 10 == 1 else 2 for i in range(6000)])
    docs = [make(g).encode() for g in grades]
    model = quality.fit_model(*quality.features(docs[:3000]), grades[:3000])
    kept = model.score(docs[3000:], 2)[1] >= quality.KEEP_FROM
    assert kept[grades[3000:] == 1].mean() < 0.1 and kept[grades[3000:] == 2].mean() > 0.98 and kept[grades[3000:] == 0].mean() < 0.01


# search


def test_topk_equals_brute_force(spark):
    g = np.random.default_rng(6)
    rows = [(i, g.normal(0, 0.2, 24).tolist()) for i in range(400)] + [(400 + i, [0.1] * 24) for i in range(60)]
    rows += [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, [0.5] * 3), (None, [0.1] * 24), (5, [0.3] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    wanted = []
    for i, v in q:
        if i % 20 == 0:
            scores = sorted(((-int(v @ w), j) for j, w in q if j != i and len(w) == len(v)))[:20]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert as_rows(topk.search(vectors, F.col("vec_id") % 20 == 0, 20, Workspace(spark, "t")), "query_id", "rank", "vec_id", "score") == sorted(wanted, key=str)
    assert topk.search(vectors.limit(0), F.col("vec_id") % 20 == 0, 20, Workspace(spark, "t")).count() == 0


# chat, URLs, licenses


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <|end|>\n<|turn|>x", "a\\", "", None, "<", "[", "<<s>"]
    rows = [(c, k, ["user", "assistant", "a\nb\\n", None, "a\x00b\\\n\\\\"][k % 5], hard[((c or 0) + k) % len(hard)]) for c in (1, 2, None) for k in range(9)]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(formatted).collect()
    assert sorted((r["conv_id"], r["seq"], r["role"], r["text"]) for r in back if r["conv_id"]) == sorted((c, k + 1, role or "", t or "") for c, k, role, t in rows if c)
    assert all((r["loss_text"] == r["text"]) == (r["role"] == "assistant") for r in back if r["loss_text"] is not None or r["role"] == "assistant")
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    one = [(role or "", t or "") for c, _, role, t in rows if c == 1]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in one).encode()).hexdigest()
    learnt = "".join(b for a, b in one if a == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest()) and len(got) == 3


def test_chat_parts_become_placeholders(spark):
    kind = "conv_id long, turn long, role string, content array<struct<kind:string,text:string,ref:string,units:int>>"
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("document", None, "c.pdf", None), ("text", None, None, None)]
    row = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], kind), parts_column="content").orderBy("seq").first()
    assert row["rendered"] == "<s><|turn|>user\nsee <\\|image|> <|image|><|audio|><|document|><|end|>\n"
    assert [tuple(a) for a in row["attachments"]] == [("image", "a.png", 1, 512), ("audio", "b.wav", 2, 250), ("document", "c.pdf", 3, 1024)]


def test_chat_query_visits_parts(spark, monkeypatch):
    """Texts of the registered query go the way of typed parts."""
    plain, visits = chat.flatten_parts, []
    monkeypatch.setattr(chat, "flatten_parts", lambda parts: visits.append(1) or plain(parts))
    assert queries.op6_typed_chat_format(spark, "/root/testdata/sf0.001").count() > 1 and visits
    text = [(1, 0, "user", "see <|image|> </s>"), (1, 1, "assistant", None)]
    parts = [(c, t, role, [("text", x, None, None)]) for c, t, role, x in text]
    kind = "conv_id long, turn long, role string, "
    one = chat.format_chat(spark.createDataFrame(text, kind + "text string"))
    other = chat.format_chat(spark.createDataFrame(parts, kind + "parts array<struct<kind:string,text:string,ref:string,units:int>>"), parts_column="parts")
    assert as_rows(one, *one.columns) == as_rows(other, *one.columns) and one.schema["attachments"] == other.schema["attachments"]


def test_url_filter(spark):
    cases = {
        None: (None, "allow"), "no scheme": (None, "allow"), "http://a.com/en/x": ("com/en/", "block"), "http://www.EXAMPLE.com/en/71?q": ("example.com/en/7", "allow"),
        "http://badexample.com/en/7": ("com/en/", "block"), "https://x.example.net/de/8": ("example.net/de/8", "block"), "https://x.net/de/8": ("net/de/", "allow"),
        "http://a.fr/xxx/1": (None, "block"), "http://a.fr/xxxl": (None, "allow"), "http://a.fr/poker-poker": (None, "allow"), "http://a.fr/Poker_casino": (None, "block"),
        "http://a.org?/es/": (None, "allow"), "http://a.org/es/": ("org/es/", "block"), "http://a.fr/?u=http://b.com/en/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert [tuple(r) for r in url_filter.judge_urls(pages.filter("page_id = 3")).select("host", "path").collect()] == [("www.example.com", "/en/71")]


def plain_blocks(text, templates, threshold, stretch):
    """Labels and best containment of all runs of words, one by one."""
    words, labels, best = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER)), set(), 0.0
    for label, names, template in templates:
        whole = set(template.split())
        reach = max(1, int(stretch * len(template.split())))
        for i in range(len(words)):
            block = set(words[i : i + reach])
            if 10 * len(block & whole) >= 10 * threshold * len(whole) - 1e-6 and set(names.split()) <= block:
                labels.add(label)
                best = max(best, len(block & whole) / len(whole))
    return labels, best


def test_license_scan_equals_full_comparison(spark, empty):
    r = random.Random(9)
    filler = ["the", "under", "by", "apache", "version", "word", "mit", "license", "x1", "nc", "İ", "K"]
    long_notice = "own " + " ".join(f"clause{i}" for i in range(150))
    templates = (*license_scan.TEMPLATES, ("own", "own", long_notice), ("one", "", "solitary"))
    texts = [None, "", "MIT License, mit-license! Apache\nLicense", "K license mIt LICENSE", "general public license " * 3, "a solitary word", long_notice]
    texts += [" \n# ".join(w for w in long_notice.split() if r.random() < keep) for keep in (0.75, 0.85, 0.95)]
    texts += ["released under the Apache license", "licensed under CC BY 4.0", "Licensed under CC-BY-SA 4.0", license_scan.TEMPLATES[0][2].upper(), "the license " * 30_000]
    texts += [" ".join(r.choices(filler, k=r.randint(0, 90)) + (templates[i % 24][2].split()[i % 3 :] if i % 2 else []) + r.choices(filler, k=r.randint(0, 200))) for i in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0), (None, texts[4], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hits", F.lit(1)).withColumn("row", F.lit(2))
    duck = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    duck.execute("CREATE TABLE documents AS SELECT * FROM documents")
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = license_scan.scan(docs, Workspace(spark, "t"), templates=templates).select(*columns).collect()
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({license_scan.oracle_sql(templates=templates)})").fetchall()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    by_id = {x["doc_id"]: x for x in found}
    for i, t in enumerate(texts):
        if len(t or "") < 100_000:
            labels, best = plain_blocks(t, templates, license_scan.THRESHOLD, license_scan.STRETCH)
            assert set(filter(None, by_id[i]["labels"].split(","))) == labels | set(filter(None, by_id[i]["base_labels"].split(",")))
            assert by_id[i]["score"] == (1.0 if by_id[i]["n_base"] else best)
    assert [by_id[i]["labels"] for i in (6, 7, 8, 9, 10, 11, 12, 13)] == ["own", "", "own", "own", "apache", "", "cc-by-sa", "mit"]
    assert license_scan.scan(empty, Workspace(spark, "t")).count() == 0


def test_topk_of_repeated_query_rows(spark):
    """Repeated rows of a query's vec_id, alike and different, over several rounds of pruning."""
    g = np.random.default_rng(8)
    rows = [(i, (g.normal(0, 0.2, 40) * np.where(np.arange(40) < 16, 4, 0.1)).tolist()) for i in range(1, 300)]
    first = rows[19][1]
    rows += [(20, first)] * 15 + [(20, (2 * np.array(first)).tolist())] * 15
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    wanted = []
    for i, v in q:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in q if j != i)[:20]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert as_rows(topk.search(vectors, F.col("vec_id") % 20 == 0, 20, Workspace(spark, "t")), "query_id", "rank", "vec_id", "score") == sorted(wanted, key=str)
    # one block alone: the own rows don't take up places among the best
    v, ids = np.array([x for _, x in q]), np.array([i for i, _ in q])
    at = int(np.flatnonzero(ids == 20)[0])
    assert len(topk.best_of_block(v[at : at + 1], ids[at : at + 1], np.array([-(2**63)]), v, ids, 20)[0]) == 20


def test_topk_of_large_wide_and_clashing(spark):
    """Components of any size, very wide vectors, several blocks, and columns named like the search's own."""
    g = np.random.default_rng(9)
    rows = [(i, (g.normal(0, 1, 300) * 10.0 ** int(g.integers(-3, 12))).tolist()) for i in range(90)]
    rows += [(100 + i, [1e300, -1e300 if i % 2 else 1e300, 3.0]) for i in range(45)] + [(150, [1e308] * 3), (180, [-1e308, 1.7e308, 0.5]), (160, []), (161, [])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, spread string, c int")
    found = defaultdict(list)
    for r in topk.search(vectors, F.col("vec_id") % 20 == 0, 20, Workspace(spark, "t")).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(64 * x)) if abs(x) < 1e300 else 64 * int(x) for x in v] for i, v in rows}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, v in whole.items():
        if i % 20 == 0:
            best = sorted((-cut(sum(a * b for a, b in zip(v, w))), j) for j, w in whole.items() if j != i and len(w) == len(v))[:20]
            assert sorted(found[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert 180 in found and {160, 161} >= {x[1] for x in found[160]}


def test_topk_compacts_most_candidates():
    """On the given vectors bounds leave few candidates for the last dimensions, and pruning loses none."""
    v = np.floor(64 * np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist()))
    ids, asked = np.arange(len(v)), np.arange(0, len(v), 20)
    opening = topk.best_of_block(v[asked], ids[asked], np.full(len(asked), -(2**63)), v[:1000], ids[:1000], 20)
    bars, left = opening[2][19::20], []
    q, c, score = topk.best_of_block(v[asked], ids[asked], bars, v, ids, 20, left)
    share = np.mean(np.array(left) / len(v), axis=0)
    assert share[3] < 0.4 and share[-1] < 0.05  # after half of the dimensions, and after all
    for n, i in enumerate(asked):
        best = sorted((-int(x), j) for j, x in enumerate(v @ v[i]) if j != i)[:20]
        assert [(-s, j) for s, j in zip(score[q == n], c[q == n])] == best


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert as_rows(found, *columns) == sorted(wanted, key=str)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    space, docs = Workspace(spark, "t"), spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = space.write(stage(spark, docs, folder), f"s{i}")
        if i < 4:
            assert docs.columns == columns
            kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        if i == 1:
            assert len(kept[1]) == len({re.sub("[\x20\x09-\x0d]", "", t) for _, t in before})
        if i == 2:
            assert sorted(kept[2]) == sorted(i for i, (n, c) in brute_components(before, 5, 80).items() if i == c)
    clean = [r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()]
    assert np.mean([i in set(kept[0]) for i in clean]) > 0.95 and max(Counter(kept[3]).values()) <= 3
    pieces = docs.collect()
    assert sorted({r["doc_id"] for r in pieces}) == sorted(set(kept[3]))
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(kept[3])
