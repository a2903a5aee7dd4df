"""The training-data operators against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import decontam, embdedup, linededup, minhash, packing, quality, secrets, sharding, toxicity, urlfilter
from parley.llm.components import components
from parley.llm.scratch import Scratch

random.seed(5)
WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sal") for b in ("n", "ra", "to", "lek", "x", "ñu")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.08 else "") for _ in range(n))


BASE = prose(200, 1)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace("ban", "BAN")), (4, " ".join(BASE.split(" ")[:190])), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, prose(120, 2)), (10, prose(3000, 3)), (11, "\n\n \t"), (12, "日本語 テキスト <|endoftext|> x"), (1, BASE), (None, "ban ra"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # Columns of other names, one of which an operator uses itself, ride along.
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], f"{SCHEMA}, line string, shard int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (9, 8), (500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 500: 500}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_packing_round_trip(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, length=64).collect()
    want = sorted([*own.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ROWS)
    pieces, stream = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"] and r["offset"] + r["length"] <= 64
        stream.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["sequence_id"] * 64 + r["offset"] - r["start"]), []).append((r["start"], ids))
    assert sorted([x for _, ids in sorted(p) for x in ids] for p in pieces.values()) == want
    for k, spans in stream.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 64 or k == max(stream)
    assert packing.pack(empty, path).count() == 0


def test_decontamination(spark, docs, empty):
    words = decontam.words
    bench = spark.createDataFrame([(1, " ".join(BASE.split(" ")[5:40])), (2, "One, two"), (3, None), (4, "nowhere at all"), (None, "ban")], "item_id long, text string")
    items = [(1, words(" ".join(BASE.split(" ")[5:40]).encode())), (2, [b"one", b"two"]), (4, [b"nowhere", b"at", b"all"])]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs, bench).collect())
    want = []
    for d, t in ROWS:
        w = words(t.encode() if t else None)
        hit, found = set(), set()
        for item, x in items:
            for k in range(max(1, len(x) - 12)):
                part = x[k : k + 13]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit.update(range(p, p + len(part)))
                        found.add(str(item))
        want.append((str(d), len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.filter("false")).filter("contaminated").count() == 0
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[4] for x in want)
    near = decontam.contamination(docs, bench, proximity=(2, 3)).filter("array_contains(near_items, '2')").count()
    assert near == 2


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    # The reworded term is in no slice or in another one; a posting at the end of the document before is nearer than slop.
    rows = [(1, "x alpha"), (2, "beta gamma alpha x")]
    near = lambda rows: {r["doc_id"] for r in decontam.contamination(spark.createDataFrame(rows, SCHEMA).coalesce(1), bench, proximity=(3, 5)).collect() if r["near_items"]}
    assert near(rows[:2]) == {2}
    common = [(10 + k, "delta") for k in range(4000)]
    assert near(common + rows[:2]) == {2}
    assert near([(1, "z z alpha"), (2, "beta gamma alpha")]) == {2}


def test_decontamination_in_blocks_and_segments(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(BASE.split(" ")[5:40])), (2, "One, two"), (3, " ".join(BASE.split(" ")[30:60])), (4, "ban ra")], "item_id long, text string")
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], str(r["runs"]), str(r["near_items"]))
    whole = sorted(map(key, decontam.contamination(docs, bench, proximity=(2, 3)).collect()))
    assert any(x[7] != "[]" for x in whole) and sum(x[2] > 0 for x in whole) > 3
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 100)
    monkeypatch.setattr(decontam, "SEGMENT_DOCS", 2)
    assert sorted(map(key, decontam.contamination(docs, bench, proximity=(2, 3)).collect())) == whole
    clean = decontam.decontaminate(docs, bench).count()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    assert sorted(map(key, decontam.contamination(docs, bench, proximity=(2, 3)).collect())) == whole
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    assert decontam.decontaminate(docs, bench).count() == clean == sum(not x[5] for x in whole)


def test_one_benchmark_block_is_held(spark, docs, monkeypatch):
    import gc
    import weakref

    class Block(list):
        def __reduce__(self):
            return list, (list(self),)

    def blocks(_):
        for k in range(3):
            block = Block([(str(k), BASE.encode())])
            held = weakref.ref(block)
            yield block
            del block
            gc.collect()
            assert held() is None

    monkeypatch.setattr(decontam, "_blocks", blocks)
    assert decontam.contamination(docs, docs).filter("n_items = 3").count() >= 2


def test_phrases_and_proximity_by_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["the"] * 20
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 80))) for _ in range(120)]
    tests = [" ".join(r.choices(vocabulary, k=r.randrange(1, 6))) for _ in range(40)] + [" ".join(x.split()[:9]) for x in texts[:10]]
    got = {x["doc_id"]: (x["items"], x["near_items"], x["n_hit"]) for x in decontam.contamination(spark.createDataFrame(list(enumerate(texts)), SCHEMA), spark.createDataFrame(list(enumerate(tests)), "item_id long, text string"), size=3, proximity=(2, 4)).collect()}
    often = {}
    for w in " ".join(texts).split():
        often[w] = often.get(w, 0) + 1
    for d, text in enumerate(texts):
        w = text.split()
        items, near, hit = set(), set(), set()
        for i, test in enumerate(tests):
            x = test.split()
            for k in range(max(1, len(x) - 2) if x else 0):
                part = x[k : k + 3]
                for at in range(len(w) - len(part) + 1):
                    if w[at : at + len(part)] == part:
                        items.add(str(i))
                        hit.update(range(at, at + len(part)))
            rare = sorted({y for y in x if y in often}, key=lambda y: (often[y], y))[:2]
            if len(rare) == 2 and any(w[p] == rare[0] and rare[1] in w[max(0, p - 4) : p + 5] for p in range(len(w))):
                near.add(str(i))
        assert got[d] == (sorted(items), sorted(near), len(hit))


def test_minhash(docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    by_id = {}
    for (d, _), v in got.items():
        by_id[d] = v
    assert by_id[1] == (1, True) and by_id[2] == (1, False) and by_id[3] == (1, False) and by_id[4] == (1, False)
    assert by_id[5] == (5, True) and by_id[6] == (6, True) and by_id[7] == (7, True) and by_id[8] == (7, False) and by_id[11] == (11, True)
    assert minhash.near_duplicates(docs).count() == len(ROWS)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.dedup_documents(docs).columns == docs.columns


def test_line_dedup(spark, docs, empty):
    long = "a line that is long enough to be compared with others, word by word"
    rows = [(1, f"{long}\nshort\n\nunique content of the first one"), (2, f"{long}.\nshort\n\n{long}"), (3, None), (4, ""), (5, f"  {long}  ")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (rows[0][1], 4, 0), 2: ("short\n", 4, 2), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("", 1, 1)}
    assert linededup.dedup_lines(docs).count() == len(ROWS)
    assert linededup.dedup_lines(empty).count() == 0


def near_lines(lines):
    """The components of equal or near lines, by brute force."""
    sets = {x: {x[k : k + linededup.SHINGLE] for k in range(len(x) - linededup.SHINGLE + 1)} for x in set(lines)}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= linededup.THRESHOLD * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    return {x: find(x) for x in sets}


def stays(lines):
    part, seen = near_lines(lines), set()
    return [part[x] not in seen and not seen.add(part[x]) for x in lines]


def lines_kept(spark, lines):
    rows = linededup.dedup_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], SCHEMA)).collect()
    return [r["n_dropped"] == 0 for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_line_dedup_short_and_unbroken(spark):
    r = random.Random(11)
    kanji = [chr(0x4E00 + k) for k in range(600)]
    made = []
    for k in range(40):
        made.append(" ".join(r.choice(WORDS) + str(r.randrange(100, 999)) for _ in range(2 + k % 4)) + " number 7")
        made.append("".join(r.choices(kanji, k=20 + k)))
        made.append("https://example.org/" + "".join(r.choices("abcdefghij", k=20 + k)))
        made.append("\t".join(r.choice(WORDS) + str(r.randrange(100, 999)) for _ in range(4 + k % 20)))
        made.append(" ".join(r.choice(WORDS) + str(r.randrange(100, 999)) for _ in range(8 + k % 16)))
    made = [x for x in made if len(x) >= 16]  # one changed end of shorter lines is no near copy
    lines = made + [x[:-1] + "Z" for x in made] + ["Z" + x[1:] for x in made]
    want = stays(lines)
    assert sum(not x for x in want) > len(made)
    assert lines_kept(spark, lines) == want


def test_line_dedup_common_passage(spark, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", 16)
    r = random.Random(12)
    word = lambda: r.choice(WORDS) + r.choice(WORDS)
    head = " ".join(word() for _ in range(50))
    lines = [f"{head} " + " ".join(word() + str(r.randrange(100, 999)) for _ in range(r.randrange(25, 50))) for _ in range(150)]
    lines += [x.rsplit(" ", 1)[0] + f" {word()}" for x in lines[:100]]
    want = stays(lines)
    assert 90 < sum(not x for x in want) < 150
    assert lines_kept(spark, lines) == want


def test_sharding(docs, empty, spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 9).cast("int"))).alias("text"))
    rows = sharding.digests(many).collect()
    size, slots = {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 4000 and set(size) == set(range(8)) and max(size.values()) - min(size.values()) < 200
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.digests(docs).count() == len(ROWS) and sharding.digests(empty).count() == 0


def test_secrets(spark, docs, empty):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
    rows = [(1, "password=abcdef x token = short"), (2, "é AKIA" + "A" * 16 + f" {key} https://db.example.com/x"), (3, "0123456789abcdef01234567 z"), (4, f"{key} alone"), (5, None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "assign:0:15", 2: f"access:2:22,key:23:{23 + len(key)},endpoint:{24 + len(key)}:{24 + len(key) + 24}", 3: "hex:0:24", 4: "", 5: ""}
    assert secrets.digests(docs).count() == len(ROWS) and secrets.digests(empty).count() == 0


def test_url_filter(spark):
    log = [("domain", "Example.net", "spam", "add", "2024-01-05"), ("domain", "example.net", "spam", "remove", "2024-01-10"), ("prefix", "a.org/x", "bad", "add", "2024-01-01"), (None, "b", "c", "add", "2024-01-01")]
    entries = spark.createDataFrame(log, "kind string, pattern string, category string, action string, at string").withColumn("at", F.col("at").cast("date"))
    seen = [(1, "http://www.A.example.net/p", "2024-01-04"), (2, "http://a.example.net/p", "2024-01-05"), (3, "http://a.example.net", "2024-01-10"), (4, "https://a.org/x/y?q", "2024-01-02"), (5, None, "2024-01-06"), (6, "junk", "2024-01-06"), (7, "http://example.net/", None)]
    captures = spark.createDataFrame(seen, "k int, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("date"))
    assert {r["k"]: len(r["matches"]) for r in urlfilter.active_entries(captures, entries).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0}
    assert urlfilter.active_entries(captures, entries.filter("false")).filter("size(matches) > 0").count() == 0


def test_url_filter_deep_and_www(spark):
    log = [("prefix", "deep.org/a/b/c/d", "x"), ("prefix", "WWW.deep.org/a/b/c/d/e/", "y"), ("host", "www.other.net", "z"), ("domain", "www.third.net", "w"), ("prefix", "four.org//q", "v"), ("prefix", "bare.org", "u")]
    entries = spark.createDataFrame([(*r, "add", "2024-01-01") for r in log], "kind string, pattern string, category string, action string, at string").withColumn("at", F.col("at").cast("date"))
    seen = [(1, "http://deep.org/a/b/c/d/e/f/g"), (2, "http://deep.org/a/b/c/dd"), (3, "http://www.other.net/"), (4, "http://other.net/p"), (5, "http://sub.third.net/"), (6, "http://four.org/q/r"), (7, "http://deep.org/a/b//c/d"), (8, "http://bare.org/p"), (9, "http://bare.org")]
    captures = spark.createDataFrame(seen, "k int, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    got = {r["k"]: "".join(sorted(m["category"] for m in r["matches"])) for r in urlfilter.active_entries(captures, entries).collect()}
    assert got == {1: "xy", 2: "", 3: "z", 4: "z", 5: "w", 6: "v", 7: "x", 8: "u", 9: "u"}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * 0.25).tolist(), int(i % 3)) for i in range(300)] + [(300 + i, base[0].tolist(), 0) for i in range(20)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [None] + [1.0] * 15, 1), (403, [float("nan")] + [1.0] * 15, 1), (404, base[0].tolist(), None)]
    got = {r["vec_id"]: tuple(r) for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=64).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in rows if i < 400]
    links, root = dict.fromkeys(got, 0), {i: i for i in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v, lab in good:
        for j, w, other in good:
            if i < j and lab == other and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (i, links[i], find(i), find(i) == i) for i in got} and sum(links.values()) > 500
    assert embdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def cosine_groups(rows):
    """n_links and component by id, by brute force; vectors are scaled by their greatest component."""
    good = [(i, np.array(v) / np.abs(v).max(), lab) for i, v, lab in rows]
    links, root = dict.fromkeys((i for i, *_ in good), 0), {i: i for i, *_ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v, lab in good:
        for j, w, other in good:
            if i < j and lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (i, links[i], find(i), find(i) == i) for i in root}


EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def test_embeddings_of_several_dimensions_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "WIDE", 20)  # 24 dimensions are ordered by variance only
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=d) * 0.2 + base).tolist(), 0) for d in (3, 7, 24) for i, base in zip(range(d * 1000, d * 1000 + 60), np.repeat(rng.normal(size=(6, d)), 10, axis=0), strict=True)]
    tiny, huge = [1e-200, 1e-200, 0.0], [1e200, 1e200, 1e190]
    rows += [(1, tiny, 1), (2, huge, 1), (3, [5.0, 5.0, 0.0], 1), (4, [-1e-300, 0.0, 0.0], 1), (5, [-1e300, 0.0, 1.0], 1)]
    got = {r["vec_id"]: tuple(r) for r in embdedup.near_duplicates(spark.createDataFrame(rows, EMBEDDINGS), tile=4).collect()}
    assert got == cosine_groups(rows)
    assert got[2][2] == 1 and got[3][1] == 2 and got[5][2] == 4


def test_embeddings_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (3, [0.01, 1.0], 0), (None, a, 0), (4, [], 0), (5, [-0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, EMBEDDINGS).withColumns({"node": F.lit("x"), "width": F.lit(1), "vector": F.lit(2)})
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embdedup.near_duplicates(table).collect())
    # Through the two vectors of row 1, 2 and 3 are of one component.
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 1), ("4", 0, 4), ("5", 0, 5), ("None", 0, None)]


def test_embedding_tiles_meet_near_ones_only(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "BLOCK", 1)
    rng = np.random.default_rng(4)
    common = 3 * rng.normal(size=32)  # all vectors share a direction, as real ones do
    shown, plane = [], rng.normal(size=(3, 32))
    for n in (40, 160):
        centres = rng.normal(size=(n, 3)) @ plane
        rows = [(i, (common + centres[i % n] * 2 + rng.normal(size=32) * 0.05).tolist(), 0) for i in range(n * 20)]
        classes = spark.createDataFrame(rows, EMBEDDINGS).select("label", F.size("embedding").alias("width"), F.col("vec_id").alias("node"), F.lit(1).alias("copies"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        tiled = embdedup._tiles(embdedup._placed(classes, embdedup._frames(classes)), 8).cache()
        tiles = tiled.select("tile").distinct().count()
        shown.append((tiles, embdedup._meets(tiled, 0.93).count()))
        tiled.unpersist()
    (few, near), (many, more) = shown
    assert more < 0.4 * many * (many + 1) / 2 and more / near < 0.8 * (many / few) ** 2, shown


def labelled(spark, bad):
    rows = [(i, prose(60, i) if i % 2 else bad(i), int(i % 2)) for i in range(300)]
    return spark.createDataFrame([r[:2] for r in rows], SCHEMA), spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in rows], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, empty):
    texts, labels = labelled(spark, lambda i: f"{prose(40, i)} vilework{i % 7} you m0r0n {prose(10, i)}")
    lexicon = toxicity.fit(texts, labels, F.col("doc_id") % 5 != 0)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(texts, lexicon).collect()}
    assert out == {i: int(i % 2 == 0) for i in range(300)}
    assert lexicon.matches("ІDІОT") and lexicon.matches("1d10t!") and not lexicon.matches("covidiot")
    assert toxicity.Lexicon({"trash": 2.0}).matches("a trash can, trash") == [(13, 18, 2.0)]
    assert toxicity.score(docs, lexicon).count() == len(ROWS) and toxicity.score(empty, lexicon).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, lexicon).collect())


def test_quality(spark, docs, empty):
    texts, labels = labelled(spark, lambda i: " ".join([random.choice(WORDS)] * 80) if i % 4 else " | ".join(prose(60, i).split()))
    network = quality.fit(texts, labels, F.col("doc_id") % 3 != 1)
    out = {r["doc_id"]: r["predicted"] for r in quality.score(texts, network).collect()}
    assert sum(out[i] == i % 2 for i in range(300)) >= 295
    assert quality.score(docs, network).count() == len(ROWS) and quality.score(empty, network).count() == 0
    assert quality.accepted(docs, network).columns == docs.columns
