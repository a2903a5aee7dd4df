"""Toxicity, quality, secrets, sharding and the pipeline's stages against plain Python."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BASE, ROWS, SCHEMA, WORDS, prose

from parley.llm import decontam, linededup, minhash, packing, quality, secrets, sharding, toxicity, urlfilter
from parley.llm.scratch import Scratch, shared_dir

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir(LARGER), reason="the test tables are not here")
LONG = prose(30_000, 9)


def auc(rows):
    """The share of pairs of a 1 and a 0 that the score puts in order."""
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


@needs_tables
@pytest.mark.parametrize(("name", "column", "least"), [("op1_toxicity", "toxic", 0.95), ("op2_quality", "quality", 0.95)])
def test_held_out_labels(spark, name, column, least):
    from parley.llm.queries import queries

    out = queries()[name](spark, LARGER).filter("held_out")
    rows = out.join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").select("score", column).dropna().collect()
    assert len(rows) > 30 and 0 < sum(r[1] for r in rows) < len(rows)
    assert auc([tuple(r) for r in rows]) >= least


@needs_tables
def test_toxicity_is_the_same_again(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), F.col("doc_id") % 5 != 0)
    assert first.weights == again.weights and np.allclose(first.score, again.score, rtol=1e-9)


def matched(lexicon, text):
    """Matches by trying every place and every stem."""
    low = toxicity.lowered(text)
    plain = toxicity.folded(low)
    begins = [i for i in range(len(low)) if i == 0 or not low[i - 1].isalnum()]
    quiet = [(i, i + len(p)) for p in lexicon.exceptions for i in begins if plain.startswith(toxicity.folded(p), i)]
    out = []
    for i in begins:
        stems = [s for s in lexicon.weights if plain.startswith(s, i)]
        if stems and not any(a <= i and i + len(max(stems, key=len)) <= b for a, b in quiet):
            stem = max(stems, key=len)
            out.append((i, i + len(stem), lexicon.weights[stem]))
    return out


def test_matcher():
    r = random.Random(1)
    stems = {toxicity.folded(w): 1.0 + i for i, w in enumerate(("idiot", "idio", "trash", "scum", "loser", "vil3", "a"))}
    lexicon = toxicity.Lexicon(stems)
    parts = ["idiot", "1d10t", "ІDІОT", "idiotic", "xidiot", "trash can", "trash", "good loser", "loser", "ＳＣＵＭ", "sc", "vile", "a", "A,", "ß", "İ", "é", " ", "-", "!", "\n", "clown"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice([" ", "", "."]) for _ in range(r.randrange(0, 25)))
        assert lexicon.matches(text) == matched(lexicon, text), text
    assert lexicon.matches(None) == lexicon.matches("") == []
    assert len(lexicon.matches("idiot " * 50_000)) == 50_000


def test_attention_forward_pass():
    r = np.random.default_rng(5)
    bags = [[r.normal(size=quality.MEASURES).tolist() for _ in range(n)] for n in (1, 3, 2, 40)]
    net = quality.train(bags, np.array([1.0, 0.0, 1.0, 0.0]))
    w = net.weights
    for bag, got in zip(bags, net.scores(bags), strict=True):
        raw, hidden = [], []
        for x in bag:
            h = np.tanh(((np.array(x) - net.mean) / net.scale) @ w["encode"] + w["encode_bias"])
            raw.append(float((np.tanh(h @ w["tanh"]) * (1 / (1 + np.exp(-(h @ w["sigm"]))))) @ w["attend"]))
            hidden.append(h)
        a = np.exp(raw) / np.exp(raw).sum()
        z = sum(p * h for p, h in zip(a, hidden, strict=True))
        assert abs(got - 1 / (1 + np.exp(-float(z @ w["score"] + w["score_bias"][0])))) < 1e-9


def test_quality_slopes():
    r = np.random.default_rng(6)
    bags = [[r.normal(size=quality.MEASURES).tolist() for _ in range(n)] for n in (2, 1, 4)]
    y = np.array([1.0, 0.0, 1.0])
    first = quality.train(bags, y)
    loss = lambda net: -np.mean([np.log(p if t else 1 - p) for p, t in zip(net.scores(bags), y, strict=True)])
    assert loss(first) < 0.05  # it learns what it saw


def found_secrets(text):
    """Base spans, and weak parts that have a complement near them, by trying all pairs."""
    text = text or ""
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "identifier": secrets.IDENTIFIER, "key": secrets.KEY, "endpoint": secrets.ENDPOINT}
    spans = [(m.start(), kind, m.end()) for kind, p in patterns.items() for m in re.finditer(p, text) if kind != "assign" or len(m[2]) >= 6]
    keep = []
    for s, kind, e in spans:
        others = secrets.COMPLEMENT.get(kind)
        if not others or any(k in others and 0 <= max(a - e, s - b) <= secrets.SCOPE for a, k, b in spans):
            keep.append((s, secrets.KINDS.index(kind), e))
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(keep))


def test_multipart_credentials(spark):
    r = random.Random(8)
    key = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n - 3)) + "aZ7"
    parts = [lambda: f'"username": "bob{r.randrange(99)}x"', lambda: "login = alice", lambda: key(24), lambda: key(300), lambda: "https://db.example.com/x", lambda: "postgres://h:5/d", lambda: "AKIA" + "Q" * 16, lambda: "f" * 30, lambda: "password: hunter22", lambda: "token = abc"]
    fill = lambda: " ".join(r.choices(WORDS, k=r.randrange(0, 70)))
    rows = [(i, f"{fill()} " + " ".join(f"{r.choice(parts)()} {fill()}" for _ in range(r.randrange(0, 6)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, f"user = bobby {key(400)}"), (903, f"{key(30)} " + "x " * 90 + "user = bobby"), (904, f"{key(30)} " + "x " * 110 + "user = bobby"), (905, LONG + " login = carol " + key(40))]
    got = {x["doc_id"]: x["spans"] for x in secrets.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: found_secrets(t) for i, t in rows}
    assert got == want
    assert "identifier" in want[902] and "identifier" in want[903] and want[904] == "" and sum("identifier" in x for x in want.values()) > 20


def test_equal_texts_share_a_shard(spark):
    r = random.Random(4)
    texts = [prose(r.randrange(3, 60), i) for i in range(120)] + [None, ""]
    rows = [(i, r.choice(texts)) for i in range(1500)]
    placed = {}
    sizes = [0] * 8
    for x in sharding.digests(spark.createDataFrame(rows, SCHEMA)).collect():
        placed.setdefault(rows[x["doc_id"]][1], set()).add(x["shard"])
        sizes[x["shard"]] += x["size"]
    want = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert sum(sizes) == want and max(sizes) - min(sizes) < 0.01 * want
    # A boundary may cut one text's rows, where keeping them whole would miss the tolerance.
    assert sum(len(s) > 1 for s in placed.values()) <= 7
    even = [(i, f"{i // 2:06d}") for i in range(1600)]
    of = {}
    for x in sharding.digests(spark.createDataFrame(even, SCHEMA)).collect():
        of.setdefault(x["doc_id"] // 2, set()).add(x["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 7


def test_sharding_replaces_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", 99, "x"), (2, "bb", 98, "y")], "doc_id long, text string, size int, shard string")
    out = {r["doc_id"]: (r["size"], r["slot"] >= 0) for r in sharding.shard_documents(rows, 2).collect()}
    assert out == {1: (2, True), 2: (3, True)}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [t for _, t in ROWS] + [LONG, LONG + " ban", f"{BASE}\n{BASE}"]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None), (None, texts[0], "en", "s", 0), (None, None, "en", "s", 0)], COLUMNS)


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    import corpus_pipeline as p

    ids = [r["doc_id"] for r in corpus.filter("doc_id is not null").distinct().collect()]
    spark.createDataFrame([(d, d % 2, 0) for d in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(BASE.split()[20:40])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in p.STAGES:
        out = stage(spark, corpus, str(tmp_path))
        none = stage(spark, corpus.filter("false"), str(tmp_path))
        assert none.count() == 0
        if stage is not p.token_packing:
            assert out.columns == corpus.columns == none.columns and out.count() <= corpus.count()


def test_near_dedup_stage(spark, corpus):
    import corpus_pipeline as p

    kept = p.minhash_dedup(spark, corpus, "").collect()
    rows = corpus.collect()
    gram = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for k in range(max(1, len(w) - 4)) if w}
    sets = {r["doc_id"]: gram(r["text"]) for r in rows if r["doc_id"] is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({find(d) for d in sets})
    # Without an id, one row of each text.
    assert sorted(str(r["text"])[:9] for r in kept if r["doc_id"] is None) == sorted({str(r["text"])[:9] for r in rows if r["doc_id"] is None})


def test_decontamination_stage(spark, corpus, tmp_path):
    import corpus_pipeline as p

    item = " ".join(BASE.split()[20:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = p.benchmark_decontamination(spark, corpus, str(tmp_path)).collect()
    window = decontam.words(item.encode())

    def bad(text):
        w, hit = decontam.words(text.encode() if text else None), set()
        for k in range(len(window) - 12):
            for at in range(len(w) - 12):
                if w[at : at + 13] == window[k : k + 13]:
                    hit.update(range(at, at + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sorted(map(str, kept)) == sorted(str(r) for r in corpus.collect() if not bad(r["text"]))


def test_packing_stage(spark, corpus):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    out = p.token_packing(spark, corpus, "").collect()
    whole = packing.pack(corpus, p.tokenizer_path(), with_ids=True).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in out) == sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in whole)
    spans = {}
    for r in out:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(spans) == list(range(len(spans))) and all(sum(n for _, n in s) == 1024 for k, s in spans.items() if k < max(spans))


def test_line_stage_drops_emptied_documents_only(spark, corpus):
    import corpus_pipeline as p

    out = p.line_dedup(spark, corpus, "").collect()
    lost = {r["doc_id"] for r in corpus.collect()} - {r["doc_id"] for r in out}
    whole = {r["doc_id"]: r for r in linededup.dedup_lines(corpus).collect()}
    assert lost == {d for d in lost if whole[d]["n_dropped"] > 0 and not (whole[d]["text"] or "").strip()}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in out)


def test_minhash_recall_at_the_threshold(spark):
    r = random.Random(2)
    rows, pairs = [], 0
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    while pairs < 150:
        w = [r.choice(WORDS) + str(r.randrange(1000)) for _ in range(r.randrange(60, 200))]
        v = list(w)
        for at in r.sample(range(len(v)), max(1, len(v) // 32)):
            v[at] = "changed" + str(r.randrange(10**6))
        a, b = grams(w), grams(v)
        if 0.75 <= len(a & b) / len(a | b) < 0.80:
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(v))]
            pairs += 1
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[d] in (d, d - d % 2) for d, _ in rows)
    assert sum(got[2 * k + 1] == 2 * k for k in range(pairs)) >= 0.99 * pairs


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError):
        shared_dir(Session())
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    scratch = Scratch(spark)
    assert scratch.save(spark.range(3), "x").count() == 3
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_passages_to_fit_on():
    bag = [[float(k)] for k in range(1000)]
    some = quality.spread(bag, 10)
    assert len(some) == 10 and some[0] == [0.0] and some[-1] == [999.0] and quality.spread(bag[:10], 10) == bag[:10]


def test_lines_on_odd_rows(spark):
    line, digits = "the quick brown fox jumps over the lazy dog again and again", "".join(map(str, range(40_000)))
    rows = [(1, f"{line}\r\nother words of a first text here"), (1, f"\u3000{line}\t\nyet other words, of a second one"), (2, line), (None, f"{line}\nsomething only the nameless one says"), (3, digits), (4, digits[:-10] + "y" * 10), (6, "x" * 200_000), (7, "x" * 199_990 + "y" * 10), (5, "\n" * 5000)]
    table = spark.createDataFrame([(*r, 7, "n") for r in rows], "doc_id long, text string, n_lines int, h string")
    out = linededup.dedup_lines(table).collect()
    assert len(out) == len(rows) and {r["h"] for r in out} == {"n"}
    dropped = {(r["doc_id"], r["n_lines"]): r["n_dropped"] for r in out if r["doc_id"] not in (1, None)}
    # Of a letter repeated there is one shingle, so ten others make another line.
    assert dropped == {(2, 1): 1, (3, 1): 0, (4, 1): 1, (5, 5001): 0, (6, 1): 0, (7, 1): 0}
    # A null id comes first of all; both texts of id 1 lose the line.
    assert [r["n_dropped"] for r in out if r["doc_id"] is None] == [0] and sorted(r["n_dropped"] for r in out if r["doc_id"] == 1) == [1, 1]


def test_url_filter_on_odd_rows(spark):
    entries = spark.createDataFrame([("host", "a.org", None, "add", "2024-01-01"), ("host", None, "x", "add", "2024-01-01"), ("host", "a.org", "x", None, "2024-01-01"), ("host", "a.org", "x", "add", None), ("host", "a.org", "y", "add", "2024-01-01"), ("host", "a.org", "y", "add", "2024-01-01")], "kind string, pattern string, category string, action string, at string").withColumn("at", F.col("at").cast("date"))
    seen = spark.createDataFrame([(1, "http://a.org/" + "p/" * 3000, "old"), (2, "http://a.org", "old"), (2, "http://a.org", "old"), (3, "", None), (4, "http:///x", None)], "k int, url string, matches string").withColumn("fetched_at", F.lit("2024-02-01").cast("date"))
    out = urlfilter.active_entries(seen.repartition(3), entries).collect()
    assert sorted((r["k"], [m["category"] for m in r["matches"]]) for r in out) == [(1, ["y"]), (2, ["y"]), (2, ["y"]), (3, []), (4, [])]
    assert urlfilter.active_entries(seen.filter("false"), entries).count() == 0


def test_very_long_texts(spark):
    rows = spark.createDataFrame([(1, LONG * 4), (2, LONG * 4 + " ban"), (3, "z" * 1_000_000), (4, "é " * 300_000)], SCHEMA)
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(rows, toxicity.Lexicon({"ban": 2.0})).collect())
    net = quality.train([quality.passages("a b c"), quality.passages("| | |")], np.array([1.0, 0.0]))
    assert quality.score(rows, net).count() == 4
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[500:540]))], "item_id long, text string")
    assert {r["doc_id"]: r["n_items"] for r in decontam.contamination(rows, bench).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert sharding.digests(rows).count() == secrets.digests(rows).count() == linededup.dedup_lines(rows).count() == 4
