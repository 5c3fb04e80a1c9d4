"""The training-data operators against brute force, and their defined cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgewren.llm import ann, bpe, common, fingerprint, graph, licences, mixing, neardup, quality, queries, shingles, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, copies and repeated rows, and clashing columns."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 48), (2, text.upper(), "en", "a", 48), (3, None, None, None, None), (4, "", "de", "b", 0), (5, " \n\t", "de", "b", 3), (6, LONG, "fr", "c", len(LONG)), (6, LONG, "fr", "c", len(LONG)), (7, "x" * 5000, "en", "c", 5000), (8, "nul\x00l 　漢字 😀", None, "a", 9), (None, text, "en", "b", 48)]
    extra = spark.createDataFrame(rows, DOCS)
    for c in ("n_tokens", "token_ids", "score", "predicted", "size", "target", "taken", "key", "bands", "fingerprint", "held_out", "part", "row", "label", "kept"):
        extra = extra.withColumn(c, F.lit("mine"))
    return extra


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(tokenizer):
    codec = bpe.Codec(open(queries.tokenizer_path(), encoding="utf-8").read())
    texts = ["", " ", "a<|endoftext|>b", "\x1c\x1d a\x85b", "don't we'll I'M", "x" * 3000, "abc" * 900 + "é" * 50, "漢字  　 𝔘𝔫 😀😀", "\n\n\n  a", "a​b  x 12½ ¾", LONG]
    for text in texts:
        ids = codec.encode(text)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    codec = bpe.Codec(open(queries.tokenizer_path(), encoding="utf-8").read())
    rng = np.random.default_rng(1)
    for _ in range(20):
        ids = [codec.of_byte[b] for b in rng.choice(list(b"aeinrst"), 300)]
        assert codec.merged(list(ids)) == codec._merged_long(list(ids))


def test_bpe_query(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = queries.op1_bpe(spark, DATA).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_cases(odd, none):
    out = bpe.decode(bpe.encode(odd, queries.tokenizer_path()), queries.tokenizer_path())
    assert out.columns.count("n_tokens") == 1
    for r in out.collect():
        assert r["decoded_text"] == (r["text"] or "") and r["n_tokens"] == len(r["token_ids"]) // 4 and r["label"] == "mine"
    assert bpe.encode(none, queries.tokenizer_path()).count() == 0


def brute_components(rows, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_minhash(spark, DATA).collect()}
    assert got == brute_components(zip(docs.doc_id, docs.text), 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_in_large_groups(spark, percent, monkeypatch):
    """Groups beyond a block: chains and clouds around one text, so that stars, blocks and both kinds of groups are used."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, percent)
    for whole in (64 * 8, 10):
        monkeypatch.setattr(neardup, "WHOLE_GROUP", whole)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, percent).collect()}
        assert got == want


def test_classes_of_one_part_do_not_meet_again(spark, monkeypatch):
    """All classes of different parts of a group meet, each pair once; a large part with an outlier costs little more than its rows."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    parts = {0: [1] * 1600 + [2], 1: [3] * 50, 2: [4] * 40 + [5] * 9 + [6] * 7 + [7, 8, 9] * 3 + list(range(100, 130))}
    rows, cid = [], 0
    for g, held in parts.items():
        for part in held:
            rows.append((g, cid, part))
            cid += 1
    placed = spark.createDataFrame(rows, "g long, cid long, part long").select(F.struct(F.lit(0).alias("kind"), F.col("g").alias("id")).alias("g"), "cid", "part")
    blocks: dict = {}
    for r in neardup._across(placed).collect():
        blocks.setdefault((r["block"]["g"]["id"], r["block"]["i"], r["block"]["j"]), []).append(r)
    met = Counter()
    for (g, *_), held in blocks.items():
        for x, a in enumerate(held):
            for b in held[:x]:
                if a["part"] != b["part"] and (a["inside"] or a["side"] != b["side"]):
                    met[g, min(a["cid"], b["cid"]), max(a["cid"], b["cid"])] += 1
    want = {(g, min(a, b), max(a, b)) for i, (g, a, p) in enumerate(rows) for h, b, q in rows[:i] if g == h and p != q}
    assert met.keys() == want and set(met.values()) == {1}
    assert sum(len(held) for (g, *_), held in blocks.items() if g == 0) <= 1600 + 100 + 2
    assert not any(g == 1 for g, *_ in blocks)


def test_near_duplicates_cases(spark, odd, none):
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 7, True), (8, 8, True)]
    assert [x for x in got if x[0] is None] == [(None, 1, False)]
    assert neardup.near_duplicates(none).count() == 0


def test_sketches_are_full_and_estimate_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    s = neardup.sketches([a, b, a[:1], a[:3]])
    assert not (s == neardup.EMPTY).any()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert len(np.unique(s[2])) == neardup.BINS or len(s[2]) == neardup.BINS


def test_block_intersections():
    rng = np.random.default_rng(6)
    for n, m in ((3, 50), (40, 30)):
        sets = [np.unique(rng.integers(0, 200, m).astype(np.uint64)) for _ in range(n)]
        got = neardup.intersections(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(links.limit(0)).count() == 0


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = queries.op3_mixing(spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and (got["size"] == [len(t.encode().split()) for t in got.text]).all()
    sums = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.told).all() and abs(sums.target.sum() - sums["size"].sum()) < 1e-6
    names = sorted(sums.index, key=str.encode)
    want = share_out([int(sums["size"][n]) for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], int(sums["size"].sum()), 3)
    assert np.allclose([sums.target[n] for n in names], want)
    assert (got.taken <= 3 * got["size"]).all() and (abs(sums.taken - sums.target) <= np.maximum(30, 0.05 * sums.target)).all()
    again = queries.op3_mixing(spark, DATA).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, got[again.columns].values.tolist()))


def nearest_sum(lengths, counts, budget):
    """Of all sums of any choice, the distance of the nearest one."""
    sums = {0}
    for n, k in zip(lengths.tolist(), counts.tolist()):
        sums = {s + n * j for s in sums for j in range(k + 1)}
    return min(abs(s - budget) for s in sums)


def test_budget_fit_is_exact_where_it_can_be():
    rng = np.random.default_rng(2)
    cases = [(np.array([57_178, 356_927]), np.array([3, 1]), 405_564), (np.array([8, 24]), np.array([3, 1]), 32)]
    for _ in range(60):
        lengths = np.unique(rng.integers(1, int(rng.choice([60, 3000, 500_000])), 8))
        counts = rng.integers(1, 4, len(lengths))
        cases.append((lengths, counts, int(rng.integers(0, int((lengths * counts).sum()) + 1))))
    for lengths, counts, budget in cases:
        chosen = mixing.fit(lengths, counts, budget)
        assert ((chosen >= 0) & (chosen <= counts)).all()
        assert abs(int((chosen * lengths).sum()) - budget) == nearest_sum(lengths, counts, budget)


def test_budget_fit_of_many_documents_is_near():
    rng = np.random.default_rng(8)
    for scale in (300, 20_000):
        lengths = np.unique(rng.integers(5, scale, 2500))
        counts = rng.integers(1, 400, len(lengths))
        for share in (0.02, 0.37, 0.9):
            budget = int((lengths * counts).sum() * share)
            chosen = mixing.fit(lengths, counts, budget)
            assert ((chosen >= 0) & (chosen <= counts)).all() and abs(int((chosen * lengths).sum()) - budget) <= lengths.min()


def share_out(sizes, weights, total, most):
    """Shares by weight that stop at a multiple of the size, the excess going to the others, one list at a time."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        over = [i for i in open_ if left * weights[i] / sum(weights[j] for j in open_) > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / sum(weights[j] for j in open_)
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    return targets


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}é" if i % 7 else (None if i else "Z"): int(x) for i, x in enumerate(rng.integers(0, 10 ** rng.integers(1, 5), [1, 3, 40, 300][seed]))}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = mixing.shared_out(mixing.placed_sources(rows, "source"), [5, 2, 1], 3).orderBy("place").collect()
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    assert [r["source"] for r in got] == names and [r["place"] for r in got] == list(range(len(names)))
    assert np.allclose([r["target"] for r in got], share_out([sizes[n] for n in names], [[5, 2, 1][i % 3] for i in range(len(names))], sum(sizes.values()), 3))


def test_mixing_cases(spark, odd, none):
    clashing = [F.lit("mine").alias(c) for c in ("hash", "row", "place", "bucket", "_hash", "_size", "count", "rank")]
    docs = odd.select("doc_id", "source", mixing.word_count().alias("size"), "taken", *clashing)
    rows = mixing.mix(docs, "size", [5, 2, 1]).collect()
    assert all(r[c] == "mine" for r in rows for c in ("hash", "row", "place", "bucket", "_hash", "_size", "count", "rank"))
    assert len(rows) == 10 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["source"]: r["source_size"] for r in rows} == {"a": 23, "b": 10, "c": 60001, None: 0}
    assert mixing.mix(none.select("doc_id", "source", F.lit(0).alias("size")), "size", [5, 2, 1]).count() == 0


def test_mixing_splits_a_length_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"), F.lit(7).cast("long").alias("size"))
    got = mixing.mix(docs, "size", [5, 2]).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 7 for r in got)


def test_fingerprint_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    got = queries.op4_fingerprint(spark, DATA).toPandas().set_index("doc_id")
    for i, (d, text) in enumerate(zip(docs.doc_id, docs.text)):
        cut = len(text) // 2
        edited = text[: len(text) - cut] + docs.text[(i + 1) % len(docs)][:cut]
        assert got.edited_sha256[d] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[d] == len(text)
        assert (got.fingerprint[d] == got.edited_fingerprint[d]) == (got.near_edited[d] == 1.0)
    assert got.near_edited.mean() > got.near_next.mean() + 0.2


def test_fingerprints_collide_as_similar_as_bags_are():
    rng = np.random.default_rng(4)
    sampler, off = fingerprint.Sampler(), []
    weight = lambda n: 1 + np.log(n) if n else 0
    for _ in range(150):
        words = [b"t%d" % i for i in rng.zipf(1.5, 200) % 500]
        other = words[: rng.integers(0, 200)] + [b"u%d" % i for i in rng.integers(0, 500, 80)]
        a, b = b" ".join(words), b" ".join(other)
        x, y = Counter(a.split()), Counter(b.split())
        true = sum(min(weight(x[k]), weight(y[k])) for k in x | y) / sum(max(weight(x[k]), weight(y[k])) for k in x | y)
        f, g = sampler.fingerprints([a, b])
        off.append(np.mean([f[i : i + 4] == g[i : i + 4] for i in range(0, 4 * fingerprint.SAMPLES, 4)]) - true)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.09


def test_fingerprint_of_a_full_table(monkeypatch):
    texts = [b" ".join(b"w%d" % (i * j) for i in range(50)) for j in range(40)] + [b" ".join(b"x%d" % i for i in range(700))]
    want = fingerprint.Sampler().fingerprints(texts)
    monkeypatch.setattr(fingerprint, "CACHE_ROWS", 400)
    monkeypatch.setattr(fingerprint, "KEPT_ROWS", 100)
    assert fingerprint.Sampler().fingerprints(texts) == want


def test_fingerprint_cases(odd, none):
    rows = fingerprint.fingerprint(odd).collect()
    prints = [r["fingerprint"] for r in rows]
    assert prints[0] == prints[1] == prints[9] and prints[2] == prints[3] == prints[4] == "" and prints[5] == prints[6]
    paired = fingerprint.with_next(odd.select("doc_id", "text"), odd.select("doc_id"), ["text"]).collect()
    assert len(paired) == 10
    assert sorted((r["doc_id"] or 99, (r["text"] or "")[:4], (r["next_text"] or "")[:4]) for r in paired)[0] == (1, "one ", "ONE ")
    assert [(r["next_text"] or "")[:4] for r in paired if r["doc_id"] is None] == ["one "]
    assert [(r["next_text"] or "")[:4] for r in paired if r["doc_id"] == 8] == ["one "]
    assert fingerprint.with_next(none, none.select("doc_id"), ["text"]).count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "zero byte", "outlier", "equal", "date", "null"])
def test_next_rows_of_any_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(8)
    ids = [int(i) for i in rng.permutation(500)]
    if kind == "outlier":
        ids[7] = 10**18
    rows = [(i, f"t{i}", "mine", "mine") for i in ids]
    if kind == "equal":  # a third of the rows has one id, some of them with equal texts
        rows = [(250 if j % 3 == 0 else i, f"t{i // 4}", "mine", "mine") for j, (i, *_) in enumerate(rows)]
    if kind == "null":
        rows += [(None, f"n{j % 7}", "mine", "mine") for j in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket_ string, copy_ string").repartition(5)
    if kind == "string":
        docs = docs.withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id").cast("string")))
    if kind == "zero byte":
        docs = docs.withColumn("doc_id", F.concat(F.lit("a\x00"), F.col("doc_id").cast("string"), F.lit("\x00")))
    if kind == "date":
        docs = docs.withColumn("doc_id", F.date_add(F.lit("2001-01-01").cast("date"), F.col("doc_id").cast("int")))
    got = fingerprint.with_next(docs, docs.select("doc_id"), ["text"])
    assert got.columns == [*docs.columns, "next_text"]
    got = got.withColumn("tie", F.xxhash64("text")).collect()
    assert len(got) == len(rows) and all(r["bucket_"] == r["copy_"] == "mine" for r in got)
    order = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: (r["doc_id"].encode() if kind in ("string", "zero byte") else r["doc_id"], r["tie"]))
    assert [r["next_text"] for r in order] == [r["text"] for r in order[1:] + order[:1]]
    assert {r["next_text"] for r in got if r["doc_id"] is None} <= {order[0]["text"]}


def test_toxicity(spark, odd, none):
    words = "red green blue house tree road walk slow fast over".split()
    rng, rows, labels = np.random.default_rng(7), [], []
    for i in range(600):
        text, toxic = list(rng.choice(words, 30)), i % 5 == 0
        if toxic:
            text[3] = ["idiot,", "blorkish", "blorkers"][i % 3]
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, marks).where(toxicity.held_out()).join(marks, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in out) and len(out) > 100
    scored = toxicity.score(odd, marks).collect()
    assert len(scored) == 10 and all(0 <= r["score"] <= 1 and r["label"] == "mine" for r in scored)
    assert toxicity.score(none, marks.limit(0)).count() == 0


def test_grammar_tags():
    g = toxicity.Grammar({"=idiot": 2.0, "blork" + toxicity.TWICE: 3.0})
    tags = lambda t: {k: -np.log(1 - v) for k, v in zip(toxicity.TAGS, g.features(t.encode())) if v}
    for text, want in (
        ("what an idiot!", {"plain": 2.0}), ("you are an idiot.", {"directed": 2.0}), ("idiot, that is what you are", {"directed": 2.0}), ("this is not an idiot.", {"negated": 2.0}),
        ("she said that he is an idiot.", {"reported": 2.0}), ("i will kill you", {"threat": 1.0}), ("he said i will kill you", {"reported": 1.0}), ("i will not kill you", {"negated": 1.0}),
        ("i kill time", {}), ("she said it. what an idiot", {"plain": 2.0}), ("one blorka", {}), ("blorka and blorkb", {"plain": 3.0}), ("idiot idiot", {"plain": 4.0}), ("", {}),
    ):
        assert tags(text) == pytest.approx(want), text
    assert not g.features(None).any()
    assert g.features(b"an idiot. an idiot.")[0] > g.features(b"an idiot idiot")[0]  # two clauses say more than one


def test_composition_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        def machine(inner, outer):
            arcs = {(int(q), int(x)): [(int(rng.integers(outer)), int(rng.integers(3))) for _ in range(rng.integers(3))] for q in range(3) for x in range(inner)}  # noqa: B023
            return toxicity.Transducer(0, {int(q) for q in rng.choice(3, 2)}, {k: v for k, v in arcs.items() if v})

        a, b = machine(2, 3), machine(3, 4)
        both = a.then(b).numbered()
        for word in itertools.product(range(2), repeat=4):
            want = sorted(z for y in a.written(list(word)) for z in b.written(y))
            assert sorted(both.written(list(word))) == want


def test_machine_has_one_path_and_tags_as_the_rules_say():
    t = toxicity
    machine = t.grammar()
    rng = np.random.default_rng(6)
    kinds = [0, 0, t.INSULT, t.HARM, t.INTENT, t.TARGET, t.NOT, t.SAY, t.INSULT | t.TARGET, t.HARM | t.INTENT]
    for _ in range(3000):
        clause = [int(x) for x in rng.choice(kinds, rng.integers(0, 9))]
        want = []
        for i, x in enumerate(clause):
            near = lambda bit: any(y & bit for y in clause[max(0, i - t.NEAR) : i + 1])  # noqa: E731, B023
            menace = x & t.HARM and near(t.INTENT)
            name = "reported" if any(y & t.SAY for y in clause[: i + 1]) else "negated" if near(t.NOT) else "threat" if menace else "directed" if any(y & t.TARGET for y in clause) else "plain"
            want.append(1 + t.TAGS.index(name) if x & t.INSULT or menace else 0)
        assert machine.written(clause) == [want]


def test_negated_and_reported_insults_decide_otherwise(spark):
    rng, filler = np.random.default_rng(2), "red green blue house tree road walk slow fast over".split()
    rows, labels = [], []
    frames = [("what an idiot", 1), ("you are an idiot", 1), ("this is not an idiot", 0), ("she said that is an idiot", 0), ("i will kill you", 1), ("we walk over", 0)]
    for i in range(900):
        frame, toxic = frames[i % len(frames)]
        words = [" ".join(rng.choice(filler, 8)) for _ in range(3)]
        rows.append((i, f"{words[0]}. {frame}. {words[1]}. {words[2]}."))
        labels.append((i, 1, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, marks).where(toxicity.held_out()).join(marks, "doc_id").collect()
    assert len(out) > 200 and all(r["predicted"] == r["toxic"] for r in out)


def test_toxicity_on_held_out_rows(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted[got.toxic == 0] == 0).mean() > 0.97 and (got.predicted[got.toxic == 1] == 1).mean() > 0.75


def test_quality(spark, odd, none):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert {r["quality_score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_cotraining_hands_over_labels():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 3000)
    a, b = (y[:, None] * 2.0 + rng.normal(size=(3000, 2)) for _ in range(2))
    free, left = [a[60:], b[60:]], np.ones(2940, bool)

    def surest(models):
        out = []
        for v in (0, 1):
            p = 1 / (1 + np.exp(-(free[v] @ models[v][0] + models[v][1])))
            found = [(side, i) for side, i in quality.extremes(np.where(left, p, 0.5), np.arange(len(p)))]
            out.append((free[1 - v][[i for _, i in found]], np.array([side for side, _ in found], float)))
        return out

    model = quality.cotrain([a[:60], b[:60]], y[:60].astype(float), surest)
    assert ((model.scores([a, b])[2] > 0.5) == y).mean() > 0.92


def test_surest_rows_of_a_table_equal_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(quality, "GIVEN", 7)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=quality.CONTENT)], int(rng.integers(32)), int(rng.integers(32)), None if k % 9 == 0 else float(rng.integers(0, 5000))) for k in rng.permutation(400)]
    pool = spark.createDataFrame(rows, "key long, a array<double>, lang int, source int, length double").repartition(4)
    models = [(rng.normal(size=quality.CONTENT) * 2, 0.1), (rng.normal(size=2 * quality.SLOTS + 4) * 3, -0.2)]
    surest, taken = quality._surest_of(pool), set()
    by_key = sorted(rows)
    x = quality._views([dict(zip(("key", "a", "lang", "source", "length"), r)) for r in by_key])
    chances = [1 / (1 + np.exp(-np.clip(x[v] @ models[v][0] + models[v][1], -35, 35))) for v in (0, 1)]
    for _ in range(3):
        got, now = surest(models), set()
        for v in (0, 1):
            order = [i for i in range(400) if i not in taken]
            good = [i for i in sorted(order, key=lambda i: (-chances[v][i], i)) if chances[v][i] >= quality.SURE][:7]  # noqa: B023
            bad = [i for i in sorted(order, key=lambda i: (chances[v][i], i)) if chances[v][i] <= 1 - quality.SURE][:7]  # noqa: B023
            assert got[v][1].tolist() == [1.0] * len(good) + [0.0] * len(bad) and np.allclose(got[v][0], x[1 - v][good + bad])
            now |= set(good + bad)
        assert now
        taken |= now


def test_licences(spark, odd, none):
    text = "Copyright (c) 2020 Some One\n\n" + licences.TEXTS["MIT"].replace("sublicense", "sublicence").upper()
    rows = [(1, text), (2, "Intro\n* Released under the MIT Licence.\nBody\nLicensed under CC BY-NC 4.0"), (3, licences.TEXTS["MIT"] + " more"), (4, None), (5, "SPDX-License-Identifier: ISC"), (6, "© 2001 Somebody")]
    got = {r["doc_id"]: (r["text_licence"], r["line_licences"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "CC-BY-NC-4.0,MIT"), 3: (None, ""), 4: (None, ""), 5: ("ISC", "ISC"), 6: (None, "")}
    assert licences.scan(odd).count() == 10 and licences.scan(none).count() == 0


def test_licences_as_published(spark):
    isc = """ISC License

Copyright (c) 2020 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + licences.TEXTS["ISC"].split("\n", 1)[1]
    names = "Apache-2.0 GPL-2 GPL-3 LGPL-2.1 LGPL-3 MPL-2.0 CC0-1.0".split()
    rows = [(n, open(f"/usr/share/common-licenses/{n}").read()) for n in names]
    rows += [("mit", "MIT License\n\nCopyright Some One\n\n" + licences.TEXTS["MIT"]), ("isc", isc), ("name", "MIT License\nmore")]
    got = {r["doc_id"]: (r["text_licence"], r["line_licences"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = {n: n + ".0" * ("." not in n) for n in names}
    assert {n: got[n][0] for n in names} == want
    assert got["mit"] == ("MIT", "MIT") and got["isc"] == ("ISC", "ISC") and got["name"] == (None, "MIT")


def test_licences_wrapped_and_headed():
    """Expected answers are written here, apart from the operator's table of digests; DuckDB runs the same SQL form."""
    import textwrap

    texts = {"MIT": licences.TEXTS["MIT"], "ISC": licences.TEXTS["ISC"], "BSD-2-Clause": licences.TEXTS["BSD-2-Clause"], "BSD-3-Clause": licences.TEXTS["BSD-3-Clause"], "0BSD": licences.TEXTS["0BSD"]}
    rows = []
    for name, text in texts.items():
        for width in (50, 60, 65, 72, 76, 78, 79, 80, 1000):
            body = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n"))
            for head in ("", "Copyright (c) 2020 Jane Doe\n\n", "Copyright 2020 Acme\n(c) 2021 Foo\n\n", f"{licences.NAMES.get(name, [name])[0]}\n\nCopyright (C) 2020, 2021 Jane\nAll rights reserved.\n\n"):
                rows.append((len(rows), name, head + body))
            rows.append((len(rows), None, body + "\n(c) commercial use is forbidden"))
            rows.append((len(rows), None, body + "\ncopyright holders may not be sued"))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, want varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = dict(con.execute(f"select doc_id, text_licence from ({licences.scan_sql()})").fetchall())
    assert all(got[i] == want for i, want, _ in rows)


def test_copyright_lines_and_others(spark):
    """Lines that change a licence are kept, and lines that only name holders go, in several wrappings; expected answers are written here."""
    import textwrap

    body = lambda name, width=1000: "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in licences.TEXTS[name].split("\n"))
    rows = []
    altering = [
        "Copyright infringement claims against the author void this grant.", "Copyright transfer to the vendor is required for any use.", "copyright assignment is required",
        "Copyright protected fonts are excluded from this permission.", "(c) 2 of the preceding clauses do not apply to companies.", "(c) commercial use is forbidden", "copyright holders may not be sued",
        "Copyright law of the vendor's country applies.", "Jane Doe may not use it", "(c) copyright assignments are required",
    ]
    for width in (40, 60, 76, 1000):
        for line in altering:
            for text in (f"{line}\n\n{body('MIT', width)}", f"{body('MIT', width)}\n{line}\n", f"MIT License\n\n{line}\n{body('MIT', width)}"):
                rows.append((None, text))
        heads = [
            "Copyright Andrew Lee", "Copyright Lawrence", "Copyright Holden", "Copyright Notix", "MIT License\n\nCopyright, The Regents of the University", "Copyright (c) 2020 Jane Doe,\n  Ann Lee and\n  Others", "Copyright (c) Andrew Lee",
            "(C) Copyright Ann Other", "© Ann Other", "The MIT License (MIT)\nhttps://opensource.org/licenses/MIT\n", "MIT License\r\n\r\nCopyright (c) 2019 by Jane\r\nCopyright Ann Lee\r\nCopyright Ann Poe", "# Copyright 1999-2020 jane doe <j@x.org>. All rights reserved.",
            "// (c) 2001, 2002 someone",
        ]
        for head in heads:
            rows.append(("MIT", f"{head}\n\n{body('MIT', width)}"))
        rows.append(("BSD-2-Clause", "Copyright 2001 X\n\n" + body("BSD-2-Clause", width).replace("\n1. ", "\n * ").replace("\n2. ", "\n * ")))
        rows.append(("BSD-3-Clause", "Copyright Ann Lee\n\n" + "\n".join(textwrap.wrap(licences.TEXTS["BSD-3-Clause"].replace("the name of the copyright holder", "the name of Ann Lee and Sons, Inc."), width))))
        rows.append((None, body("BSD-3-Clause", width).replace("without", "with")))
    numbered = [(i, text) for i, (_, text) in enumerate(rows)]
    got = {r["doc_id"]: r["text_licence"] for r in licences.scan(spark.createDataFrame(numbered, "doc_id long, text string")).collect()}
    wrong = [(want, got[i], text[:90]) for i, (want, text) in enumerate(rows) if got[i] != want]
    assert wrong == []
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", numbered)
    assert {i: x for i, _, x, _ in con.execute(licences.scan_sql()).fetchall()} == got


def test_licences_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(licences.scan_sql()).fetchall()
    assert sorted(map(tuple, queries.op6_licences(spark, DATA).collect()), key=str) == sorted(want, key=str)


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0]), (None, x[0].tolist()), (5050, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("id") % 50 == 0).toPandas()
    ids = np.array([*range(3000), 5050])
    full = np.r_[x, x[7:8]]
    u = full / np.linalg.norm(full, axis=1, keepdims=True)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, [s[list(ids).index(v)] for v in own.vec_id], atol=1e-12)
        hit, total = hit + len(set(own.vec_id) & set(ids[order])), total + 5
    assert hit / total >= 0.9
    few = ann.search(table.where("vec_id < 3"), F.col("id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert ann.search(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_search_finds_the_smallest_ids_of_many_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[rng.permutation(900)[:400]] = x[0]
    x[300:600] = rng.normal(size=16) * rng.uniform(0.5, 2, (300, 1))  # other vectors of equal codes
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[50].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("id") % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = [i for i in range(900) if (x[i] == x[0]).all()]
    for q in range(0, 900, 50):
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, np.sort(np.delete(u @ u[q], q))[::-1][:5], atol=1e-9)
        if q in same:
            assert own.vec_id.tolist() == sorted([i for i in same if i != q] + [50] * (50 in same and q != 50))[:5]


def test_search_of_extreme_and_unequal_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 8))
    scale = np.array([1e200, 1e-200, 1.0, 1e-310])[np.arange(400) % 4]
    rows = [(i, (v * s).tolist(), "mine", "mine") for i, (v, s) in enumerate(zip(x, scale))] + [(1000 + i, [float(i), 1.0], "mine", "mine") for i in range(0, 60, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, score string")
    got = ann.search(table, F.col("id") % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        own = got[got.query_id == q].sort_values("rank")
        assert np.isfinite(own.score).all() and np.allclose(own.score, [u[q] @ u[i] for i in own.vec_id], atol=1e-6)
        hit += len(set(own.vec_id) & set(np.argsort(-np.delete(u @ u[q], q, 0))[:5] + (np.argsort(-np.delete(u @ u[q], q, 0))[:5] >= q)))
    assert hit >= 0.9 * 40
    assert sorted(got[got.query_id == 1000].vec_id) == [1010, 1020, 1030, 1040, 1050] and got[got.query_id == 1050].vec_id.tolist() == [1040, 1030, 1020, 1010, 1000]


def test_search_reranks_a_bounded_number_for_each_query(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = np.random.default_rng(1).normal(size=(1500, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.search(table, F.col("id") % 50 == 0, depth=40).toPandas()
    hit = sum(len(set(got[got.query_id == q].vec_id) & set(i for i in np.argsort(-(u @ u[q]))[:6] if i != q)) for q in range(0, 1500, 50))
    assert hit >= 0.9 * 150


def test_only_found_vectors_are_moved(spark, monkeypatch):
    """What is reranked is joined to the found vectors' keys before anything is shuffled or made distinct."""
    kept = {}
    monkeypatch.setattr(ann, "staged", lambda df, name, **more: kept.setdefault(name, common.staged(df, name, **more)))
    x = np.random.default_rng(2).normal(size=(3000, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(table, F.col("id") == 50, depth=20)
    assert found.count() == 5 and kept["needed"].count() <= 21
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[h1#[^\n]*\n[^\n]*\n?[^\n]*LeftSemi", plan), plan


def test_search_query(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x = np.array(rows.embedding.tolist(), np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.op2_additive(spark, DATA).toPandas()
    assert set(got.query_id) == {i for i in rows.vec_id if i % 50 == 0}
    hit = 0
    for q in set(got.query_id):
        s = u @ u[list(rows.vec_id).index(q)]
        order = [int(rows.vec_id[i]) for i in np.lexsort((rows.vec_id, -s)) if rows.vec_id[i] != q][:5]
        hit += len(set(order) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.9 * len(got)


def test_components_of_random_graphs_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", 3)
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(500, int(i)) for i in range(501, 560)] + [(600, 559), (601, 600)]
    up = {n: n for p in pairs for n in p}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs for n in (a, b) if a != b}
    assert got == {n: root(n) for n in linked}


def test_words_are_cut_at_ascii_blanks_only():
    assert len(shingles.word_hashes("a\u00a0b\x1cc\u0085d\te".encode())) == 2
    assert (shingles.shingle_set(b"A b C") == shingles.shingle_set(b"a B\nc")).all() and len(shingles.shingle_set(b" ")) == 0


def test_components_take_few_jobs(spark, monkeypatch):
    """Links of bands to their pivots: few tables are staged, with least neighbours that are sent and with joined ones, hubs among them."""
    rng = np.random.default_rng(5)
    nodes = rng.permutation(400)
    pairs = [(int(nodes[i] * 2 + g), int(nodes[j] * 2 + g)) for g in range(2) for i in range(9) for j in rng.choice(400, 60, replace=False)]
    pairs += [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in up:
        before = dict(up)
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
        if up == before:
            break
    made, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: made.append(name) or kept(df, name))
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert {r["node"]: r["label"] for r in graph.components(links).collect()} == up
    assert len(made) <= 7
    for name, value in (("SENT", 0), ("LINKS", 3), ("PIECE", 1)):
        monkeypatch.setattr(graph, name, value, raising=False)
        got = [(r["node"], r["label"]) for r in graph.components(links).collect()]
        assert dict(got) == up and len(got) == len(up)
