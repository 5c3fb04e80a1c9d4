"""Cross-tokenizer alignment against brute force with the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sedgewren.llm import align, queries
from sedgewren.sources.stage import staged

DATA = "/root/testdata/sf0.001"
A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
LONG = " ".join(f"wörd{i % 977}  x" for i in range(20_000))
TEXTS = [None, "", " ", "a", "Hello there, general!", "a<|endoftext|>b <s> </s> <unk> <0x41>", "has ▁ sign", "漢字 😀😀 é\x00\n\n\t", "  lead", "trail  ", "Hello there, general!", "x" * 3000, LONG]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    from sedgewren.llm.bpe import byte_symbols

    back = {s: b for b, s in byte_symbols().items()}
    t, sp = libraries
    found = []
    for text in texts:
        groups, links = [], []
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i in sp.encode(text) for p in [sp.id_to_piece(i)]]
            whole = b" " + text.encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                i = j = at = bt = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at <= bt:
                        left.append(a[i][0])
                        at, i = at + len(a[i][1]), i + 1
                    else:
                        right.append(b[j][0])
                        bt, j = bt + len(b[j][1]), j + 1
                    if at == bt:
                        groups.append((left, right))
                        left, right = [], []
                ends = lambda x: [sum(len(v) for _, v in x[: k + 1]) for k in range(len(x))] if len(x) < 300 else None
                spans = lambda x: [(k, e - len(v), e) for (k, v), e in zip(x, _running(x))]
                sa, sb = spans(a), spans(b)
                k = 0
                for x, s, e in sa:
                    while k and sb[k - 1][2] > s:
                        k -= 1
                    while k < len(sb) and sb[k][2] <= s:
                        k += 1
                    m = k
                    while m < len(sb) and sb[m][1] < e:
                        links.append((x, sb[m][0]))
                        m += 1
        found.append((groups, links))
    held = Counter(p for _, links in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for g, links in found]


def _running(tokens):
    out, n = [], 0
    for _, v in tokens:
        n += len(v)
        out.append(n)
    return out


def run(df, sent=None):
    rows = staged(align.align(df, A, B), "aligned-test")
    counts = staged(align.with_best(staged(align.pair_counts(rows), "pairs-test"), align.b_vocabulary(B)), "counts-test")
    return align.with_counts(rows, counts, **({"sent": sent} if sent else {}))


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_odd_texts_equal_brute_force(spark, libraries):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for sent in (None, 40):  # with the rarer pairs joined by a shuffle, too
        got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in run(df, sent).collect()}
        want = brute(TEXTS, libraries)
        assert [got[i] for i in range(len(TEXTS))] == want
    assert want[0] == want[1] == want[6] == (0, 0, 0, 0, 0, 0, "") and want[5][0] > 0


def test_query_equals_brute_force(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(docs, brute([t for _, t in docs], libraries))}
    rows = queries.op13_alignment(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in COLUMNS[:-1]) == w[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")


def test_clashing_columns_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, None, None)], "doc_id long, text string, groups string")
    for c in ("n_best", "link_pairs", "_row0", "pair", "times", "documents", "best", "n_a"):
        df = df.withColumn(c, F.lit("mine"))
    out = run(df).collect()
    assert len(out) == 3 and {r["n_a"] for r in out} == {0, 2} and {r["count_sum"] for r in out if r["n_a"]} == {4} and out[0]["pair"] == "mine"
    assert run(df.limit(0)).count() == 0


def test_table_between_vocabularies(spark):
    rows = staged(align.align(spark.createDataFrame([("the cat",), ("the dog",)], "text string"), A, B), "aligned-test")
    counts = align.with_best(staged(align.pair_counts(rows), "pairs-test"), align.b_vocabulary(B))
    ids = align.pair_ids(counts, align.b_vocabulary(B)).where("best and documents = 2").collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    assert [sp.id_to_piece(int(r["b_id"])) for r in ids] == ["▁the"]


def test_stretches_give_the_same_tokens(libraries):
    known = align.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())
    text = " ".join(["a  b", "▁x", "   ", "long" * 30, "\n é"] * 8000)
    parts = known.stretches(text)
    assert len(parts) > 2 and [i for p in known.pieces.encode(parts) for i in p] == libraries[1].encode(text)


def test_new_words_are_merged_together(libraries, monkeypatch):
    """Ids of many texts equal the library's while a small cache turns over; only words of over 40 bytes are merged one by one."""
    known = align.Tokenizers(open(A, encoding="utf-8").read(), open(B, "rb").read())
    alone, one = [], known.codec.merged
    monkeypatch.setattr(known.codec, "merged", lambda ids: alone.append(len(ids)) or one(ids))
    known.codec.cache.half = 30
    texts = [f"abc{'xyz' * (i % 17)} näme{i % 7} '{i}' {'ß漢😀'[i % 3] * (i % 5)}\n  <|endoftext|> it's{'q' * (i % 90)}" for i in range(400)]
    for i in range(0, len(texts), 50):
        got = known.encoded(texts[i : i + 50])[0]
        assert [x.tolist() for x in got] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts[i : i + 50]]
    assert alone and min(alone) > 40 and len(known.codec.cache) <= 400
