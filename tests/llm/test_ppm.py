"""Prediction by partial matching against a plain model that walks every symbol through dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sedgewren.llm import ppm, queries
from tests.llm.test_llm import DATA, none, odd  # noqa: F401

BLANKS = b" \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").encode().lower().split()


class Plain:
    """The model of the module's docstring, without arrays, hashes or buckets."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        self.edges = defaultdict(Counter)
        for t in texts:
            s = b"\n" * ppm.ORDER + self.symbols(t)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.counts[s[i - k : i]][s[i]] += 1
            parts = [None, *self.phrases(t)]
            for x, y in zip(parts, parts[1:]):
                self.edges[x][y] += 1

    @staticmethod
    def symbols(text):
        return b" ".join(words_of(text)) + b"\n"

    @staticmethod
    def phrases(text):
        words, out = words_of(text), [b""]
        for i, w in enumerate(words):
            out[-1] += w + (b" " if i < len(words) - 1 else b"\n")
            if i < len(words) - 1 and xxhash.xxh3_64_intdigest(w) % ppm.PHRASE == 0:
                out.append(b"")
        return out if words else [b"\n"]

    def distribution(self, context):
        """Probability of every symbol after a context."""
        left, out, excluded = 1.0, {}, set()
        for k in range(len(context) + 1):
            seen = self.counts.get(context[k:])
            if not seen:
                continue
            rest = {x: n for x, n in seen.items() if x not in excluded}
            if not rest:
                continue
            total, once = sum(rest.values()), sum(n == 1 for n in rest.values())
            for x, n in rest.items():
                out[x] = left * n / (total + once + 1)
            left *= (once + 1) / (total + once + 1)
            excluded |= set(rest)
        alphabet = [x for x in range(256) if bytes((x,)) not in [bytes((b,)) for b in BLANKS]] + [0x20, 0x0A]
        for x in alphabet:
            out.setdefault(x, left / (len(alphabet) - len(excluded)))
        return out

    def score(self, text):
        before, total = b"\n" * ppm.ORDER, 0.0
        parts = self.phrases(text)
        for i, part in enumerate(parts):
            own = 0.0
            for x in part:
                own += math.log10(self.distribution(before)[x])
                before = (before + bytes((x,)))[-ppm.ORDER :]
            seen = self.edges.get(parts[i - 1] if i else None)
            if seen:
                n, all_of = seen[part], sum(seen.values())
                if not i:
                    total += math.log10(n / all_of / 2) if n else own - math.log10(2)
                    continue
                own = math.log10(n / (all_of + 1)) if n else own - math.log10(all_of + 1)
            total += own
        return total


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, texts[0], texts[1].upper(), None, "", " \t ", "tail of\x0bline\nends", "x" * 3000]


def test_scores_equal_those_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK", 2000)
    monkeypatch.setattr(ppm, "PIECE", 300)
    texts = corpus(60, 3)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 3 == 0
    got = {r["doc_id"]: r for r in ppm.score(rows, held).collect()}
    model = Plain([t for i, t in enumerate(texts) if i % 3])
    counts = Counter(w for i, t in enumerate(texts) if i % 3 for w in [*words_of(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, words = got[i], [*words_of(t), b"\n"]
        assert abs(r["score"] - model.score(t)) < 1e-9 * max(1, abs(r["score"]))
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i % 3 == 0, len(words), n)
        assert r["n_known"] == sum(w in counts for w in words)
        assert abs(r["base_score"] - sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-9 * max(1, len(words))


def test_probabilities_sum_to_one():
    model = Plain([t for t in corpus(30, 5)])
    for context in (b"\n" * ppm.ORDER, b"abcabc", b"zzzzzz", b"tail o", b"xxxxxx"):
        assert abs(sum(model.distribution(context).values()) - 1) < 1e-12


def test_query_and_held_out_rows():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op7_ppm(spark, DATA).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model = Plain([r["text"] for r in rows if not held(r["doc_id"])])
    assert set(got) == {r["doc_id"] for r in rows}
    for r in sorted(rows, key=lambda r: len(r["text"]))[:120]:
        x = got[r["doc_id"]]
        assert x["held_out"] == held(r["doc_id"]) and abs(x["score"] - model.score(r["text"])) < 1e-9 * max(1, abs(x["score"]))


def test_copies_and_word_order_tell(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    shuffled = prose[0].split()
    rng.shuffle(shuffled)
    texts = [*prose, *[prose[0]] * 40, " ".join(shuffled)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(rows, F.col("doc_id") == len(texts) - 1).collect()}
    assert got[0] > 0.5 * got[5] and got[0] > -60  # 41 copies against one
    assert got[len(texts) - 1] < 10 * got[0]  # the same words in another order


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(corpus(40, 9))), "doc_id long, text string")
    whole = sorted(tuple(r) for r in ppm.score(rows).collect())
    monkeypatch.setattr(ppm, "BLOCK", 200)
    monkeypatch.setattr(ppm, "BUCKETS", 3)
    parts = sorted(tuple(r) for r in ppm.score(rows.repartition(5)).collect())
    assert [r[:5] for r in whole] == [r[:5] for r in parts]
    assert np.allclose([r[5:] for r in whole], [r[5:] for r in parts], rtol=1e-12)


def test_cases(odd, none):  # noqa: F811
    rows = ppm.score(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert ppm.score(none).count() == 0
    untrained = ppm.score(odd, F.lit(True)).collect()
    assert all(abs(r["base_score"]) < 1e-9 and r["train_tokens"] == 0 for r in untrained)
    assert all(abs(r["score"] + math.log10(ppm.SYMBOLS)) < 1e-12 for r in untrained if r["n_tokens"] == 1)
