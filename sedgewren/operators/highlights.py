"""Rectangles of a text on its page: the words of an anchor are matched, in order, with the page's words and their boxes.

``words`` has document_id, page_num, place (the order of reading), line, word, x0, y0, x1, y1, as a parser gives them.  A page's words are
one row, which anchors of that page meet in an equi-join; a page is bounded, and so is what an anchor can find on it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewren.functions.text import highlight_anchor, normalized


def pages_of_words(words: DataFrame) -> DataFrame:
    """document_id, page_num, b: the words of a page in reading order, lower-cased, with their boxes (place, word, line, x0, y0, x1, y1)."""
    box = F.struct("place", F.lower("word").alias("word"), "line", "x0", "y0", "x1", "y1")
    return words.where("word <> ''").groupBy("document_id", "page_num").agg(F.array_sort(F.collect_list(box)).alias("b"))


def hits(page: Column, asked: Column) -> Column:
    """Places (from 1) on a page where the asked words begin.

    The first asked word may be the end of a page's word and the last one its beginning, as an anchor can start or end inside of a
    word; a single one may stand anywhere in a word.
    """
    n, size = F.size(asked), F.size(page)
    first, last = F.element_at(asked, 1), F.element_at(asked, -1)

    def fits(p: Column) -> Column:
        inner = (n <= 2) | (F.slice(page, p + 1, F.greatest(n - 2, F.lit(0))) == F.slice(asked, 2, F.greatest(n - 2, F.lit(0))))
        ends = F.get(page, p - 1).endswith(first) & F.get(page, p + n - 2).startswith(last)
        return F.when(n == 1, F.get(page, p - 1).contains(first)).otherwise(ends & inner)

    return F.when((n > 0) & (size >= n), F.filter(F.sequence(F.lit(1), size - n + 1), fits)).otherwise(F.array().cast("array<int>"))


def rectangles(words: DataFrame, anchors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """<key>, page_num, hit (from 1, in reading order), line, x0, y0, x1, y1: a rectangle for each line of each hit.

    ``anchors`` has the key, document_id, page_num and text; of a text its first words are searched for, letter case and white space aside
    (see text.highlight_anchor()). A page that is not there, or an empty text, gives no row.
    """
    return page_rectangles(pages_of_words(words), anchors, F.col("b"), key)


def page_rectangles(pages: DataFrame, anchors: DataFrame, words: Column, key: str = "chunk_id") -> DataFrame:
    """As rectangles(), for pages as rows: ``words`` (an array of word, line, x0, y0, x1, y1 in reading order) is computed from a page's columns
    where its anchors have met it as one row, so nothing but these columns is shuffled, once.
    """
    asked = F.filter(F.split(F.lower(normalized(highlight_anchor(F.col("text")))), " "), lambda x: x != "")
    listed = anchors.select("document_id", "page_num", F.struct(F.col(key).alias("key"), asked.alias("asked")).alias("a"))
    listed = listed.groupBy("document_id", "page_num").agg(F.collect_list("a").alias("a"))  # a page's
    rows = listed.join(pages, ["document_id", "page_num"]).select("page_num", "a", F.filter(words, lambda x: x["word"] != "").alias("b"))
    rows = rows.select("page_num", "b", F.transform("b", lambda x: F.lower(x["word"])).alias("w"), F.explode("a").alias("a")).select(F.col("a.key").alias(key), "page_num", "b", "w", F.col("a.asked").alias("asked"))
    found = rows.select(key, "page_num", "b", F.size("asked").alias("n"), F.posexplode(hits(F.col("w"), F.col("asked"))).alias("hit", "p"))
    boxes = found.select(key, "page_num", (F.col("hit") + 1).alias("hit"), F.explode(F.slice("b", F.col("p"), F.col("n"))).alias("box"))
    lines = boxes.groupBy(key, "page_num", "hit", F.col("box.line").alias("line"))
    return lines.agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))


def offsets(pages: DataFrame, anchors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """<key>, at, n_chars: where each anchor stands on its page (see text.found_at()), and its length.

    ``pages`` has document_id, page_num and page; ``anchors`` the key, document_id, page_num and anchor. The anchors of a page meet it as
    one row, so a page is normalised once, whatever the number of its anchors.
    """
    plain = lambda c: F.lower(normalized(F.col(c)))
    listed = anchors.select("document_id", "page_num", F.struct(F.col(key).alias("key"), plain("anchor").alias("anchor"), F.length("anchor").alias("n")).alias("a"))
    listed = listed.groupBy("document_id", "page_num").agg(F.collect_list("a").alias("a"))  # a page's
    rows = listed.join(pages.select("document_id", "page_num", plain("page").alias("page")), ["document_id", "page_num"]).select("a", "page")

    def at(page, anchor):
        return None if anchor is None else -1 if anchor == "" else None if page is None else page.find(anchor)

    def run(batches):
        for batch in batches:
            out = [(a["key"], at(page, a["anchor"]), a["n"]) for of, page in zip(batch.column(0), batch.column(1).to_pylist()) for a in of.as_py()]
            if out:
                keys, found, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type.value_type.field("key").type), pa.array(found, pa.int32()), pa.array(n, pa.int32())], names=[key, "at", "n_chars"])

    return rows.mapInArrow(run, T.StructType([anchors.schema[key], T.StructField("at", T.IntegerType()), T.StructField("n_chars", T.IntegerType())]))
