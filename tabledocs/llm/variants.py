"""Spelling variants by permuterm rotations: all rotations of terminator-marked
words are sorted into groups, so that words one edit apart stand in one prefix
range that skips the edited character; groups are scanned and give neighbours.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, of at
least ``min_chars`` code points and ``min_count`` occurrences. (The deletion of a
character from some runs, by ``noise``, plants misspellings.)

How it runs
  1. Words are counted per batch of texts, then summed by group.
  2. With a terminator, ``x c y`` has the rotation ``y $ x c``. Its prefix
     ``y $ x`` skips ``c``: words that share it differ by that one character (a
     replacement), and a word whose whole rotation it is lacks it (an indel).
     A word gives one entry for each skipped character and one for each whole
     rotation, 2 L + 1 in all. A group holds at most one word for each letter
     and one whole rotation: it is bounded by the alphabet, however many words
     there are.
  3. Groups are not expanded into pairs: each gives, for each of its entries,
     how many of the others are near and which of them has most occurrences
     (the first or second of the group). In a run of one letter only the
     first can be deleted, so each pair of words meets exactly once.
  4. The form is the near word of most occurrences; roots follow the forms by
     doubling: each written step halves the way, and a way has at most
     log5 of the largest count.

Defined results
  null text: no words. null id: as the empty text in the noise hash. Rows
  repeated: each counts. Empty table: empty result. Ties: the word smallest in
  code-point order. Other input columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import chunks_by_chars, prepare, quoted, written

MARK = "$"


def word_counts(doc, text: str, noise: int | None, least: int) -> Counter:
    """The words of one text, at least ``least`` code points long."""
    runs = Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text))
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in runs.items():
        raw = run.encode().lower()
        if noise and (h := zlib.crc32(raw, prefix)) % noise == 0:
            at = h % len(run)
            word = raw.decode()
            word = word[:at] + word[at + 1:]
            if len(word) < least:
                continue
        else:
            word = raw.decode()
        out[word] += n
    return out


def _words(batches, noise, least):
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        for i, j in chunks_by_chars(texts, 8_000_000):
            total: Counter = Counter()
            for doc, text in zip(ids[i:j], texts[i:j]):
                if text:
                    total.update(word_counts(doc, text, noise, least))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 199, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """word, n of the words that count."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return (texts.mapInArrow(partial(_words, noise=noise, least=min_chars), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """word, n and its entries: key (a rotation without the skipped character, or
    whole), whole, and first (the skipped character begins its run)."""
    at = lambda i, k: F.substr("word", i, k)
    size = F.length("word")

    def skip(i: Column) -> Column:
        return F.struct(F.concat(at(i + 1, size), F.lit(MARK), at(F.lit(1), i - 1)).alias("key"), F.lit(False).alias("whole"),
                        ((i == 1) | (at(i, F.lit(1)) != at(i - 1, F.lit(1)))).alias("first"))

    def whole(i: Column) -> Column:
        return F.struct(F.concat(at(i + 1, size), F.lit(MARK), at(F.lit(1), i)).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    entries = F.concat(F.transform(F.sequence(F.lit(1), size), skip), F.transform(F.sequence(F.lit(0), size), whole))
    return words.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.key", "e.whole", "e.first")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (struct of rank -n, word) of each word with a near one."""
    # ordered so that the smallest struct is the best word
    entry = F.struct((-F.col("n")).alias("neg"), "word", "whole", "first")
    groups = rotations(words).groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("all")).where(F.size("all") > 1)
    skips = F.filter("all", lambda x: ~x["whole"])
    firsts = F.filter("all", lambda x: x["first"])
    wholes = F.filter("all", lambda x: x["whole"])
    groups = groups.select("all", skips.alias("skips"), firsts.alias("firsts"), wholes.alias("wholes"))
    name = lambda x: F.struct(x["neg"].alias("neg"), x["word"].alias("word"))

    def answer(x: Column) -> Column:
        other = F.filter(F.slice("skips", 1, 2), lambda y: y["word"] != x["word"])
        near_skip = F.when(F.size("skips") > 1, name(F.get(other, F.lit(0))))
        near_whole = F.when(x["first"] & (F.size("wholes") > 0), name(F.get("wholes", F.lit(0))))
        of_skip = F.size("skips") - 1 + F.when(x["first"], F.size("wholes")).otherwise(0)
        near_first = F.when(F.size("firsts") > 0, name(F.get("firsts", F.lit(0))))
        return F.struct(x["word"].alias("word"), F.when(x["whole"], F.size("firsts")).otherwise(of_skip).cast("bigint").alias("n_near"),
                        F.when(x["whole"], near_first).otherwise(F.least(near_skip, near_whole)).alias("best"))
    answers = groups.select(F.explode(F.transform("all", answer)).alias("a")).select("a.*").where("n_near > 0")
    return answers.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form) without cycles, by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 199, min_chars: int = 6,
                   min_count: int = 5, ratio: int = 5) -> DataFrame:
    """Per word: word, n, n_near, form, form_n (null without a form), root."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms then have ever larger counts")
    words = written(count_words(docs, id_col, text_col, noise, min_chars, min_count), "variant-words")
    judged = written(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(-F.col("best.neg") >= F.col("n") * ratio, F.col("best")).alias("best")), "variant-near")
    judged = judged.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.neg")).alias("form_n"))
    found = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
