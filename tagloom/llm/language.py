"""Language of a text by word-first backoff: known words score by their frequency per language, unseen
ones by their character n-grams, longest first."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts, written

#: The model is fitted on about so many documents of each language at most, chosen by a hash of id and text.
PER_LANGUAGE = 5_000
#: Longest n-gram; least relative frequency of a word and of an n-gram among those of its length. So a language has
#: at most 1 / floor entries of each kind, which bounds the model.
LONGEST, WORD_FLOOR, GRAM_FLOOR = 5, 2e-5, 5e-5
#: With more languages than this the floors rise in proportion, so that the whole model is bounded however many there are.
LANGUAGES = 64
#: Words kept with their scores per task; emptied when full, which changes no result.
MEMO = 400_000

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word between blanks."""
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def remainder(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Text and language of the documents to learn from: a language, an id whose remainder is not 1, and a hash below the
    share that leaves about ``per_language`` documents of the language."""
    from tagloom.operators.sizing import lookup_join

    able = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id")) != 1)).select("doc_id", "text", "lang")
    sizes = written(able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return lookup_join(able, sizes, ["lang"], how="inner").where(place * F.col("n") < per_language).select("text", "lang")


def entries(training: DataFrame) -> DataFrame:
    """lang, size (0: word, else n-gram length), entry, share: the entries above their floors."""
    fields = [T.StructField("lang", T.StringType()), T.StructField("size", T.IntegerType()),
              T.StructField("entry", T.StringType()), T.StructField("n", T.LongType())]

    def count_words(batches):
        import pandas as pd

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                c = Counter()
                for t in texts:
                    c.update(text_words(t))
                yield pd.DataFrame({"lang": lang, "size": 0, "entry": list(c), "n": list(c.values())})

    def count_grams(batches):
        import pandas as pd

        for pdf in batches:
            for lang, some in pdf.groupby("lang"):
                c = [Counter() for _ in range(LONGEST + 1)]
                for w, n in zip(some["entry"], some["n"]):
                    for size in range(1, LONGEST + 1):
                        for g in grams(w, size):
                            c[size][g] += n
                for size in range(1, LONGEST + 1):
                    yield pd.DataFrame({"lang": lang, "size": size, "entry": list(c[size]), "n": list(c[size].values())})

    schema = T.StructType(fields)
    by = ["lang", "size", "entry"]
    some = training.where(F.col("text").isNotNull())
    words = written(some.mapInPandas(count_words, schema).groupBy(*by).agg(F.sum("n").alias("n")), "words")
    every = written(words.unionByName(words.mapInPandas(count_grams, schema).groupBy(*by).agg(F.sum("n").alias("n"))), "entries")
    totals = every.groupBy("lang", "size").agg(F.sum("n").alias("total")).withColumnsRenamed({"lang": "l", "size": "s"})
    share = F.col("n") / F.col("total")
    languages = totals.select("l").distinct().count()
    floor = F.when(F.col("size") == 0, WORD_FLOOR).otherwise(GRAM_FLOOR) * F.lit(max(1.0, languages / LANGUAGES))
    # the totals have LONGEST + 1 rows per language
    joined = every.join(F.broadcast(totals) if _few(totals) else totals, (F.col("lang") == F.col("l")) & (F.col("size") == F.col("s")))
    return joined.where(share >= floor).select("lang", "size", "entry", share.alias("share"))


def _few(df: DataFrame) -> bool:
    from tagloom.operators.sizing import fits_broadcast

    return fits_broadcast(df)


class Model:
    """Penalties (-log10 of shares) of words and n-grams in the languages that have them; elsewhere an entry costs ``absent``, one more
    than the floor. Per size: the entries' rows, where a row's values start, their languages, and by how much each is less than ``absent``."""

    def __init__(self, table):
        self.languages = sorted(set(table["lang"]))
        at = {x: i for i, x in enumerate(self.languages)}
        raised = max(1.0, len(at) / LANGUAGES)
        self.absent = [-np.log10((WORD_FLOOR if size == 0 else GRAM_FLOOR) * raised) + 1 for size in range(LONGEST + 1)]
        self.index, self.start, self.lang, self.less = [], [], [], []
        for size in range(LONGEST + 1):
            part = table[table["size"] == size]
            index = {e: i for i, e in enumerate(dict.fromkeys(part["entry"]))}
            rows = np.fromiter((index[e] for e in part["entry"]), np.int64, len(part))
            order = np.argsort(rows, kind="stable")
            self.index.append(index)
            self.start.append(np.searchsorted(rows[order], np.arange(len(index) + 1)).astype(np.int32))
            self.lang.append(np.array([at[x] for x in part["lang"]], np.int32)[order])
            self.less.append((self.absent[size] + np.log10(part["share"].to_numpy(float))).astype(np.float32)[order])

    def values(self, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of entries of a size: (which of ``rows``, language, by how much less than absent), one each per language that has it."""
        start = self.start[size][rows]
        count = self.start[size][rows + 1] - start
        which = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        return which, self.lang[size][at], self.less[size][at]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, new: list[str]) -> np.ndarray:
        """Scores of words not met before."""
        m = self.model
        out = np.full((len(new), len(m.languages)), m.absent[LONGEST], np.float64)
        known = [m.index[0].get(w, -1) for w in new]
        at = np.array([i for i, k in enumerate(known) if k >= 0], np.int64)
        out[at] = m.absent[0]
        which, lang, less = m.values(0, np.array([k for k in known if k >= 0], np.int64))
        out[at[which], lang] -= less
        left = [i for i, k in enumerate(known) if k < 0]
        for size in range(LONGEST, 0, -1):  # the longest n-grams of which any is known decide
            get, rows, owner, share, rest = m.index[size].get, [], [], [], []
            for i in left:
                w = f" {new[i]} "
                hits = [k for j in range(len(w) - size + 1) if (k := get(w[j:j + size])) is not None]
                if hits:
                    rows += hits
                    owner += [i] * len(hits)
                    share += [1 / len(hits)] * len(hits)
                else:
                    rest.append(i)
            if rows:
                which, lang, less = m.values(size, np.array(rows, np.int64))
                np.subtract.at(out, (np.array(owner, np.int64)[which], lang), less * np.array(share)[which])
            left = rest
        return out.astype(np.float32)

    def __call__(self, texts: list[str | None]):
        """Language and score of each text."""
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        parts = [text_words(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.scores = {}, self.scores[:0]
        new = sorted(set().union(*parts).difference(self.memo))
        if new:
            held = len(self.memo)
            self.memo.update(zip(new, range(held, held + len(new))))
            self.scores = np.concatenate([self.scores[:held], self._learn(new)])
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for i, p in enumerate(parts):
            if p:
                mean = self.scores[np.fromiter(map(self.memo.__getitem__, p), np.int64, len(p))].mean(axis=0, dtype=np.float64)
                best = int(mean.argmin())
                lang[i], score[i] = self.model.languages[best], float(1 / np.power(10.0, mean[best] - mean).sum())
        return lang, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model of the documents that may be learnt from; the floors bound its entries, and they rise with the languages: it holds
    LANGUAGES * (1 / WORD_FLOOR + LONGEST / GRAM_FLOOR) of them at most."""
    return Model(entries(training_rows(docs, per_language)).toPandas())


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` with lang_pred and score of each whole text. The model is broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def kernel(texts):
            lang, score = scorer(texts)
            return {"lang_pred": lang, "score": score}

        return kernel

    return map_texts(docs, keep, F.col(text), [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from. Ties go to the first language
    in code point order. A null id is neither held out nor learnt from; repeated rows each count. The score is the chance of the best language if
    each language's mean penalty is a log-probability. Very long texts are read whole; an empty table gives no rows, other columns are not read.
    """
    keep = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))}
    return predict(docs, fit(docs), keep)
