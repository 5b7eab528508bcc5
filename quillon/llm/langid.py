"""Language identification: multinomial naive Bayes over hashed character n-grams.

The trained matrix of log-probabilities (one row a language, ``2**bits`` columns) is of fixed width, so it is
shipped to the executors whole; its height is the number of languages seen in training, checked against
``max_languages``. Texts are scored in numpy batches: n-gram codes of a batch at once, a gather from the matrix,
and a sum for each text.

Defined results: a null text, or one without any letter, is ``und`` with score 0. With no labelled text to learn
from, every text is ``und``. Rows are judged one by one, so repeated rows and null ids get a row each. Only the
columns named are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """1 for code points that are letters, else 0."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def grams(texts: list[str], bits: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased letters: (text's number, bucket, has a letter), n from 1 to ``longest``.

    Runs of anything but letters count as one space; n-grams of nothing but spaces are left out.
    """
    n = len(texts)
    joined = "\n".join(x.lower().replace("\n", " ") for x in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = codes == 10
    owner = np.cumsum(ends) - ends
    letter = _table()[codes]
    has = np.zeros(n, dtype=bool)
    has[owner[letter]] = True
    keep = letter | np.concatenate(([False], letter[:-1])) | ends
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    plain = np.where(letter, codes, 32).astype(np.uint64)
    who, what = [], []
    code = np.zeros(len(plain), dtype=np.uint64)
    for k in range(1, longest + 1):
        m = len(plain) - k + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x110001) + plain[k - 1 : k - 1 + m] + np.uint64(k)
        mixed = code * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        inside = (owner[:m] == owner[k - 1 : k - 1 + m]) & (letter[:m] | letter[k - 1 : k - 1 + m])
        who.append(owner[:m][inside])
        what.append((mixed >> np.uint64(64 - bits))[inside].astype(np.int64))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(who), np.concatenate(what), has


@dataclass
class Model:
    """``weights``: log-probability of a bucket for each language; ``prior``: log share of the training texts."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray
    bits: int
    longest: int

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability."""
        n = len(texts)
        if not self.languages or not n:
            return ["und"] * n, np.zeros(n)
        who, what, has = grams(texts, self.bits, self.longest)
        total = np.empty((n, len(self.languages)))
        for k in range(len(self.languages)):
            total[:, k] = self.prior[k] + np.bincount(who, weights=self.weights[k][what], minlength=n)
        best = total.argmax(1)
        p = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, p, 0.0)


def _batches(texts: list[str], most: int = 1 << 19) -> Iterator[slice]:
    """Slices of about ``most`` characters, so that memory is bounded by the longest text."""
    at, held = 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15, longest: int = 3, smooth: float = 0.5, max_languages: int = 1000) -> Model:
    """Learn from every row of ``labelled`` with text and language. Counts are summed on the executors;
    the driver gets a row for each language and occupied bucket, at most ``max_languages * 2**bits``."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby("lang"):
                own = held.setdefault(name, np.zeros((1 << bits) + 1, dtype=np.int64))
                texts = part["text"].tolist()
                own[-1] += len(texts)
                for s in _batches(texts):
                    own[:-1] += np.bincount(grams(texts[s], bits, longest)[1], minlength=1 << bits)
        for name, own in held.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": own[at]})

    languages = sorted(x.lang for x in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"the model is made for {max_languages} languages at most")
    found = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(languages), (1 << bits) + 1))
    n[found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=int), found["bucket"].to_numpy()] = found["n"].to_numpy()
    docs, n = n[:, -1], n[:, :-1] + smooth
    prior = np.log((docs + 1) / (docs.sum() + len(languages))) if languages else docs
    return Model(languages, prior, np.log(n / n.sum(1, keepdims=True)), bits, longest)


def predict(model: Model, text: Column) -> Column:
    """struct(lang_pred, score) for a column of texts. Batches are cut by characters, never the texts."""
    shared = {"model": model}

    @F.pandas_udf("lang_pred string, score double")
    def judge(column: pd.Series) -> pd.DataFrame:
        texts = [x if isinstance(x, str) else "" for x in column]
        names: list[str] = []
        scores = [np.zeros(0)]
        for s in _batches(texts):
            a, b = shared["model"].score(texts[s])
            names += a
            scores.append(b)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    return judge(text)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 divided by 3; a null id counts as empty text (false)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), **fitting)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(model, F.col("text")).alias("x"))
    return rows.select("doc_id", "held_out", "x.lang_pred", "x.score")
