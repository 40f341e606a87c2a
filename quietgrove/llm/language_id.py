"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and everything but letters becomes a single blank; its n-grams of one to
``MAX_N`` characters are hashed into ``BUCKETS`` columns. Fitting sums the n-gram counts of a
labelled sample by language as a Spark aggregation; the smoothed log probabilities form one
matrix of buckets by languages. Tasks get it as a broadcast, gather the rows of a batch's n-grams
and add them up by document. Whole texts count, long ones piece by piece.

The fit uses at most ``ROWS_PER_LANGUAGE`` labelled rows of a language (chosen by a hash of
their key), in at most ``MAX_LANGUAGES`` languages, most frequent first; this bounds fitting
and the broadcast (64 MB at most). All rows are predicted.

Defined cases: a null text or one without a letter is ``und`` with score 0, and so is every text
if nothing was labelled; null labels are not learned; repeated rows are predicted alike; result
columns replace input columns of the same name. Equal scores go to the first language by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator, Optional

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import begin_task, bound_batches, free_name, give_back, replacing

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_N = 4
#: Shorter n-grams are much alike in all languages of a script, so they are no evidence.
LEAST_N = 3
ROWS_PER_LANGUAGE = 4_000
MAX_LANGUAGES = 250
UNDETERMINED = "und"
#: Characters that are turned into n-grams at a time.
PIECE = 1 << 20
#: n-grams that are scored at a time.
BATCH_GRAMS = 1 << 18

_ASCII_OTHER = re.compile(r"[^a-z]+")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal_form(text: Optional[str]) -> str:
    """Lower-case letters and their marks, with single blanks between and around words; empty
    without letters (numerals such as fractions and circled digits are none)."""
    lower = text.lower() if text else ""
    if lower.isascii():
        body = _ASCII_OTHER.sub(" ", lower).strip()
    else:
        body = _OTHER.sub(" ", lower).strip() if _LETTER.search(lower) else ""
    return f" {body} " if body else ""


def hashed_grams(body: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a normal form, in pieces."""
    for begin in range(0, max(len(body), 1), PIECE):
        piece = body[begin:begin + PIECE + MAX_N - 1]
        chars = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        starts = min(len(chars), PIECE)
        code = np.zeros(len(chars), dtype=np.uint64)
        for n in range(1, MAX_N + 1):
            code = (code[:len(chars) - n + 1] * np.uint64(0x110001) + chars[n - 1:]) if n > 1 else chars
            mixed = (code[:starts] + np.uint64(n)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MIX
            yield (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass
class LanguageModel:
    """Languages in name order and the log probabilities of buckets (rows) in them."""

    languages: list[str]
    log_prob: np.ndarray

    def score(self, texts: list[Optional[str]]) -> np.ndarray:
        """Posterior probability of each language, one row per text; zeros if undetermined."""
        return self.judge(texts)[0]

    def judge(self, texts: list[Optional[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior probabilities, and for each text the evidence for its best language.

        Evidence is the mean log probability of the text's n-grams of ``LEAST_N`` characters or
        more, less that of a draw of buckets at random; the last array is their number. It is
        positive only if the language explains the text, whatever the other languages do.
        """
        out = np.zeros((len(texts), len(self.languages)))
        long_sums, n_long = np.zeros_like(out), np.zeros(len(texts), dtype=np.int64)
        if not self.languages:
            return out, np.zeros(len(texts)), n_long
        held: list[np.ndarray] = []
        is_long: list[bool] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owner, size, is_long
            if held:
                bounds = np.cumsum([0] + [len(h) for h in held[:-1]])
                sums = np.add.reduceat(self.log_prob[np.concatenate(held)], bounds, axis=0,
                                       dtype=np.float64)
                np.add.at(out, np.array(owner), sums)
                wide = np.array(is_long)
                np.add.at(long_sums, np.array(owner)[wide], sums[wide])
            held, owner, size, is_long = [], [], 0, []

        lettered = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            body = normal_form(text)
            if not body:
                continue
            lettered[i] = True
            for order, grams in enumerate(hashed_grams(body)):
                if len(grams):
                    wide = order % MAX_N + 1 >= LEAST_N
                    n_long[i] += wide * len(grams)
                    is_long.append(wide)
                    held.append(grams)
                    owner.append(i)
                    size += len(grams)
                    if size > BATCH_GRAMS:
                        flush()
        flush()
        shifted = np.exp(out - out.max(axis=1, keepdims=True))
        best = long_sums[np.arange(len(texts)), out.argmax(axis=1)]
        evidence = np.where(n_long > 0, best / np.maximum(n_long, 1) + np.log(BUCKETS), 0.0)
        return shifted / shifted.sum(axis=1, keepdims=True) * lettered[:, None], evidence, n_long

    def predict(self, df: DataFrame, text: str = "text", evidence: bool = False) -> DataFrame:
        """Every row with ``lang_pred`` and ``score``, and if wanted ``evidence`` and ``n_grams``."""
        bound_batches(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.languages, self.log_prob))

        @F.pandas_udf("lang_pred string, score double, evidence double, n_grams long")
        def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            begin_task("language_id")
            model = LanguageModel(*shared.value)
            for texts in batches:
                if not model.languages:
                    yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0,
                                        "evidence": 0.0, "n_grams": 0})
                    continue
                scores, proof, n_grams = model.judge(texts.tolist())
                best = scores.argmax(axis=1)
                top = scores[np.arange(len(texts)), best]
                names = np.array(model.languages, dtype=object)[best]
                names[top == 0] = UNDETERMINED
                yield pd.DataFrame({"lang_pred": names, "score": np.minimum(top, 1.0),
                                    "evidence": proof, "n_grams": n_grams})
            give_back()

        name = free_name(df, "judged")
        found = df.withColumn(name, judge(F.col(f"`{text}`").cast("string")))
        results = ("lang_pred", "score", "evidence", "n_grams") if evidence else ("lang_pred", "score")
        return replacing(found, {c: F.col(name)[c] for c in results}, keep=df.columns)


def fit(df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE, smoothing: float = 0.5) -> LanguageModel:
    """Learn from the rows of ``df`` that have a label.

    The driver takes a count for each language and bucket that occurs, and the model is a matrix of
    ``BUCKETS`` by languages (64 MB at ``MAX_LANGUAGES``) that every task gets. With more languages
    than that there is no model: an error is raised, and none is left out.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(f"`{label}`").cast("string").alias("label"),
                     F.col(f"`{text}`").cast("string").alias("text"),
                     F.xxhash64(F.col(f"`{key}`").cast("string")).alias("draw")
                     ).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"labels name more than {MAX_LANGUAGES} languages")
    languages = sorted(r["label"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))
    chosen = F.lit(False)
    for r in sizes:
        share = min(1.0, rows_per_language / r["n"])
        chosen = F.when(F.col("label") == r["label"],
                        F.pmod("draw", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).otherwise(chosen)
    place = {name: i for i, name in enumerate(languages)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin_task("language_id")
        total = np.zeros((len(place), BUCKETS), dtype=np.int64)
        for batch in batches:
            for name, body in zip(batch["label"], batch["text"]):
                for grams in hashed_grams(normal_form(body)):
                    total[place[name]] += np.bincount(grams, minlength=BUCKETS)
        at = np.nonzero(total)
        yield pd.DataFrame({"lang": at[0].astype(np.int32), "bucket": at[1].astype(np.int32),
                            "n": total[at]})

    counts = rows.where(chosen).select("label", "text").mapInPandas(
        counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    matrix = np.zeros((BUCKETS, len(languages)))
    matrix[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    matrix += smoothing
    return LanguageModel(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32))
