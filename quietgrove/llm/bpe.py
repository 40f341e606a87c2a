"""Encoding and decoding with a byte-level BPE vocabulary, exact on texts of any length.

Ordinary text falls into short pieces at word boundaries, and pieces are merged one by one.
A piece without such boundaries (a long run of letters, say) is encoded as a tree: it is cut
into leaves that are encoded independently, and neighbours are then joined pairwise. At a join
the last and first ``k`` tokens of the two sides are encoded again as one window; if the
window's outermost tokens come out as they were, both sides agree and nothing further out can
change, because a BPE encoding is right exactly if every two neighbouring tokens are. If not,
``k`` doubles, up to the whole of both sides.

Texts up to ``LONG_TEXT`` characters are encoded where they lie. Longer ones are cut into
parts at word boundaries and inside long pieces, the parts are encoded by different tasks, and
the ids of each text are put together again (joins inside a piece as above).

Special tokens written out in a text get their own id, as the vocabulary file asks for.
Defined cases: null counts as an empty text, which has no ids; repeated rows are encoded each
for itself; ids outside the vocabulary raise an error on decoding; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import functools
import json
import re
from typing import Iterator, Optional

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import bound_batches, free_name, replacing
from quietgrove.scratch import Scratch

#: Bytes of a leaf; longer pieces are encoded as trees.
LEAF = 2_048
LONG_TEXT = 1 << 16
#: Characters of a part of a long text, and leaves' bytes in a part of a long piece.
PART = 1 << 14

# Fixed value: how this kind of vocabulary splits text into pieces.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
          r"|\s+(?!\S)|\s+")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a vocabulary file, turned round."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """What each id of a vocabulary file stands for; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    signs = byte_signs()
    out = {v: bytes(signs[c] for c in k) for k, v in spec["model"]["vocab"].items()}
    out.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return out


def text_from(names: dict[int, bytes], ids) -> str:
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    return b"".join(map(names.__getitem__, ids)).decode("utf-8", errors="replace")


class ByteBpe:
    """A byte-level BPE vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf = leaf
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = token_bytes(path)
        ranks = {self.token_bytes[v]: v for v in spec["model"]["vocab"].values()}
        self._core = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks,
                                       special_tokens={})
        self._split = Tokenizer.from_file(path).pre_tokenizer
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece, in one go."""
        return self._core._encode_single_piece(piece) if piece else []

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a piece from the ids of its two sides."""
        k = 2
        while left and right:
            a, b = left[-k:], right[:k]
            window = self.merge(self.bytes_of(a + b))
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[:len(left) - len(a)] + window + right[len(b):]
            k *= 2
        return left or right

    def join_all(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i]
                      for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def piece(self, piece: bytes) -> list[int]:
        return self.join_all([self.merge(piece[i:i + self.leaf])
                              for i in range(0, len(piece), self.leaf)])

    def _unsplit(self, text: str) -> bool:
        """Whether a piece may be longer than a leaf."""
        if len(text) * 4 <= self.leaf:
            return False
        limit = self.leaf // 4
        return max(map(len, text.split()), default=0) > limit or \
            re.search(r"\s{%d}" % limit, text) is not None

    def stretches(self, text: str) -> Iterator[tuple[str, str]]:
        """The text in order as ('special' | 'plain' | 'long', stretch)."""
        parts = self._specials.split(text) if self._specials else [text]
        for part in parts:
            if part in self.special:
                yield "special", part
            elif not self._unsplit(part):
                if part:
                    yield "plain", part
            else:
                yield from self._around_long(part)

    def _around_long(self, text: str) -> Iterator[tuple[str, str]]:
        """Long pieces and what lies between them.

        How white space splits depends on what follows it, so white space right before a long
        piece is handed out piece by piece instead of being split once more without it.
        """
        spans = [span for _, span in self._split.pre_tokenize_str(text)]
        begin = 0
        for i, (a, b) in enumerate(spans):
            if b - a <= self.leaf // 4:
                continue
            gap = i
            while gap and spans[gap - 1][0] >= begin and text[slice(*spans[gap - 1])].isspace():
                gap -= 1
            if spans[gap][0] > begin:
                yield "plain", text[begin:spans[gap][0]]
            for c, d in spans[gap:i + 1]:
                yield "long", text[c:d]
            begin = b
        if begin < len(text):
            yield "plain", text[begin:]

    def encode(self, text: Optional[str]) -> list[int]:
        if not text:
            return []
        if not self._unsplit(text) and not (self._specials and self._specials.search(text)):
            return self._core.encode_ordinary(text)
        out: list[int] = []
        for kind, stretch in self.stretches(text):
            if kind == "special":
                out.append(self.special[stretch])
            elif kind == "plain":
                out += self._core.encode_ordinary(stretch)
            else:
                out += self.piece(stretch.encode())
        return out

    def parts(self, text: str, size: int = PART) -> Iterator[tuple[int, int, bytes]]:
        """The text as (piece number, kind, bytes); parts of one long piece share its number.

        Kinds: 0 plain, 1 part of a long piece, 2 special.
        """
        number = 0
        for kind, stretch in self.stretches(text):
            if kind == "special":
                yield number, 2, stretch.encode()
                number += 1
            elif kind == "long":
                body = stretch.encode()
                for i in range(0, len(body), size):
                    yield number, 1, body[i:i + size]
                number += 1
            else:
                begin = 0
                while begin < len(stretch):
                    # a run of white space after other text always begins a new piece
                    cut = re.compile(r"(?<=\S)(?=\s)").search(stretch, begin + size)
                    end = cut.start() if cut else len(stretch)
                    yield number, 0, stretch[begin:end].encode()
                    number += 1
                    begin = end

    def encode_part(self, kind: int, body: bytes) -> list[int]:
        if kind == 2:
            return [self.special[body.decode()]]
        return self._core.encode_ordinary(body.decode()) if kind == 0 else self.piece(body)

    def assemble(self, parts: list[tuple[int, int, list[int]]]) -> list[int]:
        """Ids of a text from those of its parts, in order."""
        out: list[int] = []
        held: list[list[int]] = []
        last = None
        for number, kind, ids in parts:
            if held and number != last:
                out += self.join_all(held)
                held = []
            if kind == 1:
                held.append(ids)
            else:
                out += ids
            last = number
        return out + self.join_all(held)

    def decode(self, ids) -> str:
        return text_from(self.token_bytes, ids)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of a file, loaded once per Python process."""
    return ByteBpe(path)


def _encode_short(df: DataFrame, body: str, path: str, out: str):
    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([np.array(bpe.encode(t), dtype=np.int32) for t in texts])

    return df.withColumn(out, ids_of(body))


def _encode_long(df: DataFrame, body: str, path: str, out: str) -> DataFrame:
    """Parts of long texts are encoded by different tasks and joined by text."""
    spark = df.sparkSession
    key = free_name(df, "row")
    stored = Scratch(spark).save(df.withColumn(key, F.expr("uuid()")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                rows = [(row, i, *p) for i, p in enumerate(bpe.parts(text))]
                yield pd.DataFrame(rows, columns=["row", "n", "piece", "kind", "body"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [np.array(bpe.encode_part(k, b), dtype="<u4").tobytes()
                   for k, b in zip(batch["kind"], batch["body"])]
            yield batch.drop(columns="body").assign(ids=ids)

    @F.pandas_udf("array<int>")
    def assemble(parts: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([np.array(bpe.assemble(
            [(p["piece"], p["kind"], np.frombuffer(p["ids"], dtype="<u4").tolist())
             for p in row]), dtype=np.int32) for row in parts])

    parts = stored.select(F.col(key).alias("row"), F.col(body).alias("text")).mapInPandas(
        cut, "row string, n long, piece long, kind int, body binary")
    coded = parts.repartition("row", "n").mapInPandas(
        encode, "row string, n long, piece long, kind int, ids binary")
    whole = coded.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("n", "piece", "kind", "ids"))).alias("parts"))
    whole = whole.select(F.col("row").alias(key), assemble("parts").alias(out))
    return stored.join(whole, key).drop(key)


def encode(df: DataFrame, path: str, text: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """Every row with ``ids`` (array of int), the encoding of its whole text."""
    bound_batches(df.sparkSession)
    body, out = free_name(df, "body"), free_name(df, "coded")
    rows = df.withColumn(body, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    long = F.length(body) > long_text
    short = _encode_short(rows.where(~long), body, path, out)
    both = short.unionByName(_encode_long(rows.where(long), body, path, out))
    return replacing(both, {"ids": F.col(out)}, keep=df.columns)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the text that its ids stand for; null ids give an empty text."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        names = token_bytes(path)
        return pd.Series([text_from(names, r) if r is not None else "" for r in rows])

    name = free_name(df, "text_found")
    found = df.withColumn(name, text_of(F.col(f"`{ids}`")))
    return replacing(found, {out: F.col(name)}, keep=df.columns)
