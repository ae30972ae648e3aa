"""Byte-level BPE encoding of whole texts, long ones by tree concatenation, and decoding.

A text of at most LONG characters is encoded by the tokenizers library in one call. A longer one is cut into halves until
they have at most LEAF characters; tasks encode the leaves in parallel; then neighbours are joined up the tree. At each
join a window around it is encoded anew, and grows until it agrees with both sides: AGREE tokens in a row equal, with the
same bounds, on the left at the window's start and on the right anywhere before its end. A BPE encoding is right exactly
if each two neighbouring tokens are the encoding of their joint bytes, so agreement on both sides makes the whole right.
Agreement does not count within REACH bytes of the join, where a special token or the splitting of words may look across
it, nor next to an apostrophe, where the splitting of words depends on what stands before.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common
from bitloom.llm.words import WordIds, load

LONG, LEAF, WINDOW, REACH, AGREE = 32_768, 16_384, 256, 32, 3
#: Words whose ids a worker keeps, and texts that it encodes at once.
CACHED, TEXTS = 300_000, 128
#: White space before a space, and how other white space begins in UTF-8.
_BLANKS = (b"  ", b"\t ", b"\n ", b"\x0b ", b"\x0c ", b"\r ", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def _table(vocabulary: dict[str, int], special: dict) -> list[bytes]:
    """The bytes of each token. Byte-level vocabularies write a byte that is printable as that character, and the others, in
    order, as the characters from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() if i in special else bytes(map(byte_of.__getitem__, token))
    return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        self.tokenizer = t = load(path)
        vocabulary, special = t.get_vocab(with_added_tokens=True), t.get_added_tokens_decoder()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has a character for each byte
            self.bytes_of[i] = len(token.encode()) if i in special else len(token)
        self.specials = [s.content.encode() for s in special.values()]
        self.table = _table(vocabulary, special)
        self.first, self.spaced = WordIds(t, cached=CACHED), WordIds(t, b" ", cached=CACHED)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts. Where all spaces follow something else than white space, and there is no special token, the
        tokenizer splits before each space, so that the ids are those of the words with their spaces."""
        out: list = [None] * len(texts)
        data = [t.encode("utf-8") for t in texts]
        words = [k for k, d in enumerate(data) if not any(x in d for x in _BLANKS) and not any(x in d for x in self.specials)]
        split = [data[k].split(b" ") for k in words]
        for k, a, b in zip(words, self.first.ids([s[:1] for s in split]), self.spaced.ids([s[1:] for s in split]), strict=True):
            out[k] = np.frombuffer(a + b, "<u4")
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(found.ids, "<u4")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of the tokens' bytes, special tokens included; what is not UTF-8 becomes U+FFFD."""
        return [b"".join(map(self.table.__getitem__, i.tolist())).decode("utf-8", "replace") for i in ids]

    def bounds(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins, then the end."""
        return np.concatenate(([0], np.cumsum(self.bytes_of[ids])))

    def join(self, left: bytes, left_ids: np.ndarray, right: bytes, right_ids: np.ndarray) -> np.ndarray:
        """The ids of left + right, from those of the two."""
        if not left or not right:
            return left_ids if left else right_ids
        text, cut = left + right, len(left)
        at_left, at_right = self.bounds(left_ids), self.bounds(right_ids) + cut
        size = WINDOW
        while True:
            a, k = self._start(text, at_left, cut - size)
            end = min(cut + size, len(text))
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            new = self.encode([text[a:end].decode()])[0]
            at = self.bounds(new) + a
            left_ok = a == 0 or self._same(left_ids, at_left, k, new, at, 0) and at[AGREE] <= cut - REACH
            right_from = self._agreed(text, right_ids, at_right, new, at, cut, end)
            if left_ok and right_from is not None:
                j, i = right_from
                return np.concatenate((left_ids[:k], new[:j], right_ids[i:]))
            size *= 2

    @staticmethod
    def _plain(text: bytes, p: int) -> bool:
        """Whether a window may begin at p: between characters, with no apostrophe at either side."""
        return text[p] & 0xC0 != 0x80 and text[p] != 39 and text[p - 1] != 39

    def _start(self, text: bytes, at: np.ndarray, p: int) -> tuple[int, int]:
        """The last token bound up to p at which a window may begin, and its token; else the text's start."""
        k = int(np.searchsorted(at, p, "right")) - 1
        while k > 0 and not self._plain(text, int(at[k])):
            k -= 1
        return (int(at[k]), k) if k > 0 else (0, 0)

    @staticmethod
    def _same(ids: np.ndarray, at: np.ndarray, k: int, new: np.ndarray, at_new: np.ndarray, j: int) -> bool:
        return len(new) >= j + AGREE and len(ids) >= k + AGREE and np.array_equal(ids[k : k + AGREE], new[j : j + AGREE]) and at[k] == at_new[j]

    def _agreed(self, text: bytes, ids: np.ndarray, at: np.ndarray, new: np.ndarray, at_new: np.ndarray, cut: int, end: int) -> tuple[int, int] | None:
        """A token of new and one of the right side from which on both agree; at the text's end, both ends."""
        if end == len(text):
            return len(new), len(ids)
        shared, js, ks = np.intersect1d(at_new[:-1], at[:-1], return_indices=True)
        for p, j, k in zip(shared, js, ks, strict=True):
            if p >= cut + REACH and j + AGREE < len(new) and at_new[j + AGREE] <= end - REACH and self._plain(text, int(p)) and self._same(ids, at, k, new, at_new, j):
                return int(j), int(k)
        return None

    def tree(self, texts: list[bytes], ids: list[np.ndarray]) -> np.ndarray:
        """The ids of the joined texts: neighbours are joined, then those, up to the root."""
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            odd = [len(texts) - 1] * (len(texts) % 2)
            ids = [self.join(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs] + [ids[i] for i in odd]
            texts = [texts[i] + texts[i + 1] for i in pairs] + [texts[i] for i in odd]
        return ids[0] if ids else np.zeros(0, "<u4")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (their text).

    A null or empty text has no ids. Rows that repeat, id included, each get a row. A null id stays null; other columns are
    not read. An empty table gives no rows. No task holds more than one long document at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def whole():
        c = codec(tokenizer)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            ids = [i for k in range(0, len(texts), TEXTS) for i in c.encode(texts[k : k + TEXTS])]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) for i in ids], "ids": [i.tobytes() for i in ids], "decoded": c.decode(ids)}

        return work

    def leaves():
        c = codec(tokenizer)

        def work(batch: pa.RecordBatch) -> dict:
            return {n: batch.column(n) for n in ("doc_id", "key", "part", "copies", "text")} | {"ids": [i.tobytes() for i in c.encode(batch.column("text").to_pylist())]}

        return work

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        c, group = codec(tokenizer), group.sort_values("part")
        ids = c.tree([t.encode() for t in group["text"]], [np.frombuffer(i, "<u4") for i in group["ids"]])
        row = (group["doc_id"].iloc[0], len(ids), ids.tobytes(), c.decode([ids])[0])
        return pd.DataFrame([row] * int(group["copies"].iloc[0]), columns=["doc_id", "n_tokens", "ids", "decoded"])

    size = F.length("text")
    short = common.map_batches(rows.where(size <= long), whole, SCHEMA)
    parts = F.pow(F.lit(2), F.ceil(F.log2(size / leaf))).cast("int")
    big = (
        rows.where(size > long)
        .groupBy("doc_id", F.sha2("text", 256).alias("key"))
        .agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("from", F.floor(size * F.col("part") / F.col("parts")).cast("int"))
        .withColumn("to", F.floor(size * (F.col("part") + 1) / F.col("parts")).cast("int"))
        .select("doc_id", "key", "part", "copies", F.substring("text", F.col("from") + 1, F.col("to") - F.col("from")).alias("text"))
        .repartition("key", "part")
    )
    pieces = common.map_batches(big, leaves, "doc_id long, key string, part int, copies long, text string, ids binary")
    return short.unionByName(pieces.groupBy("key", "doc_id").applyInPandas(joined, SCHEMA))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode() returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


