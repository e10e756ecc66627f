"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are a monoid under concatenation, and so are their encodings: a text is halved recursively down to leaves, leaves
are encoded by themselves, and neighbours are joined by encoding a window around the seam again. The words (the pieces
that the tokenizer's first pass splits off, within which all merges happen) are found by a scan that keeps no state, so

* a word of the left part stands if it ends at least ``MARGIN`` characters before the seam, as the scan never looks
  further ahead than that past a word's end, and
* from the first word bound that the window's scan shares with the right part's own scan, the right part's words stand.

The window grows until both hold; all tokens outside it are kept. Very long texts are cut into segments that are
encoded in separate tasks and joined pairwise, level by level, in the cluster.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolith.runtime import discard, materialize

#: Where the public vocabularies lie; the same on every executor.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Characters of a leaf of the tree, of the first window, and of a segment that one task encodes.
LEAF, WINDOW, SEGMENT = 4_096, 64, 262_144
#: Fixed value: the words of byte-level BPE with the usual first pass.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past a word's end that the scan may have looked at (contractions look furthest), with one to spare.
MARGIN = 4


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of one file; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_level(tokenizer) -> bool:
    """Whether the words of a text are found by the usual first pass over its own characters, as the tree needs."""
    settings = json.loads(tokenizer.to_str())
    first = settings.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return bool(plain and settings.get("normalizer") is None and settings.get("model", {}).get("type") == "BPE")


@lru_cache(maxsize=4)
def _by_rank(path: str):
    """A faster encoder of whole texts with the same ids, for byte-level vocabularies whose ids are in the order of their
    merges (then the rank of a pair is the id of what it becomes); else None."""
    tokenizer = load(path)
    if not byte_level(tokenizer):
        return None
    model = json.loads(tokenizer.to_str())["model"]
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    ranks = {token: i for i, token in enumerate(_id_bytes(path)) if token}
    special = set(tokenizer.get_added_tokens_decoder())
    whole = {token for token, i in ranks.items() if i not in special}
    if merged != sorted(merged) or len({bytes([b]) for b in range(256)} - whole):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={t: i for t, i in ranks.items() if i not in special}, special_tokens={})


@dataclass
class Piece:
    """An encoded text: its ids, and for each word the end in characters and in ids."""

    text: str
    ids: np.ndarray
    ends: np.ndarray
    id_ends: np.ndarray


def leaf(tokenizer, text: str) -> Piece:
    """Encode one text by itself."""
    spans = tokenizer.pre_tokenizer.pre_tokenize_str(text)
    encoding = tokenizer.encode(text, add_special_tokens=False)
    words = np.fromiter(encoding.word_ids, np.int64, len(encoding.word_ids))
    counts = np.bincount(words, minlength=len(spans))
    if len(counts) != len(spans):
        raise ValueError("the tokenizer's words and its first pass disagree")
    return Piece(text, np.array(encoding.ids, np.int32), np.array([end for _, (_, end) in spans], np.int64), np.cumsum(counts))


def join(tokenizer, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
    """The encoding of the concatenation, by encoding only a window around the seam."""
    seam = len(left.text)
    if not seam or not len(right.text):
        return right if not seam else left
    text = left.text + right.text
    kept = int(np.searchsorted(left.ends, seam - MARGIN, side="right"))  # words of the left part that stand
    start = int(left.ends[kept - 1]) if kept else 0
    reach = window
    while True:
        stop = min(seam + reach, len(text))
        middle = leaf(tokenizer, text[start:stop])
        ends = middle.ends + start
        sure = len(ends) if stop == len(text) else int(np.searchsorted(ends, stop - MARGIN, side="right"))
        # bounds at or after the seam that the right part's own scan has too
        shared = [k for k in range(int(np.searchsorted(ends, seam)), sure) if ends[k] == seam or _has(right.ends, ends[k] - seam)]
        if shared or stop == len(text):
            break
        reach *= 2
    if not shared:
        take, rest = len(ends), len(right.ends)
    else:
        take = shared[0] + 1
        rest = int(np.searchsorted(right.ends, ends[shared[0]] - seam, side="right"))
    left_ids = int(left.id_ends[kept - 1]) if kept else 0
    mid_ids = int(middle.id_ends[take - 1]) if take else 0
    right_ids = int(right.id_ends[rest - 1]) if rest else 0
    return Piece(
        text,
        np.concatenate([left.ids[:left_ids], middle.ids[:mid_ids], right.ids[right_ids:]]),
        np.concatenate([left.ends[:kept], ends[:take], right.ends[rest:] + seam]),
        np.concatenate([left.id_ends[:kept], middle.id_ends[:take] + left_ids, right.id_ends[rest:] - right_ids + left_ids + mid_ids]),
    )


def _has(sorted_values: np.ndarray, value: int) -> bool:
    at = int(np.searchsorted(sorted_values, value))
    return at < len(sorted_values) and sorted_values[at] == value


def tree(tokenizer, text: str, leaf_chars: int = LEAF, window: int = WINDOW) -> Piece:
    """Encode a text by halves."""
    if len(text) <= leaf_chars:
        return leaf(tokenizer, text)
    middle = len(text) // 2
    return join(tokenizer, tree(tokenizer, text[:middle], leaf_chars, window), tree(tokenizer, text[middle:], leaf_chars, window), window)


def encode_texts(path: str, texts: list[str | None], leaf_chars: int = LEAF) -> list[np.ndarray]:
    """Ids of each text: texts of one leaf by themselves, longer ones by the tree, null and empty ones as no ids.

    A tokenizer with a normalizer or another first pass has no words that the tree could rely on, so its texts are encoded
    whole, whatever their length."""
    tokenizer = load(path)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
    trees = byte_level(tokenizer)
    whole = [i for i, t in enumerate(texts) if t and (len(t) <= leaf_chars or not trees)]
    ranked = _by_rank(path)
    if ranked is None:
        for i, encoding in zip(whole, tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(encoding.ids, np.int32)
    else:
        for i in whole:
            out[i] = np.array(ranked.encode_ordinary(texts[i]), np.int32)
    for i, t in enumerate(texts):
        if t and len(t) > leaf_chars and trees:
            out[i] = tree(tokenizer, t, leaf_chars).ids
    return out


def _list_array(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _encoder(path: str, leaf_chars: int, counts: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            rows = encode_texts(path, batch.column(at).to_pylist(), leaf_chars)
            value = pa.array([len(r) for r in rows], pa.int64()) if counts else _list_array(rows)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), value], names=[*(batch.schema.names[i] for i in kept), "__out"])

    return encode


#: A part of a long text and its encoding, as :class:`Piece`.
_PIECE = "__row bigint, part bigint, text string, ids array<int>, ends array<bigint>, id_ends array<bigint>"


def _frame(row, part, pieces: list[Piece]) -> pd.DataFrame:
    return pd.DataFrame({
        "__row": row, "part": part, "text": [p.text for p in pieces], "ids": [p.ids for p in pieces], "ends": [p.ends for p in pieces], "id_ends": [p.id_ends for p in pieces],
    })


def _pieces(path: str, leaf_chars: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield _frame(frame["__row"], frame["part"], [tree(load(path), t, leaf_chars) for t in frame["text"]])

    return encode


def _joiner(path: str):
    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        pieces = [Piece(t, np.asarray(i, np.int32), np.asarray(e, np.int64), np.asarray(n, np.int64)) for t, i, e, n in zip(frame["text"], frame["ids"], frame["ends"], frame["id_ends"])]
        return _frame([frame["__row"].iloc[0]], [frame["part"].iloc[0] // 2], [reduce(lambda a, b: join(load(path), a, b), pieces)])

    return joined


def _encoded(documents: DataFrame, kept: Sequence[str], text: str, path: str, counts: bool, leaf_chars: int, segment: int) -> DataFrame:
    """The columns ``kept`` of every row, and ``__out``: its ids, or how many there are."""
    names = [f"c{i}" for i in range(len(kept))]
    rows = documents.select(*(F.col(c).alias(n) for c, n in zip(kept, names)), F.col(text).cast("string").alias("__text"))
    columns = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    encode = _encoder(path, leaf_chars, counts)
    shape = ", ".join([*columns, "__out bigint" if counts else "__out array<int>"])
    if not byte_level(load(path)):
        out = rows.mapInArrow(encode, shape)
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, kept)), "__out")
    # bytes first: few texts have so many that their characters must be counted
    long_ = F.coalesce((F.octet_length("__text") > segment) & (F.char_length("__text") > segment), F.lit(False))
    parts = [rows.where(~long_).mapInArrow(encode, shape)]
    # written before the segments are cut: the row number must not change when a task runs again
    long = materialize(rows.where(long_).withColumn("__row", F.monotonically_increasing_id()), "long-texts")
    longest = long.agg(F.max(F.char_length("__text")).alias("n")).first()["n"]
    if longest:
        size = F.ceil(F.char_length("__text") / segment)
        cut = long.select("__row", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)).alias("part"), "__text")
        cut = cut.select("__row", "part", F.expr(f"substring(__text, cast(part * {segment} + 1 as int), {segment})").alias("text"))
        level = materialize(cut.repartition("__row", "part").mapInPandas(_pieces(path, leaf_chars), _PIECE), "segments")
        for _ in range(int(np.ceil(np.log2(-(-longest // segment))))):
            below, level = level, materialize(level.withColumn("pair", F.floor(F.col("part") / 2)).groupBy("__row", "pair").applyInPandas(_joiner(path), _PIECE), "joined")
            discard(below)
        value = F.size("ids").cast("bigint") if counts else F.col("ids")
        parts.append(long.drop("__text").join(level.select("__row", value.alias("__out")), "__row").select(*names, "__out"))
    return reduce(DataFrame.unionByName, parts).select(*(F.col(n).alias(c) for n, c in zip(names, kept)), "__out")


def encode_documents(
    documents: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS, leaf_chars: int = LEAF, segment: int = SEGMENT  # noqa: A002
) -> DataFrame:
    """``id`` and ``ids`` (array of int) of every row, without special tokens.

    Null and empty texts have no ids (an empty list). Repeated rows and ids are encoded as they come; a null id stays
    null; further columns are ignored, whatever their names; an empty input gives no rows. Texts of more than
    ``segment`` characters are encoded in segments by separate tasks and joined pairwise in log2 rounds. A tokenizer that
    isn't byte-level BPE with the usual first pass (one with a normalizer, say) encodes every text whole.
    """
    return _encoded(documents, [id], text, os.path.join(folder, tokenizer), False, leaf_chars, segment).withColumnRenamed("__out", "ids")


def token_counts(
    documents: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS, keep: Sequence[str] = (),  # noqa: A002
    leaf_chars: int = LEAF, segment: int = SEGMENT,
) -> DataFrame:
    """``id``, the columns ``keep`` and ``tokens``: the number of ids of every row; 0 for null and empty texts. Long texts
    take the same way as in :func:`encode_documents`."""
    return _encoded(documents, [id, *keep], text, os.path.join(folder, tokenizer), True, leaf_chars, segment).withColumnRenamed("__out", "tokens")


@lru_cache(maxsize=4)
def _id_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = load(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in byte_of for c in token):
            out[i] = bytes(byte_of[c] for c in token)
    return out


def decode_documents(encoded: DataFrame, id: str = "doc_id", ids: str = "ids", tokenizer: str = BYTE_BPE, folder: str = TOKENIZERS) -> DataFrame:  # noqa: A002
    """``id`` and ``text``: the inverse of :func:`encode_documents`, but for null texts, which come back empty."""
    path = os.path.join(folder, tokenizer)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(path)
        for batch in batches:
            texts = [b"".join(table[i] for i in row or ()).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(decode, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id)
