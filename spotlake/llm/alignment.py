"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of their ids go together."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import BYTE_LEVEL, Vocabulary, byte_level

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: At most so many id pairs are broadcast: those that hold at least one link in so many.
FREQUENT = 100_000


@functools.cache
def pieces(path: str) -> tuple[Callable[[list[str]], list[np.ndarray]], Vocabulary]:
    """Encoder of a sentence-piece file and its vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)], Vocabulary(found)


def coalesce(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of intervals by start and, in that order, the number of the group of each: a group begins where a start reaches
    the greatest end so far, so groups are the unions of overlapping intervals."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    return order, np.cumsum(np.r_[0, start[order][1:] >= reach[:-1]]) if len(order) else np.zeros(0, np.int64)


def align_batch(texts: list[str], a_path: str, b_path: str, digest: bool) -> dict[str, list]:
    """Columns of align_tokenizers for some texts that are not empty."""
    (encode_a, voc_a), (encode_b, voc_b) = byte_level(a_path), pieces(b_path)
    spaced = [" " + t for t in texts]
    ids = [encode_a(spaced), encode_b(texts)]
    whole = [t.encode() for t in spaced]
    for own, voc in zip(ids, (voc_a, voc_b)):
        joined, at = voc.join(np.concatenate(own)), 0
        for k, one in enumerate(own):
            size = int(voc.length[one].sum())
            if joined[at : at + size] != whole[k]:
                whole[k] = None  # no tokens of either
            at += size
    none = np.zeros(0, np.int64)
    ids = [[none if w is None else one for one, w in zip(own, whole)] for own in ids]
    n_a, n_b = (np.array([len(x) for x in own], np.int64) for own in ids)
    token = [np.concatenate(own) for own in ids]
    end = [np.cumsum(voc.length[t]) for voc, t in zip((voc_a, voc_b), token)]
    start = [e - voc.length[t] for voc, t, e in zip((voc_a, voc_b), token, end)]
    doc = [np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b)]
    # texts follow each other without a gap in both, so no group goes over the end of a text
    order, group = coalesce(np.concatenate(start), np.concatenate(end))
    side = np.repeat([0, 1], [len(token[0]), len(token[1])])[order]
    ids, docs, ends = np.concatenate(token)[order], np.concatenate(doc)[order], np.concatenate(end)[order]
    by = np.argsort(group * 2 + side, kind="stable")
    group, side, ids, docs, ends = group[by], side[by], ids[by], docs[by], ends[by]
    # inside a group only tokens of equal ends are linked: with tokens of one byte at least, the last of each side
    last = np.r_[(group[1:] != group[:-1]) | (side[1:] != side[:-1]), True] if len(by) else np.zeros(0, bool)
    a, b = np.flatnonzero(last & (side == 0)), np.flatnonzero(last & (side == 1))
    if not np.array_equal(ends[a], ends[b]):
        raise AssertionError("groups end together")
    pair = ids[a] << 32 | ids[b]
    first = np.searchsorted(docs, np.arange(len(texts) + 1))
    links = np.searchsorted(docs[a], np.arange(len(texts) + 1))
    mark = np.where(last, np.where(side == 0, 1, 2), 0)
    written = voc_a.written + voc_b.written
    text = list(map(written.__getitem__, (ids * 3 + mark + side * len(voc_a.written)).tolist()))
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(links), "n_links": np.diff(links), "groups": [], "pairs": []}
    for k in range(len(texts)):
        groups = "".join(text[first[k] : first[k + 1]])[:-1]
        out["groups"].append(hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups)
        found, n = np.unique(pair[links[k] : links[k + 1]], return_counts=True)
        out["pairs"].append((found, n))
    return out


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES, digest: bool = False) -> DataFrame:
    """Tokens of two tokenizers for each whole text, the groups of both that cover the same bytes, and their links.

    Returns a row for each row: _row (a key), doc_id, n_a, n_b (tokens), n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, ids
    of either side for each group; with `digest` its SHA-256) and pairs, an array of (pair, n): the pair of ids that ends a
    group, as id of A times 2^32 plus id of B, and how often. A reads a space and the text, B the text, before which it puts
    a space itself. Null and empty texts, and those of which either tokenizer keeps other bytes, have no tokens: zeros,
    empty groups and no pairs. Null and repeated ids are rows like any other. The table is written to the shared folder.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1_000_000):
            texts = batch.column(2).to_pylist()
            full = [k for k, t in enumerate(texts) if t]
            got = align_batch([texts[k] for k in full], a_path, b_path, digest) if full else None
            columns = [batch.column(0), batch.column(1)]
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                n = np.zeros(len(texts), np.int64)
                if full:
                    n[full] = got[name]
                columns.append(pa.array(n))
            groups, lists = [""] * len(texts), [(np.zeros(0, np.int64),) * 2] * len(texts)
            for j, k in enumerate(full):
                groups[k], lists[k] = got["groups"][j], got["pairs"][j]
            offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in lists)]), pa.int32())
            values = pa.StructArray.from_arrays([pa.array(np.concatenate([x[j] for x in lists]), pa.int64()) for j in (0, 1)], ["pair", "n"])
            columns += [pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(work, f"_row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<pair:long,n:long>>")
    return materialize(found, "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many links of all texts a pair of ids is, and whether no other pair of its B id is in more.
    The greatest counts are a row for each id of B, of which a vocabulary has few."""
    counts = materialize(aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.select("pair", "count", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of align_tokenizers with n_best (links whose pair is the most frequent one of its B id) and count_sum (sum of the
    counts of its links' pairs) in place of pairs.

    Pairs that hold at least one of `frequent` links are at most `frequent`, so they are broadcast; links of other pairs are
    shuffled by the pair, of which none has a greater share than that. Sums are exact."""
    counts = materialize(pair_counts(aligned), "pair-bests")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * F.lit(frequent) >= F.lit(total)
    links = aligned.select("_row", F.inline("pairs"))
    known = links.join(F.broadcast(counts.where(often)), "pair", "left")
    sums = lambda df: df.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    rare = known.where("count is null").select("_row", "pair", "n").join(counts.where(~often), "pair")
    both = sums(known.where("count is not null")).unionByName(sums(rare)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs").join(both, "_row", "left").na.fill(0, ["n_best", "count_sum"])
