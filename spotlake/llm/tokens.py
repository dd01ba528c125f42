"""Token counts: an exact histogram of encoded lengths that answers every context limit."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Fixed value of the vocabulary: splits a text before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points on which the quicker encoder is tried against the file's own; texts of others take the latter. So do texts
#: of more than LONG characters, as a long run of white space overflows the quicker one's stack.
TRIED = [*range(0x800), *range(0x2000, 0x2070), *range(0x3040, 0x3100), *range(0x4E00, 0xA000)]
LONG = 100_000


class Vocabulary:
    """The bytes of each id, one after the other, and its decimal number followed by each of the marks that may come after it."""

    def __init__(self, tokens: list[bytes]):
        if b"" in tokens:
            raise ValueError("a token without bytes cannot be aligned")
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.written = [f"{i}{mark}" for i in range(len(tokens)) for mark in ",|;"]

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        return self.bytes[np.repeat(self.first[ids] - end + length, length) + np.arange(length.sum())].tobytes()


@functools.cache
def byte_level(path: str) -> tuple[Callable[[list[str]], list[np.ndarray]], Vocabulary]:
    """Encoder of a byte-level BPE file and its vocabulary. A byte's stand-in is itself if it is printable Latin-1, else the
    next free character from 256 on. Byte pairs are merged by the same ranks in tiktoken, which is some four times quicker;
    texts take it if all their characters are among those for which both encoders were found to part words alike."""
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {token.content for token in model.get_added_tokens_decoder().values()}
    ranks = {bytes(stand_in[c] for c in token): i for token, i in model.get_vocab().items() if token not in special}
    found = [b" "] * model.get_vocab_size()  # an id of no plain token never comes
    for token, i in ranks.items():
        found[i] = token
    quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    trials = ["a{0}a 1{0}1 .{0}. {0}\n{0}  {0}".format(chr(c)) for c in TRIED]
    alike = "".join(t[1] for t, ids in zip(trials, slow(trials)) if ids == quick(t))
    other = re.compile(f"[^{re.escape(alike)}]")

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = [None if len(t) > LONG or other.search(t) else np.array(quick(t), np.int64) for t in texts]
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = np.array(slow([texts[k]])[0], np.int64)
        return out

    return encode, Vocabulary(found)


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_LEVEL) -> DataFrame:
    """(doc_id, n_tokens): the number of tokens of each whole text by a byte-level BPE file; null and empty texts have 0. One row per
    row. A task holds a slice of its texts at a time, at most some 4 MB or one text; runs of millions of blanks are no harm."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = byte_level(vocabulary)
        for batch in slices(batches, size=4_000_000):
            n = [len(ids) for ids in encode([text or "" for text in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).schema)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with suffix sums; row L answers the context limit L.

    Returns n_tokens, docs (of that length), docs_at_least and tokens_at_least (suffix sums from L on), docs_at_most,
    truncated_total (tokens left when each document is cut to L), quantile (share of documents of at most L tokens),
    total_docs, total_tokens. The running sums go over distinct lengths, of which there are no more than the longest
    document has tokens. Null lengths are ignored; an empty table gives no rows.
    """
    counts = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))
    onward = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select("n_tokens", "docs", F.sum("docs").over(onward).alias("docs_at_least"), F.sum(F.col("docs") * F.col("n_tokens")).over(onward).alias("tokens_at_least"))
    whole = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.withColumn("total_docs", F.sum("docs").over(whole)).withColumn("total_tokens", F.sum(F.col("docs") * F.col("n_tokens")).over(whole))
    at_most = F.col("total_docs") - F.col("docs_at_least") + F.col("docs")
    kept = F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return sums.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"), kept.alias("truncated_total"), (at_most / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total) for any limits, whether or not a document has that length."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    kept = F.sum(F.least("n_tokens", "context_limit") * F.col("docs"))
    return F.broadcast(asked).join(histogram).groupBy("context_limit").agg(kept.alias("truncated_total"))


def quantile_lengths(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of the documents does not exceed."""
    asked = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return F.broadcast(asked).join(histogram, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
