"""Language-model scores by a hidden Markov model whose states emit words."""

from __future__ import annotations

import secrets as entropy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, lower_words, materialize, slices

#: What states emit: the end (0), each frequent word (1 to their number), and rare words by their last two bytes.
SUFFIXES = 96
SEGMENT = 1024


def tokenize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number of each word, dictionary index of each word, dictionary): words end at ASCII white space, A-Z count
    as a-z, a null text has none."""
    lists = lower_words(texts)
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        owner, ids = owner[ids != empty], ids[ids != empty]
    return owner, ids, coded.dictionary


def suffix_class(word: bytes, frequent: int) -> int:
    return 1 + frequent + zlib.crc32(word[-2:]) % SUFFIXES


@dataclass
class Hmm:
    """start and transition probabilities of states; emission[k, s] is the chance of class k in state s."""

    start: np.ndarray
    move: np.ndarray
    emission: np.ndarray


def first_model(states: int, totals: np.ndarray, seed: int = 11) -> Hmm:
    """States that tend to stay, and emissions drawn around the corpus' class frequencies."""
    rng = np.random.default_rng(seed)
    emission = (totals[:, None] + 1.0) * rng.gamma(1.0, 1.0, (len(totals), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emission / emission.sum(axis=0))


def forward(model: Hmm, seen: np.ndarray, sizes: np.ndarray, counts: bool = False):
    """Natural-log likelihoods of concatenated class sequences, by scaled forward recursion over whole sequences.

    A sequence is cut into segments of SEGMENT steps; the transfer matrix of each segment gives the exact state
    distribution at which the next one starts, so that all segments advance together. With counts: also the expected
    starts, moves and emissions (Baum-Welch).
    """
    s, pieces = len(model.start), -(-sizes // SEGMENT)
    n_seg, ends = int(pieces.sum()), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(n_seg) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - sizes)[owner] + nth * SEGMENT
    length = np.minimum(SEGMENT, ends[owner] - begin)
    by = np.argsort(-length, kind="stable")
    b, n = begin[by], length[by]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if n_seg else 0) + 1), side="right")  # segments of more than t steps

    many = pieces[owner[by]] > 1
    transfer = np.zeros((n_seg, s, s))
    if many.any():
        at = np.flatnonzero(many)
        m = np.broadcast_to(np.eye(s), (len(at), s, s)).copy()
        for t in range(int(n[at[0]])):
            k = np.searchsorted(-n[at], -(t + 1), side="right")
            m[:k] = (m[:k].reshape(-1, s) @ model.move).reshape(k, s, s) * model.emission[seen[b[at[:k]] + t]][:, None, :]
            if t % 16 == 15:
                m[:k] /= m[:k].max(axis=(1, 2), keepdims=True)
        transfer[at] = m / m.max(axis=(1, 2), keepdims=True)
    place = np.empty(n_seg, np.int64)
    place[by] = np.arange(n_seg)
    enter = np.empty((n_seg, s))
    enter[place[nth == 0]] = model.start
    for k in range(1, int(pieces.max(initial=0))):
        now = np.flatnonzero(nth == k)
        x = np.einsum("ni,nij->nj", enter[place[now - 1]], transfer[place[now - 1]])
        enter[place[now]] = x / x.sum(axis=1, keepdims=True)

    logs, alpha = np.zeros(n_seg), enter.copy()
    kept = np.empty((len(seen), s)) if counts else None
    for t, k in enumerate(active):
        x = (alpha[:k] @ model.move) * model.emission[seen[b[:k] + t]]
        c = x.sum(axis=1)
        alpha[:k] = x / c[:, None]
        logs[:k] += np.log(c)
        if counts:
            kept[b[:k] + t] = alpha[:k]
    likelihood = np.bincount(owner[by], weights=logs, minlength=len(sizes))
    if not counts:
        return likelihood

    leave = np.ones((n_seg, s))
    for k in range(int(pieces.max(initial=0)) - 2, -1, -1):
        now = np.flatnonzero((nth == k) & (pieces[owner] > k + 1))
        x = np.einsum("nij,nj->ni", transfer[place[now + 1]], leave[place[now + 1]])
        leave[place[now]] = x / x.sum(axis=1, keepdims=True)
    beta, moves, gamma, starts = leave, np.zeros((s, s)), np.empty((len(seen), s)), np.zeros(s)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        before = kept[b[:k] + t - 1] if t else enter[:k]
        w = model.emission[seen[b[:k] + t]] * beta[:k]
        ahead = (before @ model.move) * w
        norm = ahead.sum(axis=1, keepdims=True)
        gamma[b[:k] + t] = ahead / norm
        moves += before.T @ (w / norm)
        back = w @ model.move.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
        if not t:
            heads = nth[by] == 0
            first = enter[heads] * back[heads]
            starts = (first / first.sum(axis=1, keepdims=True)).sum(axis=0)
    emissions = np.stack([np.bincount(seen, weights=gamma[:, j], minlength=len(model.emission)) for j in range(s)], axis=1)
    return likelihood, starts, moves * model.move, emissions


def train(sequences: DataFrame, totals: np.ndarray, states: int = 4, rounds: int = 4, prior: float = 20.0) -> Hmm:
    """Baum-Welch over all sequences (binary column `classes` of 32-bit numbers).

    Each round, tasks emit the expected counts of what they have seen, a row for each class with a number a state; the
    rows are summed by a shuffle. Every state has `prior` counts more, distributed like `totals`, the corpus' counts of classes.
    """
    model, spark = first_model(states, totals), sequences.sparkSession
    names, share = [f"n{j}" for j in range(states)], totals / max(1.0, totals.sum())

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, total = current.value, np.zeros((1 + states + len(totals), states))
        for seen, sizes, _ in sequence_slices(batches):
            _, starts, moves, emissions = forward(hmm, seen, sizes, counts=True)
            total += np.vstack([starts, moves, emissions])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, j]) for j in range(states))], ["k", *names])

    for _ in range(rounds):
        current = spark.sparkContext.broadcast(model)
        got = sequences.select("classes").mapInArrow(expect, "k long, " + ", ".join(f"{c} double" for c in names))
        got = got.groupBy("k").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        total = np.zeros((1 + states + len(totals), states))
        total[got["k"]] = got[names]
        start, moves, emissions = total[0] + 0.1, total[1 : 1 + states] + 0.1, total[1 + states :] + prior * share[:, None] + 1e-6
        model = Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
    return model


def sequence_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(concatenated classes, lengths, batch) of slices of about half a million tokens; `classes` is the last column."""
    for batch in slices(batches, 4000, 2_000_000):
        raw = batch.column(batch.num_columns - 1)
        if len(batch):
            yield np.frombuffer(b"".join(raw.to_pylist()), np.int32), pc.binary_length(raw).to_numpy() // 4, batch


def frequent_from(counts: DataFrame, head: int, least: int) -> int:
    """The count from which on there are at most `head` words, at least `least`. Found on a histogram of counts."""
    bins = counts.where(F.col("c") >= least).groupBy(F.floor(F.log2(F.col("c").cast("double")) * 64).alias("b")).agg(F.min("c").alias("c"), F.count("*").alias("n")).collect()
    edge, room = 1 << 62, head
    for r in sorted(bins, key=lambda r: -r["b"]):
        room -= r["n"]
        if room < 0:
            break
        edge = r["c"]
    return edge


def score_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, states: int = 4, rounds: int = 4, head: int = 100_000, least: int = 3) -> DataFrame:
    """Score whole texts by a unigram base and by a hidden Markov model, both learnt from all training documents: those whose
    crc32(doc_id as text) mod folds is not held_out (a null id counts as an empty text).

    The model: latent states emit the end, frequent words (the `head` most frequent with `least` occurrences, or as many
    as have clearly more than the rest), and classes of rare words, which in turn emit their words by counts with half a count added, an
    unknown word being one more of its class. score is the log10 probability of the words and the end.

    Counts and emissions of frequent words are sent to every task; the other words of a document are joined
    with the counts by a shuffle, summed up for each document beforehand. A null or empty text is just an end; texts of any
    length are scored whole; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, ids, words = tokenize(batch.column(0))
            n = np.bincount(ids, minlength=len(words))
            have = np.flatnonzero(n)
            tokens = pa.concat_arrays([words.take(pa.array(have)).cast(pa.string()), pa.array([""])])
            yield pa.RecordBatch.from_arrays([tokens, pa.array(np.append(n[have], len(batch)))], ["token", "n"])

    counted = rows.where("not held_out").select("text").mapInArrow(count, "token string, n long")
    counts = materialize(counted.groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    edge = frequent_from(counts.where("token <> ''"), head, least)
    known = counts.where((F.col("c") >= edge) & (F.col("token") != "")).toPandas().sort_values(["c", "token"], ascending=[False, True])
    ends = counts.where("token = ''").select(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_frequent = len(known)
    suffix = (F.crc32(F.substring(F.col("token").cast("binary"), -2, 2)) % SUFFIXES).cast("int")
    per = counts.where((F.col("c") < edge) & (F.col("token") != "")).groupBy(suffix.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    mass, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    mass[per["k"]], kinds[per["k"]] = per["n"], per["v"]
    totals = np.concatenate([[ends], known["c"].to_numpy(float), mass])
    train_tokens, vocabulary = int(totals.sum()), int((ends > 0) + n_frequent + kinds.sum())
    log_class = np.concatenate([np.zeros(1 + n_frequent), np.log10(mass + 0.5 * (kinds + 1))])
    share = docs.sparkSession.sparkContext.broadcast((known["token"].to_numpy(object), known["c"].to_numpy(np.int64)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, c = share.value
        value_set = pa.array(tokens, pa.large_string())
        for batch in slices(batches):
            owner, ids, words = tokenize(batch.column(2))
            at = pc.fill_null(pc.index_in(words, value_set=value_set), -1).to_numpy(zero_copy_only=False)
            tails = pc.binary_slice(words.cast(pa.large_binary()), -2).dictionary_encode()
            kinds = np.array([suffix_class(x, len(tokens)) for x in tails.dictionary.to_pylist()] or [0], np.int32)[tails.indices.to_numpy(zero_copy_only=False)]
            kinds = np.where(at >= 0, at + 1, kinds).astype(np.int32)
            n, docs = np.bincount(owner, minlength=len(batch)), len(batch)
            logs = np.log10(np.append(c, 0) + 0.5)
            known = at[ids] >= 0
            a = np.bincount(owner, weights=np.where(known, logs[at[ids]], 0.0), minlength=docs) + np.log10(ends + 0.5)
            hits = np.bincount(owner[known], minlength=docs) + (ends > 0)
            pair, tf = np.unique(owner[~known] * max(1, len(words)) + ids[~known], return_counts=True)
            who, which = np.divmod(pair, max(1, len(words)))
            offsets = pa.array(np.searchsorted(who, np.arange(docs + 1)).astype(np.int32))
            tail = pa.ListArray.from_arrays(offsets, words.take(pa.array(which)).cast(pa.string()))
            times = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            flat, stops = kinds[ids], np.cumsum(n)
            seqs = pa.array([flat[e - m : e].tobytes() + b"\0\0\0\0" for e, m in zip(stops.tolist(), n.tolist(), strict=True)], pa.binary())
            key = pa.array(entropy.randbits(62) + np.arange(docs, dtype=np.int64))
            out = [key, batch.column(0), batch.column(1), pa.array(n + 1), pa.array(hits.astype(np.int64)), pa.array(a), tail, times, seqs]
            yield pa.RecordBatch.from_arrays(out, ["key", "doc_id", "held_out", "n_tokens", "hits", "a", "tail", "times", "classes"])

    shape = f"key long, doc_id {id_type}, held_out boolean, n_tokens long, hits long, a double, tail array<string>, times array<int>, classes binary"
    found = materialize(rows.mapInArrow(look_up, shape), "lm-rows")
    model = docs.sparkSession.sparkContext.broadcast(train(found.where("not held_out"), totals, states, rounds))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, sizes, batch in sequence_slices(batches):
            owner = np.repeat(np.arange(len(sizes)), sizes)
            value = forward(model.value, seen, sizes) / np.log(10) - np.bincount(owner, weights=log_class[seen], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], [*kept, "hmm"])

    kept = ["key", "doc_id", "held_out", "n_tokens", "hits", "a"]
    scored = found.select(*kept, "classes").mapInArrow(likelihood, f"key long, doc_id {id_type}, held_out boolean, n_tokens long, hits long, a double, hmm double")
    rare = found.select("key", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("key", F.col("t.tail").alias("token"), F.col("t.times").alias("tf"))
    rare = rare.join(counts, "token", "left").groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("ra"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("rn"))
    scored = scored.join(rare, "key", "left")
    rare_words = F.coalesce("ra", F.lit(0.0))
    base = F.col("a") + rare_words - F.col("n_tokens") * F.lit(float(np.log10(train_tokens + 0.5 * (vocabulary + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("rn", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (rare_words + F.col("hmm")).alias("score"))
