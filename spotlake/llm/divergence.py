"""Source divergence audit: how the terms of each source of a language depart from the language and from other sources."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

#: ASCII letters in lower case, bytes of other characters as they are, all else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a task holds before it passes them on.
HELD = 1_000_000
#: Digests of texts that a task remembers.
SEEN = 400_000
COPIES = "lang string, digest binary, source string, n long, text string"
COUNTS = "lang string, term string, docs long, cells array<struct<source:string,count:long>>"


def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to rows of COPIES: a task passes on a text once, and at the end how many more copies of it each
    source has."""
    more: Counter = Counter()
    seen: set[tuple[str, bytes]] = set()

    def rest() -> pa.RecordBatch:
        columns = [[key[k] for key in more] for k in range(3)]
        kinds = [pa.string(), pa.binary(), pa.string()]
        arrays = [*map(pa.array, columns, kinds), pa.array(more.values(), pa.int64()), pa.nulls(len(more), pa.string())]
        more.clear()
        return pa.RecordBatch.from_arrays(arrays, ["lang", "digest", "source", "n", "text"])

    for batch in batches:
        digests, new = [], []
        for i, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            digest = hashlib.sha256(batch.column(2)[i].as_buffer()).digest()
            if (lang, digest) in seen:
                more[lang, digest, source] += 1
            else:
                seen.add((lang, digest))
                digests.append(digest)
                new.append(i)
        if new:
            own = batch if len(new) == len(batch) else batch.take(pa.array(new))
            arrays = [own.column(0), pa.array(digests, pa.binary()), own.column(1), pa.array(np.ones(len(new), np.int64)), own.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "digest", "source", "n", "text"])
        if len(seen) + len(more) > SEEN:
            seen.clear()
            yield rest()
    yield rest()


def collapse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of COPIES, those of equal texts of a language after each other and a row with the text first. A text that fills a
    third of the rows is shuffled once by each task that reads it."""
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text")).mapInArrow(first_copies, COPIES)
    return rows.repartition("lang", "digest").sortWithinPartitions("lang", "digest", F.col("text").isNull())


def texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, Counter]]:
    """From rows of collapse(): language, text and copies in each source of every different text."""
    last, text, copies = None, b"", Counter()
    for batch in batches:
        lang, digest, source, n = (batch.column(k).to_pylist() for k in range(4))
        for i, key in enumerate(zip(lang, digest)):
            if key != last:
                if last:
                    yield last[0], text, copies
                last, text, copies = key, batch.column(4)[i].as_buffer().to_pybytes(), Counter()
            copies[source[i]] += n[i]
    if last:
        yield last[0], text, copies


def weighted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of collapse() to rows of COUNTS: partial sums of documents by language and term, and of occurrences by source. Each
    different text is split into words once and counts as often as it has copies."""
    docs: dict[str, Counter] = defaultdict(Counter)
    count: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, terms in docs.items():
            place = dict(zip(terms, range(len(terms))))
            at = [np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in count[lang].values()]
            times = [np.fromiter(c.values(), np.int64, len(c)) for c in count[lang].values()]
            source = np.repeat(np.arange(len(at)), [len(x) for x in at])
            at, times = np.concatenate(at), np.concatenate(times)
            order = np.argsort(at, kind="stable")
            names = pa.array(list(count[lang]), pa.string()).take(pa.array(source[order]))
            cells = pa.StructArray.from_arrays([names, pa.array(times[order])], ["source", "count"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(len(terms) + 1)), pa.int32()), cells)
            words = pa.array(list(terms), pa.binary()).cast(pa.string())
            whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), words, pa.array(terms.values(), pa.int64()), lists], ["lang", "term", "docs", "cells"])
            for start in range(0, len(whole), 20_000):
                yield whole.slice(start, 20_000)
        docs.clear()
        count.clear()

    for lang, text, copies in texts_once(batches):
        words = text.translate(LETTERS).split()
        if not words:
            continue
        n, own = copies.total(), None
        if n == 1:
            docs[lang].update(set(words))
        else:
            own = Counter(words)
            for term in own:
                docs[lang][term] += n
        for source, n in copies.items():
            mine = count[lang][source]
            entries -= len(mine)
            if own is None:
                mine.update(words)
            else:
                for term, times in own.items():
                    mine[term] += n * times
            entries += len(mine)
        if entries > HELD:
            yield from flush()
            entries = 0
    yield from flush()


def share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), exact; null without terms."""
    whole = lambda c: c.cast("decimal(19,0)")
    above, below = F.lit(scale).cast("decimal(10,0)") * whole(count + 1), F.when(terms > 0, whole(total + terms))
    return F.call_function("div", above, below) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with the sources that have them to sums for pairs of sources, of what the terms that both have add to those of
    sources alone. Blocks of terms are matrices of terms by sources; only cells that are there are combined."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        cells = lists.flatten()
        row = np.repeat(np.arange(len(batch)), np.diff(offsets))
        names = cells.field(0).dictionary_encode()
        source = names.indices.to_numpy(zero_copy_only=False)
        p, none = (cells.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        lang = langs.indices.to_numpy(zero_copy_only=False)[row]
        for one in range(len(langs.dictionary)):
            mine = np.flatnonzero(lang == one)
            present, code = np.unique(source[mine], return_inverse=True)
            width = max(1, 1_000_000 // max(1, len(present)))
            base = np.ones(len(present), np.int64)
            base[code] = none[mine]
            rows, at = np.unique(row[mine], return_inverse=True)
            total = {}
            for start in range(0, len(rows), width):
                part = slice(*np.searchsorted(at, [start, start + width]))
                dense = np.zeros((min(width, len(rows) - start), len(present)), np.int64)
                dense[at[part] - start, code[part]] = p[mine[part]]
                for s in np.unique(code[part]):
                    block = dense[dense[:, s] > 0]
                    own, there = block[:, [s]], block > 0
                    q = np.where(there, block, 1)
                    value = f(own, q) - f(own, base) - f(base[s], q) + f(base[s], base)
                    total[s] = total.get(s, 0) + np.where(there, value, 0).sum(axis=0)
            for s, sums in total.items():
                other = np.flatnonzero((sums != 0) & (np.arange(len(present)) != s))
                named = lambda k: names.dictionary.take(pa.array(present[k]))  # noqa: E731, B023
                columns = [pa.array([langs.dictionary[one].as_py()] * len(other), pa.string()), named(np.full(len(other), s)), named(other), pa.array(sums[other], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def divergence_audit(docs: DataFrame, min_docs: int = 3, top: int = 200, scale: int = 1_000_000_000, **columns: str) -> DataFrame:
    """Scores how far sources of a language lie apart, and which terms set a source off from its language.

    Terms are runs of ASCII letters, of which A-Z count as a-z, and characters outside ASCII; a language keeps those in at
    least min_docs of its documents. Each (lang, source) and each lang gives a kept term the share
    1 + floor(scale * (count + 1) / (N + V)), where N is its number of occurrences of kept terms and V that of kept terms.
    Against a share q a share p has floor((p - q)^2 / q).

    Returns lang, source, part, item, value, rank. Part "pair": item is each other source of the language, value the sum
    over all kept terms. Part "term": item is a kept term that the source has and whose share is above the language's, the
    `top` largest. Ranks go by value downward, then by item.

    Equal texts of a language are one row with the number of copies in each source and are split into terms once. Sums
    over pairs of sources take in only terms that both have; terms of one source alone come from the histogram of its
    shares, and those of neither from their number. Null text, lang and source are ''; a source without terms has N = 0, a
    language without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Other columns are ignored.
    """
    partial = collapse(docs, **columns).mapInArrow(weighted_counts, COUNTS).repartition("lang", "term")
    # dealt by language and term, rows need no further shuffle: a term has a row for each task before, not for each text
    number = F.col("pos") == 0
    each = partial.select("lang", "term", "docs", F.posexplode("cells")).select("lang", "term", F.when(number, F.col("docs")).otherwise(0).alias("docs"), "col.*")
    each = each.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("whole"), F.collect_list(F.struct("source", "count")).alias("cells"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).drop("docs"), "terms")

    names = [F.coalesce(F.col(columns.get(f"{c}_col", c)).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    cells = kept.select("lang", "term", "whole", F.inline("cells"))
    own = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("n_lang"))
    groups = docs.select(*names).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"), scale)), "sources")

    shares = cells.join(small(groups), ["lang", "source"])
    shares = shares.select("lang", "term", "whole", "source", "p0", "v", "n_lang", share(F.col("count"), F.col("n"), F.col("v"), scale).alias("p"))

    together = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells")).select("lang", "cells").where("size(cells) > 1")
    both = together.mapInArrow(shared_terms, "lang string, source string, item string, value long")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(small(other), "lang").where("source <> item")
    from_own = F.sum(F.col("terms") * (excess(F.col("p"), F.col("q0")) - excess(F.col("p0"), F.col("q0"))))
    to_own = F.sum(F.col("terms") * (excess(F.col("q0"), F.col("p")) - excess(F.col("q0"), F.col("p0"))))
    alone = alone.groupBy("lang", "source", "item").agg(from_own.alias("a"), to_own.alias("b"))
    alone = alone.select("lang", F.inline(F.array(F.struct("source", "item", F.col("a").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))))
    neither = groups.join(small(other), "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * excess(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    pairs = neither.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    q = share(F.col("whole"), F.col("n_lang"), F.col("v"), scale)
    terms = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
