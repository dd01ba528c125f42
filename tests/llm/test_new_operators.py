"""Divergence of sources, alignment of tokenizers and chat formatting against brute force, and their results for odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("spotlake.llm")

from spotlake.llm import alignment, chat, divergence, queries, tokens  # noqa: E402

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_divergence(docs, min_docs, top):
    rows = [(lang or "", source or "", LETTER.findall(lower(text))) for text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        seen = Counter(w for r in mine for w in set(r[2]))
        kept = {w for w, n in seen.items() if n >= min_docs}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) * (p - q) // q
        for s in count:
            pairs = [(t, sum(f(share(count[s], w), share(count[t], w)) for w in kept)) for t in count if t != s]
            terms = [(w, f(share(count[s], w), share(whole, w))) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            order = lambda x: sorted(x, key=lambda v: (-v[1], v[0].encode()))
            out += [(lang, s, "pair", t, v, k) for k, (t, v) in enumerate(order(pairs), 1)]
            out += [(lang, s, "term", t, v, k) for k, (t, v) in enumerate(order(terms)[:top], 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["Ab", "c", "é", "É", "d1e", "ff", "ﬁ", "Z", "g'h", "ı"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    docs = [(" ".join(rng.choice(words[: rng.choice([3, 12, 50])]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice("xyz")) for _ in range(120)]
    docs += [docs[5]] * 40 + [(docs[5][0], docs[5][1], "copy")] * 7 + [(None, "en", None), ("", "fr", "only"), ("", "fr", "two"), ("rare words", "it", "a"), (None, None, None), ("x " * 70_000 + "Q", "en", "x")]
    table = spark.createDataFrame([(*d, "n", 1) for d in docs], "text string, lang string, source string, term string, n long")
    for top in (4, 200):
        got = sorted(map(tuple, divergence.divergence_audit(table, top=top).collect()))
        assert got == brute_divergence(docs, 3, top)
    once = list(divergence.texts_once(divergence.collapse(table).toArrow().to_batches()))
    assert sorted((lang, text.decode(), sorted(n.items())) for lang, text, n in once) == sorted(
        (lang, text, sorted(Counter(d[2] or "" for d in docs if (d[1] or "", d[0] or "") == (lang, text)).items())) for lang, text in {(d[1] or "", d[0] or "") for d in docs}
    )
    assert divergence.divergence_audit(table.where("false")).count() == 0


def test_partial_counts_are_passed_on(spark, monkeypatch):
    rows = spark.createDataFrame([("a b a", "en", "s"), ("b c", "en", "t")] * 9 + [("c d", "en", "s")], "text string, lang string, source string")
    batches = lambda: iter(divergence.collapse(rows).toArrow().to_batches())
    def total():
        found = Counter()
        for b in divergence.weighted_counts(batches()):
            for r in b.to_pylist():
                found[r["lang"], r["term"]] += r["docs"]
                found.update({(r["lang"], r["term"], c["source"]): c["count"] for c in r["cells"]})
        return found

    whole = total()
    monkeypatch.setattr(divergence, "HELD", 1)
    monkeypatch.setattr(divergence, "SEEN", 1)
    assert total() == whole and whole["en", "a", "s"] == 18 and whole["en", "a"] == 9
    repeated = [pa.RecordBatch.from_pylist([{"lang": "en", "source": s, "text": "a"}] * 3) for s in "sst"]
    assert sum(sum(b.column("n").to_pylist()) for b in divergence.first_copies(iter(repeated))) == 9


def brute_alignment(texts):
    """By dictionaries of offsets, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(alignment.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    from tokenizers.pre_tokenizers import ByteLevel

    plain = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes([k]).decode("latin-1"))[0][0][-1]: k for k in range(128)}
    out, count = [], Counter()
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(piece, ib)) != whole:
            out.append((0, 0, "", []))
            continue
        at, ends_a = 0, []
        for i in ia:
            shown = a.id_to_token(i)
            at += sum(1 for _ in shown)  # a character stands for a byte
            assert all(plain[c] == whole[at - len(shown) + k] for k, c in enumerate(shown) if c in plain)
            ends_a.append(at)
        assert at == len(whole)
        ends_b, at = [], 0
        for i in ib:
            at += len(piece(i))
            ends_b.append(at)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut)  # noqa: E731, B023
            groups.append(f"{inside(ia, ends_a)}|{inside(ib, ends_b)}")
            low = cut
        links = [(i, j) for i, x in zip(ia, ends_a) for j, y in zip(ib, ends_b) if x == y]
        count.update(links)
        out.append((len(ia), len(ib), ";".join(groups), links))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(na, nb, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), g) for na, nb, g, links in out]


TEXTS = [
    "The cat sat on the mat.", "the the the  the", None, "", " ", "é ü 漢字 🙂", "a\tb\n\nc", "▁x", "<|endoftext|> hi <s></s>", "The cat sat on the mat.", "x" * 500, " " * 3000, "In nicht ü einachie lichütz.",
    "the cat, the Mat; the hat 12345 \x00 <0x41>", "it\u2019s \u0660\u00b2 a\u00a0b \u3000 \u05d0\u0301 I'LL we'll \u0ba4\u0bae \U0001d7d8x",
]


def test_alignment_equals_brute_force(spark):
    want = brute_alignment(TEXTS)
    rows = spark.createDataFrame([(k % 12 if k else None, t, 1, "p") for k, t in enumerate(TEXTS)], "doc_id long, text string, _group int, pair string").repartition(3)
    aligned = alignment.align_tokenizers(rows)
    for frequent in (alignment.FREQUENT, 20, 1):  # all, some and hardly any pairs are broadcast
        got = alignment.score_links(aligned, frequent).collect()
        found = Counter((r.doc_id, r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum, r.groups) for r in got)
        assert found == Counter((k % 12 if k else None, *w) for k, w in enumerate(want))
        assert all(r.n_groups == r.n_links for r in got)
    assert want[7][0] == 0 and want[8][0] > 0 and want[1][4] > 0
    digests = {r.groups for r in alignment.align_tokenizers(rows, digest=True).collect()}
    assert digests == {hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want}
    assert alignment.score_links(alignment.align_tokenizers(rows.where("false"))).count() == 0


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(alignment.BYTE_LEVEL)
    model.encode_special_tokens = True
    encode, _ = alignment.byte_level(alignment.BYTE_LEVEL)
    rng = random.Random(2)
    some = [chr(c) for c in tokens.TRIED] + [*" \n\t'dlm1A."] * 900 + ["\ua7f1", "\U0001f600", "<|endoftext|>"] * 30
    texts = [" " + "".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [x.tolist() for x in encode(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_very_long_texts(spark):
    rows = spark.createDataFrame([(1, " " * 5_000_000), (2, "\n" * 3_000_000), (3, "word " * 300_000), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_lengths(rows).collect()}
    assert got[1] == 5_000_000 and got[2] == 1_500_000 and got[3] == 300_001 and got[4] == got[5] == 0


def test_alignment_of_very_long_texts(spark):
    rows = spark.createDataFrame([(1, " " * 2_000_000), (2, "\n" * 300_000), (3, "word " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.align_tokenizers(rows, digest=True).collect()}
    assert got[1].n_a == 2_000_001 and got[3].n_links >= 200_000 and got[2].n_a > 0


def render_plain(turns):
    return "".join(f"[{role}]{text}\n" for role, text in turns)


def render_with_ends(turns):
    return "<s>" + "".join(f"[{role}]{text}\n" for role, text in turns) + "</s>"


def render_rewriting(turns):
    return "".join(f"[{role}]{'...' if k < len(turns) - 2 else text}\n" for k, (role, text) in enumerate(turns))


def render_counting(turns):
    return "".join(f"[{k}{role}]{text}\n" for k, (role, text) in enumerate(turns))


@pytest.mark.parametrize("render", [render_plain, render_with_ends, chat.marked_turns])
@pytest.mark.parametrize("window", [1, 3, 24])
def test_pieces_make_up_the_whole_conversation(render, window):
    rng = random.Random(window)
    for n in (1, 2, 3, 7, 30):
        turns = [(rng.choice(["user", "assistant", "a]b\\", ""]), rng.choice(["", "hi", "[user]", "</s>", "<|im_end|>", "<\\|x", "\n", "é" * 9])) for _ in range(n)]
        pieces = list(chat.conversation_pieces(iter(turns), render, window, 2, "assistant"))
        assert "".join(p["formatted"] for p in pieces) == render(turns)
        assert [p["offset"] for p in pieces] == [sum(len(q["formatted"]) for q in pieces[:k]) for k in range(len(pieces))]
        texts = [chat.unescape(p["formatted"][t["text_start"] : t["text_end"]]) for p in pieces for t in p["turns"]]
        if render is not render_with_ends or not any("</s>" in t for _, t in turns):
            assert not any(p["rewrites"] for p in pieces)
        if render is chat.marked_turns:
            assert texts == [t for _, t in turns]
        assert sum(len(p["turns"]) for p in pieces) == n


def test_rewritten_history_is_told():
    turns = [("user", f"text {k}") for k in range(40)]
    assert any(p["rewrites"] for p in chat.conversation_pieces(iter(turns), render_rewriting, 24, 2, "user"))
    assert any(p["rewrites"] for p in chat.conversation_pieces(iter(turns), render_counting, 24, 2, "user"))
    assert not any(p["rewrites"] for p in chat.conversation_pieces(iter(turns[:20]), render_counting, 24, 2, "user"))
    lost = next(chat.conversation_pieces(iter([("user", "x"), ("tool", "y")]), lambda ts: "".join(f"[{r}]{t if r == 'user' else ''}" for r, t in ts), 24, 2, "tool"))
    assert [t["text_start"] for t in lost["turns"]] == [6, -1] and not lost["turns"][1]["loss"]


def test_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "a", "<|im_end|>", "\n"]) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.read_role(chat.marked_turns([(text, "")]).removesuffix(chat.END + "\n")) == text


def test_chat_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, "a\nb"]), rng.choice([None, "", "<|im_start|>", "\\", "hi\nthere", "x" * 50])) for _ in range(60)]
    rows += [(9, k, "assistant" if k % 2 else "user", f"t{k} " + "y" * (200_000 if k == 30 else 3)) for k in range(120)] + [rows[0]] * 3
    table = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, piece string, offset int")
    want = {}
    for key in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(role or "", text or "") for _, role, text in turns]
        learnt = "".join(t for r, t in turns if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[key] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(chat.marked_turns(turns)))
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(table)).collect()} == want
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


def test_planted_conversation_is_escaped(spark):
    got = {r.conv_id: r for r in queries.op13_chat(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert len(got) == rows.select("conv_id").distinct().count() + 1
    assert sum(r.loss_chars for r in got.values()) == rows.where("role = 'assistant'").agg(F.sum(F.length("text"))).first()[0] + got[-1].loss_chars
