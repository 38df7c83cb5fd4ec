"""Conversation trie, token counts and alignment of tokenizers against brute-force versions, and on odd, empty and clashing tables."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import alignment, conversation_trie, token_counts
from panelworks.llm.queries import byte_bpe, piece_model, word_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """The nodes of rebuilt conversations by their paths, node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(rebuilt.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = Counter(), Counter()
    for path, who in members.items():
        gain = (len(who) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += gain
    ends = defaultdict(list)
    for c, ts in sorted(rebuilt.items()):
        ends[ts].append(str(c))
    sha = lambda p: hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()
    out = [(who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(kids[p]) if p in kids else 0, leaves[p], saved[p], sha(p)) for p, who in members.items()]
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_the_whole_table(spark, sf):
    turns = table(spark, sf, "conversations")
    assert as_rows(conversation_trie.conversation_trie(turns).select(COLUMNS)) == brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_deep_and_bushy_conversations(spark):
    """Blocks of 16 turns: paths over many blocks, branches at every depth, copies, whole blocks exactly, one conversation with a third of all rows."""
    rng = random.Random(11)
    rows = []
    trunk = [("user" if k % 2 else "assistant", f"line {k} of the trunk") for k in range(150)]
    for c in range(60):
        cut = rng.choice([0, 3, 7, 8, 15, 16, 17, 31, 32, 33, 48, 64, 100, 128, 150])
        turns = trunk[:cut] + [("user", f"w{rng.randrange(2)} x") for _ in range(rng.choice([0, 0, 1, 2, 9, 20]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(61, k, "user", "again") for k in range(300)]
    rows += [(c, k, *t) for c in (100, 101, 102, 120, 133) for k, t in enumerate(trunk[:64])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS)
    assert as_rows(conversation_trie.conversation_trie(df, block=16).select(COLUMNS)) == brute_trie(rows)


def test_trie_odd(spark):
    """Null ids, turns, roles and texts, repeated rows and turn numbers, turnless conversations, families without a first one."""
    rows = [(None, 0, "user", "no conversation"), (0, None, "user", "b"), (0, None, "user", "a"), (0, 1, None, None), (0, 1, None, None), (1, 0, "", ""), (25, 0, "user", "alone"), (25, 0, "user", "alone"), (26, 5, "user", "x " * 3000)]
    rows += [(c, k, "user", "same") for c in range(40, 60) for k in range(c % 3 + 1)]
    df = spark.createDataFrame(rows, TURNS)
    expected = brute_trie(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in expected)  # rebuilt without a turn
    assert as_rows(conversation_trie.conversation_trie(df).select(COLUMNS)) == expected
    clash = df.select("*", *[F.lit("x").alias(n) for n in ["pos", "part", "name", "depth", "length", "symbol", "up", "words", "h", "base", "got", "n", "row", "a`b"]])
    assert as_rows(conversation_trie.conversation_trie(clash).select(COLUMNS)) == expected
    assert conversation_trie.conversation_trie(df.limit(0)).count() == 0


def test_ends_in_pieces(spark, monkeypatch):
    rows = [(b"a" * 16, c) for c in range(5000)] + [(b"b" * 16, 7)]
    monkeypatch.setattr(conversation_trie, "ENDS", 64)
    got = dict(conversation_trie.end_digests(spark.createDataFrame(rows, "name binary, conv_id long")).collect())
    assert {bytes(k): v for k, v in got.items()} == {b"a" * 16: hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(), b"b" * 16: hashlib.sha256(b"7").hexdigest()}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13, 16])
def test_names_follow_the_prefix_alone(n):
    symbols = [bytes([k]) * 16 for k in range(16)]
    full = conversation_trie.names_below(symbols, b"r" * 16, None)
    assert conversation_trie.names_below(symbols[:n], b"r" * 16, None) == full[: n + 1] and len(set(full)) == 17


# 12


@functools.cache
def fresh():
    """The library's own tokenizer, none of the operator's."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def whole_counts(texts):
    own = fresh()
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def brute_counts(rows):
    return sorted(((i, len((t or "").encode()), n, n > token_counts.LIMIT) for (i, t), n in zip(rows, whole_counts([t for _, t in rows]), strict=True)), key=repr)


ATOMS = ["'s", "'ll", "'", "!", "a", "é", "é", "́", "한", "ᄀ", "ᅡ", "ᆨ", " ", "\n", "  ", "9", "12", "<|endoftext|>", "<|", "|>", "abc", "İ", "Σ", "漢字", "don't", "x" * 30, "🙂", " ", "<|startoftext|>", "Étion,", "ŒUVRE...", "straße's", "Ab'S", "x<|", "WORD%%%", "ǅ"]


def test_every_common_word_end_is_a_place_to_splice():
    own, rng, seen = token_counts.Counter(word_bpe()), random.Random(12), 0
    for _ in range(400):
        text = "".join(rng.choice(ATOMS) + " " * (rng.random() < 0.2) for _ in range(120))
        cut, overlap = len(text) // 2, rng.choice([20, 40, 60])
        _, ends, before = own.window(text[: cut + overlap], False, 2 * overlap)
        left = dict(zip(ends.tolist(), before.tolist()))
        n, ends, before = own.window(text[cut - overlap :], True, 2 * overlap)
        for place, to in zip((ends + cut - overlap).tolist(), before.tolist()):
            if place in left:
                seen += 1
                assert left[place] - to + n == whole_counts([text])[0] == own.counts([text])[0]
    assert seen > 1000


def test_counts_of_the_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    assert as_rows(token_counts.count_tokens(docs, word_bpe())) == brute_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_counts_of_spliced_texts(spark, docs_of, sf):
    """Small chunks, so that nearly every text is cut; words longer than the overlap make it widen, up to the whole text."""
    rng = random.Random(13)
    rows = [(k, "".join(rng.choice(ATOMS) + " " * (rng.random() < 0.3) for _ in range(rng.choice([5, 50, 400, 3000])))) for k in range(60)]
    rows += [(70, "a" * 5000), (71, "ab " * 3000 + "c" * 4000), (72, "é" * 2500 + " x"), (73, None), (None, "one two"), (74, "漢字" * 900), (74, "漢字" * 900)]
    got = token_counts.count_tokens(docs_of(rows), word_bpe(), chunk=200, overlap=40)
    assert as_rows(got) == brute_counts(rows)
    docs = table(spark, sf, "documents").limit(40)
    kept = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(token_counts.count_tokens(docs_of(kept), word_bpe(), chunk=700, overlap=100)) == brute_counts(kept)


def test_counts_odd(odd_docs, empty_docs, clashing):
    expected = brute_counts([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert as_rows(token_counts.count_tokens(odd_docs, word_bpe())) == expected
    assert as_rows(token_counts.count_tokens(clashing, word_bpe())) == expected
    assert token_counts.count_tokens(empty_docs, word_bpe()).count() == 0
    with pytest.raises(ValueError, match="word ends"):
        token_counts.Counter(byte_bpe())


# 13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(byte_bpe()), sentencepiece.SentencePieceProcessor(model_file=piece_model())
    a_model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(text):
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        pieces = [b_model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        full = (" " + text).encode()
        return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == full == b"".join(b_bytes) else ([], [], [], [])

    docs, held = [], Counter()
    for i, text in rows:
        a, a_bytes, b, b_bytes = tokens(text) if text else ([], [], [], [])
        spans = lambda parts: list(zip(np.cumsum([0, *map(len, parts)]).tolist(), np.cumsum(list(map(len, parts))).tolist()))
        sa, sb = spans(a_bytes), spans(b_bytes)
        links, j = [], 0
        for k, (x, y) in enumerate(sa):
            while j and sb[j][0] >= x:
                j -= 1
            while j < len(sb) and sb[j][1] <= x:
                j += 1
            m = j
            while m < len(sb) and sb[m][0] < y:
                links.append((a[k], b[m]))
                m += 1
        ends = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, low = [], 0
        for end in ends:
            left = ",".join(str(t) for t, s in zip(a, sa) if low < s[1] <= end) if len(a) < 2000 else None
            right = ",".join(str(t) for t, s in zip(b, sb) if low < s[1] <= end) if len(a) < 2000 else None
            groups.append(f"{left}|{right}")
            low = end
        held.update(set(links))
        docs.append((i, a, b, ends, links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, ends, links, groups in docs:
        digest = "" if not a else None if len(a) >= 2000 else hashlib.sha256(groups.encode()).hexdigest()
        out.append((i, len(a), len(b), len(ends), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest))
    return out


def same_alignment(got, rows):
    """Equal rows; the groups of texts of 2,000 tokens and more are not spelt out by the brute-force version."""
    expected = brute_alignment(rows)
    key = lambda r: repr(r[:7])
    got, expected = sorted((tuple(r) for r in got.collect()), key=key), sorted(expected, key=key)
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    assert all(g[7] == e[7] or e[7] is None for g, e in zip(got, expected, strict=True))


def test_alignment_of_the_whole_table(spark, sf):
    docs = table(spark, sf, "documents")
    same_alignment(alignment.align_tokenizers(docs, byte_bpe(), piece_model()), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_alignment_in_many_batches(spark, sf, monkeypatch):
    """Small batches, so that counts come from many of them, over several levels of each tree."""
    from panelworks.llm.alignment import align_tokenizers

    monkeypatch.setattr(alignment, "FAN", 2)
    docs = table(spark, sf, "documents").repartition(12)
    same_alignment(align_tokenizers(docs, byte_bpe(), piece_model()), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_alignment_odd(docs_of, odd_docs, empty_docs, clashing):
    align = lambda df: alignment.align_tokenizers(df, byte_bpe(), piece_model())
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    same_alignment(align(odd_docs), rows)
    same_alignment(align(clashing), rows)
    assert align(empty_docs).count() == 0
    texts = ["a▁b", "<|endoftext|> and <s> </s> <unk>", "<0x41>", "\x00", "  two  spaces ", "🙂🙂", "naïve\r\n\ttab", "x" * 300, " ", None, ""]
    same_alignment(align(docs_of(list(enumerate(texts)))), list(enumerate(texts)))
    assert align(docs_of([(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(1 << 31, n, replace=False).astype("<u4")
    hashed = alignment.PerfectHash.build(keys)
    assert sorted(hashed.number(keys).tolist()) == list(range(n))
    again = alignment.PerfectHash.loads(*hashed.dumps())
    assert (again.number(keys) == hashed.number(keys)).all()
    with pytest.raises(ValueError, match="not in the hash"):
        alignment._looked_up(again, np.zeros(n, "<u4") if n else np.zeros(0, "<u4"), np.array([(1 << 31) + 5], "<u4"))
