"""Token alignment, spelling variants and chat windows against brute force."""

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

tok = pytest.importorskip("public_tokenizers")

from vecspark.llm import chat, spelling, token_align  # noqa: E402

BYTE, PIECE = tok.path("byte_bpe_50k.json"), tok.path("piece_bpe_32k.model")

# --- token alignment --------------------------------------------------------------------------------------------

ODD = ["</s>", "<|endoftext|>", "<unk>", " ", "  ", "\n", "\n\n", "\t", "é", "日本語", "😀", "<0x41>", " ", "▁", "don't", "1234567", "\x00", "x" * 50, "ﬁ", "a  b", "'s", "\r\n"]


def texts():
    rng = random.Random(5)
    some = [None, "", " ", "  ", "\n", "▁", " lead", "trail ", "  two", "　wide", "'s start", " x", "</s>", "word " * 30000]
    some += ["".join(rng.choice(["the ", "quick ", "brown", "fox ", ",", " and", rng.choice(ODD)]) for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    return some + ["the quick brown fox jumps over the lazy dog " * 40] * 30


def aligned_by_hand(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_model.encode_special_tokens = True
    of = {c: b for b, c in token_align.byte_characters().items()}
    per = []
    for i, t in docs:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        a_bytes = [bytes(of[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        raw = f" {t}".encode()
        if not t or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = lambda parts: accumulate(map(len, parts))
        a_end, b_end = dict(zip(ends(a_bytes), a)), dict(zip(ends(b_bytes), b))
        cuts = sorted(a_end.keys() & b_end.keys())
        groups, a_at, b_at = [], sorted(a_end), sorted(b_end)
        for c in cuts:
            own = [[at.pop(0) for _ in range(bisect_right(at, c))] for at in (a_at, b_at)]
            groups.append("|".join(",".join(str(ids[p]) for p in at) for ids, at in zip((a_end, b_end), own)))
        per.append((i, a, b, groups, [(a_end[c], b_end[c]) for c in cuts]))
    count, best = Counter(x for p in per for x in p[4]), {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    digest = lambda g, a: hashlib.sha256(";".join(g).encode()).hexdigest() if a else ""
    return sorted((str(i), len(a), len(b), len(g), len(x), sum(count[k] == best[k[1]] for k in x), sum(count[k] for k in x), digest(g, a)) for i, a, b, g, x in per)


def test_long_rows_are_cut_where_both_tokenizers_cut():
    """Every long text in pieces has the groups and links that it has whole."""
    a, b = token_align.sides(BYTE, PIECE)
    for text in [t for t in texts() if t] + ["x" * 300, "日本 語 " * 50, "a  b \n c\td " * 40, "▁ a" * 50, "ok " * 100 + "▁"]:
        row = np.frombuffer(f" {text}".encode(), np.uint8)
        counts, whole, posted = token_align.aligned(row, np.array([0, len(row)]), a, b)
        token_align.TOGETHER, before = 37, token_align.TOGETHER
        try:
            columns, postings = token_align._long_row(row, a, b)
            pieces = token_align._pieces(row, 37)
        finally:
            token_align.TOGETHER = before
        assert b"".join(p.tobytes() for p in pieces) == row.tobytes() and all(p[0] == 32 for p in pieces)
        assert columns["n_a"] == [counts["n_a"][0]] and columns["n_b"] == [counts["n_b"][0]] and columns["n_links"] == [counts["n_links"][0]]
        assert columns["groups_sha256"] == [hashlib.sha256(whole[0]).hexdigest() if len(whole[0]) else ""]
        total = Counter()
        for x in postings:
            for q, p, _, n in zip(*map(np.ndarray.tolist, x)):
                total[q, p] += n
        assert total == Counter({(q, p): n for q, p, _, n in zip(*map(np.ndarray.tolist, posted))})


@pytest.mark.parametrize("parts,salt", [(1, 1 << 24), (5, 200)])
def test_alignment_equals_brute_force(spark, monkeypatch, parts, salt):
    """Nulls, empty, long and odd texts, repeated rows and ids, hot pairs split over salts, a clashing extra column."""
    monkeypatch.setattr(token_align, "SALT_BYTES", salt)
    docs = [(i % 170 if i % 17 else None, t) for i, t in enumerate(texts())]
    rows = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, bucket int").repartition(parts)
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in token_align.align(rows, BYTE, PIECE).collect())
    assert got == aligned_by_hand(docs)


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align(none, BYTE, PIECE).collect() == []
    blank = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in token_align.align(blank, BYTE, PIECE).collect()} == {(0, 0, 0, 0, 0, 0, "")}


# --- spelling ---------------------------------------------------------------------------------------------------


def spelled_by_hand(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if k >= 2 and len(w) >= 7}
    near, letters = {w: set() for w in n}, set("".join(n))
    for w in n:
        for i in range(len(w) + 1):
            others = [w[:i] + c + w[i:] for c in letters] + ([w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters] if i < len(w) else [])
            for x in others:
                if x != w and x in n:
                    near[w].add(x)
                    near[x].add(w)
    best = {w: min(((-n[x], x) for x in near[w]), default=(0, None)) for w in n}
    form = {w: x if -m >= 10 * n[w] and x else None for w, (m, x) in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.fixture(scope="module")
def misspelled():
    rng = random.Random(3)
    alphabet = "abÉéc"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 10))) for _ in range(60)]

    def changed(w):
        k, i = rng.randrange(4), rng.randrange(len(w))
        return [w, w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:]][k]

    docs = [(i, " ".join(changed(rng.choice(base)) for _ in range(rng.randrange(300))) + rng.choice(["", "ABCDEFGH×÷ß 1x", "Ÿabcdefghi"])) for i in range(150)]
    common = "prefixofathird"  # one prefix holds a third of all words
    docs += [(i, " ".join(common + rng.choice(["", "a", "b", "ab", "ba", "aab", "abc"]) for _ in range(50))) for i in range(20)]
    return docs + [(None, "abcdefghijk abcdefghijk"), (5, None), (6, ""), (7, " ".join(["x" * 200] * 2 + ["x" * 201] * 2 + ["y" + "x" * 200] * 2))]


@pytest.mark.parametrize("range_words", [1 << 15, 60])
def test_spelling_equals_brute_force(spark, misspelled, range_words):
    """One range, and many, where most nodes of the trie are open; equal counts, runs of one letter, null ids."""
    words = spelling.corpus_words(spark.createDataFrame([(*d, "x") for d in misspelled], "doc_id long, text string, word string"))
    got = spelling.spelling_groups(words, range_words=range_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == spelled_by_hand(misspelled)


def test_forms_are_followed_to_the_last(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaaabbc", 1000), ("zzzzzzz", 4)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 1, 10)
    assert got["aaaaabb"] == ("aaaabbb", "aaaabbb", 2, 1000)
    assert got["aaaabbb"] == (None, "aaaabbb", 2, None) and got["zzzzzzz"] == (None, "zzzzzzz", 0, None)


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short short")]):
        assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


# --- chat -------------------------------------------------------------------------------------------------------

MARKS = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>", "<|im_end|>\n<|im_start|>user\nx", "", "  ", "é\\n<s>[/INST]", "[\\INST]", "<<s>", "[[/INST]]"]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "bêta", "gam", rng.choice(MARKS)]) for _ in range(rng.randrange(60)))
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 12) if c else 500):  # one conversation holds most turns
            role = "system" if t == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "tool\nx", "us<s>er\\", "", None])
            rows.append((None if c == 7 else c, t, role, text() if rng.random() < 0.95 else None))
    rows += [(3, 50, "assistant", "long " * 3000), (4, None, "user", "first"), (5, 3, "zz", "same"), (5, 3, "zz", "same"), (0, 0, "system", "be brief")]
    rng.shuffle(rows)
    return rows


def read_by_hand(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(len(chat.write_turn(r[2] or "", r[3] or "")[0]) for r in own)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(own), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), digest(loss), size)
    return out


def unambiguous(rows):
    seen = Counter((r[0], r[1], r[2]) for r in rows)
    return [r for r in rows if seen[r[:3]] == 1 or r[3] == "same"]


@pytest.mark.parametrize("segment,parts", [(1 << 16, 4), (700, 13)])
def test_chat_windows_read_back(spark, turns, segment, parts):
    rows = unambiguous(turns)
    windows = chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int"), BYTE, 256, 64, segment, parts).cache()
    assert {r[0]: tuple(r)[1:] for r in chat.read_back(windows).collect()} == read_by_hand(rows)
    # a window over the budget holds one new turn; history and the system turn come first, and no target twice
    assert windows.where("n_tokens > 256 and n_turns > 1").isEmpty()
    assert not windows.where("n_repeated > 0").isEmpty()
    for r in windows.where("first_turn > 0 and n_repeated > 0").limit(50).collect():
        shown = chat.read_turns(r.text)
        assert len(shown) == r.n_repeated + r.n_turns
        begin = sum(length for _, _, length in shown[: r.n_repeated])
        assert all(x.start >= begin for x in r.loss)
        assert len(r.loss) == sum(role == "assistant" and text != "" for role, text, _ in shown[r.n_repeated :])


def test_system_turn_leads_every_window(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(1, 60)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE, 256, 100, 500).orderBy("first_turn").collect()
    assert len(got) > 10 and [r.first_turn for r in got][1:] == [r.first_turn + r.n_turns for r in got][:-1]
    for r in got:
        shown = chat.read_turns(r.text)
        assert shown[0][:2] == ("system", "be brief") and r.n_tokens <= 256
        numbers = [int(text.split()[1]) for _, text, _ in shown[1:]]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    assert all(r.n_repeated >= 2 for r in got[1:])


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "|im_start|>", "|im_end|>", "x", "\n"]) for _ in range(rng.randrange(12)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
        assert chat.read_turns(chat.write_turn(text, text)[0])[0][:2] == (text, text)


def test_chats_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(none, BYTE)
    assert windows.collect() == [] and chat.read_back(windows).collect() == []
    one = chat.read_back(chat.format_chats(spark.createDataFrame([(9, None, None, None)], none.schema), BYTE)).collect()
    assert len(one) == 1 and one[0].n_turns == 1 and one[0].loss_chars == 0
