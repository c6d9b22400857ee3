"""Token alignment against a scan of both tokenizers' ends."""

import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from chronoframe.llm import align
from chronoframe.llm.align import VOCABULARIES, Pair, align_tokens, aligned, common_ends, count_links, describe_links, links, op11_token_alignment
from chronoframe.llm.common import table

ODD = ["", "a", " ", "  x  y", "\t\n x", "漢字😀é" * 40, "<|endoftext|> <s> </s> <unk> <0x41>", "▁a", "a\0b", "ﬁ ½ ｆｕｌｌ", "a" * 5000, " " * 3000, "=-" * 4000, "word " * 3000, "‍́\U0001f9d1"]


@pytest.fixture(scope="module")
def pair():
    return Pair.of(f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model")


@cache
def libraries(json_file, piece_file):
    import sentencepiece
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(json_file.decode())
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_proto=piece_file)


def scanned(text, pair):
    """Groups of both token lists, found by walking over all bytes; None without tokens. The JSON file's own library encodes A."""
    if not text:
        return None
    own, model = libraries(pair.json_file, pair.piece_file)
    a, b = own.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    va, vb = pair.loaded()
    spell_a, spell_b = [va.spelled[i] for i in a], [vb.spelled[i] for i in b]
    if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
        return None
    owner = lambda spelled: [k for k, s in enumerate(spelled) for _ in s]
    in_a, in_b = owner(spell_a), owner(spell_b)
    found, start_a, start_b = [], 0, 0
    for i in range(len(in_a)):
        last = i + 1 == len(in_a)
        if last or (in_a[i] != in_a[i + 1] and in_b[i] != in_b[i + 1]):
            found.append((a[start_a : in_a[i] + 1], b[start_b : in_b[i] + 1]))
            start_a, start_b = in_a[i] + 1, in_b[i] + 1
    return found


def described(texts, pair):
    """The contract's columns by plain counting."""
    every = [scanned(t, pair) for t in texts]
    often = [Counter((x, y) for p, q in groups or () for x in p for y in q) for groups in every]
    n = Counter(k for c in often for k in c)
    best = {}
    for (x, _), k in n.items():
        best[x] = max(best.get(x, 0), k)
    out = []
    for groups, c in zip(every, often, strict=True):
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups or ())
        out.append((
            sum(len(p) for p, _ in groups or ()), sum(len(q) for _, q in groups or ()), len(groups or ()), sum(c.values()),
            sum(k for p, k in c.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in c.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_ranks_and_the_file_encode_alike(pair):
    """All characters, in several neighbourhoods: the ranks' library is used for the file's."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(pair.json_file.decode())
    va, _ = pair.loaded()
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for k in range(0, len(codes), 4000):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)} {chr(c)}b" for c in codes[k : k + 4000]]
        assert [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)] == va.encode(texts)


def test_common_ends_of_random_tokens():
    rng = np.random.default_rng(3)
    for dense in (0.02, 0.3, 0.9):
        parts_a, parts_b, n_a, at = [], [], [], 0
        for _ in range(40):
            size = int(rng.integers(1, 400))
            ends_a, ends_b = ({*rng.choice(size, int(size * dense) or 1, replace=False).tolist(), size - 1} for _ in "ab")
            parts_a.append(np.sort(list(ends_a)) + at + 1)
            parts_b.append(np.sort(list(ends_b)) + at + 1)
            n_a.append(len(ends_a))
            at += size
        a, b = np.concatenate(parts_a), np.concatenate(parts_b)
        assert np.array_equal(common_ends(a, b, np.array(n_a)), np.isin(a, b))


def test_links_in_steps_and_of_large_groups():
    rng = np.random.default_rng(4)
    n_a, n_b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    text = np.sort(rng.integers(0, 5, 60))
    a, b = rng.integers(0, 20, n_a.sum()), rng.integers(0, 20, n_b.sum())
    wanted, i, j = Counter(), 0, 0
    for t, p, q in zip(text, n_a, n_b, strict=True):
        wanted.update((int(t) << 40 | int(x) << 20 | int(y)) for x in a[i : i + p] for y in b[j : j + q])
        i, j = i + p, j + q
    for step, large in ((1 << 22, 1 << 16), (7, 1 << 16), (1, 1 << 16), (50, 12), (1 << 22, 0)):
        keys, times = links(a, b, n_a, n_b, text, 20, step, large)
        assert keys.tolist() == sorted(wanted)
        assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == wanted


def test_a_tampered_spelling_has_no_tokens(pair):
    """Equal lengths are not enough: the bytes have to be those of the text."""
    _, vb = pair.loaded()
    ids, n = vb.ids(["some words", "other words", ""])
    data = [b" some words", b" other words", b""]
    assert vb.spells(ids, n, data).tolist()[:2] == [True, True]
    assert vb.spells(ids, n, [b" some words", b" other wordz", b""]).tolist()[:2] == [True, False]
    assert vb.spells(ids, n, [b" some wordz", b" other words!", b""]).tolist()[:2] == [False, False]


@pytest.mark.parametrize("most_pairs", [4_000_000, 10])
def test_query_against_a_scan(spark, pair, most_pairs, monkeypatch):
    """Sent to every task, and joined: the same columns; repeated rows, null keys and texts, and a clashing column."""
    monkeypatch.setattr(align, "GROUP_BYTES", 20_000)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(60).collect()] + ODD + [None, "same", "same"]
    rows = [(None if k == 3 else k, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    found = align_tokens(docs, pair).cache()
    out = describe_links(found, count_links(found, pair.bits, 1000), pair.bits, most_pairs).collect()
    wanted = described(texts, pair)
    assert Counter((r._key, *(r[c] for c in COLUMNS)) for r in out) == Counter((None if k == 3 else k, *w) for k, w in enumerate(wanted))


def test_groups_are_given_on_demand(spark, pair):
    docs = spark.createDataFrame([(1, "Hello worlds of tokens"), (2, "")], "doc_id long, text string")
    got = {r._key: r for r in align_tokens(docs, pair, with_groups=True).collect()}
    wanted = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in scanned("Hello worlds of tokens", pair))
    assert got[1].groups == wanted and got[1].groups_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
    assert got[2].groups == "" and got[2].groups_sha256 == ""
    assert align_tokens(docs.limit(0), pair).count() == 0


def test_a_long_group_without_common_ends(pair):
    """A text in one group: its distinct pairs are counted, not its occurrences one by one."""
    va, vb = pair.loaded()
    speller = align.Speller(len(va.spelled), len(vb.spelled))
    for text in ("a" * 30_000, "ab" * 20_000, "क्" * 9000):
        (got,), groups = aligned([text], va, vb, speller), scanned(text, pair)
        assert (got.n_groups, got.n_links) == (len(groups), sum(len(p) * len(q) for p, q in groups))


def test_registered_query(spark):
    texts = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    pair = Pair.of(f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model")
    out = {r.doc_id: r for r in op11_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    for r, w in zip(texts, described([r.text for r in texts], pair), strict=True):
        assert tuple(out[r.doc_id][c] for c in COLUMNS) == w
