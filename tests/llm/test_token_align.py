"""The alignment of two tokenisations against the files' own libraries and sets of bytes."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import token_align
from skeinwork.llm.common import table

SHAPE = "doc_id long, text string, row string, links string"
TEXTS = [None, "", " ", "a", "\n\n\t x", "Hello  world, it's 2024!", "naïve café — 東京の天気 🎉🎉", "▁stands for space", "<|endoftext|> and <s> </s> <0x41>", "a\x00b", " 　wide", "xyzzy" * 4000, "same text", "same text", "é ﬁ ½", "don't DON'T " * 50]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{token_align.FOLDER}/{token_align.BYTE_FILE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{token_align.FOLDER}/{token_align.PIECE_FILE}")


def brute(texts, libraries):
    a, b = libraries
    at = token_align.byte_characters()

    def spans(ids, pieces):
        out, end = [], 0
        for i, p in zip(ids, pieces, strict=True):
            out.append((i, end, end + len(p)))
            end += len(p)
        return out

    docs = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_pieces = [bytes(at[c] for c in a.id_to_token(i)) for i in a_ids]
        b_pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
        if b"".join(a_pieces) != whole or b"".join(b_pieces) != whole:
            docs.append(([], [], [], []))
            continue
        x, y = spans(a_ids, a_pieces), spans(b_ids, b_pieces)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = [(low, high) for low, high in zip([0, *cuts], cuts)]
        links, k = [], 0
        for i, s, e in x:
            while k and y[k - 1][2] > s:
                k -= 1
            while k < len(y) and y[k][1] < e:
                if y[k][2] > s:
                    links.append((i, y[k][0]))
                k += 1
        named = [tuple(",".join(str(i) for i, s, e in z if low <= s < high) for z in (x, y)) for low, high in groups] if len(x) < 3000 else None
        docs.append((x, y, links, named if named is not None else groups))
    held = Counter(p for *_, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for x, y, links, named in docs:
        text = ";".join("|".join(g) for g in named) if named and isinstance(named[0][0], str) else None
        digest = "" if not x else hashlib.sha256(text.encode()).hexdigest() if text else None
        out.append((len(x), len(y), len(named), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return out


def rows_of(df):
    return sorted((r.doc_id is not None, r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[2:8] == w[:6]
        assert w[6] is None or g[8] == w[6]


@pytest.mark.parametrize("bound", [token_align.BROADCAST_PAIRS, 0])
def test_equals_brute_force(spark, libraries, bound):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(TEXTS)], SHAPE)
    same(rows_of(token_align.align(docs, broadcast_pairs=bound)), brute(TEXTS, libraries))


def test_documents_equal_brute_force(spark, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    same(rows_of(token_align.align(docs)), brute([r.text for r in docs.collect()], libraries))


def test_empty_table_and_null_ids(spark):
    assert token_align.align(spark.createDataFrame([], SHAPE)).count() == 0
    found = token_align.align(spark.createDataFrame([(None, "one two", "", ""), (None, "one two", "", ""), (1, None, "", "")], SHAPE)).collect()
    assert sorted((r.doc_id is None, r.n_a > 0, r.count_sum) for r in found) == [(False, False, 0), (True, True, 4), (True, True, 4)]


@pytest.fixture(scope="module")
def byte_tokens():
    with open(f"{token_align.FOLDER}/{token_align.BYTE_FILE}", "rb") as f:
        return token_align.ByteTokens(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_the_byte_vocabulary_encodes_as_its_own_library(libraries, byte_tokens, text):
    assert byte_tokens.encode(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
