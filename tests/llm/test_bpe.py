import base64
from collections import Counter

import pytest

from vitalscope.llm import bpe

from .helpers import LONG, docs_of, empty_docs

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_equals_tiktoken(spark, folder, monkeypatch):
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [
        (-1, None), (-2, ""), (-3, "  a  b\n\n c \n d  e\x1c f \n x  \n y"), (-4, "a" * 3000 + " " + "xyz" * 5000), (-5, LONG[:50_000]),
        (-6, "don't we'll <|endoftext|> 12 ½ ²x"), (-6, " \n "), (-8, "z" * 399 + "1" + "y" * 400 + "2" + "w" * 401), (-7, "日本語テキスト 🎉🎉　x"), (None, "x"), (None, "x"),
    ]
    want = Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    for block, known in ((bpe.BLOCK, bpe.KNOWN), (200, bpe.KNOWN), (200, 30)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "KNOWN", known)
        got = bpe.encode(docs_of(spark, rows), PATH, P.PATTERN).collect()
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(empty_docs(spark), PATH, P.PATTERN, digests=True).collect() == []


def test_tokens_that_occur_in_words_and_their_last_pairs():
    tokens = bpe.load_ranks(PATH)
    merges = bpe.Merges(tokens)
    assert merges.ordered
    assert all((pair is None) == (len(t) < 2) or tokens[pair[0]] + tokens[pair[1]] == t for t, pair in zip(tokens, merges.pairs) if t)
    words = [b" ofontionndhe", b"", "日本語".encode(), b"aaaaaa", b" ofontion", bytes(range(256))]
    occurring = bpe.Occurring(merges.edges, merges.ends)
    made, each = occurring(bpe.np.frombuffer(b"".join(words), bpe.np.uint8), bpe.np.array([len(w) for w in words]))
    cuts = bpe.np.cumsum(each)[:-1]
    for word, got in zip(words, bpe.np.split(made, cuts)):
        assert got.tolist() == [i for i, t in enumerate(tokens) if len(t) > 1 and t in word and merges.pairs[i]]


def test_rank_file_whose_tokens_come_before_their_parts(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 290, b"bc": 300, b"cd": 295, b"aa": 60_000, b"zy": 310, b"xzyx": 305}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ranks.items()))
    assert not bpe.Merges(bpe.load_ranks(str(path))).ordered
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["abcd abcabcd aaaabc", "bcdabcaa é aaaaa cdcdbc", "xzyxzyx", ""]
    got = bpe.encode(docs_of(spark, list(enumerate(texts))), str(path), P.PATTERN).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}
    assert all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in got)
