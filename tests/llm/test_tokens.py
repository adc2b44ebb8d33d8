import os

import pytest

from normgraph.llm import tokens as tk
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary")
TEXTS = [
    "Hello world", "", "  two  blanks ", "a" * 20_000, "ab" * 7001, "aaaaaaa aaa aaaa", "été – naïve’s don't I'LL we've", "<|endoftext|> plain", "\r\n\r\n\t x y z", "तीन शब्द हैं", "委员会审议了第10.5款。", "ก" * 3000, "🏛️⚖️🙂 emoji",
    "12345678 ½ Ⅷ", "x​y", "\U00020bb7", " " * 5000 + "end", "The controller shall notify Reg. (ZU) 2016/117.",
]


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(open(tk.VOCABULARY, "rb").read())


def reference(texts):
    import tiktoken

    ranks = {tk.base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc, [enc.encode_ordinary(t or "") for t in texts]


def test_same_as_the_library(encoder):
    enc, want = reference(TEXTS)
    for _ in range(2):  # new, then remembered
        flat, ends = encoder(TEXTS)
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert [enc.decode(w) for w in want] == TEXTS  # and back


def test_forgetting(encoder):
    small = tk.Encoder(open(tk.VOCABULARY, "rb").read(), keep=3)
    _, want = reference(TEXTS)
    for t, w in zip(TEXTS, want):
        assert small([t])[0].tolist() == w


def test_queue():
    q = tk.RankQueue(50_257)
    for rank, place in ((50_000, 1), (3, 2), (64, 3), (4096, 4), (3, 5)):
        q.push(rank, place)
    assert [q.pop() for _ in range(5)] == [(3, [2, 5]), (64, [3]), (4096, [4]), (50_000, [1]), None]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", [9]), (2, None, [9]), (3, "", [9]), (None, "Hello", None), (1, "Hello world", [9])], "doc_id long, text string, ids array<int>")
    assert rows(tk.token_ids(df)) == sorted([(1, [15496, 995]), (2, []), (3, []), (None, [15496]), (1, [15496, 995])], key=str)
    assert tk.token_ids(df.limit(0)).count() == 0
